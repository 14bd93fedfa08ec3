"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with single spaces for all else; n-grams of one to three of these characters are hashed
into a fixed number of buckets. Fitting counts buckets by language on all labelled rows, summed by Spark; the log-probability matrix, languages x buckets, is broadcast. Scoring counts the
buckets of each text, batch by batch in numpy and over the whole text, and multiplies these sparse counts with the matrix.

Defined results: a null text, or one without a letter, is 'und' with score 0; so is every text if nothing was learned.
Equal posteriors go to the language that sorts first. The score is the posterior probability of the answer.
Rows are judged one by one, so repeated rows, ties and order do not matter; other columns are not touched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import codepoints, mixed, pieces, segment_sums

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Positions that are counted at a time: bounds the memory of a worker, whatever a text's length and the number of languages.
BLOCK = 1 << 17
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """Log probabilities by language and bucket; 'prior' is each language's log share of the labelled texts."""

    languages: tuple[str, ...]
    log_probability: np.ndarray
    prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Lower case of each letter of the basic plane; a space for whatever is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with single spaces between words, and the texts' offsets in them."""
    table = _letters()
    out = table[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        out[points == c] = c if unicodedata.category(chr(c))[0] == "L" else 32
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    at = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return out[keep], at[offsets]


def ngrams(points: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n characters from each position; the last n - 1 positions have none."""
    x = points.astype(np.uint64)
    h = np.full(max(0, len(x) - n + 1), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(h)]
    return (mixed(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def learnt(doc_id: Column) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1; a null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(True))


def fit(labelled: DataFrame, text: str, lang: str, doc_id: str, most_languages: int = 200) -> Model:
    """Learn from every labelled text; more than most_languages labels are an error."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counted = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(most_languages + 1).collect()}
    if len(counted) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counted:
        return Model((), np.zeros((0, BUCKETS)), np.zeros(0))
    texts = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch, data, offsets in pieces(batches, "text"):
            points, at = letters(*codepoints(data, offsets))
            names = batch.column(0).to_pylist()
            own = {name: k for k, name in enumerate(dict.fromkeys(names))}
            of = np.array([own[name] for name in names], np.int64)
            sums = np.zeros(len(own) * BUCKETS, np.int64)
            for text, bucket in _places(points, at):
                sums += np.bincount(of[text] * BUCKETS + bucket, minlength=len(sums))
            for name, k in own.items():
                found[name] = found.get(name, 0) + sums[k * BUCKETS : (k + 1) * BUCKETS]
        for name, to in found.items():
            full = np.flatnonzero(to)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(to[full])], names=["lang", "bucket", "n"])

    sums = texts.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counted))
    counts = np.full((len(languages), BUCKETS), 0.5)
    if len(sums):
        counts[pd.Index(languages).get_indexer(sums.lang), sums.bucket.to_numpy()] += sums.n.to_numpy()
    total = np.array([counted[x] for x in languages], float)
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), np.log(total / total.sum()))


def _places(points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and bucket of each n-gram, for BLOCK positions at a time; a text may go over several blocks."""
    for a in range(0, len(points), BLOCK):
        b = min(a + BLOCK, len(points))
        texts, buckets = [], []
        for n in ORDERS:
            h = ngrams(points[a : b + n - 1], n)
            place = np.arange(a, a + len(h))
            text = np.searchsorted(at, place, "right") - 1
            whole = place + n <= at[text + 1]  # an n-gram doesn't cross the end of its text
            texts.append(text[whole])
            buckets.append(h[whole])
        yield np.concatenate(texts), np.concatenate(buckets)


def _counted(points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse counts of the texts' n-grams as (text, bucket, times), block by block."""
    for text, bucket in _places(points, at):
        code, times = np.unique(text * BUCKETS + bucket, return_counts=True)
        yield code // BUCKETS, code % BUCKETS, times


def _judge(points: np.ndarray, at: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its best language, that language's posterior, and whether it has a letter."""
    scores = np.tile(model.prior, (len(at) - 1, 1))
    lettered = segment_sums((points != 32).astype(np.int64), at) > 0
    for text, bucket, times in _counted(points, at):
        if len(text):
            low = text[0]
            for k, row in enumerate(model.log_probability):
                sums = np.bincount(text - low, times * row[bucket].astype(np.float64))
                scores[low : low + len(sums), k] += sums
    best = scores.argmax(axis=1)
    posterior = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
    return best, posterior, lettered


def predict(df: DataFrame, text: str, model: Model, keep: tuple[str, ...], lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns `keep` of df with the predicted language and its score; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x buckets floats: at most most_languages x 128 kB
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNDETERMINED])
        for batch, data, offsets in pieces(batches, "__text"):
            points, at = letters(*codepoints(data, offsets))
            if model.languages:
                best, posterior, known = _judge(points, at, model)
            else:
                best, posterior, known = np.zeros(len(at) - 1, int), np.zeros(len(at) - 1), np.zeros(len(at) - 1, bool)
            answer = names.take(pa.array(np.where(known, best, len(model.languages))))
            # `keep` may name the text too, so columns go by position
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], answer, pa.array(np.where(known, posterior, 0.0))], names=[*keep, lang_pred, score])

    return source.mapInArrow(judge, schema)
