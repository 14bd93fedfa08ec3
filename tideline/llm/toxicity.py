"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased; each word, with a border on either side, gives its character n-grams of three to five, hashed to rows of an embedding
table. The mean of a text's distinct rows goes through a linear softmax of two classes; rows and weights are trained together by Adagrad. A
misspelling that was never seen shares most n-grams, and so most of its vectors, with what was. Since the mean and the
layer are both linear, a row adds one number to the log odds; scoring adds those over the whole text.

Training uses a bounded sample, about `positives` and `negatives` labelled texts drawn by a hash of the id, whatever their length (a text has at most BUCKETS distinct rows); the sample's class
shares are corrected to those of all labelled rows. Scoring has no bound and no shuffle.

Defined results: null and empty texts, and texts without letters, have the score of the bias alone. Without labels of both
classes each score is the share of class 1 among the labels, or 0 without any. Rows with a null label are not learnt from; of repeated labels of
an id the largest counts. Rows are scored one by one, so repeated rows and ties do not matter; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import codepoints, mixed, pieces
from tideline.llm.language_id import letters

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
DIMENSION = 8
#: n-grams with a zero vector that every text has besides its own, so that a text of few n-grams is not judged by chance.
DAMPING = 50


@dataclass(frozen=True)
class Model:
    embedding: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds_by_row(self) -> np.ndarray:
        return (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def subwords(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the start of every n-gram that holds a border at its ends only, and its bucket.

    A border stands before each text, so that text k starts at offsets[k] + k.
    """
    x = np.append(np.insert(points, offsets[:-1], 32), 32).astype(np.uint64)
    space = np.flatnonzero(x == 32)
    following = np.full(len(x), len(x), np.int64)
    following[:-1] = np.repeat(space, np.diff(space, prepend=0))[: len(x) - 1] if len(space) else following[:-1]
    for n in ORDERS:
        count = len(x) - n + 1
        if count <= 0:
            continue
        at = np.flatnonzero(following[:count] >= np.arange(n - 1, n - 1 + count))
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[at + k]
        yield at, (mixed(h) & np.uint64(BUCKETS - 1)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text its distinct buckets. Each counts 1 / (their number + DAMPING), for a short text less than one together."""
    points, at = letters(*codepoints(data, offsets))
    starts = at + np.arange(len(at))
    found: list[list[np.ndarray]] = [[] for _ in range(len(at) - 1)]
    for where, h in subwords(points, at):
        cut = np.searchsorted(where, starts)
        for k in range(len(found)):
            found[k].append(h[cut[k] : cut[k + 1]])
    out = []
    for parts in found:
        own = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        out.append(own)
    return out


def train(texts: list[np.ndarray], labels: np.ndarray, odds_shift: float, epochs: int = 8, rate: float = 0.3, batch: int = 64, least_texts: int = 3, seed: int = 7) -> Model:
    """Adagrad on embedding rows and weights together; odds_shift is added to the learnt bias.

    Rows of n-grams in fewer than least_texts texts stay zero: they would carry chance alone.
    """
    rng = np.random.default_rng(seed)
    spread = np.zeros(BUCKETS, np.int32)
    for c in texts:
        spread[c] += 1
    common = spread >= least_texts
    embedding = rng.normal(0, 0.3, (BUCKETS, DIMENSION)).astype(np.float32)
    embedding[~common] = 0
    weights = rng.normal(0, 1, (DIMENSION, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e = np.full(BUCKETS, 1e-8, np.float32)
    seen_w, seen_b = np.full(weights.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    order = rng.permutation(len(texts))
    batches = [order[a : a + batch] for a in range(0, len(order), batch)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            y = labels[batches[k]]
            kept = [texts[r][common[texts[r]]] for r in batches[k]]
            text = np.repeat(np.arange(len(kept), dtype=np.int32), [len(c) for c in kept])
            share = np.array([1 / (len(texts[r]) + DAMPING) for r in batches[k]], np.float32)[text]
            own, inverse = np.unique(np.concatenate(kept), return_inverse=True)
            rows = embedding[own]
            mean = np.stack([np.bincount(text, share * rows[inverse, d], len(y)) for d in range(DIMENSION)], axis=1).astype(np.float32)
            logit = mean @ weights + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = p @ weights.T
            slope = np.stack([np.bincount(inverse, share * back[text, d], len(own)) for d in range(DIMENSION)], axis=1).astype(np.float32)
            for value, seen, g in ((weights, seen_w, mean.T @ p), (bias, seen_b, p.sum(axis=0))):
                seen += g * g
                value -= rate * g / np.sqrt(seen)
            seen_e[own] += (slope * slope).mean(axis=1)
            embedding[own] -= rate * slope / np.sqrt(seen_e[own])[:, None]
    return Model(embedding, weights, float(bias[1] - bias[0]) + odds_shift)


def learnt(doc_id: Column) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 5, is not 0; a null id is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, positives: int = 2500, negatives: int = 5000) -> Model:
    """Learn from labels of rows that `learnt` allows; see the module's docstring for the sample's bounds."""
    own = labels.where(learnt(F.col(doc_id)) & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if len(n) < 2:
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 2), np.float32), math.log(share / (1 - share)) if 0 < share < 1 else math.inf * (2 * share - 1))
    draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1_000_000))
    limit = F.when(F.col("y") == 1, math.ceil(1e6 * min(1, positives / n[1]))).otherwise(math.ceil(1e6 * min(1, negatives / n[0])))
    chosen = own.where(draw < limit)  # about positives + negatives ids, whatever the input: small enough to send to every task
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            got = features(data, offsets)
            at = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(c) for c in got], out=at[1:])
            cols = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(got)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cols], names=["id", "y", "cols"])

    sample = rows.select("id", "y", "text").mapInArrow(extract, "id long, y int, cols array<int>").toArrow().sort_by("id")
    y = sample["y"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 2), np.float32), math.log(n[1]) - math.log(n[0]))
    texts = [c.values.to_numpy() for c in sample["cols"]]
    shift = math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return train(texts, y, shift)


def score(docs: DataFrame, text: str, model: Model, keep: tuple[str, ...], name: str = "score") -> DataFrame:
    """Columns `keep` of docs and the probability of class 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.log_odds_by_row(), model.bias))  # one megabyte
    source = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_row, bias = shared.value
        for batch, data, offsets in pieces(batches, "__text"):
            logit = np.array([by_row[c].sum(dtype=np.float64) / (len(c) + DAMPING) for c in features(data, offsets)]) + bias
            with np.errstate(over="ignore"):
                probability = 1 / (1 + np.exp(-logit))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(probability)], names=[*keep, name])

    return source.mapInArrow(judge, schema)
