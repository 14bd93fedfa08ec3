"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors with three rounds of random signs and a fast Hadamard transform, and hashes them to the nearest signed
axis. Buckets become finer with the number of different vectors: turns follow one another, the last of them over some axes only, until
a bucket holds about `per_bucket` vectors (never coarser than one whole turn); probes grow with the 3/4 power of the buckets, so that a
query meets a smaller share of a larger table at about the same recall.

Equal vectors are one row of the index with their k + 1 smallest ids, which is all that an answer can hold of them; equal queries are
searched once. Buckets are found and matched with ids alone; vectors are then sent once to each of their blocks. A bucket
with many vectors is split into blocks of about `block` rows by a hash of the id, and so are many queries. A block returns each query's
best ones in exact double-precision Euclidean distance on the original vectors; the best k of those over all blocks are the answer,
which is what one ranking of all candidates gives.

Defined results: vectors that are null, empty, of another length than the most common one, zero, or with a null or non-finite
component take no part. Ties go to the smaller id. A query is not its own neighbour; other rows with its id are none either. Rows that repeat an id are
one candidate at the smaller distance. With fewer than k candidates found, all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import staged

#: Tables, share of the buckets of one whole turn that a query probes, rows of a block, vectors to a bucket.
TABLES, SHARE, BLOCK, PER_BUCKET = 8, 1 / 8, 4096, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two; keeps lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, table: int, turn: int, seed: int) -> np.ndarray:
    """A pseudo-rotation of unit rows, filled up with zeros to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng((seed, table, turn)).choice([-1.0, 1.0], (3, n))
    for s in signs:
        y = hadamard(y * s)
    return y


def fineness(vectors: int, length: int, per_bucket: int = PER_BUCKET, share: float = SHARE) -> tuple[list[int], int]:
    """Axes of each turn, and probes in each table, for a number of different vectors of one length."""
    n = 1 << max(1, (length - 1).bit_length())
    turns, have = [n], 2 * n
    while (more := vectors // (per_bucket * have * 2)) >= 1:
        turns.append(min(n, 1 << (more.bit_length() - 1)))
        have *= 2 * turns[-1]
    return turns, min(have, math.ceil(share * 2 * n * (have / (2 * n)) ** 0.75))


def buckets(unit: np.ndarray, table: int, turns: list[int], probes: int, seed: int) -> np.ndarray:
    """The `probes` best buckets of each row, best first; the first one is its own."""
    best, score = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for turn, axes_used in enumerate(turns):
        y = rotated(unit, table, turn, seed)[:, :axes_used]
        signed = np.concatenate([y, -y], axis=1)  # axis a, and axes_used + a for its opposite
        axes = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
        heights = np.take_along_axis(signed, axes, 1)
        total = (score[:, :, None] + heights[:, None, :]).reshape(len(unit), -1)
        names = (best[:, :, None] * signed.shape[1] + axes[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        best, score = np.take_along_axis(names, order, 1), np.take_along_axis(total, order, 1)
    return best


def usable(df: DataFrame, vec: str) -> tuple[DataFrame, int]:
    """Rows whose vector takes part, as arrays of floats where they are stored so and of doubles otherwise, and the vectors' length."""
    kind = "float" if df.schema[vec].dataType.simpleString() == "array<float>" else "double"
    good = df.withColumn(vec, F.col(vec).cast(f"array<{kind}>")).where(
        F.col(vec).isNotNull()
        & (F.size(vec) > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(vec, lambda x: x != 0)
    )
    sizes = good.groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return (good.where(F.size(vec) == sizes[0]["n"]), sizes[0]["n"]) if sizes else (good.where(F.lit(False)), 1)


def _placed(df: DataFrame, tables: int, turns: list[int], probes: int, seed: int) -> DataFrame:
    """h, lead, table, bucket: the best buckets of each vector of df (h, lead, vec) in each table."""
    step = max(1, min(2048, (1 << 22) // (probes * 2 * max(turns))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), step):
                batch = whole.slice(a, step)
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                unit = flat / np.abs(flat).max(axis=1, keepdims=True)  # first by the largest component: squares neither vanish nor overflow
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for t in range(tables):
                    found = buckets(unit, t, turns, probes, seed)
                    rows = pa.array(np.repeat(np.arange(len(batch)), found.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(rows), t, np.int32)), pa.array(found.ravel())], names=["h", "lead", "table", "bucket"])

    return df.select("h", "lead", "vec").mapInArrow(assign, "h long, lead long, table int, bucket long")


def _nearest(d: np.ndarray, ids: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` nearest different ids and their distances, of vectors at distances d with the ids of each; ties to the smaller id."""
    take = most
    while True:
        take = min(take, len(d))
        near = np.flatnonzero(d <= np.partition(d, take - 1)[take - 1])
        who = np.concatenate([ids[i] for i in near])
        far = np.repeat(d[near], [len(ids[i]) for i in near])
        order = np.lexsort((who, far))
        who, far = who[order], far[order]
        first = np.sort(np.unique(who, return_index=True)[1])
        if len(first) >= most or take == len(d):
            return who[first[:most]], far[first[:most]]
        take *= 2


def _best(index: pd.DataFrame, queries: pd.DataFrame, most: int) -> pd.DataFrame:
    """Each query's best ids of one block."""
    out: dict[str, list] = {"h": [], "lead": [], "vec_id": [], "score": []}
    if len(index) and len(queries):
        x, ids = np.stack(index.vec.to_numpy()).astype(np.float64), index.ids.tolist()
        for h, lead, vec in zip(queries.h.to_numpy(), queries.lead.to_numpy(), queries.vec.to_numpy(), strict=True):
            who, far = _nearest(np.sqrt(np.square(x - vec).sum(axis=1)), ids, most)
            out["h"] += [h] * len(who)
            out["lead"] += [lead] * len(who)
            out["vec_id"] += who.tolist()
            out["score"] += far.tolist()
    return pd.DataFrame(out).astype({"h": "int64", "lead": "int64", "vec_id": "int64", "score": "float64"})


def neighbours(
    vectors: DataFrame, vec_id: str, vec: str, is_query: Column, k: int = 10, tables: int = TABLES, share: float = SHARE, block: int = BLOCK, per_bucket: int = PER_BUCKET, seed: int = 20240229
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates of every row for which is_query holds, against all rows."""
    rows, length = usable(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec"), is_query.alias("q")).where("id is not null"), "vec")
    rows = rows.withColumn("h", F.xxhash64("vec"))
    # Different vectors: a row_number filter of this kind is applied before the shuffle as well, so one very common vector stays small
    nth = F.row_number().over(Window.partitionBy("h", "vec").orderBy("id"))
    few = rows.select("h", "vec", "id").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    index = staged(few.groupBy("h", "vec").agg(F.min("id").alias("lead"), F.collect_list("id").alias("ids")), "vectors")
    who = rows.where("q").select("id", "h", "vec").distinct()
    asked = staged(who.groupBy("h", "vec").agg(F.min("id").alias("lead")), "queries")
    turns, probes = fineness(index.count(), length, per_bucket, share)
    own = staged(_placed(index, tables, turns, 1, seed), "places")
    wanted = staged(_placed(asked, tables, turns, probes, seed), "probes")
    # Blocks of each bucket: sizes of both sides, one row for every bucket that is probed
    size = own.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    many = wanted.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
    grid = size.join(many, ["table", "bucket"])
    parts = own.join(grid, ["table", "bucket"]).withColumn("part", F.pmod(F.xxhash64("h", "lead"), F.col("blocks")).cast("int"))
    parts = parts.groupBy("h", "lead").agg(F.collect_list(F.struct("table", "bucket", "part", "groups")).alias("at"))  # one for each table
    held = index.join(parts, ["h", "lead"]).select("vec", "ids", F.explode("at").alias("a")).select("a.*", "vec", "ids")
    held = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    probed = wanted.join(grid, ["table", "bucket"]).withColumn("group", F.pmod(F.xxhash64("h", "lead"), F.col("groups")).cast("int"))
    probed = probed.join(asked, ["h", "lead"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["table", "bucket", "part", "group"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best(left, right, k + 1)

    met = held.select(*keys, "vec", "ids").groupBy(*keys).cogroup(probed.select(*keys, "h", "lead", "vec").groupBy(*keys)).applyInPandas(search, "h long, lead long, vec_id long, score double")

    def first(df: DataFrame, by: list[str], most: int) -> DataFrame:
        one = df.groupBy(*by, "vec_id").agg(F.min("score").alias("score"))
        return one.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, most).alias("near"))

    answers = first(met, ["h", "lead"], k + 1).join(asked, ["h", "lead"]).drop("lead")
    hits = who.join(answers, ["h", "vec"]).select(F.col("id").alias("query_id"), F.explode("near").alias("hit")).select("query_id", "hit.*").where("vec_id != query_id")
    flat = first(hits, ["query_id"], k).select("query_id", F.posexplode("near").alias("at", "hit"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
