"""A trie of conversations: every distinct sequence of first turns is a node, with its members, children, leaves and what sharing it saves.

Each conversation's prefixes get a chained 128-bit digest. A count-min sketch of all digests, of bounded size, then screens them: an estimate of one proves that no
other conversation has the prefix, and so none of those that go on from it. Such tails are emitted where they are; only their first node and the prefixes that may be
shared are shuffled, for exact grouping by digest. Sums over subtrees need no walk down the trie: each node and each leaf is charged to its smallest member, summed
backwards along that conversation, and added up by node.

Defined results: rows without a conv_id belong to no conversation. A null role or text is empty; a null turn comes first, ties go by role and text, and repeated rows
are turns of their own. A conversation of any length streams through its task. A conversation without a turn is a member of the root alone. Other columns are not
used, whatever their names. An empty table has no root and gives no rows. `%` keeps the sign of a negative conv_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import sketches
from tideline.llm.common import staged

#: Turns that lie together in a row of digests; conversations whose ends are listed together.
SEGMENT, LISTED = 1024, 16
SEGMENTS = "conv_id long, start int, parent binary, digests binary, sizes binary, last boolean"
SCREENED = "conv_id long, depth int, digest binary, size long, last boolean, kind string"
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place from 1, role, text."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.where("conv_id IS NOT NULL").withColumn("place", F.row_number().over(own)).drop("turn")


def forked(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, part, place, role, text: each conversation c with the first h turns of c - c % every before its own turns after its first h; h = crc32(c) % most.

    A row of part -1 stands for the conversation itself, which may have no turn. Only heads, of under `most` turns, are joined.
    """
    h = lambda c: F.crc32(c.cast("string")) % most
    ids = turns.where("place = 1").select("conv_id")
    own = turns.where(F.col("place") > h(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "place", "role", "text")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    joined = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base").where(F.col("place") <= h(F.col("conv_id")))
    marks = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"))
    return own.unionByName(joined.select("conv_id", F.lit(0).alias("part"), "place", "role", "text")).unionByName(marks)


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of digests of rows sorted by conversation, part and place; part -1 opens a conversation."""
    conv, start, parent, digests, sizes, out = None, 0, b"", [], [], []

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "start", "parent", "digests", "sizes", "last"])

    def row(last: bool) -> tuple:
        return conv, start, parent, b"".join(digests), np.array(sizes, np.int64).tobytes(), last

    for batch in batches:
        columns = [batch.column(k) for k in range(5)]
        for c, part, role, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[3].cast(pa.binary()), columns[4].cast(pa.binary()), strict=True):
            if part < 0:
                if conv is not None:
                    out.append(row(True))
                conv, start, parent, digests, sizes = c, 0, b"", [], []
            else:
                if len(digests) == SEGMENT:
                    out.append(row(False))
                    start, parent, digests, sizes = start + SEGMENT, digests[-1], [], []
                role, text = role.as_buffer(), text.as_buffer()
                h = hashlib.blake2b((digests[-1] if digests else parent) + len(role).to_bytes(8, "little"), digest_size=16)
                h.update(role)
                h.update(text)
                digests.append(h.digest())
                sizes.append(len(text))
            if len(out) >= 512:
                yield packed(out)
                out = []
    if conv is not None:
        yield packed([*out, row(True)])


def low_halves(batch: pa.RecordBatch) -> np.ndarray:
    """64 bits of each digest of a batch of segments."""
    return np.concatenate([np.frombuffer(x.as_buffer(), "<u8")[::2] for x in batch.column(3)] or [np.zeros(0, np.uint64)]).astype(np.uint64)


def screened(sketch: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of prefixes: 'tail' is proved to be one conversation's own, as is the prefix before it; 'first' is a tail's first; 'shared' may be shared; 'none' is a conversation without a turn."""
    names, blank = ["conv_id", "depth", "digest", "size", "last", "kind"], np.frombuffer(b"", "<u8")
    for batch in batches:
        for conv, start, parent, digests, sizes, ends in zip(*[batch.column(k) for k in range(6)], strict=True):
            d, n = digests.as_buffer(), np.frombuffer(sizes.as_buffer(), np.int64)
            if not len(n):
                kind = np.array(["none"] * (start.as_py() == 0), object)
                if not len(kind):
                    continue
                columns = np.zeros(1, np.int64), np.zeros(1, np.int32), [b""], np.zeros(1, np.int64), np.ones(1, bool)
                yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.binary()), pa.array(columns[3]), pa.array(columns[4]), pa.array(kind, pa.string())], names)
                continue
            before = parent.as_buffer()
            half = np.concatenate([np.frombuffer(before, "<u8")[:1] if len(before) else blank, np.frombuffer(d, "<u8")[::2]]).astype(np.uint64)
            alone = np.logical_or.accumulate(sketches.estimate(sketch, half) <= 1)
            held = np.concatenate([np.zeros(int(not len(before)), bool), alone])
            kind = np.where(held[1:], np.where(held[:-1], "tail", "first"), "shared")
            last = np.zeros(len(n), bool)
            last[-1] = ends.as_py()
            keys = [d[16 * i : 16 * i + 16].to_pybytes() if k == "shared" else None for i, k in enumerate(kind)]
            depth = np.arange(1, len(n) + 1, dtype=np.int32) + start.as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), conv.as_py(), np.int64)), pa.array(depth), pa.array(keys, pa.binary()), pa.array(n), pa.array(last), pa.array(kind.astype(object), pa.string())], names)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, ends_sha256 of rows (digest, bucket, ids) sorted by digest and bucket: the ids of a digest stream through one hash."""
    key, h, out = None, None, []
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["digest", "ends_sha256"])
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            if digest != key or h is None:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = digest, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.as_buffer())
            if len(out) >= 4096:
                yield pack(out)
                out = []
    if h is not None:
        yield pack([*out, (key, h.hexdigest())])


def trie(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node; rows as `forked` gives them."""
    spark = rows.sparkSession
    one_by_one = rows.select("conv_id", "part", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    segments = staged(one_by_one.mapInArrow(digested, SEGMENTS), "segments")
    prefixes = segments.agg(F.coalesce(F.sum(F.length("digests") / 16), F.lit(0)).cast("long")).first()[0]
    sketch = spark.sparkContext.broadcast(sketches.gathered(segments, low_halves, sketches.cells_for(prefixes), 2))
    found = staged(segments.mapInArrow(lambda batches: screened(sketch.value, batches), SCREENED), "screened")

    # What may be shared: exact groups by digest, then back to each conversation's own prefixes
    shared, first = found.where("kind = 'shared'"), found.where("kind = 'first'")
    groups = shared.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"), F.count_if("last").alias("n_ends"))
    least = found.where("kind = 'none' OR depth = 1").agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("convs"))
    known = shared.join(groups, "digest").unionByName(first.withColumns({"n": F.lit(1).cast("long"), "rep": F.col("conv_id"), "n_ends": F.col("last").cast("long")}))
    along = Window.partitionBy("conv_id").orderBy("depth")
    mine = F.col("rep") == F.col("conv_id")
    adjacent = lambda of, by: F.when(of("depth", 1).over(along) == F.col("depth") + by, of("rep", 1).over(along))
    known = known.withColumns({
        "up": adjacent(F.lag, -1),
        "child": (F.coalesce(adjacent(F.lead, 1), F.lit(None)) == F.col("conv_id")).cast("long"),
        "saves": F.sum(F.when(mine, (F.col("n") - 1) * F.col("size")).otherwise(0)).over(Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)),
        # A conversation's end is a leaf unless others go on from it; it is charged to its smallest member. Ends in a tail are leaves
        "leaf": 1 - F.max(F.when(F.col("last") & ~(mine & (F.col("n") == F.col("n_ends"))), 1).otherwise(0)).over(Window.partitionBy("conv_id")),
    })
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    # A prefix whose predecessor is in a tail has its own conversation for a parent
    parent = F.when(F.col("depth") > 1, F.coalesce("up", "conv_id"))
    nodes = known.where("kind = 'shared'").groupBy("digest").agg(
        F.min("rep").alias("conv_id"), F.min("depth").alias("depth"), F.max(parent).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), n("child").alias("n_children"), n("leaf").alias("n_leaves"), n("saves").alias("saved_tokens"),
    )
    ends = found.where("last AND kind IN ('shared', 'none')").groupBy("digest", F.shiftright("conv_id", LISTED).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = ends.repartition("digest").sortWithinPartitions("digest", "bucket").mapInArrow(listed, "digest binary, ends_sha256 string")
    nodes = nodes.join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))

    own_end = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY)
    single = lambda df, parent: df.select("conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), own_end.alias("ends_sha256"))
    tails = single(found.where("kind = 'tail'"), F.col("conv_id")).union(single(known.where("kind = 'first'"), parent))
    columns = tails.columns
    below = staged(nodes.select(*columns).union(tails), "nodes")

    root_ends = ends.where(F.length("digest") == 0).agg(F.max("ends_sha256").alias("e"))
    top = below.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), n("n_leaves").alias("leaves"), n("saved_tokens").alias("saved_tokens"))
    root = least.where("convs > 0").join(top, how="cross").join(root_ends, how="cross")  # a row each
    root = root.select(F.col("root").alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("long"), F.col("convs"), "n_children", F.greatest("leaves", F.lit(1)), "saved_tokens", F.coalesce("e", F.lit(EMPTY)))
    # Nodes below the root without another parent hang from it
    filled: Column = F.when((F.col("depth") == 1), F.col("root")).otherwise(F.col("parent_conv_id"))
    whole = below.join(F.broadcast(least.select("root")), how="cross").withColumn("parent_conv_id", filled).select(*columns).union(root)
    return whole.select(*[F.col(c) if c == "ends_sha256" else F.col(c).cast("long") for c in columns])
