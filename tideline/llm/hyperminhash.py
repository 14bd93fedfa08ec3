"""Near-duplicates by HyperMinHash: compressed registers, banding, collision-corrected estimates, full verification.

1. Words of lower-cased bytes are hashed in numpy, shingles of `words` words are hashed and made distinct per text. Of each of 256
   buckets the least hash is kept as its count of leading zeros and the ten bits that follow it, in 16 bits. Empty
   buckets borrow from others in a fixed random order for banding, so that short texts band as long ones do.
2. Texts with equal sets (128 bits of fingerprint and the size) are one class, represented by the smallest id.
3. Registers are cut in bands; representatives that share a band meet. In each band bucket the member that shares most
   with others is the hub, and pairs are made with the hub only, so that a bucket makes as many pairs as it has rows.
4. Pairs whose estimate, corrected for chance collisions of registers, lies well below the threshold are left; all
   others are confirmed on their full sets, and the confirmed links make components.
5. What the hubs cannot tell is finished exactly by a prefix join. Of the texts in buckets that still hold several components, shingles
   are ordered from the rarest to the most frequent. Texts that link share a shingle within the first few of both, and what
   comes before the first shared one is shared by neither, which bounds what the two can have in common. The join is by shingle and class
   of size, applies that bound, and leaves out pairs within a component: a pair of the component that is largest under a key is never made. A large group of
   texts that each differ by edits of their own so makes few pairs, whether the edits' shingles are unique or shared with some others.

The number of rows in a band follows from the threshold: a pair three standard errors below it is missed with a probability under 1e-4.

Defined results: a text without words, or null, has an empty set and is its own component; with fewer words than a shingle
has, the whole sequence is one shingle. Every row is a document: rows that repeat an id are judged by their own texts and carry the smallest id that each of
these reaches. A null id counts as larger than any other: a component of null ids alone has a null component_id. Kept are rows whose id is their component_id,
nulls equal. Columns other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import mixed, pieces, staged
from tideline.llm.components import connected_components

BUCKETS, MANTISSA = 256, 10
#: An estimate this far below the threshold is five standard errors of 256 registers.
SLACK = 0.15

_RANDOM = np.random.default_rng(20240601)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BYTE[[32, 9, 10, 11, 12, 13]] = 0
_DONORS = np.stack([_RANDOM.permutation(BUCKETS) for _ in range(BUCKETS)])
_ORDER = _RANDOM.permutation(BUCKETS)
_COEFFICIENTS = _RANDOM.integers(1, 1 << 63, BUCKETS, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and for each text the range of its words (n + 1 offsets)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = _BYTE[low]
    word = inside != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = word[edges]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))), axis=0) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(data))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = _powers(int(place.max()) + 1)
    hashes = mixed(np.add.reduceat(inside * powers[place], starts))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, at = word_hashes(data, offsets)
    joined = np.full(max(0, len(hashes) - words + 1), words, np.uint64)
    for k in range(words):
        joined = mixed(joined * _STEP + hashes[k : k + len(joined)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                whole = mixed(whole * _STEP + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """256 registers of a sorted set: leading zeros plus one above ten bits of mantissa; 0 if the bucket is empty."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (shingles[first] >> np.uint64(8)) & np.uint64((1 << 48) - 1)
    zeros = 48 - np.frexp(rest.astype(np.float64))[1]
    mantissa = ((rest << zeros.astype(np.uint64)) & np.uint64((1 << 47) - 1)) >> np.uint64(47 - MANTISSA)
    out[bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


def rows_per_band(threshold: float) -> int:
    """The largest number for which a pair three standard errors below the threshold is missed less than once in 10,000 times."""
    low = threshold - 3 * math.sqrt(threshold * (1 - threshold) / BUCKETS)
    return next(r for r in range(16, 0, -1) if (1 - low**r) ** (BUCKETS // r) < 1e-4 or r == 1)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band of the registers, empty ones borrowed; the bands of a set with no shingle are not asked for."""
    full = sketch != 0
    if not full.all():
        empty = np.flatnonzero(~full)
        donors = _DONORS[empty]
        sketch = sketch.copy()
        sketch[empty] = sketch[donors[np.arange(len(empty)), full[donors].argmax(axis=1)]]
    n = BUCKETS // rows
    x = sketch[_ORDER[: n * rows]].astype(np.uint64).reshape(n, rows)
    return mixed((x * _COEFFICIENTS[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64) * _STEP)


def estimate(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, with the equal registers that chance alone gives taken off.

    Two unrelated registers are equal if their minima fall in the same cell of leading zeros and mantissa. With n shingles in
    a bucket the minimum is about exponential with rate n, so that the chance is the sum over cells of the product of both
    probabilities; cells are the same for every pair, rates are rounded to powers of 1.25.
    """
    used = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    share = equal / np.maximum(used, 1)
    chance = np.array([_chance(round(math.log(x / BUCKETS, 1.25)), round(math.log(y / BUCKETS, 1.25))) for x, y in zip(np.maximum(sizes_a, 1), np.maximum(sizes_b, 1), strict=True)])
    return np.where(used > 0, (share - chance) / (1 - chance), 0.0)


_CHANCES: dict[tuple[int, int], float] = {}
_CELLS = np.concatenate([np.ldexp(1 + np.arange(1 << MANTISSA) / (1 << MANTISSA), -z - 1) for z in range(40, -1, -1)] + [[1.0]])


def _chance(x: int, y: int) -> float:
    if (x, y) not in _CHANCES:
        p, q = (np.diff(-np.expm1(-(1.25**k) * _CELLS)) for k in (x, y))
        _CHANCES[x, y] = float((p * q).sum() / max(1e-12, p.sum() * q.sum()))
    return _CHANCES[x, y]


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """row, doc_id, text_key, n, fp1, fp2, keys (band hashes), sketch (512 bytes) of docs with columns doc_id, text_key and text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            n, one, two, keys, regs = [], [], [], [], []
            for s in shingle_sets(data, offsets, words):
                n.append(len(s))
                m = mixed(s + _STEP)
                one.append(m.sum(dtype=np.uint64))
                two.append(mixed(m ^ _STEP).sum(dtype=np.uint64))
                r = registers(s)
                regs.append(r.astype("<u2").tobytes())
                keys.append(_as_long(bands(r, rows)) if len(s) else np.zeros(0, np.int64))
            at = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=at[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(_as_long(np.array(one, np.uint64))),
                    pa.array(_as_long(np.array(two, np.uint64))),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys))),
                    pa.array(regs, pa.binary()),
                ],
                names=["doc_id", "text_key", "n", "fp1", "fp2", "keys", "sketch"],
            )

    found = docs.select("doc_id", "text_key", "text").mapInArrow(sketch, "doc_id long, text_key long, n long, fp1 long, fp2 long, keys array<long>, sketch binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """row and the distinct shingle hashes of its text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            found = shingle_sets(data, offsets, words)
            at = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(s) for s in found], out=at[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(_as_long(np.concatenate(found))))], names=["row", "shingles"])

    return texts.select("row", "text").mapInArrow(sets, "row long, shingles array<long>")


def _likely(pairs: DataFrame, base: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate is at least `least`."""
    side = base.select("row", "n", "sketch")
    wide = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(len(batch), BUCKETS) for k in (3, 5))
            good = estimate(x, y, batch.column(2).to_numpy(), batch.column(4).to_numpy()) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return wide.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(judge, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, together: int = 500) -> DataFrame:
    """Pairs whose full sets reach the threshold. The set of `a` goes out once for about `together` of its partners, not with each of them."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("parts"))
    heads = parts.join(sets.toDF("a", "shingles"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    partners = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    partners = partners.join(sets.toDF("b", "shingles"), "b").select("a", "part", "b", "shingles")
    met = heads.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.int64)
        for batch in batches:
            a, b, shingles = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            at, flat, whole = shingles.offsets.to_numpy(), shingles.values.to_numpy(), b.is_null().to_pylist()
            good = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                own = flat[at[k] : at[k + 1]]
                if whole[k]:
                    head = own.copy()
                    continue
                common = len(head) + len(own) - len(np.unique(np.concatenate([head, own])))
                good[k] = 100 * common >= percent * (len(head) + len(own) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), b.filter(pa.array(good))], names=["a", "b"])

    return met.mapInArrow(judge, "a long, b long")


def _open_pairs(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (row, component) of different components which the prefix join cannot rule out; see 5 above."""
    each = sets.join(members, "row").select("row", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    # What only one of these texts has, it shares with no partner, and a text with much of that links with none
    spread = staged(each.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "spread")
    rare = each.join(spread, "h").groupBy("row").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("texts", "h"))).alias("rare"))
    rare = rare.where(100 * F.size("rare") >= percent * F.col("n"))
    own = F.col("n") - F.size("rare")
    longest = F.col("n") - F.ceil(percent * F.col("n") / 100).cast("int") + 1  # texts that link share one of these, the rarest
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    prefix = rare.select("row", "component", "n", own.alias("own"), F.slice("rare", 1, longest - own).alias("rare")).join(size, "component")
    prefix = prefix.select("row", "n", F.struct("members", "component").alias("of"), F.posexplode("rare").alias("at", "shingle"), "own")
    # With all before this shingle unshared, a partner may have so many shingles at most
    place = F.col("own") + F.col("at")
    most = F.floor((F.col("n") - place) * (100 + percent) / percent).cast("int") - F.col("n")
    prefix = staged(prefix.select("row", "n", "of", F.col("shingle.h").alias("h"), most.alias("most")), "prefix")

    def step(n: Column) -> Column:
        return F.floor(F.log(n) / math.log(1.05)).cast("int")

    least, upper = F.ceil(percent * F.col("n") / 100), F.least("n", "most")
    larger = prefix.where(upper >= least).withColumn("class", F.explode(F.sequence(step(least), step(upper))))
    smaller = prefix.where("most >= n").withColumn("class", step(F.col("n")))
    key = ["h", "class"]
    # Under each key the texts of one component meet the others only: those of the component with the most members
    first = staged(smaller.groupBy(*key).agg(F.max("of").alias("first")), "first")
    x = larger.join(first, key).withColumn("side", F.explode(F.when(F.col("of") == F.col("first"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    y = smaller.join(first, key).withColumn("side", F.when(F.col("of") == F.col("first"), 0).otherwise(1))
    x = x.select(*key, "side", F.col("row").alias("x"), F.col("n").alias("nx"), F.col("of").alias("ox"), F.col("most").alias("mx"))
    y = y.select(*key, "side", F.col("row").alias("y"), F.col("n").alias("ny"), F.col("of").alias("oy"), F.col("most").alias("my"))
    may = (F.col("ox") != F.col("oy")) & (F.col("ny") <= F.col("mx")) & (F.col("nx") <= F.col("my")) & (100 * F.col("ny") >= percent * F.col("nx")) & ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x"))))
    return x.join(y, [*key, "side"]).where(may).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """row, doc_id, text_key (xxhash64 of the text), n, group (equal for the rows of a component), component_id: a row for every row of docs, written."""
    threshold = percent / 100
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    base = staged(sketches(texts, words, rows_per_band(threshold)), "sketches")
    same = ["n", "fp1", "fp2"]
    classes = staged(base.where("n > 0").groupBy(*same).agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id")), "classes")
    rows = base.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("row", F.explode("keys").alias("key"))
    shared = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    met = staged(rows.join(shared, "key"), "bands")
    degree = staged(met.groupBy("row").agg(F.sum(F.col("size") - 1).alias("degree")), "degrees")
    wanted = base.join(degree, "row", "left_semi").select("row", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    held = texts.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["row"])
    sets = staged(full_sets(held, words), "sets")

    # Pairs with the hub of each bucket
    ranked = met.join(degree, "row").select("key", "row", "degree")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", -F.col("row"))).alias("hub")).select("key", (-F.col("hub.col2")).alias("a"))
    tested = staged(met.join(hubs, "key").where("a <> row").select("a", F.col("row").alias("b")).distinct(), "candidates")
    links = staged(_confirmed(staged(_likely(tested, base, threshold - SLACK), "likely"), sets, percent), "links")
    labels = connected_components(links)

    # Texts in buckets that hold several components still
    apart = met.select("key", "row").join(labels.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    keys = apart.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    members = staged(apart.join(keys, "key", "left_semi").select("row", "component").distinct(), "open")
    if members.limit(1).count():
        pairs = _open_pairs(sets, members, percent).join(tested.union(tested.select("b", "a")), ["a", "b"], "left_anti")
        likely = staged(_likely(staged(pairs, "candidates"), base, threshold - SLACK), "likely")
        more = staged(_confirmed(likely, sets, percent), "links")
        if more.limit(1).count():
            labels = connected_components(links.union(more))
    found = classes.join(labels.toDF("rep", "component"), "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    least = found.groupBy("group").agg(F.min("least_id").alias("component_id"))
    found = staged(found.join(least, "group").select(*same, "group", "component_id"), "components")
    out = base.select("row", "doc_id", "text_key", *same).join(found, same, "left")
    return out.select("row", "doc_id", "text_key", "n", F.coalesce("group", "row").alias("group"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every row of docs.

    Linked are texts with 100 * common >= percent * united shingles.
    """
    return judged(docs, doc_id, text, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that with the smallest id (null last); of rows equal in id and text one stays."""
    rows = staged(judged(docs, doc_id, text, words, percent), "judged")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("text_key"))
    first = rows.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    first = staged(first.select("group", "first.doc_id", "first.text_key"), "first")
    own = rows.join(first.select("group", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "group")
    chosen = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    gone = own.where(~chosen).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    again = own.where(chosen).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    gone, again = staged(gone, "gone"), staged(again, "again")
    here = (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("_key")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_id"))
    left = docs.join(gone, here, "left_anti")
    if not again.limit(1).count():
        return left
    return left.join(again, here, "left_anti").union(left.join(again, here, "left_semi").dropDuplicates([doc_id, text]))
