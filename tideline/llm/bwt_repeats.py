"""Exact removal of repeated passages: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of `length` bytes has one anchor: of its substrings of `GRAM` bytes the one with the least hash, leftmost among equals. Equal strings
have equal anchors at the same place, so that strings can be dealt out by their anchor's hash, each to one task and
without a copy. Consecutive strings of a text with the same anchor make a context, which is what moves.

1. Contexts are found in numpy; what is kept of each is its anchor's hash, 128 bits of hash of its bytes, and its place.
2. Anchors that occur once are done. Contexts with equal bytes are one; with two or more copies all of their strings repeat.
3. The other contexts of an anchor go, with their bytes, to the block of their anchor. A block's Burrows-Wheeler transform comes from a suffix
   array that is ordered as far as the threshold needs. From the boundaries between suffixes with different first bytes, backward extension,
   breadth first, gives the boundaries with common prefixes of 1, 2, ... bytes, and stops at `length`: rows with no boundary
   between them then share at least `length` bytes.
4. All repeated strings of a context hold its anchor, so that together they cover one range; ranges are merged by text.

A group of contexts with one anchor that is larger than `HOT_BYTES` is not sent to one task. Each of its strings gets a further anchor, by another order of the
hashes, and contexts are cut anew by both; equal ones are one again, and what is still too large is split in this way up to `SPLITS` times. Groups that
resist all of that (none in any test data) are hashed (128 bits) string by string and counted by Spark's aggregation.

Passages of `words` words that also occur in another document are found in the same way, with 64-bit hashes of words in the place of bytes; they can be shorter
than `length` bytes, and nothing of them is removed. Words are runs without white space, so that passages are equal whatever stands between their words; contexts are told apart by the anchor's hash and 64 bits of their own. Here a string has to
occur under another id, so that contexts are done if their anchor occurs under one id alone, and two equal ones only prove a repeat if their ids differ. Anchors with more than `HOT_BYTES` of contexts are hashed and counted at once.

Defined results: a null text is empty; a text shorter than `length` loses nothing; matches never cross texts. Rows that
repeat an id and a text are two documents with the same result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import mixed, pieces, staged

GRAM = 64
WORD_GRAM = 8
BLOCK_BYTES = 2 << 20
HOT_BYTES = 4 << 20
SPLITS = 3
#: A place within the texts of one step; as many bits as the length of a Spark string needs.
_PLACE = np.uint64((1 << 31) - 1)
#: Between the contexts of a block; no byte of UTF-8.
_BORDER = b"\xff"

_RANDOM = np.random.default_rng(20240715)
_TABLES = [_RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


class RangeHash:
    """64-bit hashes of any range of an array of bytes or 64-bit codes, equal for equal ones wherever they are."""

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, which: int):
        self.inverse = pow(_STEPS[which], -1, 1 << 64)
        terms = _TABLES[which][data] if data.dtype == np.uint8 else mixed(data ^ np.uint64(_STEPS[which]))
        terms *= self.powers(_STEPS[which], len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        have = cls._powers.get(base)
        if have is None or len(have) < n:
            size = max(n, 1 << 16)
            out = np.full(size, np.uint64(base & 0xFFFFFFFFFFFFFFFF))
            out[0] = 1
            have = np.cumprod(out, dtype=np.uint64)
            if size <= 1 << 20:
                cls._powers[base] = have
        return have[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = self.powers(self.inverse, int(start.max()) + 1 if len(start) else 1)[start]
        return mixed((self.sums[end] - self.sums[start]) * back + (end - start).astype(np.uint64))


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, turn: int = 0, gram: int = GRAM, one: RangeHash | None = None) -> tuple[np.ndarray, ...]:
    """text, first and last start of its strings, anchor's place, anchor's hash: a row for each context of the texts. Each turn orders hashes in its own way; `one` are the hashes of data, where they are known."""
    sizes = np.diff(offsets)
    per_text = np.maximum(sizes - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not per_text.any():
        return none, none, none, none, none.astype(np.uint64)
    one = one or RangeHash(data, 0)
    every = np.arange(len(data) - gram + 1)
    hashes = one.of(every, every + gram)
    if turn:
        hashes = mixed(hashes + np.uint64(turn * _STEPS[0] & (1 << 64) - 1))
    least = (hashes & ~_PLACE) | every.astype(np.uint64)
    width, need = 1, length - gram + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < need:
        least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
    text = np.repeat(np.arange(len(sizes)), per_text)
    start = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + np.repeat(offsets[:-1], per_text)
    place = (least[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(first[1:], len(text)) - 1
    at = place[first]
    return text[first], start[first], start[last], at, hashes[at]


def _hashes(data: np.ndarray) -> list[RangeHash]:
    return [RangeHash(data, k) for k in range(2)]


def _text_hashes(hashes: list[RangeHash], offsets: np.ndarray) -> np.ndarray:
    return (hashes[0].of(offsets[:-1], offsets[1:]) ^ mixed(hashes[1].of(offsets[:-1], offsets[1:]))).view(np.int64)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the words of the texts, and the texts' offsets counted in words."""
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    border = np.zeros(len(data) + 1, bool)  # before this byte
    border[offsets] = True
    border[1:] |= np.append(~inside[:-1], True) if len(data) else False
    start = np.flatnonzero(inside & border[:-1])
    border[:-1] |= ~inside
    end = np.flatnonzero(inside & border[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


def word_codes(raw: bytes) -> np.ndarray:
    """Hashes of the words of one text."""
    data = np.frombuffer(raw, np.uint8)
    return RangeHash(data, 0).of(*word_places(data, np.array([0, len(data)]))[:2])


def _listed(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, hashes: list[RangeHash]) -> pa.ListArray:
    """The contexts of each text, with places counted from its start."""
    text, lo, hi, at, fp = contexts(data, offsets, length, gram=gram, one=hashes[0])
    c = [h.of(lo, hi + length) for h in hashes] if len(lo) else [fp for _ in hashes]
    # The anchor's place within the context is part of what makes contexts equal
    c[0] = mixed(c[0] + (at - lo).astype(np.uint64))
    columns = [fp.view(np.int64), *(x.view(np.int64) for x in c), *((x - offsets[text]).astype(np.int32) for x in (lo, hi))]
    rows = pa.StructArray.from_arrays([pa.array(x) for x in columns], names=["fp", *[f"c{k + 1}" for k in range(len(c))], "lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)), rows)


def found_contexts(texts: DataFrame, length: int, words: int) -> DataFrame:
    """doc_id, text_hash, n_bytes, sha, contexts, passages (contexts of words): a row for each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            hashes = _hashes(data)
            start, end, at = word_places(data, offsets)
            codes = hashes[0].of(start, end)
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_text_hashes(hashes, offsets)), pa.array(np.diff(offsets)), pa.array(sha), _listed(data, offsets, length, GRAM, hashes), _listed(codes, at, words, WORD_GRAM, [RangeHash(codes, 0)])],
                names=["doc_id", "text_hash", "n_bytes", "sha", "contexts", "passages"],
            )

    return texts.mapInArrow(find, "doc_id long, text_hash long, n_bytes long, sha string, contexts array<struct<fp:long,c1:long,c2:long,lo:int,hi:int>>, passages array<struct<fp:long,c1:long,lo:int,hi:int>>")


def suffix_order(block: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of block, of bytes or small numbers, in the order of their first `depth` items at least; those that agree on these in any order."""
    n = len(block)
    if block.dtype == np.uint8:
        filled = np.concatenate([block, np.zeros(8, np.uint8)]).astype(np.uint64)
        key, done = np.zeros(n, np.uint64), 8
        for k in range(8):
            key = (key << np.uint64(8)) | filled[k : k + n]
        del filled
    else:
        key, done = block, 1
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    del key
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is its first row
    while done < depth:
        # Rows in groups of two or more
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            break
        starts = order[rows]
        after = starts + done
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = (rank[starts] << 32) | second
        inner = np.argsort(by, kind="stable")
        order[rows] = starts[inner]
        by = by[inner]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = by[1:] != by[:-1]
        new[rows] = fresh
        rank[order[rows]] = rows[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        done *= 2
    return order


def prefix_intervals(block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of block in order, the empty one first, and whether a row differs from the one before within `length` items; interval expansion on the block's transform."""
    n = len(block) + 1
    order = np.append(len(block), suffix_order(block, length))  # the empty suffix is the first row
    transform = block.astype(np.int16 if block.dtype == np.uint8 else np.int32)[order - 1]
    transform[order == 0] = block.max(initial=0).astype(np.int64) + 1  # nothing stands before the whole block
    by_byte = np.argsort(transform, kind="stable")
    to = np.empty(n, np.int64)  # row of the suffix that starts one byte earlier
    to[by_byte] = np.append(np.arange(1, n), 0)
    counts = np.append(1, np.bincount(block))
    before = np.full(n, -1, np.int64)  # the row before with the same byte in the transform
    same = transform[by_byte[1:]] == transform[by_byte[:-1]]
    before[by_byte[1:][same]] = by_byte[:-1][same]
    # Intervals of rows that share a prefix; the first ones share their first byte
    found = np.zeros(n, bool)
    heads = (np.cumsum(counts) - counts)[counts > 0]
    found[heads] = True
    end = np.zeros(n, np.int64)
    begin = np.zeros(n, np.int64)
    end[0] = n
    fresh = heads
    for _ in range(1, length):
        # Split intervals at the fresh boundaries
        within = begin[fresh]
        upto = end[within]
        following = np.append(fresh[1:], n)
        sharing = np.append(within[1:] == within[:-1], False)
        upto = np.where(sharing, following, upto)
        lead = np.append(True, within[1:] != within[:-1])
        end[within[lead]] = fresh[lead]
        end[fresh] = upto
        sizes = upto - fresh
        rows = np.arange(int(sizes.sum())) + np.repeat(fresh - (np.cumsum(sizes) - sizes), sizes)
        start = np.repeat(fresh, sizes)
        begin[rows] = start
        # Backward extension: the first row of each byte in the new interval starts one that shares one byte more
        reach = to[rows[before[rows] < start]]
        fresh = np.sort(reach[~found[reach]])
        found[fresh] = True
        if not len(fresh):
            break
    return order, found


def shares_prefix(block: np.ndarray, length: int) -> np.ndarray:
    """For each position of block, whether the `length` items from it also start elsewhere in it."""
    order, found = prefix_intervals(block, length)
    shared = ~found
    shared[:-1] |= ~found[1:]
    out = np.zeros(len(order), bool)
    out[order] = shared
    return out[:-1]


def shares_with_others(block: np.ndarray, length: int, owner: np.ndarray) -> np.ndarray:
    """For each position of block, whether the `length` items from it also start at a position of another owner."""
    order, found = prefix_intervals(block, length)
    first = np.flatnonzero(found)
    own = np.append(owner, 0)[order]
    shared = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(shared, np.diff(np.append(first, len(order))))
    return out[:-1]


def _repeats(rows: list[tuple], length: int, of_words: bool) -> list[tuple]:
    """doc_id, text_hash, start, end of what the repeated strings of each context cover, for the contexts of whole anchors."""
    if of_words:
        codes = word_codes((b" " + _BORDER + b" ").join(r[4] for r in rows) + b" " + _BORDER)
        sizes = np.diff(np.flatnonzero(codes == codes[-1]), prepend=-1) - 1
        ids = {r[0]: k for k, r in enumerate(rows)}
        owners = [-1 - k if r[5] else ids[r[0]] for k, r in enumerate(rows)]  # what two ids have is another's for both
        shared = shares_with_others(np.unique(codes, return_inverse=True)[1], length, np.repeat(owners, sizes + 1))
        sizes = sizes.tolist()
    else:
        sizes = [len(r[4]) for r in rows]
        block = np.frombuffer(_BORDER.join(r[4] for r in rows) + 8 * _BORDER, np.uint8)
        shared = shares_prefix(block, length)
    out, at = [], 0
    for (doc_id, text_hash, lo, *_), size in zip(rows, sizes, strict=True):
        own = np.flatnonzero(shared[at : at + size - length + 1])
        if len(own):
            out.append((doc_id, text_hash, lo + int(own[0]), lo + int(own[-1]) + length))
        at += size + 1
    return out


_SPANS = "doc_id long, text_hash long, start int, end int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "text_hash", "start", "end"])


def _owner() -> F.Column:
    """The id, a null as an id of its own."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def expanded(parts: DataFrame, length: int, of_words: bool = False) -> DataFrame:
    """Spans of repeated strings of contexts (doc_id, text_hash, lo, fp, raw); an anchor's contexts are one task's. Those of words have their places in words, repeat under another id, and have a further column, whether two ids have the whole context (`shared`)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, group = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3] != group and size > BLOCK_BYTES:
                    yield _spans(_repeats(rows, length, of_words))
                    rows, size = [], 0
                group = row[3]
                rows.append(row)
                size += len(row[4])
        if rows:
            yield _spans(_repeats(rows, length, of_words))

    return parts.repartition("fp").sortWithinPartitions("fp").mapInArrow(expand, _SPANS)


def split_anew(parts: DataFrame, length: int, turn: int) -> DataFrame:
    """parts(doc_id, text_hash, lo, fp, raw) cut by a further anchor: the same columns, and c1 and c2, which equal contexts share."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                one = batch.slice(a, 1024)
                raw = one.column(4).cast(pa.large_binary())
                data, offsets = b"".join(raw.to_pylist()), np.zeros(len(one) + 1, np.int64)
                np.cumsum([len(x) for x in raw.to_pylist()], out=offsets[1:])
                found = np.frombuffer(data, np.uint8)
                text, lo, hi, at, fp = contexts(found, offsets, length, turn)
                if not len(text):
                    continue
                c = [h.of(lo, hi + length) for h in _hashes(found)]
                c[0] = mixed(c[0] + (at - lo).astype(np.uint64))
                both = mixed(one.column(3).to_numpy().view(np.uint64)[text] + mixed(fp ^ np.uint64(turn)))
                own = pa.array(text)
                start = one.column(2).to_numpy()[text] + (lo - offsets[text]).astype(np.int32)
                cuts = [data[x:y] for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([one.column(0).take(own), one.column(1).take(own), pa.array(start.astype(np.int32)), pa.array(both.view(np.int64)), pa.array(cuts, pa.binary()), *[pa.array(x.view(np.int64)) for x in c]], names=["doc_id", "text_hash", "lo", "fp", "raw", "c1", "c2"])

    return parts.mapInArrow(split, "doc_id long, text_hash long, lo int, fp long, raw binary, c1 long, c2 long")


def split_spans(hot: DataFrame, length: int, hot_bytes: int) -> list[DataFrame]:
    """Spans of the contexts of anchors that are too large for one task, split by further anchors; see the module's docstring."""
    columns, spans = ["doc_id", "text_hash", "lo", "fp", "raw"], []
    for turn in range(1, SPLITS + 1):
        parts = staged(split_anew(hot.select(*columns), length, turn), "parts")
        same = ["fp", "c1", "c2"]
        kinds = staged(parts.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "lo")).alias("first"), F.max(F.length("raw")).alias("size")), "kinds")
        spans.append(parts.join(kinds.where("n > 1").select(*same), same).select("doc_id", "text_hash", F.col("lo").alias("start"), (F.col("lo") + F.length("raw")).alias("end")))
        anchors = staged(kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.sum("size").alias("bytes")).where("kinds > 1 AND least = 1").select("fp", "bytes"), "anchors")
        left = parts.join(kinds.select(*same, "first"), same).where(F.struct("doc_id", "text_hash", "lo").eqNullSafe(F.col("first"))).join(anchors, "fp").select(*columns, "bytes")
        left = staged(left, "left")
        spans.append(expanded(left.where(F.col("bytes") <= hot_bytes).select(*columns), length))
        hot = left.where(F.col("bytes") > hot_bytes)
        if not hot.limit(1).count():
            return spans
    return [*spans, counted(hot.select(*columns), length)]


def counted(parts: DataFrame, length: int, of_words: bool = False) -> DataFrame:
    """Spans of contexts whose strings are hashed and counted by the engine, for anchors that further anchors don't split, and for large ones of words."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text_hash, lo, _, raw, *shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = word_codes(raw) if of_words else np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                h = [x.of(at, at + length).view(np.int64) for x in _hashes(data)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(at), pa.int64()), pa.array(np.full(len(at), text_hash)), pa.array(np.full(len(at), lo, np.int32)), pa.array((lo + at).astype(np.int32)), *map(pa.array, h), pa.array([any(shared)] * len(at), pa.bool_())], names=["doc_id", "text_hash", "lo", "start", "h1", "h2", "shared"])

    each = parts.mapInArrow(strings, "doc_id long, text_hash long, lo int, start int, h1 long, h2 long, shared boolean")
    repeats = (F.min(_owner()) < F.max(_owner())) | F.max("shared") if of_words else F.count(F.lit(1)) > 1
    twice = each.groupBy("h1", "h2").agg(repeats.alias("repeats")).where("repeats").select("h1", "h2")
    hits = each.join(twice, ["h1", "h2"])
    return hits.groupBy("doc_id", "text_hash", "lo").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end")).select("doc_id", "text_hash", "start", "end")


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on id (nulls equal) and text hash; the columns of both, keys once."""
    right = b.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    return a.join(right, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")), how).drop("_doc_id", "_text_hash")


def passage_contexts(whole: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, lo, hi, fp of the contexts of words that are shared by two ids as they are (`shared`), or that have to be compared with others of their anchor (`wanted`; the anchor's bytes)."""
    each = whole.select("doc_id", "text_hash", F.explode("passages").alias("c")).select("doc_id", "text_hash", "c.*")
    ids = lambda: (F.min(_owner()).alias("least"), F.max(_owner()).alias("most"))
    again = staged(each.groupBy("fp").agg(*ids()).where("least < most").select("fp"), "anchors")
    each = staged(each.join(again, "fp"), "passages")
    same, key = ["fp", "c1"], F.xxhash64("doc_id", "text_hash", "lo")
    size = (F.max(F.col("hi") - F.col("lo")) + words) * 8
    kinds = each.groupBy(*same).agg(*ids(), F.min(key).alias("first"), size.cast("long").alias("size"), F.count(F.lit(1)).alias("n"))
    kinds = staged(kinds.withColumn("shared", F.col("least") < F.col("most")), "passages")
    # Of a kind under two ids one context, of equal keys two, stands for all; of a kind under one id all are compared
    anchors = kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.min("shared").alias("all_shared"), F.sum(F.when(F.col("shared"), F.col("size")).otherwise(F.col("size") * F.col("n"))).alias("bytes"))
    flags = kinds.join(anchors.where("kinds > 1 AND NOT all_shared").select("fp", "bytes"), "fp", "left").where("shared OR bytes IS NOT NULL")
    wanted = F.col("bytes").isNotNull() & (~F.col("shared") | (key == F.col("first")))
    return staged(each.join(flags.select(*same, "shared", "first", "bytes"), same).select("doc_id", "text_hash", "lo", "hi", "fp", "shared", "bytes", wanted.alias("wanted")), "passages")


def covered(spans: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shared_words, n_shared_passages: the words and runs that spans cover."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("runs"), F.lit(-1).alias("upto"))

    def add(x: F.Column, s: F.Column) -> F.Column:
        more = F.greatest(s["end"] - F.greatest(s["start"], x["upto"]), F.lit(0)).cast("long")
        return F.struct((x["words"] + more).alias("words"), (x["runs"] + (s["start"] > x["upto"]).cast("long")).alias("runs"), F.greatest(x["upto"], s["end"]).alias("upto"))

    each = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return each.select("doc_id", "text_hash", F.aggregate("spans", start, add).alias("x")).select("doc_id", "text_hash", F.col("x.words").alias("n_shared_words"), F.col("x.runs").alias("n_shared_passages"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, hot_bytes: int = HOT_BYTES, words: int = 51) -> DataFrame:
    """A row for every row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start, end of each removed run); and n_shared_words, n_shared_passages, words in runs of at least `words` that another document has too."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = staged(found_contexts(texts, length, words), "contexts")
    passages = passage_contexts(whole, words)
    each = whole.select("doc_id", "text_hash", F.explode("contexts").alias("c")).select("doc_id", "text_hash", "c.*")
    # Written by itself, so that the join below can be split where one anchor has very many contexts
    again = staged(each.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "anchors")
    each = staged(each.join(again, "fp"), "contexts")
    same = ["fp", "c1", "c2"]
    kinds = staged(each.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "lo", "hi")).alias("first")), "contexts")
    copies = each.join(kinds.where("n > 1").select(*same), same).select("doc_id", "text_hash", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    size = F.col("first.hi") - F.col("first.lo") + length
    open_anchors = kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.sum(size).alias("bytes")).where("kinds > 1 AND least = 1")
    wanted = kinds.join(staged(open_anchors.select("fp", "bytes"), "anchors"), "fp").select("first.*", "fp", "bytes", F.lit(False).alias("of_words"), F.lit(False).alias("shared"))
    wanted = wanted.unionByName(passages.where("wanted").select("doc_id", "text_hash", "lo", "hi", "fp", "bytes", F.lit(True).alias("of_words"), "shared"))
    wanted = staged(wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi", "fp", "bytes", "of_words", "shared")).alias("wanted")), "wanted")
    copies = staged(copies, "spans")

    ids = copies.select("doc_id").union(wanted.select("doc_id")).distinct().withColumnRenamed("doc_id", "_id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_text_hashes(_hashes(data), offsets)), batch.column(1)], names=["doc_id", "text_hash", "text"])

    held = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(keyed, "doc_id long, text_hash long, text string")
    held = staged(held, "texts")
    one = held.dropDuplicates(["doc_id", "text_hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                rows = []
                for doc, text_hash, body, spots in zip(*(c.to_pylist() for c in batch.slice(a, 64).columns), strict=True):
                    raw = body.encode()
                    if any(s["of_words"] for s in spots):
                        first, last = (x.tolist() for x in word_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[:2])
                    rows += [(doc, text_hash, s["lo"], s["fp"], raw[first[s["lo"]] : last[s["hi"] + words - 1]] if s["of_words"] else raw[s["lo"] : s["hi"] + length], s["bytes"], s["of_words"], s["shared"]) for s in spots]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "text_hash", "lo", "fp", "raw", "bytes", "of_words", "shared"])

    cuts = _same(one, wanted, "inner").select("doc_id", "text_hash", "text", "wanted").mapInArrow(cut, "doc_id long, text_hash long, lo int, fp long, raw binary, bytes long, of_words boolean, shared boolean")
    cuts = staged(cuts, "cuts")
    columns, of_words, small = ["doc_id", "text_hash", "lo", "fp", "raw"], F.col("of_words"), F.col("bytes") <= hot_bytes
    shared = passages.where("shared").select("doc_id", "text_hash", F.col("lo").alias("start"), (F.col("hi") + words).alias("end"))
    shared = covered(shared.union(expanded(cuts.where(of_words & small).select(*columns, "shared"), words, True)).union(counted(cuts.where(of_words & ~small).select(*columns, "shared"), words, True)))
    spans = [copies, expanded(cuts.where(~of_words & small).select(*columns), length)]
    hot = cuts.where(~of_words & ~small).select(*columns)
    if hot.limit(1).count():
        spans += split_spans(hot, length, hot_bytes)
    spans = staged(reduce(DataFrame.union, spans), "spans").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text_hash, body, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, runs = body.encode(), []
                for start, end in sorted((s["start"], s["end"]) for s in own):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                kept, at = hashlib.sha256(), 0
                for start, end in [*runs, [len(raw), len(raw)]]:
                    kept.update(raw[at:start])
                    at = end
                out.append((doc, text_hash, sum(e - s for s, e in runs), kept.hexdigest(), [{"start": s, "end": e} for s, e in runs]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "text_hash", "gone", "kept", "runs"])

    done = _same(one, spans, "inner").select("doc_id", "text_hash", "text", "spans").mapInArrow(remove, "doc_id long, text_hash long, gone long, kept string, runs array<struct<start:long,end:long>>")
    out = _same(_same(whole.select("doc_id", "text_hash", "n_bytes", "sha"), done, "left"), shared, "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return out.select("doc_id", "n_bytes", F.coalesce("gone", F.lit(0)).alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("runs", none).alias("removed"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_shared_words", "n_shared_passages")])
