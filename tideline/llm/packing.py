"""Packing by lexical retrieval: documents that share rare words go into the same windows of tokens.

Documents are dealt to shards of a bounded number of tokens. Their place follows from the least hash of their words, so that near-copies and texts with a rare word
in common meet; a place with more than a shard's tokens, such as thousands of copies, is split by row. Each shard builds a BM25 inverted index of its documents. A
window's seed is the document that its start holds; the seed's most telling words ask the index for the nearest unused documents, which fill the window, best first.
The one that meets the window's end is cut there and goes on as the next window's seed. What a shard has at its end is cut into powers of two, so that no
sequence needs padding.

Tokens: a text is cut before blanks and line ends, where the byte-level pattern cuts too, and each part is encoded once and remembered; new parts of Latin letters
go through the faster of two libraries, which has the same ranks, the others through `tokenizers`. Texts in which three white-space characters follow each other,
or two end it, or that hold an added token, are encoded whole by `tokenizers`, as are all with a tokenizer of another kind.

Defined results: a null text is empty and has the end id alone. Repeated rows and ids are documents of their own. A document of any length is cut into whole windows.
Other columns are not used, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import freed, mixed, pieces, staged

#: Tokens of a shard, and what a document costs besides its tokens; buckets of places; words that a seed asks for; parts that a worker remembers.
SHARD, EACH, PLACES, ASKED, KNOWN = 1 << 20, 64, 1 << 14, 32, 500_000
#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: Parts of up to so many bytes are found by their bytes in one table; longer ones in a dictionary.
SHORT = 24
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: Bytes of the white space beyond ASCII: two bytes, and the third byte after E2 80.
TWO, THIRD = (0x85, 0xA0), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Parts:
    """Numbers of short byte strings, by their exact bytes, in an open-addressing table."""

    def __init__(self, room: int = 1 << 12):
        self.keys, self.value, self.size = np.zeros((4, room), np.uint64), np.full(room, -1, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys[0] ^ mixed(keys[1] ^ mixed(keys[2] + keys[3]))) & np.uint64(len(self.value) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers; -1 for those not held."""
        at, out, left = self._slots(keys), np.full(keys.shape[1], -1, np.int32), np.arange(keys.shape[1])
        while len(left):
            value = self.value[at]
            same = value >= 0
            for k in range(4):
                same &= self.keys[k][at] == keys[k][left]
            out[left[same]] = value[same]
            on = (value >= 0) & ~same
            left, at = left[on], (at[on] + 1) & (len(self.value) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys must differ from one another and from those held."""
        if 2 * (self.size + len(values)) > len(self.value):
            held = np.flatnonzero(self.value >= 0)
            old = self.keys[:, held], self.value[held]
            self.__init__(1 << (4 * (self.size + len(values))).bit_length())
            self.add(*old)
        at = self._slots(keys)
        self.size += len(values)
        while len(values):
            free = self.value[at] < 0
            self.value[at[free]] = values[free]  # of several at a free place the last one gets it
            won = free & (self.value[at] == values)
            self.keys[:, at[won]] = keys[:, won]
            keys, values, at = keys[:, ~won], values[~won], (at[~won] + 1) & (len(self.value) - 1)


class Encoder:
    """Ids of texts, by parts that are encoded once."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer)
        pre, vocabulary = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab", {})
        self.library, self.added = Tokenizer.from_str(tokenizer), [t["content"].encode() for t in spec.get("added_tokens", [])]
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"].get("merges", [])]
        byte = byte_of_letter()
        ranked = all(vocabulary.get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges))
        self.byte_level = ranked and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if self.byte_level:
            import tiktoken

            ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges) and all(c in byte for c in token)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the pattern of byte-level pre-tokenizers
            self.fast = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.width[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.parts, self.long = Parts(), {}
        self.start, self.n, self.flat, self.entries, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0

    def _put(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new entries, whose ids lie end to end."""
        while self.entries + len(sizes) > len(self.n):
            self.start, self.n = np.concatenate([self.start, np.zeros(len(self.n), np.int64)]), np.concatenate([self.n, np.zeros(len(self.n), np.int64)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        own = np.arange(self.entries, self.entries + len(sizes), dtype=np.int32)
        self.start[own], self.n[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.entries, self.used = self.entries + len(sizes), self.used + len(ids)
        return own

    def _learnt(self, new: list[bytes]) -> np.ndarray:
        """Numbers of new parts. Those of Latin letters that begin with a blank and do not end with one are encoded end to end, where nothing joins; the others by the library."""
        plain = np.array([p[0] in (10, 32) and p[-1] not in b" \n" and not BLANKS[p[-1]] and max(p) < 0xE0 and p[1:2] not in (b" ", b"\n") for p in new], bool)
        out = np.empty(len(new), np.int32)
        at = np.flatnonzero(plain)
        if len(at):
            joined = b"".join(new[i] for i in at)
            ids = np.array(self.fast.encode_ordinary(joined.decode()), np.int64)
            ends = np.cumsum([len(new[i]) for i in at])
            cut = np.cumsum(self.width[ids])
            last = np.searchsorted(cut, ends)
            if len(ids) and last[-1] < len(cut) and np.array_equal(cut[last], ends):
                out[at] = self._put(ids, np.diff(last, prepend=-1))
            else:
                plain[:] = False
        at = np.flatnonzero(~plain)
        if len(at):
            done = [np.array(e.ids, np.int64) for e in self.library.encode_batch([new[i].decode("utf-8", "replace") for i in at], add_special_tokens=False)]
            out[at] = self._put(np.concatenate(done), np.array([len(d) for d in done]))
        return out

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the library must see whole: with three blanks in a row, two at the end, or an added token."""
        out = np.zeros(len(offsets) - 1, bool)
        blank = BLANKS[data]
        for lead, at in ((0xC2, np.isin(data[1:], TWO)), (0xE2, None), (0xE1, None), (0xE3, None)):
            found = np.flatnonzero(data[:-1] == lead)
            if at is not None:
                found = found[at[found]]
                blank[found] = blank[found + 1] = True
            elif len(found):
                found = found[found + 2 < len(data)]
                b, c = data[found + 1], data[found + 2]
                hit = found[((b == 0x80) & np.isin(c, THIRD)) | ((b == 0x81) & (c == 0x9F))] if lead == 0xE2 else found[(b == (0x9A if lead == 0xE1 else 0x80)) & (c == 0x80)]
                blank[hit] = blank[hit + 1] = blank[hit + 2] = True
        marks = np.flatnonzero(blank[:-2] & blank[1:-1] & blank[2:]) if len(data) > 2 else np.zeros(0, np.int64)
        ends = np.flatnonzero(np.diff(offsets) > 1)
        out[ends] = blank[offsets[ends + 1] - 1] & blank[offsets[ends + 1] - 2]
        found, raw = list(marks), data.tobytes()
        for token in self.added:
            a = raw.find(token)
            while a >= 0:
                found.append(a)
                a = raw.find(token, a + 1)
        out[np.searchsorted(offsets, np.array(found, np.int64), "right") - 1] = True
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, `end` after each, and where each text's ids begin. data: their UTF-8 bytes end to end."""
        if self.entries > KNOWN:
            self.clear()
        texts = len(offsets) - 1
        whole = self._whole(data, offsets) if self.byte_level else np.ones(texts, bool)
        full = np.flatnonzero(np.diff(offsets) > 0)
        first = np.zeros(len(data) + 1, bool)
        first[:-1] = (data == 32) | (data == 10)
        if whole.any():
            first[:-1] &= ~np.repeat(whole, np.diff(offsets))
        first[offsets[full]] = True
        begin = np.flatnonzero(first[: len(data)])
        size = np.diff(np.append(begin, len(data)))
        of = np.searchsorted(offsets, begin, "right") - 1
        entry = np.full(len(begin), -1, np.int32)
        alone = whole[of]
        short = np.flatnonzero((size <= SHORT) & ~alone)
        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        words_ = np.ndarray((len(data) + 24,), "<u8", padded, 0, (1,))
        keys = np.stack([*(words_[begin[short] + 8 * k] & MASKS[np.clip(size[short] - 8 * k, 0, 8)] for k in range(3)), size[short].astype(np.uint64)])
        entry[short] = self.parts.find(keys)
        raw = padded.tobytes()
        while len(miss := np.flatnonzero(entry[short] < 0)):
            own = keys[:, miss]
            _, one = np.unique(mixed(own[0] ^ mixed(own[1] ^ mixed(own[2] + own[3]))), return_index=True)
            at = short[miss[one]]
            self.parts.add(own[:, one], self._learnt([raw[a : a + n] for a, n in zip(begin[at].tolist(), size[at].tolist(), strict=True)]))
            entry[short[miss]] = self.parts.find(own)
        long = np.flatnonzero((size > SHORT) & ~alone)
        new = dict.fromkeys(p for i in long if (p := raw[begin[i] : begin[i] + size[i]]) not in self.long)
        if new:
            self.long.update(zip(new, self._learnt(list(new)).tolist(), strict=True))
        for i in long:
            entry[i] = self.long[raw[begin[i] : begin[i] + size[i]]]
        held = self.entries, self.used
        for i in np.flatnonzero(alone):  # not kept
            ids = self.library.encode(raw[begin[i] : begin[i] + size[i]].decode("utf-8", "replace"), add_special_tokens=False).ids
            entry[i] = self._put(np.array(ids, np.int64), np.array([len(ids)]))[0]
        n = self.n[entry]
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum()))
        out = np.full(len(place) + texts, end, np.uint32)
        out[place + np.repeat(of, n)] = self.flat[place + np.repeat(self.start[entry] - before, n)]
        self.entries, self.used = held
        return out, np.concatenate([[0], np.cumsum(np.bincount(of, n, texts).astype(np.int64) + 1)])


ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """A worker's encoder, kept for its next task."""
    if tokenizer not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[tokenizer] = Encoder(tokenizer)
    return ENCODERS[tokenizer]


def word_starts(tokenizer: str) -> np.ndarray:
    """For each id, whether a word begins with it: after a blank or line end."""
    vocabulary = json.loads(tokenizer)["model"]["vocab"]
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        out[i] = token[:1] in "ĠĊ▁"
    return out


def words(ids: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit digest of each word of documents, which end with their end id and have no word there, and its document's number."""
    first = np.concatenate([starts, [False]])[np.minimum(ids, len(starts))]
    first[offsets[:-1]] = True
    last = np.zeros(len(ids), bool)
    last[offsets[1:] - 1] = True
    first |= last
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    within = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
    h = mixed(np.add.reduceat(mixed(ids.astype(np.uint64) + (within.astype(np.uint64) << np.uint64(32)) + np.uint64(1)), at))
    keep = ~last[at]
    return h[keep], (np.searchsorted(offsets, at, "right") - 1)[keep]


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """doc_id, row, ids (binary, 32-bit), n_tokens, place: each document's ids with the end id, and its place by the least digest of its words. tokenizer: the file's text."""
    starts = word_starts(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, starts))
    kind = dict(docs.dtypes)[doc_id]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, starts = encoder(shared.value[0]), shared.value[1]
        for batch, data, at in pieces(batches, "text"):
            ids, offsets = own.encode(data, at, end)
            h, of = words(ids, offsets, starts)
            least = np.full(len(batch), np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, of, h)
            place = (mixed(least) & np.uint64(PLACES - 1)).astype(np.int32)
            size = np.diff(offsets)
            narrow = [ids[offsets[i] : offsets[i + 1]].astype("<u2" if len(starts) <= 1 << 16 else "<u4").tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(narrow, pa.binary()), pa.array(size), pa.array(place)], ["doc_id", "row", "ids", "n_tokens", "place"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(encoded, f"doc_id {kind}, row long, ids binary, n_tokens long, place int")


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """docs with their shard: neighbouring places together up to `size`, a larger place split by row."""
    cost = docs.groupBy("place").agg(F.sum(F.col("n_tokens") + EACH).alias("cost"))  # PLACES rows at most
    before = F.coalesce(F.sum("cost").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = cost.select("place", F.floor(before / size).alias("first"), F.ceil(F.col("cost") / size).alias("split"))
    shard: Column = F.col("first") + F.pmod(F.xxhash64("row"), F.col("split"))
    return docs.join(F.broadcast(first), "place").withColumn("shard", shard).drop("place", "first", "split")


class Index:
    """A BM25 inverted index of a shard's documents."""

    def __init__(self, words_: np.ndarray, of: np.ndarray, n: int):
        known, term = np.unique(words_, return_inverse=True)
        pair, tf = np.unique(term * n + of, return_counts=True)
        term, self.docs = pair // max(n, 1), pair % max(n, 1)
        length = np.bincount(of, minlength=n).astype(float)
        df = np.bincount(term, minlength=len(known))
        self.first = np.concatenate([[0], np.cumsum(df)])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.docs] / max(length.mean() if n else 0, 1)))
        # Each document's most telling words that another one has too
        shared = np.flatnonzero(df[term] > 1)
        shared = shared[np.lexsort((term[shared], -self.weight[shared], self.docs[shared]))]
        self.term, self.begin = term[shared], np.searchsorted(self.docs[shared], np.arange(n + 1))
        self.n = n

    def nearest(self, doc: int, used: np.ndarray, most: int = 64) -> np.ndarray:
        """Unused documents by falling score, those with a word in common only."""
        asked = self.term[self.begin[doc] : min(self.begin[doc + 1], self.begin[doc] + ASKED)]
        if not len(asked):
            return asked
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in asked])
        score = np.bincount(self.docs[at], self.weight[at], minlength=self.n)
        score[used] = 0
        best = np.argpartition(-score, most)[:most] if self.n > most else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]


def filled(sizes: np.ndarray, index: Index, window: int) -> tuple[np.ndarray, list[int]]:
    """The order of the documents, and those of them that are seeds without a part before the window."""
    order, seeds, used, free, fill, seed = [], [], np.zeros(len(sizes), bool), 0, 0, -1
    near: list[int] = []
    sizes = sizes.tolist()
    for _ in range(len(sizes)):
        doc = -1
        if fill:  # the window's seed asks; when its neighbours are used up, the last one placed asks on
            for asking in (seed, order[-1]):
                while near and used[near[-1]]:
                    near.pop()
                if not near:
                    near = index.nearest(asking, used)[::-1].tolist()
                if near:
                    doc = near.pop()
                    break
        if doc < 0:
            while used[free]:
                free += 1
            doc = free
        if not fill:
            seeds.append(doc)
        used[doc] = True
        order.append(doc)
        if not fill or fill + sizes[doc] >= window:  # what is left of it opens the next window
            seed, near = doc, []
        fill = (fill + sizes[doc]) % window
    return np.array(order, np.int64), seeds


def spans(order: np.ndarray, sizes: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """document, start, length, sequence, offset of each piece: windows in turn, the last one in powers of two."""
    total = int(sizes.sum())
    ends, rest = list(range(window, total + 1, window)), total % window
    at = total - rest
    while rest:
        part = 1 << (rest.bit_length() - 1)
        at, rest = at + part, rest - part
        ends.append(at)
    here, sequence, begin = 0, 0, 0
    for doc in order.tolist():
        start, size = 0, int(sizes[doc])
        while start < size:
            n = min(size - start, ends[sequence] - here)
            yield doc, start, n, sequence, here - begin
            start, here = start + n, here + n
            if here == ends[sequence]:
                sequence, begin = sequence + 1, here


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 2048, end: int = 1) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset of each piece. tokenizer: the tokenizer file's text."""
    done = staged(tokenized(docs, tokenizer, doc_id, text, end), "tokens")
    starts = docs.sparkSession.sparkContext.broadcast(word_starts(tokenizer))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        size = group["n_tokens"].to_numpy()
        width = "<u2" if len(starts.value) <= 1 << 16 else "<u4"
        offsets = np.concatenate([[0], np.cumsum(size)])
        ids = np.concatenate([np.frombuffer(x.as_buffer(), width) for x in group["ids"]]).astype("<u4")
        order, _ = filled(size, Index(*words(ids, offsets, starts.value), len(size)), window)
        rows = np.array(list(spans(order, size, window)), np.int64).reshape(-1, 5)
        doc, start, length, sequence, offset = rows.T
        at = offsets[doc] + start
        parts = pa.array([ids[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.binary())
        out = pa.table({"doc_id": group["doc_id"].take(pa.array(doc)), "start": start, "length": length, "ids": parts, "doc_tokens": size[doc], "sequence_id": (group["shard"][0].as_py() << 32) + sequence, "offset": offset})
        freed()
        return out

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return shards(done).groupBy("shard").applyInArrow(pack, schema)
