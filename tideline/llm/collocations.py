"""Collocations: phrases of two to four words by language, counted exactly in HAT-tries and scored by their weakest cut.

Counting: a task gives words ids of its own and counts phrases in a HAT-trie. Below a shallow trie of word ids lie hash containers, each for a range of
prefixes; a container that grows too large bursts in two between prefixes (between phrases, where one prefix fills it). When a task holds too many phrases its
largest subtrees leave as sorted runs, and all that is left leaves at its end. Runs of pairs and longer phrases are cut by the hash of language and first three words
(a pair's both) and compressed, with the words themselves; the runs of one prefix partition meet and are added up there. There is a partition for about every
million words of the corpus, and no frequent word or pair fills one.

Phrases are counted in three passes, words, pairs, and three or four words together. A phrase that reaches `least` holds only words and pairs that do, so the
later passes skip places whose words or pairs cannot. What may is known from a sketch of bounded size: it lets some through in vain, and never stops one.

Defined results: a null text is empty; a null lang is `und`. Repeated rows count again. Texts of any length are counted whole, in slices that carry the last words
over. Other columns of documents are not used, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import sketches
from tideline.llm.common import freed, mixed, staged, text_buffer

#: Phrases in a container before it bursts, and in a task before subtrees leave; words that a task knows of a language; bytes of text counted in one step.
BURST, HELD, KNOWN, STEP = 1 << 16, 3_000_000, 1_000_000, 1 << 20
#: Bytes that end a piece, all turned into the last one of them.
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b".........." )
SCHEMA, RUNS = "lang string, phrase string, n long", "part int, lang string, phrases binary, counts binary"
#: Words of the corpus for each prefix partition; rows that one window ranks.
SHARE, RANKED = 1_000_000, 40_000


class Container:
    """Counts by 64-bit key in an open-addressing hash table; 0 is no key."""

    def __init__(self, room: int = 1 << 10):
        self.keys, self.counts, self.size = np.zeros(room, np.uint64), np.zeros(room, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys must differ from one another."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.items()
            self.__init__(1 << (4 * (self.size + len(keys))).bit_length())
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        at = (mixed(keys) & mask).astype(np.int64)
        while len(keys):
            held = self.keys[at]
            same, free = held == keys, held == 0
            self.counts[at[same]] += counts[same]
            self.keys[at[free]] = keys[free]  # of several keys at a free place the last one gets it
            won = free.copy()
            won[free] = self.keys[at[free]] == keys[free]
            self.counts[at[won]] = counts[won]
            self.size += int(won.sum())
            left = ~(same | won)
            keys, counts, at = keys[left], counts[left], (at[left] + 1) & int(mask)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and their counts."""
        at = np.flatnonzero(self.keys)
        at = at[np.argsort(self.keys[at])]
        return self.keys[at], self.counts[at]


class HatTrie:
    """Counts of phrases (prefix << 32 | rest) in burstable containers, each for a range of keys."""

    def __init__(self, burst: int = BURST):
        self.lows, self.parts, self.burst = np.zeros(1, np.uint64), [Container()], burst

    def __len__(self) -> int:
        return sum(p.size for p in self.parts)

    def add(self, keys: np.ndarray) -> None:
        """keys in any order, each as often as it occurs."""
        keys, counts = np.unique(keys, return_counts=True)
        cuts = [*np.searchsorted(keys, self.lows), len(keys)]
        for i in reversed(range(len(self.parts))):
            if cuts[i] < cuts[i + 1]:
                self.parts[i].add(keys[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]])
                if self.parts[i].size > self.burst:
                    self._burst(i)

    def _burst(self, i: int) -> None:
        keys, counts = self.parts[i].items()
        shift, middle = np.uint64(32), len(keys) // 2
        cut = int(np.searchsorted(keys, (keys[middle] >> shift) << shift)) or int(np.searchsorted(keys >> shift, keys[middle] >> shift, "right"))
        cut = cut if 0 < cut < len(keys) else middle
        halves = [Container(), Container()]
        halves[0].add(keys[:cut], counts[:cut])
        halves[1].add(keys[cut:], counts[cut:])
        self.parts[i : i + 1] = halves
        self.lows = np.insert(self.lows, i + 1, keys[cut])

    def spilled(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the largest subtrees, until at most `keep` phrases are left."""
        left = len(self)
        for i in sorted(range(len(self.parts)), key=lambda i: -self.parts[i].size):
            if left <= keep:
                return
            if self.parts[i].size:
                left -= self.parts[i].size
                yield self.parts[i].items()
                self.parts[i] = Container()


class Ids(dict):
    """Ids of words from 1 as they come; the piece's end is 0."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.words)
        self.words.append(word)
        return out


def digest(lang: str | None, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang or ""))


def pair_digest(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(3) + mixed(second))


class Counted:
    """What a task has counted of one language."""

    def __init__(self, lang: str, level: int, sieves: list[np.ndarray], parts: int):
        self.lang, self.level, self.sieves, self.parts, self.total = lang, level, sieves, parts, 0
        self.new()

    def new(self) -> None:
        self.ids, self.pairs, self.pair_words = Ids(), {}, []
        self.single = np.zeros(1 << 10, np.int64)
        self.hashes, self.fits = np.zeros(1, np.uint64), np.zeros(1, bool)
        self.tries = [HatTrie(), HatTrie()]

    def take(self, text: bytes, carry: np.ndarray) -> np.ndarray:
        """Count the phrases that end in text; carry is the up to three ids before it, and the last ones are returned."""
        words = text.lower().translate(ENDS).replace(b".", b" . ").split()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if self.level == 1:
            n = np.bincount(ids, minlength=1)
            if len(n) > len(self.single):
                self.single = np.concatenate([self.single, np.zeros(2 * len(n) - len(self.single), np.int64)])
            self.single[: len(n)] += n
            self.total += len(ids) - int(n[0])
            return carry
        if len(self.hashes) < len(self.ids.words):
            new = np.fromiter((digest(self.lang, w) for w in self.ids.words[len(self.hashes) :]), np.uint64)
            self.hashes, self.fits = np.concatenate([self.hashes, new]), np.concatenate([self.fits, sketches.estimate(self.sieves[0], new) > 0])
        a = np.concatenate([carry, ids])
        a, last = np.where(self.fits[a], a, 0).astype(np.uint64), a[-3:]
        k, shift = len(carry), np.uint64(32)
        pair = (a[:-1] > 0) & (a[1:] > 0)
        if self.level == 2:
            at = np.flatnonzero(pair)
            at = at[at + 1 >= k]
            self.tries[0].add(a[at] << shift | a[at + 1])
            return last
        at = np.flatnonzero(pair)
        pair[at] = sketches.estimate(self.sieves[1], pair_digest(self.hashes[a[at]], self.hashes[a[at + 1]])) > 0
        three = pair[:-1] & pair[1:]
        four = np.flatnonzero(three[:-1] & three[1:])
        three, four = (x[x + n - 1 >= k] for x, n in ((np.flatnonzero(three), 3), (four, 4)))
        heads, at = np.unique(np.concatenate([three, four, four + 2]), return_inverse=True)
        whole, back = np.unique(a[heads] << shift | a[heads + 1], return_inverse=True)
        number = np.empty(len(whole), np.uint64)
        for i, x in enumerate(whole.tolist()):
            if x not in self.pairs:
                self.pairs[x] = len(self.pair_words) + 1
                self.pair_words.append(x)
            number[i] = self.pairs[x]
        p = number[back][at]
        self.tries[0].add(p[: len(three)] << shift | a[three + 2])
        self.tries[1].add(p[len(three) : len(three) + len(four)] << shift | p[len(three) + len(four) :])
        return last

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs, as rows of language, phrase and count, until at most `keep` phrases are left."""
        words = pa.array(self.ids.words, pa.binary())
        low = np.uint64(0xFFFFFFFF)

        def rows(parts: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
            """The run cut by prefix partition; each part's phrases end to end, a line end after each."""
            h = [self.hashes[p.astype(np.int64)] for p in parts[:3]]
            of = pair_digest(h[0], h[1]) if len(h) < 3 else pair_digest(pair_digest(h[0], h[1]), h[2])
            of = (mixed(of) & np.uint64(self.parts - 1)).astype(np.int32)
            order = np.argsort(of, kind="stable")
            own, first = np.unique(of[order], return_index=True)
            cut = [*first.tolist(), len(order)]
            texts = [words.take(pa.array(p[order].astype(np.int64))) for p in parts]
            phrase = pa.compute.binary_join_element_wise(pa.compute.binary_join_element_wise(*texts, b" "), pa.scalar(b""), b"\n").cast(pa.large_binary())
            at, raw, n = np.frombuffer(phrase.buffers()[1], np.int64), phrase.buffers()[2], counts[order].astype("<u8")
            packed = [[pa.compress(x, "zstd", asbytes=True) for x in (raw.slice(at[a], at[b] - at[a]), n[a:b].tobytes())] for a, b in zip(cut, cut[1:], strict=False)]
            size = [int(b - a).to_bytes(8, "little") + int(at[b] - at[a]).to_bytes(8, "little") for a, b in zip(cut, cut[1:], strict=False)]
            columns = [pa.array(own, pa.int32()), pa.array([self.lang] * len(own), pa.string()), pa.array([s + x[0] for s, x in zip(size, packed, strict=True)], pa.binary()), pa.array([x[1] for x in packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "lang", "phrases", "counts"])

        if self.level == 1:
            at = np.flatnonzero(self.single[1:]) + 1
            for a in range(0, len(at), 1 << 16):
                own = at[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(own), pa.string()), words.take(pa.array(own)).cast(pa.string()), pa.array(self.single[own])], ["lang", "phrase", "n"])
            if self.total:
                yield pa.RecordBatch.from_arrays([pa.array([self.lang]), pa.array([None], pa.string()), pa.array([self.total], pa.int64())], ["lang", "phrase", "n"])
            self.total, self.single[:] = 0, 0
            return
        pairs = np.array([0, *self.pair_words], np.uint64)
        for k, trie in enumerate(self.tries):
            for keys, counts in trie.spilled(keep):
                head, rest = keys >> np.uint64(32), keys & low
                if self.level == 2:
                    yield rows([head, rest], counts)
                else:
                    first, more = pairs[head.astype(np.int64)], [rest]
                    if k:
                        more = [pairs[rest.astype(np.int64)] >> np.uint64(32), pairs[rest.astype(np.int64)] & low]
                    yield rows([first >> np.uint64(32), first & low, *more], counts)


def slices(text: bytes, most: int = STEP) -> Iterator[bytes]:
    """text in slices of about `most` bytes, cut at blanks or piece ends only."""
    a = 0
    while len(text) - a > most:
        b = max(text.rfind(c, a, a + most) for c in (b" ", b"\t", b"\n", b".", b","))
        if b < a:  # a word longer than a slice
            b = min((x for c in (b" ", b"\t", b"\n", b".", b",") if (x := text.find(c, a + most)) >= 0), default=len(text) - 1)
        yield text[a : b + 1]
        a = b + 1
    yield text[a:]


def counts(level: int, sieves: list, parts: int, batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Runs of the phrases of a level in a task's texts, with at most `held` phrases kept."""
    own, none, sieves = {}, np.zeros(0, np.int64), [s.value for s in sieves]

    def tidy() -> Iterator[pa.RecordBatch]:
        for c in own.values():
            if len(c.ids.words) > KNOWN:
                yield from c.runs(0)
                c.new()
        if sum(len(t) for c in own.values() for t in c.tries) > held:
            for c in own.values():
                yield from c.runs(held // (4 * len(own)))

    try:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            codes = batch.column(1).dictionary_encode()
            of, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(of):
                c = own.get(lang) or own.setdefault(lang, Counted(lang, level, sieves, parts))
                block, size = [], 0
                for i in np.flatnonzero(at == code):
                    n = offsets[i + 1] - offsets[i]
                    if n > STEP:
                        carry = none
                        for part in slices(data[offsets[i] : offsets[i + 1]].tobytes()):
                            carry = c.take(part, carry)
                            yield from tidy()
                    elif n:
                        block.append(data[offsets[i] : offsets[i + 1]].tobytes())
                        size += n
                    if size >= STEP:
                        c.take(b".".join(block), none)
                        block, size = [], 0
                        yield from tidy()
                if block:
                    c.take(b".".join(block), none)
                    yield from tidy()
        for c in own.values():
            yield from c.runs(0)
    finally:
        own.clear()
        freed()


def merged(docs: DataFrame, level: int, sieves: list, least: int, words: int) -> DataFrame:
    """lang, phrase, n of the phrases of a level that occur `least` times; runs are added up by prefix partition. words: of the corpus."""
    parts = 1 << (words // SHARE).bit_length()
    runs = docs.mapInArrow(lambda batches: counts(level, sieves, parts, batches), RUNS)

    def added(group: pa.Table) -> pa.Table:
        phrases, n = [], []
        for x, c in zip(group["phrases"], group["counts"], strict=True):
            x = x.as_buffer()
            many, size = (int.from_bytes(x[a : a + 8].to_pybytes(), "little") for a in (0, 8))
            raw = pa.decompress(x.slice(16), size, "zstd")
            at = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1])
            phrases.append(pa.Array.from_buffers(pa.large_binary(), many, [None, pa.py_buffer(at.astype(np.int64)), raw]))
            n.append(pa.Array.from_buffers(pa.int64(), many, [None, pa.decompress(c.as_buffer(), 8 * many, "zstd")]))
        sums = pa.table({"phrase": pa.chunked_array(phrases), "n": pa.chunked_array(n)}).group_by("phrase").aggregate([("n", "sum")])
        sums = sums.filter(pa.compute.greater_equal(sums["n_sum"], least))
        phrase = pa.compute.binary_slice(sums["phrase"].cast(pa.binary()), 0, -1).cast(pa.string())
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * len(sums), pa.string()), "phrase": phrase, "n": sums["n_sum"]})

    return runs.groupBy("part", "lang").applyInArrow(added, SCHEMA)


def sieve(frequent: DataFrame) -> np.ndarray:
    """A sketch of frequent words or pairs."""

    def digests(batch: pa.RecordBatch) -> np.ndarray:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
        parts = [[digest(lang, w) for w in phrase.split(b" ")] for lang, phrase in rows]
        h = np.array(parts, np.uint64).reshape(len(parts), -1)
        return h[:, 0] if h.shape[1] == 1 else pair_digest(h[:, 0], h[:, 1]) if len(h) else np.zeros(0, np.uint64)

    return sketches.gathered(frequent.select("lang", "phrase"), digests, sketches.cells_for(frequent.count()), 1)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n, words) of one to four words that occur `least` times or more, and (lang, n) with all word occurrences of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    each = rows.mapInArrow(lambda batches: counts(1, [], 1, batches), SCHEMA).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = staged(each.where(F.col("phrase").isNull() | (F.col("n") >= least)), "words")
    totals = words.where("phrase IS NULL").select("lang", "n")
    total = int(totals.agg(F.sum("n")).first()[0] or 0)
    words = words.where("phrase IS NOT NULL")
    sieves = [spark.sparkContext.broadcast(sieve(words))]
    pairs = staged(merged(rows, 2, sieves, least, total), "pairs")
    sieves.append(spark.sparkContext.broadcast(sieve(pairs)))
    longer = staged(merged(rows, 3, sieves, least, total), "longer")
    return words.union(pairs).union(longer).withColumn("words", F.size(F.split("phrase", " "))), totals


def exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, scale: int = 2_000_000, inside: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to four words.

    a is the phrase's count and l and r those of its parts at the cut with the lowest score floor(scale * a / (l + r)), the earliest of equal ones. A phrase goes
    if a longer one that occurs `least` times holds it and has at least `inside` per cent of its count.
    """
    phrases, totals = frequent_phrases(docs, text, lang, least)
    found = phrases.where("words > 1").withColumnRenamed("n", "a")
    # Cuts: both parts occur at least as often as the whole, so they are among the frequent phrases
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left, right = (phrases.select("lang", F.col("phrase").alias(p), F.col("n").alias(n)) for p, n in (("first", "l"), ("rest", "r")))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(f"CAST({scale} * CAST(a AS DECIMAL(28,0)) AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0)))")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # Phrases inside longer ones
    inner = found.where("words > 2").select("lang", "a", F.explode(F.when(F.col("words") == 3, F.expr("transform(sequence(0, 1), i -> array(i, 2))")).otherwise(F.expr("array(array(0, 2), array(1, 2), array(2, 2), array(0, 3), array(1, 3))"))).alias("p"), F.split("phrase", " ").alias("w"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("p")[0] + 1, F.col("p")[1]), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * exact("longer") < inside * exact("a"))).drop("longer")
    kept = staged(kept, "collocations")
    # The first of each language among the first of each share of it, so that no language is sorted by one task
    best, few, n = (F.desc("score"), F.desc("a"), F.asc("phrase")), kept, kept.count()
    while n > RANKED:
        salted = few.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(1 + n // RANKED)))
        few = staged(salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top).drop("salt", "place"), "few")
        before, n = n, few.count()
        if n == before:
            break
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals.withColumnRenamed("n", "_n")) if totals.limit(10_001).count() <= 10_000 else totals.withColumnRenamed("n", "_n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("_n").alias("n"), "score")
