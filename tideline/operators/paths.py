"""Lookups over several joins, which share the steps they have in common."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.sources.staging import staged

#: A step: the table to go to, and the pairs of columns (here, there) that must be equal.
Step = tuple[str, tuple[tuple[str, str], ...]]


def looked_up(rows: DataFrame, frames: Mapping[str, DataFrame], paths: Mapping[str, tuple[Sequence[Step], str]], how: str = "left") -> DataFrame:
    """rows with a column for each name in paths: the given column of the table at the path's end. Paths with equal first steps share these joins.

    With a left join a row without a partner stays and has NULL; a row with several is repeated for each.
    """
    out, ends = rows, {(): {c: c for c in rows.columns}}
    for steps, _ in paths.values():
        for k in range(1, len(steps) + 1):
            prefix = tuple(steps[:k])
            if prefix in ends:
                continue
            table, pairs = prefix[-1]
            here, there = ends[prefix[:-1]], {c: f"_{len(ends)}_{c}" for c in frames[table].columns}
            on = F.lit(True)
            for a, b in pairs:
                on = on & (F.col(here[a]) == F.col(there[b]))
            out = out.join(frames[table].withColumnsRenamed(there), on, how)
            ends[prefix] = there
    return out.select(*rows.columns, *[F.col(ends[tuple(steps)][column]).alias(name) for name, (steps, column) in paths.items()])


#: Cohorts of up to so many keys are sent to all executors; larger ones are sent as a Bloom filter of at most 2^WORDS 64-bit words (8 MB), and then joined.
SENT, WORDS = 100_000, 20


def _bits(keys: Sequence[Column], words: int) -> list[tuple[Column, Column]]:
    """Word and bit of three hashes of the keys."""
    out = []
    for seed in range(3):
        h = F.xxhash64(F.lit(seed), *keys)
        out.append((F.pmod(F.shiftright(h, 6), F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))))
    return out


def filter_words(n: int) -> int:
    """Words of a filter of n keys: about 16 bits for each, up to the bound."""
    return min(1 << WORDS, 1 << max(6, (n // 4).bit_length()))


def bloom_filter(keys: DataFrame, columns: Sequence[str], words: int) -> DataFrame:
    """One row with the words of a Bloom filter of keys; built by word, so that no task holds all keys."""
    each = F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _bits([F.col(c) for c in columns], words)]))
    set_ = keys.select(each.alias("x")).groupBy("x.w").agg(F.bit_or("x.b").alias("b"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "w").join(set_, "w", "left").select("w", F.coalesce("b", F.lit(0)).alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("_words"))


def kept_by(rows: DataFrame, keys: DataFrame, pairs: Sequence[tuple[str, str]], sent: int = SENT) -> DataFrame:
    """rows whose columns are among the distinct keys, pairs of (rows' column, keys' column); a NULL is in no key.

    Keys are counted first. Few are sent to all executors. Many are sent as a filter that rules out most rows before the shuffle, and then joined exactly.
    """
    k = keys.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]).dropna().distinct()
    n = k.limit(sent + 1).count()
    on = reduce(and_, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(pairs)])
    if n <= sent:
        return rows.join(F.broadcast(k), on, "left_semi")
    k = staged(k, "keys")
    words = filter_words(k.count())
    filter_ = bloom_filter(k, k.columns, words)
    held = reduce(and_, [F.get(F.col("_words"), w.cast("int")).bitwiseAND(b) != 0 for w, b in _bits([F.col(a) for a, _ in pairs], words)])
    return rows.join(F.broadcast(filter_), held, "left_semi").join(k, on, "left_semi")


def of_cohort(rows: DataFrame, frames: Mapping[str, DataFrame], steps: Sequence[Step], column: str, cohort: DataFrame, key: str, sent: int = SENT) -> DataFrame:
    """rows whose lookup path ends in the cohort: `column` of the last table is one of its keys. Each row comes once.

    The path is walked backwards from the cohort: it restricts the last table, whose keys restrict the one before, and so on, so that the large table is read last and
    filtered by keys alone. The rows are those that `looked_up` finds forwards and a join with the cohort keeps.
    """
    reached, there = cohort.select(F.col(key).alias("_c")), "_c"
    wanted: list[tuple[str, str]] = [(column, there)]
    for i in reversed(range(len(steps))):
        table, pairs = steps[i]
        reached = kept_by(frames[table], reached, wanted, sent).select(*dict.fromkeys(b for _, b in pairs))
        wanted = [(a, b) for a, b in pairs]
    return kept_by(rows, reached, wanted, sent)
