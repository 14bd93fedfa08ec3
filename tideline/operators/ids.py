"""Numbers along a total order without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, pairwise
from operator import and_
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tideline.sources.staging import staged


LEAST_IN_RANGE, MOST_IN_RANGE = 20_000, 500_000  # rows of the frame that the ranges are made on
SAMPLED = 1_000_000


@dataclass(frozen=True)
class Ranges:
    """Ranges of a key, each but the first with its least key.

    Frames that are dealt by the same ranges join by `_range` and the key without being dealt again, and lie in the key's order: rows whose order begins with that key are
    numbered without a sample, for which what stands below a range is run twice, and without a second shuffle. Equal keys are in one range. Any least keys are right; they should
    only leave about as many rows in each range.
    """

    least: Sequence

    @staticmethod
    def _size(rows: DataFrame) -> tuple[int, int]:
        count = rows.count()
        most = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // MOST_IN_RANGE))
        return count, max(-(-count // most), LEAST_IN_RANGE)

    @staticmethod
    def numbered(rows: DataFrame, key: str, number: str) -> Ranges:
        """Ranges of a key along which rows are numbered already."""
        _, step = Ranges._size(rows)
        least = rows.where(((F.col(number) - 1) % step == 0) & (F.col(number) > 1) & F.col(key).isNotNull())
        return Ranges([r[0] for r in least.select(key).distinct().orderBy(key).collect()])

    @staticmethod
    def estimated(rows: DataFrame, key: str) -> Ranges:
        """Ranges of a whole number that hardly repeats, by percentiles of up to about a million rows."""
        count, step = Ranges._size(rows)
        parts = -(-count // step)
        if parts < 2:
            return Ranges([])
        found = rows.sample(min(1.0, SAMPLED / count), seed=1).agg(F.percentile_approx(key, [k / parts for k in range(1, parts)])).first()[0]
        return Ranges(sorted(set(found or [])))

    def rest(self, key: Column) -> Column:
        """What follows in a text key after that with which all keys of its `_range` begin: it sorts alike, and by its first bytes."""
        alike = [0, *[len(commonprefix(pair)) for pair in pairwise(self.least)], 0]
        return F.substring(key, F.get(F.lit(alike), F.col("_range")) + 1, F.lit((1 << 31) - 1))

    def placed(self, df: DataFrame, key: str) -> DataFrame:
        """df with the number of its key's range, found by halving."""
        n, least = len(self.least), F.lit(self.least)
        df = df.withColumn("_range", F.lit(0))
        for step in (1 << k for k in reversed(range(n.bit_length()))):
            df = df.withColumn("_range", F.col("_range") + F.when(F.get(least, F.col("_range") + (step - 1)) <= F.col(key), step).otherwise(0))
        return df

    def dealt(self, df: DataFrame) -> DataFrame:
        """df, which has its ranges' numbers, with a partition for each range."""
        return df.repartitionById(len(self.least) + 1, F.col("_range"))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "id", start: int = 1, out: Sequence[Column | str] | None = None, dealt: Ranges | None = None) -> DataFrame:
    """df with consecutive whole numbers along `order`; with `out`, the number and these columns of df alone, so that the others are not moved.

    Rows are ranged over partitions by the order, sorted there and written once with their places; counts by partition, one row each, give every partition its
    first number, which the rows' readers add without a join, and only where they want it. Numbers depend on the order alone, not on the partitions, if it has no ties.
    The result reads the written rows: it need not be staged again. Rows that are `dealt` by ranges of the order's first column are not ranged again.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    own = [c for c in df.columns if c != name and not (dealt and c == "_range")] if out is None else [*out]
    at = F.monotonically_increasing_id()  # the partition above the lower 33 bits, the place in it from 0
    ranges = [F.col("_range")] if dealt else []
    if dealt is None:
        placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    else:
        text = isinstance(df.select(columns[0]).schema[0].dataType, StringType)
        placed = df.sortWithinPartitions(*([dealt.rest(columns[0]), *columns[1:]] if text else columns))
    ranged = staged(placed.select(*own, *ranges, at.alias("_at")), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    found = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)), *[f(r) for r in ranges for f in (F.min, F.max)]).collect()  # a row for each partition
    if dealt and any(a[3] >= b[2] for a, b in pairwise(sorted(found))):
        raise ValueError(f"{name}: rows are not in partitions by range")
    counts = {r[0]: r[1] for r in found}
    firsts = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=0)))]
    first = F.get(F.expr(f"array({', '.join(f'{n}L' for n in firsts)})"), part.cast("int"))
    numbers = ranged.withColumn(name, (first + place + F.lit(start)).cast("long")).drop("_at", *(["_range"] if dealt else []))
    return numbers if out is None else numbers.select(name, *[c for c in numbers.columns if c != name])


def unnumbered(df: DataFrame, order: Sequence[Column | str], name: str = "id", start: int = 1, out: Sequence[Column | str] | None = None, dealt: Ranges | None = None) -> DataFrame:
    """The rows of `numbered` without their numbers, for readers that do not want them: nothing is ranged, sorted or written."""
    return df if out is None else df.select(*out)


def dense_numbered(df: DataFrame, keys: Sequence[str], name: str = "id", start: int = 1) -> DataFrame:
    """df with the place of its keys among the distinct keys; a NULL is a value of its own and comes first."""
    numbers = numbered(df.select(*keys).distinct(), keys, name, start)
    numbers = numbers.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(and_, [df[k].eqNullSafe(numbers[f"_key_{k}"]) for k in keys])
    return df.join(numbers, same).drop(*[f"_key_{k}" for k in keys])
