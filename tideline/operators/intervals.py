"""Episodes, their windows, and readings that stand until the next one.

Windows are by episode; readings that feed several measures can be repartitioned by episode key once. No operator here
collects, and each sorts only within an episode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.time import micros_between, plus, seconds_between

KEY = "anaesthetic_key"


def eligible(episodes: DataFrame, subjects: DataFrame) -> DataFrame:
    """Episodes of subjects that are no test, with a start, and with no stop before it; subject columns come along."""
    people = subjects.where("is_test = 0")
    return episodes.join(people, "patient_key").where("start_time IS NOT NULL AND (stop_time IS NULL OR stop_time >= start_time)")


def windowed(episodes: DataFrame, from_minutes: int = 0, until_minutes: int | None = None) -> DataFrame:
    """Adds window_from and window_until: the stop, or so many minutes after the start if that is earlier or no stop is known."""
    start, stop = F.col("start_time"), F.col("stop_time")
    until = stop if until_minutes is None else F.least(stop, plus(start, minutes=until_minutes))  # least skips a missing stop
    return episodes.withColumns({"window_from": plus(start, minutes=from_minutes), "window_until": until})


def readings_within(windows: DataFrame, readings: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Accepted readings with a value inside the window of their episode, both ends included; an unknown end is open."""
    good = readings.where("accepted = 1 AND value IS NOT NULL")
    if kinds is not None:
        good = good.join(F.broadcast(kinds), "kind")  # a parameter table of a few rows
    inside = (F.col("reading_time") >= F.col("window_from")) & (F.col("window_until").isNull() | (F.col("reading_time") <= F.col("window_until")))
    return windows.join(good, KEY).where(inside)


def best_at_time(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = (KEY, "reading_time")) -> DataFrame:
    """One row for each episode and time: the first in the given order."""
    first = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


def until_next(rows: DataFrame, last: Column, by: Sequence[str] = (KEY,), time: str = "reading_time", name: str = "until_time") -> DataFrame:
    """Adds the time of the next row of the same keys, or `last` for the last one."""
    return rows.withColumn(name, F.coalesce(F.lead(time).over(Window.partitionBy(*by).orderBy(time)), last))


def banded(rows: DataFrame, bands: DataFrame, value: str, low: str = "from_days", high: str = "until_days") -> DataFrame:
    """Left join to the band that holds a value; an open upper end is NULL. Bands are a parameter table of a few rows."""
    inside = (F.col(value) >= F.col(low)) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    return rows.join(F.broadcast(bands), inside, "left").drop(low, high)


def capped_seconds(a: Column, b: Column, most_minutes: int) -> Column:
    """Seconds from a to b, at most so many minutes."""
    return F.least(seconds_between(a, b), F.lit(60 * most_minutes))


def minutes(seconds: Column) -> Column:
    return seconds.cast("double") / 60.0


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool = False, ahead: bool = False) -> DataFrame:
    """For every row of left the latest row of right at or before its time, or the earliest at or after it: right's time and values, NULL without one.

    With `strict` a row of right at the same time does not count. Both sides are united and a running last value is taken, which is linear where an inequality join is
    quadratic. Right rows must be unique by keys and time; rows of either side without a time or a key find nothing and are not found.
    """
    names = [*values, right_time]
    packed = F.struct(*[F.col(c) for c in names])
    known = F.lit(True)
    for c in (*by, right_time):
        known = known & F.col(c).isNotNull()
    events = left.withColumns({"_side": F.lit(0 if strict else 2), "_at": F.col(left_time), "_held": F.lit(None).cast(right.select(packed.alias("p")).schema[0].dataType)})
    held = right.where(known).select(*by, F.lit(1).alias("_side"), F.col(right_time).alias("_at"), packed.alias("_held"))
    order = F.desc_nulls_first("_at") if ahead else F.asc_nulls_first("_at")
    run = Window.partitionBy(*by).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.unionByName(held, allowMissingColumns=True).withColumn("_held", F.last("_held", ignorenulls=True).over(run)).where("_side <> 1")
    return out.select(*left.columns, *[F.col(f"_held.{c}").alias(c) for c in names if c not in left.columns])


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], before_minutes: int | None = None, after_minutes: int | None = None, side: str = "either") -> DataFrame:
    """For every row of left the nearest row of right before its time, after it, or on either side: right's time and values, NULL without one near enough.

    A row at the same time is on both sides; of two at equal distance the earlier counts. Distances are taken to the microsecond. Both sides are united once, and a running last value is
    taken in either direction, so that no pair of rows is made. Right rows must be unique by keys and time.
    """
    names = [*values, right_time]
    packed = F.struct(*[F.col(c) for c in names])
    kind = right.select(packed.alias("p")).schema[0].dataType
    events = left.withColumns({"_side": F.lit(1), "_at": F.col(left_time), "_row": F.lit(None).cast(kind)})
    rows = events.unionByName(right.select(*by, F.lit(0).alias("_side"), F.col(right_time).alias("_at"), packed.alias("_row")), allowMissingColumns=True)
    past = Window.unboundedPreceding
    back = Window.partitionBy(*by).orderBy(F.asc("_at"), "_side").rowsBetween(past, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_at"), "_side").rowsBetween(past, 0)
    found = rows.withColumns({"_b": F.last("_row", ignorenulls=True).over(back), "_a": F.last("_row", ignorenulls=True).over(ahead)}).where("_side = 1")
    t = F.col(left_time)
    gap_b, gap_a = micros_between(F.col(f"_b.{right_time}"), t), micros_between(t, F.col(f"_a.{right_time}"))
    near_b = gap_b <= 60_000_000 * before_minutes if before_minutes is not None else gap_b.isNotNull()
    near_a = gap_a <= 60_000_000 * after_minutes if after_minutes is not None else gap_a.isNotNull()
    b, a = (F.when(near, F.col(c)) for near, c in ((near_b, "_b"), (near_a, "_a")))
    if side == "either":
        hit = F.when(near_b & (~F.coalesce(near_a, F.lit(False)) | (gap_b <= gap_a)), F.col("_b")).otherwise(a)
    else:
        hit = b if side == "before" else a
    return found.withColumn("_hit", hit).select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in names if c not in left.columns])


def superseded(rows: DataFrame, key: str, amends: str) -> DataFrame:
    """Rows that no other row amends."""
    gone = rows.where(F.col(amends).isNotNull()).select(F.col(amends).alias(key)).distinct()
    return rows.join(gone, key, "left_anti")


def one_concept(mapping: DataFrame) -> DataFrame:
    """One row for each local key: its concept if it has one mapped row alone, otherwise 0, and 'ambiguous' for several rows."""
    n = F.count(F.lit(1))
    concept = F.when((n == 1) & (F.max("status") == "mapped"), F.max("concept_id")).otherwise(F.lit(0))
    return mapping.groupBy("local_key").agg(concept.cast("long").alias("concept_id"), F.when(n > 1, F.lit("ambiguous")).otherwise(F.max("status")).alias("status"))
