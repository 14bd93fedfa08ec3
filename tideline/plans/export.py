"""Rows of chosen episodes, section by section, with an episode number in place of every key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.time import plus
from tideline.operators.ids import numbered
from tideline.operators.intervals import KEY


def by_keys(episodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Episodes whose key is listed."""
    return episodes.join(keys.select(KEY).distinct(), KEY, "left_semi")


def by_subject_dates(episodes: DataFrame, pairs: DataFrame, hours: int = 0, several: str = "all") -> DataFrame:
    """Episodes of a listed subject that start from `hours` before the date to `hours` after its end; pairs are (patient_key, date).

    several: 'all' keeps every episode of a pair with more than one, 'marked' too, with ambiguous = 1; 'none' drops these. An
    episode that several pairs name keeps the smallest pair number.
    """
    if several not in ("all", "marked", "none"):
        raise ValueError(f"several: {several}")
    m = resolved(episodes, pairs, hours)
    if several == "none":
        m = m.where("found = 1")
    out = m.groupBy(KEY).agg(F.min("pair_number").alias("pair_number"), F.max(F.when(F.col("found") > 1, 1).otherwise(0)).alias("ambiguous"))
    out = episodes.join(out, KEY)
    return out if several == "marked" else out.drop("ambiguous")


def _numbered_pairs(pairs: DataFrame) -> DataFrame:
    return numbered(pairs.select("patient_key", "date").distinct(), ["patient_key", "date"], "pair_number")


def resolved(episodes: DataFrame, pairs: DataFrame, hours: int) -> DataFrame:
    """anaesthetic_key, pair_number, found (episodes of the pair)."""
    day = F.col("date").cast("timestamp_ntz")
    start = F.col("start_time")
    m = episodes.join(_numbered_pairs(pairs), "patient_key").where((start >= plus(day, hours=-hours)) & (start < plus(day, hours=24 + hours))).select(KEY, "pair_number")
    n = m.groupBy("pair_number").agg(F.count(F.lit(1)).alias("found"))
    return m.join(n, "pair_number")


def resolution(episodes: DataFrame, pairs: DataFrame, hours: int) -> DataFrame:
    """pairs, to_one, ambiguous, to_none, percent_to_one; counts from 1 to 4 are blank, and so is then the share."""
    n = resolved(episodes, pairs, hours).select("pair_number", "found").distinct()
    one = _numbered_pairs(pairs).join(n, "pair_number", "left").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("found") == 1).alias("to_one"), F.count_if(F.col("found") > 1).alias("ambiguous"), F.count_if(F.col("found").isNull()).alias("to_none")
    )
    blank = one.withColumns({c: F.when(F.col(c).between(1, 4), None).otherwise(F.col(c)) for c in one.columns})
    return blank.withColumn("percent_to_one", F.round(100 * F.try_divide(F.col("to_one"), F.col("pairs")), 0).cast("long"))


@dataclass(frozen=True)
class Section:
    """What of a part is exported: kinds, a window around start or stop in minutes, flags that must be 1, and rows or counts."""

    name: str
    part: str
    time: str | None = None
    kinds: Sequence[str] = ()
    window: tuple[str, int, str, int] | None = None
    flags: Sequence[str] = ()
    aggregate: bool = False


def section(episodes: DataFrame, part: DataFrame, s: Section) -> DataFrame:
    """Rows of the chosen episodes; or rows_charted and anaesthetics, by kind if kinds are named."""
    rows = part
    if s.kinds:
        rows = rows.where(F.col("kind").isin(list(s.kinds)))
    for f in s.flags:
        rows = rows.where(F.col(f) == 1)
    rows = rows.join(episodes.select(KEY, "start_time", "stop_time"), KEY)
    if s.window:
        a, before, b, after = s.window
        t = F.col(s.time)
        rows = rows.where((t >= plus(F.col(f"{a}_time"), minutes=before)) & (t <= plus(F.col(f"{b}_time"), minutes=after)))
    rows = rows.drop("start_time", "stop_time")
    if not s.aggregate:
        return rows
    return rows.groupBy(*(["kind"] if s.kinds else [])).agg(F.count(F.lit(1)).alias("rows_charted"), F.countDistinct(KEY).alias("anaesthetics"))


def derived(episodes: DataFrame, measure: DataFrame, value: str, aggregate: bool = False) -> DataFrame:
    """A measure on the chosen episodes, missing where it has none; or the number of episodes and of those with a value."""
    rows = episodes.select(KEY).join(measure, KEY, "left")
    return rows.agg(F.count(F.lit(1)).alias("anaesthetics"), F.count(value).alias("with_value")) if aggregate else rows


def numbered_episodes(episodes: DataFrame) -> DataFrame:
    """anaesthetic_key and episode, its number by start and key."""
    return numbered(episodes.select(KEY, "start_time"), ["start_time", KEY], "episode").select(KEY, "episode")


def pseudonymised(rows: DataFrame, numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the episode's number first and no key column."""
    out = rows.join(numbers, KEY)
    return out.select("episode", *[c for c in rows.columns if c != KEY and c not in keys])


def sections(episodes: DataFrame, parts: Mapping[str, DataFrame], wanted: Sequence[Section], keys: Sequence[str]) -> dict[str, DataFrame]:
    """A frame for each section, and the private 'episode_key' that must not leave."""
    numbers = numbered_episodes(episodes)
    out = {}
    for s in wanted:
        rows = section(episodes, parts[s.part], s)
        out[s.name] = rows if s.aggregate else pseudonymised(rows, numbers, keys)
    return out | {"episode_key": numbers}


def earliest(episodes: DataFrame, n: int, condition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The n earliest episodes by start and key, and one row that says whether there were more."""
    rows = episodes.where(condition) if condition is not None else episodes
    more = rows.limit(n + 1).agg((F.count(F.lit(1)) > n).alias("limit_reached"))
    return rows.orderBy("start_time", KEY).limit(n), more
