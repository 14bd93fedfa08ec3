"""Standard counts of coverage, and findings of years that stand out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.time import seconds_between
from tideline.operators.intervals import KEY


def coverage_by_year(subjects: DataFrame, episodes: DataFrame, readings: DataFrame, mean_kinds: Sequence[str]) -> DataFrame:
    """Episodes by year of start, and how many have a subject, birth date, stop, reading, and accepted mean."""
    mean = F.col("kind").isin(list(mean_kinds)) & (F.col("accepted") == 1) & F.col("value").isNotNull()
    by_key = readings.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(mean).alias("means"))
    people = subjects.select("patient_key", F.lit(1).alias("known"), "birth_date").dropDuplicates(["patient_key"])
    rows = episodes.join(people, "patient_key", "left").join(by_key, KEY, "left")
    n = lambda c: F.count_if(c).alias
    return rows.groupBy(F.year("start_time").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("episodes"), n(F.col("known").isNotNull())("with_subject"), n(F.col("birth_date").isNotNull())("with_birth_date"),
        n(F.col("stop_time").isNotNull())("with_stop"), n(F.coalesce("n", F.lit(0)) > 0)("with_reading"), n(F.coalesce("means", F.lit(0)) > 0)("with_mean"),
    )


def repeated_keys(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each named frame (frame, key column): keys that several rows hold, and these rows."""
    out = None
    for name, (df, key) in frames.items():
        many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        one = many.agg(F.lit(name).alias("frame"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def readings_by_kind(readings: DataFrame, episodes: DataFrame) -> DataFrame:
    """By kind and year: readings, accepted, with a value, and with an episode."""
    keys = episodes.select(KEY, F.lit(1).alias("held")).distinct()
    return readings.join(keys, KEY, "left").groupBy("kind", F.year("reading_time").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.col("accepted") == 1).alias("accepted"), F.count_if(F.col("value").isNotNull()).alias("with_value"),
        F.count_if(F.col("held").isNotNull()).alias("with_episode"),
    )


def empty_by_reason(readings: DataFrame, text: str = "value_text") -> DataFrame:
    """By kind: why a reading does not count: nothing held, text that is no number, or not accepted."""
    empty = F.col("value").isNull()
    return readings.groupBy("kind").agg(
        F.count_if(empty & F.col(text).isNull()).alias("not_held"), F.count_if(empty & F.col(text).isNotNull()).alias("not_a_number"), F.count_if(F.col("accepted") == 0).alias("not_accepted"),
    )


def band_of(value: Column, bands: Sequence[tuple[int, str]], last: str) -> Column:
    """Label of the first band whose upper bound the value stays below."""
    out = F
    for below, label in bands:
        out = out.when(value < below, F.lit(label))
    return out.otherwise(F.lit(last))


# Bands of seconds between readings, as labels of the result
GAP_BANDS = ((1, "the same time"), (120, "under 2 minutes"), (301, "2 to 5 minutes"), (901, "over 5 and up to 15 minutes"))


def gaps(readings: DataFrame, mean_kinds: Sequence[str], bands: Sequence[tuple[int, str]] = GAP_BANDS, last: str = "over 15 minutes") -> DataFrame:
    """Gaps between consecutive mean pressures of an episode and kind, accepted or not, by kind, year and band."""
    own = Window.partitionBy(KEY, "kind").orderBy("reading_time")
    rows = readings.where(F.col("kind").isin(list(mean_kinds)) & F.col("reading_time").isNotNull()).withColumn("before", F.lag("reading_time").over(own)).where("before IS NOT NULL")
    rows = rows.withColumn("band", band_of(seconds_between(F.col("before"), F.col("reading_time")), bands, last))
    return rows.groupBy("kind", F.year("reading_time").cast("long").alias("year"), "band").agg(F.count(F.lit(1)).alias("gaps"))


def outside(readings: DataFrame, episodes: DataFrame, mean_kinds: Sequence[str]) -> DataFrame:
    """By year of start: mean pressures of an episode, those before its start and those after its stop."""
    rows = readings.where(F.col("kind").isin(list(mean_kinds))).join(episodes.where("start_time IS NOT NULL").select(KEY, "start_time", "stop_time"), KEY)
    t = F.col("reading_time")
    return rows.groupBy(F.year("start_time").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(t < F.col("start_time")).alias("before_start"), F.count_if(t > F.col("stop_time")).alias("after_stop")
    )


def cliffs(counts: DataFrame, total: str, figures: Sequence[str], period: str = "year", fraction: float = 0.5, shortfall: int = 10, step: int = 1) -> DataFrame:
    """Periods whose share of a figure is at most `fraction` of the best period's and at least `shortfall` rows short of it: period, figure, share, best.

    With counts floored to `step` shares are compared at the bounds that flooring allows: the highest this period can have against the lowest of the best.
    Counts have a row for each period, so that the windows are over a small result.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), F.col(f).alias("n")) for f in figures]))
    rows = counts.select(period, F.col(total).alias("total"), pairs.alias("p")).select(period, "total", "p.*").where("total > 0")
    high = F.least((F.col("n") + step - 1) / F.col("total"), F.lit(1.0))
    low = F.col("n") / (F.col("total") + step - 1)
    rows = rows.withColumns({"share": F.col("n") / F.col("total"), "_high": high, "_low": low}).withColumn("best", F.max("_low").over(Window.partitionBy("figure")))
    short = (F.col("best") - F.col("_high")) * F.col("total")
    return rows.where((F.col("_high") <= fraction * F.col("best")) & (short >= shortfall)).select(period, "figure", "share", "best")


def changed_bands(gaps: DataFrame, bands: Sequence[str], kind: str = "kind", period: str = "year") -> DataFrame:
    """kind, year, band, usual: years whose commonest band of gaps is not the band that is commonest in most of the kind's years. gaps: (kind, year, band, gaps).

    Of equally common bands the earlier one of `bands` counts, in a year and over the years; bands that are not listed come last, by name. Both are
    maxima within groups, so that nothing is sorted.
    """
    order = F.coalesce(F.try_element_at(F.create_map(*[x for i, b in enumerate(bands) for x in (F.lit(b), F.lit(-i))]), F.col("band")), F.lit(-len(bands)))
    year = gaps.where(F.col(period).isNotNull() & F.col("band").isNotNull()).groupBy(kind, period, "band").agg(F.sum("gaps").alias("n")).withColumn("_o", order)
    name = F.col("band")  # names fall after the order of bands, smallest first
    mode = year.groupBy(kind, period, "_o").agg(F.max("n").alias("n"), F.min_by(name, F.struct(-F.col("n"), name)).alias("band")).groupBy(kind, period).agg(F.max_by("band", F.struct("n", "_o")).alias("band"))
    votes = mode.groupBy(kind, "band").agg(F.count(F.lit(1)).alias("years")).withColumn("_o", order)
    votes = votes.groupBy(kind, "_o").agg(F.max("years").alias("years"), F.min_by(name, F.struct(-F.col("years"), name)).alias("band"))
    usual = votes.groupBy(F.col(kind).alias("_k")).agg(F.max_by("band", F.struct("years", "_o")).alias("usual"))
    return mode.join(usual, F.col(kind).eqNullSafe(F.col("_k"))).where("band <> usual").select(kind, period, "band", "usual")


def outside_shares(outside_counts: DataFrame, period: str = "year", most: float = 0.25) -> DataFrame:
    """Periods whose share of readings before the start or after the stop lies `most` or more above the least share: period, share, least."""
    rows = outside_counts.where("readings > 0").withColumn("share", (F.col("before_start") + F.col("after_stop")) / F.col("readings"))
    rows = rows.withColumn("least", F.min("share").over(Window.partitionBy(F.lit(1))))  # a row for each period
    return rows.where(F.col("share") - F.col("least") >= most).select(period, "share", "least")


def absent_kinds(readings: DataFrame, coverage: DataFrame, mean_kinds: Sequence[str], least: int = 10) -> DataFrame:
    """kind, year: years of `least` or more episodes in which a mean kind that other years hold has no reading. coverage: (year, episodes)."""
    held = readings.where(F.col("kind").isin(list(mean_kinds)) & F.col("reading_time").isNotNull()).select("kind", F.year("reading_time").cast("long").alias("year")).distinct()
    years = coverage.where(F.col("episodes") >= least).select("year")
    return held.select("kind").distinct().join(F.broadcast(years), how="cross").join(held, ["kind", "year"], "left_anti")  # a few kinds by a few years


def shares(counts: DataFrame, total: str, figures: Sequence[str]) -> DataFrame:
    """Each figure as whole per cents of the total; NULL for an empty group."""
    return counts.select(*[c for c in counts.columns if c not in figures], *[F.round(100 * F.try_divide(F.col(f), F.col(total)), 0).cast("long").alias(f"{f}_percent") for f in figures])


def with_coverage(coverage: DataFrame, flagged: DataFrame, empty_by_year: DataFrame, period: str = "year", most_blank: int = 4) -> DataFrame:
    """Coverage of each period with whether it is flagged and how many results without a reading fall in it, blanked if few."""
    years = flagged.select(period).distinct().withColumn("flagged", F.lit(True))
    out = coverage.join(years, period, "left").join(empty_by_year.withColumnRenamed("anaesthetics", "without_reading"), period, "left")
    n = F.coalesce("without_reading", F.lit(0))
    return out.withColumns({"flagged": F.coalesce("flagged", F.lit(False)), "without_reading": F.when(n.between(1, most_blank), None).otherwise(n)})
