"""Measures over subjects, episodes and readings. Unknown is NULL, never zero: no stop, no reading or no band gives NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.time import days_between, plus, seconds_between
from tideline.operators.intervals import KEY, as_of, banded, best_at_time, capped_seconds, eligible, minutes, one_concept, readings_within, superseded, until_next, windowed


def _last(stop: str = "stop_time", until: str = "window_until") -> Column:
    """Until when the last reading stands: the window's end, but unknown without a stop."""
    return F.when(F.col(stop).isNotNull(), F.col(until))


def check_bands(bands: DataFrame) -> None:
    """Refuse overlapping bands, which would repeat an episode; bands are a parameter table of a few rows."""
    rows = sorted((r["from_days"], r["until_days"]) for r in bands.collect())
    for (_, high), (low, _) in zip(rows, rows[1:], strict=False):
        if high is None or high > low:
            raise ValueError("age bands overlap")


def burden(subjects: DataFrame, episodes: DataFrame, readings: DataFrame, kinds: DataFrame, bands: DataFrame, direction: str = "below", from_minutes: int = 0, until_minutes: int | None = None, stands_minutes: int = 5) -> DataFrame:
    """Minutes beyond a threshold by age: anaesthetic_key, age_days, threshold, readings, minutes_beyond.

    Of readings at one time the preferred kind counts, then the value further beyond. A reading stands until the next or the window's end,
    for at most stands_minutes; without a stop the last one stands for nothing.
    """
    if direction not in ("below", "above"):
        raise ValueError(f"direction: {direction}")
    check_bands(bands)
    own = windowed(eligible(episodes, subjects), from_minutes, until_minutes).withColumn("age_days", days_between(F.col("birth_date"), F.col("start_time")))
    own = banded(own, bands, "age_days")
    value = F.col("value")
    kept = best_at_time(readings_within(own, readings, kinds), [F.col("preference"), value if direction == "below" else -value])
    stood = until_next(kept, _last())
    beyond = value < F.col("threshold") if direction == "below" else value > F.col("threshold")
    seconds = F.when(F.col("until_time").isNotNull() & beyond, capped_seconds(F.col("reading_time"), F.col("until_time"), stands_minutes)).otherwise(0)
    sums = stood.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), minutes(F.sum(seconds)).alias("m"))
    return own.join(sums, KEY, "left").select(KEY, "age_days", "threshold", F.coalesce("n", F.lit(0)).alias("readings"), F.when(F.col("threshold").isNotNull(), F.col("m")).alias("minutes_beyond"))


def cooling(subjects: DataFrame, episodes: DataFrame, readings: DataFrame, kind: str = "temperature", threshold: float = 36.0, from_minutes: int = 0, until_minutes: int | None = None, stands_minutes: int = 15, recovery_minutes: int = 30) -> DataFrame:
    """Minutes below a temperature, the lowest one, and the first after the stop: anaesthetic_key, readings, minutes_below, lowest, arrival_time, arrival_temperature."""
    own = windowed(eligible(episodes, subjects), from_minutes, until_minutes)
    warm = readings.where(F.col("kind") == kind)
    stood = until_next(best_at_time(readings_within(own, warm), [F.col("value")]), _last())
    seconds = F.when(F.col("until_time").isNotNull() & (F.col("value") < threshold), capped_seconds(F.col("reading_time"), F.col("until_time"), stands_minutes)).otherwise(0)
    sums = stood.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), minutes(F.sum(seconds)).alias("minutes_below"), F.min("value").alias("lowest"))
    after = own.select(KEY, "stop_time").join(warm.where("accepted = 1 AND value IS NOT NULL"), KEY)
    after = after.where((F.col("reading_time") > F.col("stop_time")) & (F.col("reading_time") <= plus(F.col("stop_time"), minutes=recovery_minutes)))
    first = after.groupBy(KEY).agg(F.min(F.struct("reading_time", "value")).alias("a"))
    return own.join(sums, KEY, "left").join(first, KEY, "left").select(KEY, F.coalesce("n", F.lit(0)).alias("readings"), "minutes_below", "lowest", F.col("a.reading_time").alias("arrival_time"), F.col("a.value").alias("arrival_temperature"))


def extreme(subjects: DataFrame, episodes: DataFrame, readings: DataFrame, kinds: DataFrame, direction: str = "lowest", from_minutes: int = 0, until_minutes: int | None = None) -> DataFrame:
    """The lowest or highest reading in the window, and when it was first met: anaesthetic_key, readings, extreme, extreme_time; NULL without a reading.

    Partial aggregates meet by episode key, as the join before has dealt them; no reading is sorted.
    """
    if direction not in ("lowest", "highest"):
        raise ValueError(f"direction: {direction}")
    own = windowed(eligible(episodes, subjects), from_minutes, until_minutes)
    signed = F.col("value") if direction == "lowest" else -F.col("value")
    least = F.min(F.struct(signed.alias("signed"), "reading_time", "value"))
    sums = readings_within(own, readings, kinds).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), least.alias("x"))
    return own.join(sums, KEY, "left").select(KEY, F.coalesce("n", F.lit(0)).alias("readings"), F.col("x.value").alias("extreme"), F.col("x.reading_time").alias("extreme_time"))


def first_beyond(subjects: DataFrame, episodes: DataFrame, readings: DataFrame, kinds: DataFrame, threshold: float, direction: str = "below", from_minutes: int = 0, until_minutes: int | None = None) -> DataFrame:
    """Minutes from the start to the first reading beyond a threshold: anaesthetic_key, readings, first_time, minutes_to_first.

    NULL where none is beyond; readings tells whether there was one at all.
    """
    if direction not in ("below", "above"):
        raise ValueError(f"direction: {direction}")
    own = windowed(eligible(episodes, subjects), from_minutes, until_minutes)
    beyond = F.col("value") < threshold if direction == "below" else F.col("value") > threshold
    sums = readings_within(own, readings, kinds).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(beyond, F.col("reading_time"))).alias("first_time"))
    return own.join(sums, KEY, "left").select(KEY, F.coalesce("n", F.lit(0)).alias("readings"), "first_time", minutes(seconds_between(F.col("start_time"), F.col("first_time"))).alias("minutes_to_first"))


def events_counted(subjects: DataFrame, episodes: DataFrame, events: DataFrame, kinds: DataFrame, from_minutes: int = 0, until_minutes: int | None = None) -> DataFrame:
    """Events of the chosen kinds in the window, ends included: anaesthetic_key, events; none is 0. An event without a time is in no window, and a kind named twice counts once."""
    own = windowed(eligible(episodes, subjects), from_minutes, until_minutes)
    chosen = events.join(F.broadcast(kinds.select("kind").distinct()), "kind", "left_semi")  # a parameter table of a few rows
    inside = (F.col("event_time") >= F.col("window_from")) & (F.col("window_until").isNull() | (F.col("event_time") <= F.col("window_until")))
    sums = own.select(KEY, "window_from", "window_until").join(chosen, KEY).where(inside).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return own.join(sums, KEY, "left").select(KEY, F.coalesce("n", F.lit(0)).alias("events"))


def completeness(subjects: DataFrame, episodes: DataFrame, readings: DataFrame, kinds: DataFrame, expected_minutes: int = 5, from_minutes: int = 0, until_minutes: int | None = None) -> DataFrame:
    """How much of the window readings cover, and the longest gap: anaesthetic_key, window_minutes, readings, covered_minutes, share_covered, longest_gap_minutes."""
    own = windowed(eligible(episodes, subjects), from_minutes, until_minutes).withColumn("window_until", F.when(F.col("stop_time").isNotNull(), F.col("window_until")))
    times = readings_within(own, readings, kinds).select(KEY, "window_from", "window_until", "reading_time").distinct()
    spaced = until_next(times, F.col("window_until"))
    gap = seconds_between(F.col("reading_time"), F.col("until_time"))
    sums = spaced.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(capped_seconds(F.col("reading_time"), F.col("until_time"), expected_minutes) * F.when(gap.isNotNull(), 1)).alias("covered"),
        F.max(gap).alias("between"),
        seconds_between(F.min("window_from"), F.min("reading_time")).alias("first"),
    )
    known = F.col("window_until").isNotNull()
    span = minutes(seconds_between(F.col("window_from"), F.col("window_until")))
    covered = F.when(known, F.coalesce(minutes(F.col("covered")), F.lit(0.0)))
    out = own.join(sums, KEY, "left")
    longest = F.when(F.col("n").isNull(), span).otherwise(minutes(F.greatest("first", "between")))
    return out.select(
        KEY, F.when(known, span).alias("window_minutes"), F.coalesce("n", F.lit(0)).alias("readings"), covered.alias("covered_minutes"),
        F.when(known & (span > 0), covered / span).alias("share_covered"), F.when(known, longest).alias("longest_gap_minutes"),
    )


def two_signal_integral(subjects: DataFrame, episodes: DataFrame, readings: DataFrame, vapour: DataFrame, co2e: DataFrame, flow_kind: str = "fresh_gas_flow", from_minutes: int = 0, until_minutes: int | None = None, stands_minutes: int = 10) -> DataFrame:
    """Volatile agent used: anaesthetic_key, agent, minutes, vapour_ml, liquid_ml, co2e_kg.

    vapour and co2e are parameter tables (kind, factor). Time is cut at every reading of flow or agent; a stretch counts while both latest readings stand.
    """
    own = windowed(eligible(episodes, subjects), from_minutes, until_minutes).withColumn("last", _last()).select(KEY, "window_from", "window_until", "last")
    agents = readings_within(own, readings, vapour.select("kind")).groupBy(KEY, "kind", F.col("reading_time").alias("agent_time")).agg(F.min("value").alias("concentration"))
    flows = readings_within(own, readings.where(F.col("kind") == flow_kind)).groupBy(KEY, F.col("reading_time").alias("flow_time")).agg(F.min("value").alias("flow"))
    charted = agents.select(KEY, "kind").distinct()
    cuts = agents.select(KEY, "kind", F.col("agent_time").alias("at")).union(charted.join(flows, KEY).select(KEY, "kind", F.col("flow_time").alias("at"))).distinct()
    stretches = until_next(cuts.join(own.select(KEY, "last"), KEY), F.col("last"), (KEY, "kind"), "at", "until").where("until IS NOT NULL").drop("last")
    standing = as_of(stretches, flows, (KEY,), "at", "flow_time", ["flow"])
    standing = as_of(standing, agents, (KEY, "kind"), "at", "agent_time", ["concentration"]).where("flow IS NOT NULL AND concentration IS NOT NULL")
    left = lambda t: F.lit(60 * stands_minutes) - seconds_between(F.col(t), F.col("at"))
    seconds = F.greatest(F.least(seconds_between(F.col("at"), F.col("until")), left("flow_time"), left("agent_time")), F.lit(0))
    volume = F.col("flow") * 1000.0 * F.col("concentration") / 100.0 * F.col("seconds") / 60.0
    sums = standing.withColumn("seconds", seconds).groupBy(KEY, "kind").agg(minutes(F.sum("seconds")).alias("m"), F.sum(volume).alias("v"))
    factors = vapour.select("kind", F.col("factor").alias("per_liquid")).join(co2e.select("kind", F.col("factor").alias("co2e")), "kind", "left")
    out = charted.join(F.broadcast(factors), "kind").join(sums, [KEY, "kind"], "left")
    used = F.coalesce("v", F.lit(0.0))
    return out.select(KEY, F.col("kind").alias("agent"), F.coalesce("m", F.lit(0.0)).alias("minutes"), used.alias("vapour_ml"), (used / F.col("per_liquid")).alias("liquid_ml"), (used / F.col("per_liquid") * F.col("co2e")).alias("co2e_kg"))


def audit_detail(subjects: DataFrame, episodes: DataFrame, readings: DataFrame, kinds: Sequence[str] = ("map_arterial", "map_cuff"), under_days: int = 28, threshold: float = 40, stands_minutes: int = 5, death_days: int = 90) -> DataFrame:
    """Per-episode rows behind the audit: anaesthetic_key, patient_key, start_year, minutes (NULL without a reading), died."""
    start = F.col("start_time")
    young = eligible(episodes, subjects).where(days_between(F.col("birth_date"), start) < under_days)
    day = start.cast("date")
    died = F.when((F.col("death_date") >= day) & (F.col("death_date") <= F.date_add(day, death_days)), 1).otherwise(0)
    own = windowed(young.withColumn("died", died))
    first = F.when(F.col("kind") == kinds[0], 0).otherwise(1)
    stood = until_next(best_at_time(readings_within(own, readings.where(F.col("kind").isin(list(kinds)))), [first, F.col("value")]), F.col("stop_time"))
    seconds = F.when((F.col("value") < threshold) & F.col("until_time").isNotNull(), capped_seconds(F.col("reading_time"), F.col("until_time"), stands_minutes)).otherwise(0)
    sums = stood.groupBy(KEY).agg(minutes(F.sum(seconds)).alias("minutes"))
    return own.join(sums, KEY, "left").select(KEY, "patient_key", F.year("start_time").cast("long").alias("start_year"), "minutes", "died")


#: Bands of minutes: (number, label, lowest minutes of the band); band 0 is for episodes without a reading.
MINUTE_BANDS = ((0, "no mean pressure recorded", None), (1, "none", None), (2, "under 5 minutes", 0), (3, "5 to 14 minutes", 5), (4, "15 minutes or more", 15))


def audit_band(m: Column) -> Column:
    return F.when(m.isNull(), 0).when(m == 0, 1).when(m < 5, 2).when(m < 15, 3).otherwise(4)


def audit(detail: DataFrame) -> DataFrame:
    """Every band with its counts: minutes_below, anaesthetics, died_within_90_days, children, children_died_within_90_days; an empty band shows 0."""
    bands = detail.sparkSession.createDataFrame([(n, label) for n, label, _ in MINUTE_BANDS], "band int, minutes_below string")
    x = detail.withColumn("band", audit_band(F.col("minutes")))
    sums = x.groupBy("band").agg(
        F.count(F.lit(1)).alias("anaesthetics"), F.sum("died").alias("died_within_90_days"), F.countDistinct("patient_key").alias("children"),
        F.countDistinct(F.when(F.col("died") == 1, F.col("patient_key"))).alias("children_died_within_90_days"),
    )
    counts = ["anaesthetics", "died_within_90_days", "children", "children_died_within_90_days"]
    return bands.join(sums, "band", "left").orderBy("band").select("minutes_below", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


OPENING = ("infusion_start", "rate_change", "infusion_restart")
INFUSION = (*OPENING, "infusion_pause", "infusion_stop")


def exposure_intervals(drugs: DataFrame, concepts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Infusions as intervals, with the columns of `keep`: a start, rate change or restart runs until the next event of its order, or of its episode and drug without an order.

    Amended rows are left out; a pause or stop opens nothing; no later event gives no end and a reason.
    """
    rows = superseded(drugs, "drug_event_key", "amends_key").where(F.col("given_time").isNotNull() & F.col("action").isin(*INFUSION))
    alone = F.col("order_key").isNull()
    same = Window.partitionBy("order_key", F.when(alone, F.col(KEY)), F.when(alone, F.col("drug"))).orderBy("given_time", "drug_event_key")
    rows = rows.withColumn("ended", F.lead("given_time").over(same)).where(F.col("action").isin(*OPENING))
    out = rows.join(one_concept(concepts).withColumnRenamed("local_key", "drug"), "drug", "left")
    return out.select(
        "drug_event_key", KEY, "order_key", "drug", F.coalesce("concept_id", F.lit(0)).alias("drug_concept_id"), F.col("given_time").alias("started"), "ended",
        F.when(F.col("ended").isNull(), F.lit("stop not recorded")).alias("stop_reason"), F.concat(F.coalesce("status", F.lit("unlisted")), F.lit(":"), F.col("drug")).alias("drug_source_value"), "amount", *keep,
    )


def direct_intervals(drugs: DataFrame) -> DataFrame:
    """The earlier form: no orders and no corrections; every event runs until the next of its episode and drug."""
    same = Window.partitionBy(KEY, "drug").orderBy("given_time", "drug_event_key")
    rows = drugs.where(F.col("action").isin(*INFUSION)).withColumn("ended", F.lead("given_time").over(same))
    return rows.where(F.col("action").isin(*OPENING)).select("drug_event_key", KEY, "drug", F.col("given_time").alias("started"), "ended")


def united(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
