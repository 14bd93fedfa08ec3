"""Shapes that analysts ask for again and again, each as a function of frames with role names for its columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import number
from tideline.functions.time import minutes_between, plus, seconds_between
from tideline.operators.intervals import as_of


# Concepts of a mean pressure by cuff and by arterial line
CUFF_MEAN, ARTERIAL_MEAN = 21492241, 21490852


def audit_of_tables(anaesthetics: DataFrame, measurements: DataFrame, deaths: DataFrame, under_days: int = 28, below: float = 40, longest_seconds: int = 300, within_days: int = 90) -> DataFrame:
    """The banded audit over converted tables: minutes below a mean pressure in children under so many days, and deaths within 90 days.

    Readings are those linked to the anaesthetic from its start to its end. Of several at one time an arterial one counts, then the lower id; each stands until the
    next or the end, for five minutes at most, and the last one of an anaesthetic without an end for no time.
    """
    from tideline.plans.measures import audit

    young = anaesthetics.where(F.col("age_days") < under_days).select("anaesthetic_id", "person_id", "start_datetime", "end_datetime")
    at, end = F.col("measurement_datetime"), F.col("end_datetime")
    rows = measurements.where(F.col("measurement_concept_id").isin(CUFF_MEAN, ARTERIAL_MEAN)).drop("person_id").join(young, F.col("measurement_event_id") == F.col("anaesthetic_id"))
    rows = rows.where((at >= F.col("start_datetime")) & (end.isNull() | (at <= end)))
    first = Window.partitionBy("anaesthetic_id", "measurement_datetime").orderBy(F.when(F.col("measurement_concept_id") == ARTERIAL_MEAN, 0).otherwise(1), "measurement_id")
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    until = F.coalesce(F.lead("measurement_datetime").over(Window.partitionBy("anaesthetic_id").orderBy("measurement_datetime")), end)
    stood = F.least(seconds_between(at, F.col("_until")), F.lit(longest_seconds))
    low = kept.withColumn("_until", until).groupBy("anaesthetic_id").agg((F.sum(F.when((F.col("value_as_number") < below) & F.col("_until").isNotNull(), stood).otherwise(0)) / 60.0).alias("minutes"))
    day = F.to_date("start_datetime")
    died = deaths.select(F.col("person_id").alias("_p"), "death_date")
    near = (F.col("person_id") == F.col("_p")) & (F.col("death_date") >= day) & (F.col("death_date") <= F.date_add(day, within_days))
    detail = young.join(low, "anaesthetic_id", "left").join(died, near, "left")
    return audit(detail.select("anaesthetic_id", F.col("person_id").alias("patient_key"), "minutes", F.when(F.col("_p").isNotNull(), 1).otherwise(0).alias("died")))


def share_below(episodes: DataFrame, readings: DataFrame, key: str, threshold: float) -> DataFrame:
    """anaesthetics, with_low: episodes with any value below the threshold from their start to their end."""
    t = F.col("time")
    low = readings.where(F.col("value") < threshold).join(episodes, key).where((t >= F.col("start")) & (F.col("end").isNull() | (t <= F.col("end")))).select(key).distinct().withColumn("_low", F.lit(1))
    return episodes.select(key).distinct().join(low, key, "left").agg(F.count(F.lit(1)).alias("anaesthetics"), F.count("_low").alias("with_low"))


def devices_by_type(episodes: DataFrame, devices: DataFrame, key: str) -> DataFrame:
    """type, device, anaesthetics (distinct), devices (rows)."""
    return episodes.join(devices, key).groupBy("type", "device").agg(F.countDistinct(key).alias("anaesthetics"), F.count(F.lit(1)).alias("devices"))


def event_intervals(records: DataFrame, events: DataFrame, case: str, record: str, first: str, second: str, least: int = 1, most: int = 1440) -> DataFrame:
    """case, minutes, between: duration of each case's first record and minutes between the first of two kinds of event; durations outside least..most are left out."""
    own = records.groupBy(case).agg(F.min(F.struct("start", record, "stop")).alias("r")).select(case, "r.*").withColumn("minutes", minutes_between(F.col("start"), F.col("stop"))).where(F.col("minutes").between(least, most))
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("time")))
    times = events.where(F.col("kind").isin(first, second)).groupBy(record).agg(at(first).alias("_a"), at(second).alias("_b"))
    return own.join(times, record, "left").select(case, "minutes", minutes_between(F.col("_a"), F.col("_b")).alias("between"))


def dose_per_kilogram(doses: DataFrame, weights: DataFrame, key: str, pattern: str) -> DataFrame:
    """Doses whose label matches, whatever its case, over the weight written as text; NULL for no weight or zero; with the day as dd/MM/yyyy and preterm or term by weeks."""
    rows = doses.where(F.ilike(F.col("label"), F.lit(pattern))).join(weights, key, "left")
    return rows.select(
        "label", F.date_format("time", "dd/MM/yyyy").alias("given"), "dose", F.try_divide(F.col("dose"), number(F.col("weight_text"))).alias("per_kg"), F.when(F.col("weeks") < 37, "preterm").otherwise("term").alias("gestation"),
    )


def utilisation(cases: DataFrame, records: DataFrame, case: str, top: int = 500) -> DataFrame:
    """service, year, month, cases (distinct), hours of their records; the first `top` rows by year, month and most cases."""
    rows = cases.join(records, case)
    g = rows.groupBy("service", F.year("day").cast("long").alias("year"), F.month("day").cast("long").alias("month")).agg(F.countDistinct(case).alias("cases"), (F.sum(minutes_between(F.col("start"), F.col("stop"))) / F.lit(60.0)).cast("double").alias("hours"))
    return g.orderBy("year", "month", F.desc("cases"), "service").limit(top)


def by_age_and_grade(rows: DataFrame, age: Column, bands: Sequence[tuple[int, str]], last: str, grade: str, least: int = 5) -> DataFrame:
    """age_band, grade, n with a minimum group."""
    from tideline.plans.counts import band_of

    return rows.groupBy(band_of(age, bands, last).alias("age_band"), F.col(grade).alias("grade")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def first_event_then_admission(cohort: DataFrame, events: DataFrame, admissions: DataFrame, key: str, subject: str) -> DataFrame:
    """Cohort rows with their first event and the subject's latest admission at or before it."""
    first = events.groupBy(key).agg(F.min("time").alias("first_event"))
    rows = cohort.join(first, key, "left")
    before = admissions.select(subject, F.col("admitted").alias("_at")).distinct()
    return as_of(rows.select(key, subject, "first_event"), before, (subject,), "first_event", "_at", []).select(key, subject, "first_event", F.col("_at").alias("admitted"))


def listed(keys: Sequence[str], table: DataFrame, key: str, labels: DataFrame, code: str) -> DataFrame:
    """Rows of pasted keys with their status label; a key without a row stays, empty."""
    given = table.sparkSession.createDataFrame([(k,) for k in keys], f"{key} string")
    return given.join(table, key, "left").join(F.broadcast(labels), code, "left")


def emergencies(cases: DataFrame, start: str, end: str, service: str | None = None) -> DataFrame:
    """label, n of emergency cases from start to before end, of one service if it is named."""
    rows = cases.where((F.col("emergency") == 1) & (F.col("day") >= F.lit(start).cast("timestamp_ntz")) & (F.col("day") < F.lit(end).cast("timestamp_ntz")))
    rows = rows.where(F.col("label") == service) if service is not None else rows
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def charted_readings(records: DataFrame, readings: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """Accepted readings of chosen kinds for listed records: the records restrict the readings by key before anything else."""
    few = readings.where(F.col("kind").isin(list(kinds)) & (F.col("accepted") == 1)).join(records.select(key).distinct(), key, "left_semi")
    return few.select(key, "reading_time", "kind", "value").orderBy(key, "reading_time", "kind", "value")


def with_case_or_visit_only(cases: DataFrame, visits: DataFrame, subject: str, visit: str, least: int = 1) -> DataFrame:
    """subject, src, n: visits with a case, and visits of subjects that have no case at all."""
    a = visits.join(cases.select(visit).where(F.col(visit).isNotNull()).distinct(), visit, "left_semi").withColumn("src", F.lit("case"))
    b = visits.join(cases.select(subject).where(F.col(subject).isNotNull()).distinct(), subject, "left_anti").withColumn("src", F.lit("visit only"))
    return a.unionByName(b).groupBy(subject, "src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def latest_before(cases: DataFrame, weights: DataFrame, case: str, subject: str, days: int = 730) -> DataFrame:
    """case, weight_time, weight: the latest readable weight in the days before the case's time."""
    w = weights.withColumn("_kg", number(F.col("text"))).where("_kg IS NOT NULL").select(subject, F.col("time").alias("_at"), "_kg")
    latest = as_of(cases.select(case, subject, "time"), w.groupBy(subject, "_at").agg(F.max("_kg").alias("_kg")), (subject,), "time", "_at", ["_kg"], strict=True)
    near = F.col("_at") >= plus(F.col("time"), days=-days)
    return latest.select(case, F.when(near, F.col("_at")).alias("weight_time"), F.when(near, F.col("_kg")).alias("weight"))


def staff_lists(staff: DataFrame, key: str) -> DataFrame:
    """key, n_staff, staff_list in order of start and label, had_handover: whether anyone started later than another."""
    own = Window.partitionBy(key).orderBy("start", "label")
    rows = staff.withColumn("_next", F.lead("start").over(own))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_staff"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "label"))), lambda s: s["label"]), "; ").alias("staff_list"), F.max(F.when(F.col("_next").isNotNull(), 1).otherwise(0)).alias("had_handover"),
    )


def pivoted(readings: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """One row for each key, one column for each kind with its mean; unreadable text does not count."""
    return readings.withColumn("_x", number(F.col("text"))).groupBy(key).pivot("kind", list(kinds)).agg(F.avg("_x"))


def eras(rows: DataFrame, subject: str, code: str, start: str, end: str) -> DataFrame:
    """First start, last end and number of rows by subject and code; no rule about gaps."""
    return rows.groupBy(subject, code).agg(F.min(start).alias("era_start"), F.max(F.coalesce(end, start)).alias("era_end"), F.count(F.lit(1)).alias("n"))


def running_amounts(totals: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """Amounts between running totals: the difference to the reading before; a total that falls starts anew."""
    own = Window.partitionBy(key, kind).orderBy("time")
    before = F.lag("total").over(own)
    return totals.withColumn("amount", F.when(before.isNull() | (F.col("total") < before), F.col("total")).otherwise(F.col("total") - before))


def returned_within(events: DataFrame, subject: str, key: str, days: int = 30) -> DataFrame:
    """key, returned: whether the same subject has another event that starts after this one's end and within so many days of it.

    Keys are unique. The first later start decides; where that is this event's own, as its end comes before its start, the start after it does.
    """
    starts = events.groupBy(subject, F.col("start").alias("_s")).agg(F.min(key).alias("_one"), F.max(key).alias("_other"))
    starts = starts.withColumn("_then", F.lead("_s").over(Window.partitionBy(subject).orderBy("_s")))
    found = as_of(events.select(key, subject, "end"), starts, (subject,), "end", "_s", ["_one", "_other", "_then"], strict=True, ahead=True)
    first = F.when((F.col("_one") == F.col(key)) & (F.col("_other") == F.col(key)), F.col("_then")).otherwise(F.col("_s"))
    return found.select(key, F.when(first <= plus(F.col("end"), days=days), 1).otherwise(0).alias("returned"))


def extremes(windows: DataFrame, readings: DataFrame, kinds: DataFrame, threshold: float, direction: str = "below") -> DataFrame:
    """anaesthetic_key, lowest, highest, count, minutes_to_first: extremes in the window, and minutes from the start to the first reading beyond the threshold."""
    from tideline.operators.intervals import KEY, readings_within

    r = readings_within(windows, readings, kinds)
    beyond = F.col("value") < threshold if direction == "below" else F.col("value") > threshold
    first = F.min(F.when(beyond, F.col("reading_time")))
    g = r.groupBy(KEY).agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count(F.lit(1)).alias("count"), minutes_between(F.min("start_time"), first).alias("minutes_to_first"))
    return windows.select(KEY).join(g, KEY, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def result_around(episodes: DataFrame, labs: DataFrame, kind: str, side: str, hours: float, subject: str = "patient_key") -> DataFrame:
    """The subject's laboratory result of a kind nearest to each episode, within so many hours: before its start, after its stop, or on either side of its start.

    episodes(anaesthetic_key, subject, start_time, stop_time), labs(subject, kind, taken_time, value, lab_key). An episode without such a result, or without the time that counts, has NULL. Of several results
    at one time that with the smallest key counts.
    """
    from tideline.operators.intervals import KEY, best_at_time, nearest

    time = "stop_time" if side == "after" else "start_time"
    held = best_at_time(labs.where((F.col("kind") == kind) & F.col("value").isNotNull() & F.col("taken_time").isNotNull()), [F.col("lab_key")], (subject, "taken_time"))
    minutes = int(60 * hours)
    out = nearest(episodes.select(KEY, subject, F.col(time).alias("_t")), held.select(subject, "taken_time", "value"), (subject,), "_t", "taken_time", ["value"], minutes, minutes, side)
    return out.select(KEY, subject, F.when(F.col("_t").isNotNull(), F.col("taken_time")).alias("taken_time"), F.when(F.col("_t").isNotNull(), F.col("value")).alias("value"))
