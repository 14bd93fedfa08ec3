"""Conversion of source frames to OMOP tables in ordered, gated steps.

A step is a function of the frames so far that returns rows of its target. Code-to-concept rows are one frame of
(vocabulary, code, concept); lookups are left joins on it, and a setting is the single row of its code. Identifiers come
from tideline.operators.ids, so that no step sorts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from tideline.functions.text import cut, number, open_end, pressures, repaired_end
from tideline.functions.time import completed_months, completed_years, days_between, minutes_between, plus
from tideline.operators.ids import Ranges, numbered, unnumbered
from tideline.operators.intervals import as_of
from tideline.plans.measures import exposure_intervals
from tideline.sources.staging import staged

Tables = dict[str, DataFrame]
Numbering = Callable[..., DataFrame]  # numbered, or unnumbered for rows whose identifiers nothing reads
FROM_RECORD, FROM_ADMINISTRATION = 32817, 32818
EVENT_FIELD = 1147082  # the field concept of procedure_occurrence_id
ASA_CLASS, WEIGHT, KILOGRAM = 4199571, 3025315, 9529
MEAN_PRESSURE, MILLIMETRES, CALCULATED = 3027598, 8876, 32882


def mapped(rows: DataFrame, concepts: DataFrame, vocabulary: str, code: str, name: str, how: str = "left") -> DataFrame:
    """rows with the concept of a code under a vocabulary; an inner join makes the mapping row a filter."""
    own = concepts.where(F.col("vocabulary") == vocabulary).select(F.col("code").alias(f"_{name}"), F.col("concept").alias(name))
    return rows.join(own, F.col(code).cast("string") == F.col(f"_{name}"), how).drop(f"_{name}")


def keyed(rows: DataFrame) -> DataFrame:
    """rows as the smaller side of a join by their key, of which a task's part is held hashed: neither side is sorted. For targets with a row for each key, never for the rows of a key's events."""
    return rows.hint("shuffle_hash")


def _ranges(rows: DataFrame, target: DataFrame, key: str, number: str, numbering: Numbering) -> Ranges | None:
    """Ranges of the key along which a target is numbered, by which rows can be dealt for their numbers; None without numbers, or where few rows are one range."""
    kind = target.schema[key].dataType
    if numbering is unnumbered or rows.schema[key].dataType != kind or not isinstance(kind, (IntegralType, StringType)):
        return None
    ranges = Ranges.numbered(target, key, number)
    return ranges if ranges.least else None


def _by_own_key(rows: DataFrame, source: DataFrame, key: str, numbering: Numbering) -> tuple[DataFrame, Ranges | None]:
    """rows dealt by ranges of a whole number that each has of its own, if they are to be numbered by it: the ranges come from their source, so that the joins are not run for a sample."""
    ranges = Ranges.estimated(source, key) if numbering is not unnumbered and isinstance(rows.schema[key].dataType, IntegralType) else None
    return (ranges.dealt(ranges.placed(rows, key)), ranges) if ranges and ranges.least else (rows, None)


def _in_ranges(rows: DataFrame, own: DataFrame, key: str, ranges: Ranges | None, how: str = "inner") -> DataFrame:
    """rows joined by key with own, both dealt by ranges if there are any. Before the numbers only what needs no shuffle may follow."""
    if ranges is None:
        return rows.join(keyed(own), key, how)
    rows, own = (ranges.dealt(ranges.placed(df, key)) for df in (rows, own))
    return rows.join(keyed(own), ["_range", key], how)


def setting(concepts: DataFrame, vocabulary: str, code: str) -> int | None:
    """The concept of a row that must be alone, or None without one."""
    got = concepts.where((F.col("vocabulary") == vocabulary) & (F.col("code") == code)).select("concept").limit(2).collect()
    if len(got) > 1:
        raise ValueError(f"{vocabulary} {code} has more than one row")
    return got[0][0] if got else None


def merged_map(own: DataFrame, site: DataFrame) -> DataFrame:
    """Mapping rows, of which a site's own wins for the same vocabulary and code."""
    keys = site.select(F.upper("vocabulary").alias("_v"), F.col("code").alias("_c")).distinct()
    return own.join(keys, (F.upper("vocabulary") == F.col("_v")) & (F.col("code") == F.col("_c")), "left_anti").unionByName(site)


def person(t: Tables, everyone: bool = False) -> DataFrame:
    rows = t["subjects"] if everyone else t["subjects"].where("is_test = 0")
    rows = mapped(numbered(rows, ["patient_key"], "person_id", out=["patient_key", "birth_date", "sex"]), t["concepts"], "SITE_SEX", "sex", "gender")
    b = F.col("birth_date")
    return rows.select(
        "person_id", F.coalesce("gender", F.lit(0)).cast("long").alias("gender_concept_id"), F.year(b).cast("long").alias("year_of_birth"), F.month(b).cast("long").alias("month_of_birth"),
        F.dayofmonth(b).cast("long").alias("day_of_birth"), b.cast("timestamp_ntz").alias("birth_datetime"), F.col("patient_key").alias("person_source_value"), F.col("sex").cast("string").alias("gender_source_value"),
    )


def coded(rows: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """provider and care_site: a number, the key as text and the label cut to its field."""
    return numbered(rows.select(key, label).dropDuplicates([key]), [key], f"{name}_id", out=[F.col(key).cast("string").alias(f"{name}_source_value"), cut(F.col(label), 255).alias(f"{name}_name")])


def visit_occurrence(t: Tables) -> DataFrame:
    rows = t["visits"].where("admitted IS NOT NULL").join(keyed(t["person"].select("person_id", F.col("person_source_value").alias("patient_key"))), "patient_key")
    sites = t["care_site"].select("care_site_id", F.col("care_site_source_value").alias("_site"))
    rows = rows.join(sites, F.col("ward_key").cast("string") == F.col("_site"), "left")
    start, end = F.col("admitted"), repaired_end(F.col("admitted"), F.col("discharged"))
    end = F.coalesce(end, start)
    return numbered(rows, ["visit_key"], "visit_occurrence_id", out=[
        "person_id", F.lit(9201).cast("long").alias("visit_concept_id"), start.cast("date").alias("visit_start_date"), start.alias("visit_start_datetime"),
        end.cast("date").alias("visit_end_date"), end.alias("visit_end_datetime"), "care_site_id", F.col("visit_key").cast("string").alias("visit_source_value"),
    ])


def _visits(t: Tables) -> DataFrame:
    return t["visit_occurrence"].select("person_id", "visit_occurrence_id", "visit_concept_id", "visit_start_date", "visit_start_datetime", F.col("visit_source_value").alias("_visit"))


def _keyed_visits(t: Tables, kind: DataType) -> DataFrame:
    """Visits with `_own`, their key as a whole number if that is what it is compared with, else as text."""
    if not isinstance(kind, IntegralType):
        return _visits(t).withColumn("_own", F.col("_visit"))
    return _visits(t).withColumn("_own", F.col("_visit").try_cast(kind)).where(F.col("_own").cast("string") == F.col("_visit"))


def _of_visits(rows: DataFrame, t: Tables, *columns: str, how: str = "inner") -> DataFrame:
    """rows with their visits, all columns of `_visits` or those named; `_again` tells a further visit of the same key. Keys are equal as text; whole numbers are compared as such, so that rows that are dealt by their key already are not dealt again."""
    kind = rows.schema["visit_key"].dataType
    visits = _keyed_visits(t, kind)
    if "_again" in columns:
        visits = visits.withColumn("_again", F.row_number().over(Window.partitionBy("_own").orderBy("visit_occurrence_id")) > 1)
    on = (F.col("visit_key") if isinstance(kind, IntegralType) else F.col("visit_key").cast("string")) == F.col("_own")
    return rows.join(visits.select("_own", *(columns or [c for c in visits.columns if c not in ("_own", "_visit")])), on, how).drop("_own")


def _details(t: Tables) -> DataFrame:
    return t["visit_detail"].select("person_id", "visit_occurrence_id", "visit_detail_id", "provider_id", "visit_detail_start_date", "visit_detail_start_datetime", F.col("visit_detail_source_value").alias("anaesthetic_key"))


def condition_occurrence(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    rows = mapped(t["diagnoses"], t["concepts"], "SITE_DIAGNOSIS", "diagnosis", "what")
    kind = rows.schema["visit_key"].dataType
    if numbering is unnumbered or not isinstance(kind, (IntegralType, StringType)):
        rows, ranges = _of_visits(rows, t), None
    else:
        visits = _keyed_visits(t, kind).select(F.col("_own").alias("visit_key"), "person_id", "visit_occurrence_id", "visit_start_date")
        ranges = _ranges(rows, visits, "visit_key", "visit_occurrence_id", numbering)
        rows = _in_ranges(rows, visits, "visit_key", ranges)
    return numbering(rows, ["visit_key", "seq"], "condition_occurrence_id", dealt=ranges, out=["person_id", F.coalesce("what", F.lit(0)).cast("long").alias("condition_concept_id"), F.col("visit_start_date").alias("condition_start_date"), "visit_occurrence_id", cut(F.col("icd"), 50).alias("condition_source_value")])


def death(t: Tables) -> DataFrame:
    rows = t["subjects"].where("death_date IS NOT NULL").join(t["person"].select("person_id", F.col("person_source_value").alias("patient_key")), "patient_key")
    return rows.select("person_id", "death_date", F.lit(FROM_RECORD).cast("long").alias("death_type_concept_id"))


def drug_exposure(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """Single doses whose action has a mapping row that says it was given."""
    rows = mapped(t["drugs"].where("given_time IS NOT NULL"), t["concepts"], "SITE_DRUG_GIVEN", "action", "_given", "inner")
    rows = _of_visits(rows, t)
    rows = mapped(mapped(rows, t["concepts"], "SITE_DRUG", "drug", "what"), t["concepts"], "SITE_ROUTE", "route", "way")
    rows, ranges = _by_own_key(rows, t["drugs"], "given_key", numbering)
    return numbering(rows, ["given_key"], "drug_exposure_id", dealt=ranges, out=[
        "person_id", F.coalesce("what", F.lit(0)).cast("long").alias("drug_concept_id"), F.col("given_time").cast("date").alias("drug_exposure_start_date"), F.col("given_time").cast("date").alias("drug_exposure_end_date"),
        F.col("amount").alias("quantity"), F.coalesce("way", F.lit(0)).cast("long").alias("route_concept_id"), "visit_occurrence_id", cut(F.col("label"), 50).alias("drug_source_value"),
        F.col("given_time").alias("drug_exposure_start_datetime"), *[F.lit(None).cast(kind).alias(name) for name, kind in (("drug_exposure_end_datetime", "timestamp_ntz"), ("drug_type_concept_id", "long"), ("stop_reason", "string"), ("sig", "string"), ("visit_detail_id", "long"), ("route_source_value", "string"), ("dose_unit_source_value", "string"))],
    ])


def drug_infusion(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """The direct form, for sources without the role view of drugs. Periods at one rate: an action under SITE_DRUG_RUNNING runs until the next mapped action of the same drug and episode; without one it has no end but a reason.

    In the layer's own range of numbers.
    """
    phases = t["concepts"].where(F.col("vocabulary").isin("SITE_DRUG_RUNNING", "SITE_DRUG_STOPPED")).select((F.col("vocabulary") == "SITE_DRUG_RUNNING").alias("_running"), F.col("code").alias("_action"))
    rows = t["infusions"].where("given_time IS NOT NULL").join(phases, F.col("action").cast("string") == F.col("_action"))
    details = t["visit_detail"].select("visit_detail_id", F.col("visit_detail_source_value").alias("anaesthetic_key"))
    ranges = _ranges(rows, details, "anaesthetic_key", "visit_detail_id", numbering)
    rows = _in_ranges(rows if ranges else rows.repartition("anaesthetic_key"), details, "anaesthetic_key", ranges, "left")  # one shuffle for the join by episode and the window
    same = Window.partitionBy("visit_detail_id", "anaesthetic_key", "drug", *(["_range"] if ranges else [])).orderBy("given_time", "given_key")  # details first: keys that begin alike are slow to sort as texts
    rows = rows.withColumn("_next", F.lead("given_time").over(same)).where("_running")
    rows = _of_visits(rows, t)
    rows = mapped(mapped(rows, t["concepts"], "SITE_DRUG", "drug", "what"), t["concepts"], "SITE_ROUTE", "route", "way")
    rows = ranges.dealt(rows) if ranges else rows
    start, end = F.col("given_time"), F.col("_next")
    return numbering(rows, ["anaesthetic_key", "drug", "given_time", "given_key", "visit_occurrence_id", "visit_detail_id", "what", "way"], "drug_exposure_id", dealt=ranges, out=[
        "person_id", F.coalesce("what", F.lit(0)).cast("long").alias("drug_concept_id"), start.cast("date").alias("drug_exposure_start_date"), start.alias("drug_exposure_start_datetime"),
        F.coalesce(end, start).cast("date").alias("drug_exposure_end_date"), end.alias("drug_exposure_end_datetime"), F.lit(FROM_ADMINISTRATION).cast("long").alias("drug_type_concept_id"), F.when(end.isNull(), F.lit("stop not recorded")).alias("stop_reason"),
        F.col("amount").cast("string").alias("sig"), F.coalesce("way", F.lit(0)).cast("long").alias("route_concept_id"), "visit_occurrence_id", "visit_detail_id", cut(F.col("label"), 50).alias("drug_source_value"),
    ])


# Concepts of routes of the role view
ROUTES = {"intravenous": 4171047, "oral": 4132161, "inhaled": 40486069}


def drug_infusion_roles(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """Infusions from the role view: corrections are resolved to their last row, and a period ends with the next event of its order, or of its episode and drug without one.

    role_drugs(drug_event_key, anaesthetic_key, order_key, drug, action, amount, unit, route, given_time, amends_key) and drug_concepts(local_key, concept_id, status). Episodes without
    a visit detail are left out. Numbers begin at 1 within the layer's range.
    """
    rows = exposure_intervals(t["role_drugs"], t["drug_concepts"], keep=("unit", "route"))
    detail = t["visit_detail"].select(F.col("visit_detail_source_value").alias("anaesthetic_key"), "visit_detail_id", "visit_occurrence_id", "person_id")
    route = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.col("route")), F.lit(0))
    return numbering(rows.join(keyed(detail), "anaesthetic_key"), ["anaesthetic_key", "order_key", "started", "drug_event_key", "visit_detail_id"], "drug_exposure_id", out=[
        "person_id", F.col("drug_concept_id").cast("long").alias("drug_concept_id"), F.col("started").cast("date").alias("drug_exposure_start_date"), F.col("started").alias("drug_exposure_start_datetime"),
        F.coalesce("ended", "started").cast("date").alias("drug_exposure_end_date"), F.col("ended").alias("drug_exposure_end_datetime"), F.lit(FROM_ADMINISTRATION).cast("long").alias("drug_type_concept_id"), "stop_reason",
        F.col("amount").cast("string").alias("sig"), route.cast("long").alias("route_concept_id"), "visit_occurrence_id", "visit_detail_id", "drug_source_value", cut(F.col("route"), 50).alias("route_source_value"), cut(F.col("unit"), 50).alias("dose_unit_source_value"),
    ])


def _with_provider(details: DataFrame, t: Tables) -> DataFrame:
    """details with the provider of their first member of staff; a row of details stays one row. Staff are dealt by episode before they are sorted, once: the smallest of texts has no hash aggregate, and would be sorted on both sides of the shuffle."""
    staff = t["episode_staff"].select(F.col("anaesthetic_key").alias("visit_detail_source_value"), "seq", "staff_key").repartition("visit_detail_source_value")
    hashed = F.xxhash64("visit_detail_source_value").alias("_hash")  # made after the shuffle: keys that begin alike are slow to sort as texts
    first = staff.groupBy(hashed, "visit_detail_source_value").agg(F.min(F.struct("seq", "staff_key")).alias("s")).select("visit_detail_source_value", F.col("s.staff_key").cast("string").alias("_staff"))
    providers = t["provider"].select("provider_id", F.col("provider_source_value").alias("_staff"))
    columns = [c for c in details.columns if c != "provider_id"]
    at = details.columns.index("provider_id")
    return details.select(*columns).join(keyed(first.join(providers, "_staff").drop("_staff")), "visit_detail_source_value", "left").select(*columns[:at], "provider_id", *columns[at:])


def visit_detail(t: Tables, through_case: bool = False) -> DataFrame:
    """One for each episode with a visit and no stop before its start; the first member of staff is its provider, in a run that has providers.

    The visit is the one that the episode's record carries or, through_case, that of its theatre case: an episode without a case is then left out.
    """
    e = t["episodes"].where("start_time IS NOT NULL AND (stop_time IS NULL OR stop_time >= start_time)")
    if through_case:
        e = e.drop("visit_key").join(t["cases"].select("case_key", "visit_key"), "case_key")
    e = _of_visits(e, t)
    kind = setting(t["concepts"], "SITE_VISIT_DETAIL", "ANAESTHESIA")
    start, stop = F.col("start_time"), F.col("stop_time")
    rows = numbered(e, ["anaesthetic_key"], "visit_detail_id", out=[
        "person_id", F.coalesce(F.lit(kind), "visit_concept_id").cast("long").alias("visit_detail_concept_id"), start.cast("date").alias("visit_detail_start_date"), start.alias("visit_detail_start_datetime"),
        F.coalesce(stop, start).cast("date").alias("visit_detail_end_date"), stop.alias("visit_detail_end_datetime"), F.lit(None).cast("long").alias("provider_id"), F.col("anaesthetic_key").alias("visit_detail_source_value"), "visit_occurrence_id",
    ])
    # Numbered first: a range is found by a sample, for which what stands below it is run twice
    return _with_provider(rows, t) if "provider" in t else rows


def procedure_anaesthetic(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """The episode itself; its kind's concept, or the one for any anaesthetic."""
    rows = mapped(t["episodes"], t["concepts"], "SITE_ANAES_KIND", "kind", "what")
    ranges = _ranges(rows, _details(t), "anaesthetic_key", "visit_detail_id", numbering)
    rows = _in_ranges(rows, _details(t), "anaesthetic_key", ranges)
    other = setting(t["concepts"], "SITE_PROCEDURE", "ANAESTHETIC")
    start, stop = F.col("start_time"), F.col("stop_time")
    return numbering(rows, ["anaesthetic_key"], "procedure_occurrence_id", dealt=ranges, out=[
        "person_id", F.coalesce("what", F.lit(other), F.lit(0)).cast("long").alias("procedure_concept_id"), start.cast("date").alias("procedure_date"), start.alias("procedure_datetime"),
        stop.cast("date").alias("procedure_end_date"), stop.alias("procedure_end_datetime"), "provider_id", "visit_occurrence_id", "visit_detail_id", F.lit("ANAESTHETIC").alias("procedure_source_value"),
    ])


def _largest(t: Tables, table: str, key: str) -> int:
    """The largest number of a table; of one whose rows come without numbers (`unread`) the one that its last row would have."""
    if table not in t:
        return 0
    return t[table].agg(F.coalesce(F.max(key), F.lit(0))).first()[0] if key in t[table].columns else t[table].count()


def procedure_events(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """Timed events that the vocabulary calls procedures, numbered on from the table's largest number."""
    rows = mapped(t["events"].where("event_time IS NOT NULL"), t["concepts"], "SITE_EVENT_PROC", "event_kind", "what", "inner")
    ranges = _ranges(rows, _details(t), "anaesthetic_key", "visit_detail_id", numbering)
    rows = _in_ranges(rows, _details(t), "anaesthetic_key", ranges)
    at = F.col("event_time")
    return numbering(rows, ["anaesthetic_key", "seq", "visit_detail_id", "what"], "procedure_occurrence_id", _largest(t, "procedure_occurrence", "procedure_occurrence_id") + 1, dealt=ranges, out=["person_id", F.col("what").cast("long").alias("procedure_concept_id"), at.cast("date").alias("procedure_date"), at.alias("procedure_datetime"), "visit_occurrence_id", "visit_detail_id", F.col("event_kind").cast("string").alias("procedure_source_value")])


def procedure_surgery(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """Operations of finished cases, numbered on from the table's largest number."""
    most = _largest(t, "procedure_occurrence", "procedure_occurrence_id")
    rows = mapped(t["operations"].where("day IS NOT NULL"), t["concepts"], "SITE_CASE_DONE", "status", "_done", "inner")
    rows = _of_visits(rows, t, "visit_occurrence_id", how="left")
    rows = rows.join(keyed(t["person"].select("person_id", F.col("person_source_value").alias("patient_key"))), "patient_key")
    rows = mapped(rows, t["concepts"], "SITE_PROC", "operation", "what")
    return numbering(rows, ["case_key", "seq", "what"], "procedure_occurrence_id", most + 1, ["person_id", F.coalesce("what", F.lit(0)).cast("long").alias("procedure_concept_id"), F.col("day").alias("procedure_date"), "visit_occurrence_id", cut(F.col("label"), 50).alias("procedure_source_value")])


def _with_procedures(details: DataFrame, t: Tables) -> DataFrame:
    """details with the anaesthetics of each visit detail, one unless an episode's key is repeated, and their times with the margin of the site's setting on either side, without which nothing lies in them; rows that find their detail need no further join."""
    margin = setting(t["concepts"], "SITE_SETTING", "EVENT_LINK_MARGIN_MINUTES")
    p = t["procedure_occurrence"].where("procedure_source_value = 'ANAESTHETIC'").where(F.lit(margin is not None))
    each = F.struct(F.col("procedure_occurrence_id").alias("id"), plus(F.col("procedure_datetime"), minutes=-(margin or 0)).alias("a"), plus(F.col("procedure_end_datetime"), minutes=margin or 0).alias("b"))
    return details.join(keyed(p.groupBy("visit_detail_id").agg(F.collect_list(each).alias("_procedures"))), "visit_detail_id", "left")


def _linked(rows: DataFrame, time: str) -> DataFrame:
    """For rows with _procedures: adds procedure_occurrence_id of the episode if the time lies in it."""
    at = F.col(time)
    inside = lambda p: (at >= p["a"]) & (p["b"].isNull() | (at <= p["b"]))
    return rows.withColumn("procedure_occurrence_id", F.explode_outer(F.filter("_procedures", inside))).withColumn("procedure_occurrence_id", F.col("procedure_occurrence_id.id")).drop("_procedures")


def _event_field() -> Column:
    return F.when(F.col("procedure_occurrence_id").isNotNull(), EVENT_FIELD).cast("long")


def _readings(t: Tables, with_visits: bool = True) -> DataFrame:
    """Accepted readings with a time, what their text writes, their visit, their episode's detail (its person and visit as `_person` and `_stay`) and the procedure that they lie in.

    A run in which several steps read them writes them once. Those of a key that several visits have are repeated, for readers of visits alone: the others leave out what is there `_again`.
    """
    if "_readings" in t:
        return t["_readings"]
    rows = t["readings"].where("reading_time IS NOT NULL AND coalesce(accepted, 'Y') <> 'N'").where(F.col("text").cast("string").rlike("[0-9]"))
    rows = rows.select("sheet_key", "seq", "visit_key", "anaesthetic_key", "kind", "text", "reading_time")
    rows = _of_visits(rows, t, "person_id", "visit_occurrence_id", "_again", how="left") if with_visits else rows.withColumn("_again", F.lit(False))
    details = t["visit_detail"].select("visit_detail_id", F.col("visit_detail_source_value").alias("anaesthetic_key"), F.col("person_id").alias("_person"), F.col("visit_occurrence_id").alias("_stay"))
    rows = _linked(rows.drop("visit_key").join(keyed(_with_procedures(details, t)), "anaesthetic_key", "left"), "reading_time")
    if with_visits:
        rows = rows.where("visit_occurrence_id IS NOT NULL OR visit_detail_id IS NOT NULL")
    return rows.drop("anaesthetic_key").withColumns({"x": number(F.col("text")), "_p": pressures(F.col("text"))}).select("*", "_p.*").drop("_p")


def measurement(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """Numeric readings that are mapped or on an episode's sheet; ounces, inches and Fahrenheit become kilograms, centimetres and Celsius."""
    rows = _readings(t).where("x IS NOT NULL AND visit_occurrence_id IS NOT NULL")
    rows = mapped(mapped(rows, t["concepts"], "SITE_OBS", "kind", "what"), t["concepts"], "SITE_OBS_UNIT", "kind", "unit")
    rows = rows.where("what IS NOT NULL OR visit_detail_id IS NOT NULL")
    x, unit = F.col("x"), F.col("unit")
    value = F.when(unit == 9373, x * 0.028349523125).when(unit == 9327, x * 2.54).when(unit == 9289, (x - 32) * 5.0 / 9.0).otherwise(x)
    standard = F.when(unit == 9373, 9529).when(unit == 9327, 8582).when(unit == 9289, 586323).otherwise(F.coalesce(unit, F.lit(0)))
    return numbering(rows, ["sheet_key", "seq", "visit_occurrence_id", "visit_detail_id", "procedure_occurrence_id", "what", "unit", "reading_time", "x"], "measurement_id", out=[
        "person_id", F.coalesce("what", F.lit(0)).cast("long").alias("measurement_concept_id"), F.col("reading_time").cast("date").alias("measurement_date"), F.col("reading_time").alias("measurement_datetime"),
        F.round(value, 3).alias("value_as_number"), standard.cast("long").alias("unit_concept_id"), F.lit(None).cast("long").alias("value_as_concept_id"), "visit_occurrence_id", "visit_detail_id",
        F.col("procedure_occurrence_id").alias("measurement_event_id"), _event_field().alias("meas_event_field_concept_id"), F.col("kind").cast("string").alias("measurement_source_value"), cut(F.col("text"), 50).alias("value_source_value"), F.lit(FROM_RECORD).cast("long").alias("measurement_type_concept_id"),
    ])


def _measured(rows: DataFrame, order: Sequence[str], t: Tables, numbering: Numbering, concept: Column, value: Column, kind: int) -> DataFrame:
    """Rows of measurement, numbered on from the table's largest number."""
    at = F.col("reading_time")
    return numbering(rows, order, "measurement_id", _largest(t, "measurement", "measurement_id") + 1, [
        "person_id", concept.cast("long").alias("measurement_concept_id"), at.cast("date").alias("measurement_date"), at.alias("measurement_datetime"), value.alias("value_as_number"),
        F.lit(MILLIMETRES).cast("long").alias("unit_concept_id"), "visit_occurrence_id", "visit_detail_id", F.col("procedure_occurrence_id").alias("measurement_event_id"), _event_field().alias("meas_event_field_concept_id"),
        F.col("kind").cast("string").alias("measurement_source_value"), cut(F.col("text"), 50).alias("value_source_value"), F.lit(kind).cast("long").alias("measurement_type_concept_id"),
    ])


def _of_details(rows: DataFrame) -> DataFrame:
    """Readings of an episode with a detail, with that detail's person and visit."""
    return rows.where("visit_detail_id IS NOT NULL AND NOT coalesce(_again, false)").withColumns({"person_id": F.col("_person"), "visit_occurrence_id": F.col("_stay")})


def measurement_pressures(t: Tables, numbering: Numbering = numbered, through_episode: bool = False) -> DataFrame:
    """'110/70' as two rows from one scan, each of a kind that is mapped for its part; numbered on from the table's largest number.

    The visit is the one that the sheet carries or, through_episode, that of its episode's visit detail: a reading of an episode without one is then left out.
    """
    values = {"SITE_OBS_SYSTOLIC": "systolic", "SITE_OBS_DIASTOLIC": "diastolic"}
    known = t["concepts"].where(F.col("vocabulary").isin(*values)).groupBy(F.col("code").alias("_c")).agg(F.collect_list(F.struct(F.col("vocabulary").alias("_v"), F.col("concept").alias("what"))).alias("_known"))
    rows = _readings(t, not through_episode).where("systolic IS NOT NULL OR diastolic IS NOT NULL")
    if through_episode:  # the detail has the person of its visit
        rows = _of_details(rows)
    else:
        rows = rows.where("visit_occurrence_id IS NOT NULL")
    rows = rows.join(known, F.col("kind").cast("string") == F.col("_c")).drop("_c").withColumn("q", F.explode("_known")).select("*", "q.*")  # a reading moves once, its two parts come last
    rows = rows.withColumn("x", reduce(lambda x, v: x.when(F.col("_v") == v, F.col(values[v])), values, F)).where("x IS NOT NULL")
    order = ["sheet_key", "seq", "_v", "visit_occurrence_id", "visit_detail_id", "procedure_occurrence_id", "what", "reading_time", "x"]
    return _measured(rows, order, t, numbering, F.col("what"), F.col("x"), FROM_RECORD)


def mean_pressure(systolic: Column, diastolic: Column) -> Column:
    """The diastolic and a third of the difference, to three places."""
    return F.round(diastolic + (systolic - diastolic) / 3.0, 3)


def measurement_mean(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """Mean pressures calculated from charted pairs of an episode, if the site's setting is 1; no rows otherwise."""
    on = setting(t["concepts"], "SITE_SETTING", "CALCULATED_MEAN_PRESSURE") == 1
    rows = _of_details(_readings(t, with_visits=False)).where(F.lit(on) & F.col("systolic").isNotNull() & F.col("diastolic").isNotNull())
    for part in ("SITE_OBS_SYSTOLIC", "SITE_OBS_DIASTOLIC"):  # a charted pressure is of a kind that is mapped for both parts
        rows = mapped(rows, t["concepts"], part, "kind", part, "inner")
    order = ["sheet_key", "seq", "reading_time", "systolic", "diastolic", "visit_occurrence_id", "visit_detail_id", "procedure_occurrence_id"]
    return _measured(rows, order, t, numbering, F.lit(MEAN_PRESSURE), mean_pressure(F.col("systolic"), F.col("diastolic")), CALCULATED)


def measurement_asa(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    rows = mapped(t["episodes"].join(keyed(_details(t)), "anaesthetic_key"), t["concepts"], "SITE_RISK_GRADE", "risk_grade", "grade", "inner")
    p = t["procedure_occurrence"].where("procedure_source_value = 'ANAESTHETIC'").select("visit_detail_id", "procedure_occurrence_id")
    return numbering(rows.join(keyed(p), "visit_detail_id", "left"), ["anaesthetic_key", "visit_detail_id", "procedure_occurrence_id", "grade"], "measurement_id", out=[
        "person_id", F.lit(ASA_CLASS).cast("long").alias("measurement_concept_id"), F.col("visit_detail_start_date").alias("measurement_date"), F.col("visit_detail_start_datetime").alias("measurement_datetime"),
        F.col("grade").cast("long").alias("value_as_concept_id"), "visit_occurrence_id", "visit_detail_id", F.col("procedure_occurrence_id").alias("measurement_event_id"), _event_field().alias("meas_event_field_concept_id"),
    ])


def observation(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    """Timed events with a mapping row."""
    rows = mapped(t["events"].where("event_time IS NOT NULL"), t["concepts"], "SITE_EVENT_OBS", "event_kind", "what", "inner")
    ranges = _ranges(rows, _details(t), "anaesthetic_key", "visit_detail_id", numbering)
    rows = _linked(_in_ranges(rows, _with_procedures(_details(t), t), "anaesthetic_key", ranges), "event_time")
    return numbering(rows, ["anaesthetic_key", "seq", "visit_detail_id", "procedure_occurrence_id", "what"], "observation_id", dealt=ranges, out=["person_id", F.col("what").cast("long").alias("observation_concept_id"), F.col("event_time").cast("date").alias("observation_date"), F.col("event_time").alias("observation_datetime"), "visit_occurrence_id", "visit_detail_id", F.col("procedure_occurrence_id").alias("observation_event_id")])


def device_exposure(t: Tables, numbering: Numbering = numbered) -> DataFrame:
    rows = mapped(t["devices"].where("placed IS NOT NULL"), t["concepts"], "SITE_DEVICE", "device", "what", "inner").join(keyed(_details(t)), "anaesthetic_key")
    end = open_end(F.col("placed"), F.col("removed"))
    rows, ranges = _by_own_key(rows, t["devices"], "device_key", numbering)
    return numbering(rows, ["device_key", "visit_detail_id", "what"], "device_exposure_id", dealt=ranges, out=["person_id", F.col("what").cast("long").alias("device_concept_id"), F.col("placed").cast("date").alias("device_exposure_start_date"), end.cast("date").alias("device_exposure_end_date"), "visit_occurrence_id", "visit_detail_id"])


#: Start and end of what bounds an observation period, by table.
PERIOD_COLUMNS = {
    "visit_occurrence": ("visit_start_date", "visit_end_date"), "procedure_occurrence": ("procedure_date", "procedure_end_date"), "measurement": ("measurement_date", None), "observation": ("observation_date", None),
    "drug_exposure": ("drug_exposure_start_date", "drug_exposure_end_date"), "condition_occurrence": ("condition_start_date", None), "device_exposure": ("device_exposure_start_date", "device_exposure_end_date"),
}


def observation_period(t: Tables) -> DataFrame:
    parts = [t[n].select("person_id", F.col(a).alias("first"), F.coalesce(b, a).alias("last") if b else F.col(a).alias("last")) for n, (a, b) in PERIOD_COLUMNS.items() if n in t]
    spans = reduce(DataFrame.unionByName, parts).groupBy("person_id").agg(F.min("first").alias("observation_period_start_date"), F.max("last").alias("observation_period_end_date"))
    return numbered(spans, ["person_id"], "observation_period_id", out=["person_id", "observation_period_start_date", "observation_period_end_date", F.lit(FROM_RECORD).cast("long").alias("period_type_concept_id")])


def cdm_source(t: Tables, name: str = "Tideline", run_date: str = "2024-01-01") -> DataFrame:
    """One row that names the source; the run's date is the caller's, so that a run can be repeated."""
    return t["person"].sparkSession.createDataFrame([(name, run_date, "v5.4")], "cdm_source_name string, cdm_release_date string, cdm_version string")


def _anaesthetics(t: Tables) -> DataFrame:
    """The episodes' procedures, with their person's birth."""
    return t["procedure_occurrence"].where("procedure_source_value = 'ANAESTHETIC' AND visit_detail_id IS NOT NULL").join(t["person"].select("person_id", "birth_datetime"), "person_id")


def anaesthetic(t: Tables) -> DataFrame:
    """One for each episode: duration, ages, first ASA class, and the latest weight in kilograms from seven days before the start to the end."""
    po = _anaesthetics(t)
    m = t["measurement"]
    asa = m.where((F.col("measurement_concept_id") == ASA_CLASS) & (F.col("meas_event_field_concept_id") == EVENT_FIELD)).groupBy(F.col("measurement_event_id").alias("procedure_occurrence_id"))
    asa = asa.agg(F.min(F.struct("measurement_datetime", "measurement_id", "value_as_concept_id")).alias("a")).select("procedure_occurrence_id", F.col("a.value_as_concept_id").alias("asa_class_concept_id"))
    w = m.where((F.col("measurement_concept_id") == WEIGHT) & (F.col("unit_concept_id") == KILOGRAM) & F.col("value_as_number").isNotNull()).select("person_id", "measurement_datetime", "measurement_id", "value_as_number")
    start, end, at = F.col("procedure_datetime"), F.col("procedure_end_datetime"), F.col("measurement_datetime")
    held = w.groupBy("person_id", "measurement_datetime").agg(F.max(F.struct("measurement_id", "value_as_number")).alias("w"))
    latest = as_of(po.select("procedure_occurrence_id", "person_id", start.alias("_start"), F.coalesce(end, start).alias("_until")), held, ("person_id",), "_until", "measurement_datetime", ["w"])
    weight = latest.where(at >= plus(F.col("_start"), days=-7)).select("procedure_occurrence_id", F.col("w.value_as_number").alias("weight_kg"))
    birth = F.col("birth_datetime")
    return po.join(asa, "procedure_occurrence_id", "left").join(weight, "procedure_occurrence_id", "left").select(
        F.col("procedure_occurrence_id").alias("anaesthetic_id"), "person_id", "visit_occurrence_id", "visit_detail_id", F.col("procedure_concept_id").alias("anaesthesia_type_concept_id"), start.alias("start_datetime"), end.alias("end_datetime"),
        minutes_between(start, end).alias("duration_minutes"), days_between(birth, start).alias("age_days"), completed_years(birth, start).alias("age_years"), completed_months(birth, start).alias("age_months"), "asa_class_concept_id", "weight_kg",
    )


def anaesthetic_phase(t: Tables) -> DataFrame:
    """One for each anaesthetic, from its times alone: in a run without that target, of the procedures that it would have."""
    times = (F.col("procedure_occurrence_id").alias("anaesthetic_id"), F.col("procedure_datetime").alias("start_datetime"), F.col("procedure_end_datetime").alias("end_datetime"))
    rows = t["anaesthetic"].select("anaesthetic_id", "start_datetime", "end_datetime") if "anaesthetic" in t else _anaesthetics(t).select(*times)
    return numbered(rows, ["anaesthetic_id"], "anaesthetic_phase_id", out=["anaesthetic_id", F.lit(1).cast("long").alias("phase_sequence"), F.lit("whole anaesthetic").alias("phase_name"), "start_datetime", "end_datetime"])


@dataclass(frozen=True)
class Step:
    """Rows for a target; key is its identifier, base what is added to it in this layer. Rows that tideline.operators.ids has numbered are written already."""

    target: str
    rows: Callable[..., DataFrame]
    key: str | None = None
    base: int = 0
    written: bool = False


CORE: Sequence[Step] = (
    Step("person", person, "person_id", written=True),
    Step("provider", lambda t: coded(t["staff"], "staff_key", "label", "provider"), "provider_id", written=True),
    Step("care_site", lambda t: coded(t["wards"], "ward_key", "label", "care_site"), "care_site_id", written=True),
    Step("visit_occurrence", visit_occurrence, "visit_occurrence_id", written=True),
    Step("condition_occurrence", condition_occurrence, "condition_occurrence_id", written=True),
    Step("death", death),
    Step("drug_exposure", drug_exposure, "drug_exposure_id", written=True),
    Step("visit_detail", lambda t: staged(visit_detail(t), "visit_detail") if "provider" in t else visit_detail(t), "visit_detail_id", written=True),
    Step("procedure_occurrence", procedure_anaesthetic, "procedure_occurrence_id", written=True),
    Step("procedure_occurrence", procedure_events, "procedure_occurrence_id", written=True),
    Step("procedure_occurrence", procedure_surgery, "procedure_occurrence_id", written=True),
    Step("measurement", measurement, "measurement_id", written=True),
    Step("measurement", measurement_pressures, "measurement_id", written=True),
    Step("measurement", measurement_mean, "measurement_id", written=True),
    Step("observation", observation, "observation_id", written=True),
    Step("device_exposure", device_exposure, "device_exposure_id", written=True),
)
OF_READINGS = (measurement, measurement_pressures, measurement_mean)
LAYER_BASE = 5_000_000_000
LAYER: Sequence[Step] = (Step("measurement", measurement_asa, "measurement_id", LAYER_BASE, written=True), Step("drug_exposure", lambda t, numbering=numbered: (drug_infusion_roles if "role_drugs" in t else drug_infusion)(t, numbering), "drug_exposure_id", LAYER_BASE, written=True))
DERIVED: Sequence[Step] = (
    Step("observation_period", observation_period, "observation_period_id", written=True),
    Step("anaesthetic", anaesthetic, "anaesthetic_id"),
    Step("anaesthetic_phase", anaesthetic_phase, "anaesthetic_phase_id", written=True),
    Step("cdm_source", cdm_source),
)


def _added(t: Tables, target: str, rows: DataFrame) -> DataFrame:
    """rows after those that the target has already."""
    if target not in t:
        return rows
    extra = set(rows.columns) - set(t[target].columns)
    if extra:
        raise ValueError(f"{target} has no {', '.join(sorted(extra))}")
    return t[target].unionByName(rows, allowMissingColumns=True)


def run(source: Mapping[str, DataFrame], steps: Sequence[Step] = (*CORE, *LAYER, *DERIVED), unread: Collection[str] = ()) -> Tables:
    """All steps in order. Later steps read earlier targets, so the rows of each step are written, once; a target with several steps is the union of theirs.

    Concepts are written first, so that their size is known and small ones need no shuffle of the rows that look them up.

    Targets in `unread` are those whose identifiers neither a later step nor the caller reads: their rows are whole, but come without identifiers, and are not written.

    A step without its key, or with columns that the target does not have yet once it exists, fails by name.
    """
    t: Tables = dict(source)
    if "concepts" in t:
        t["concepts"] = staged(t["concepts"], "concepts")
    shared = sum(s.rows in OF_READINGS for s in steps) > 1
    for s in steps:
        if shared and s.rows in OF_READINGS and "_readings" not in t:
            t["_readings"] = staged(_readings(t), "readings")
        if s.target in unread:
            t[s.target] = _added(t, s.target, s.rows(t, unnumbered))
            continue
        rows = s.rows(t)
        if s.key and s.key not in rows.columns:
            raise ValueError(f"{s.target}: the step gives no {s.key}")
        if not s.written:
            rows = staged(rows, s.target)
        if s.base:
            rows = rows.withColumn(s.key, F.col(s.key) + s.base)
        t[s.target] = _added(t, s.target, rows)
    t.pop("_readings", None)
    return t


def worklist(rows: DataFrame, concept: str, code: str, episode: str) -> DataFrame:
    """Unmapped codes: rows and episodes, most frequent first."""
    return rows.where(F.col(concept) == 0).groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(episode).alias("episodes")).orderBy(F.desc("rows"), "code")


def proposed(labels: DataFrame, concepts: DataFrame, synonyms: DataFrame, maps_to: DataFrame, domain: str, classes: Sequence[str] = (), coded_in: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mapping rows for labels(code, label) with exactly one standard target, and the others with a reason.

    A label is a concept's name or synonym in the domain, whatever its case; or, with coded_in, a concept's code in that vocabulary, and its targets are of the domain, whatever their class. A concept
    that is standard is a target of its own; valid 'Maps to' rows (concept_id, target_id) lead to further ones.
    """
    if coded_in is not None:
        names = concepts.where(F.col("vocabulary_id") == coded_in).select("concept_id", F.lower("concept_code").alias("name")).distinct()
    else:
        names = concepts.where(F.col("domain_id") == domain).select("concept_id", F.lower("concept_name").alias("name"))
        names = names.union(synonyms.join(concepts.where(F.col("domain_id") == domain).select("concept_id"), "concept_id").select("concept_id", F.lower("synonym"))).distinct()
    leads = maps_to.select("concept_id", "target_id").union(concepts.select("concept_id", "concept_id")).distinct()
    found = labels.withColumn("name", F.lower(F.trim("label"))).join(names, "name", "left").join(leads, "concept_id", "left")
    fits = F.col("domain_id") == domain if coded_in is not None else F.col("concept_class_id").isin(list(classes)) if classes else F.lit(True)
    good = concepts.where((F.col("standard_concept") == "S") & fits).select(F.col("concept_id").alias("target_id"), F.lit(True).alias("_good"))
    n = found.join(good, "target_id", "left").groupBy("code", "label").agg(F.count("concept_id").alias("hits"), F.countDistinct(F.when(F.col("_good"), F.col("target_id"))).alias("targets"), F.min(F.when(F.col("_good"), F.col("target_id"))).alias("concept"))
    reason = F.when(F.col("hits") == 0, f"no concept has this {'code' if coded_in is not None else 'name'}").when(F.col("targets") == 0, "no standard target").otherwise("several targets")
    return n.where("targets = 1").select("code", "concept"), n.where("targets <> 1").select("code", "label", reason.alias("reason"))


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
