"""Registered queries of the library's own operators on the star schema's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans import disclosure, measures, registry
from tideline.sources.driver_frames import COMMON, Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that gives its rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums of doubles depend on their order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


KINDS = [("view", 1), ("click", 2), ("purchase", 3)]
BANDS = [(0, 200, 60.0), (200, 500, 90.0), (500, 850, 120.0)]


def kinds_of(x: Frames) -> DataFrame:
    return x.spark.createDataFrame(KINDS, "kind string, preference int")


def bands_of(x: Frames) -> DataFrame:
    return x.spark.createDataFrame(BANDS, "from_days int, until_days int, threshold double")


def _burden_sql(direction: str = "below", until: int | None = None, stands: int = 720) -> str:
    beyond = "<" if direction == "below" else ">"
    end = "stop_time" if until is None else f"least(stop_time, start_time + INTERVAL {until} MINUTE)"
    return f"""
WITH {COMMON}, band(f, u, threshold) AS (VALUES (0, 200, 60.0), (200, 500, 90.0), (500, 850, 120.0)),
own AS (
  SELECT e.*, date_diff('day', birth_date, CAST(start_time AS DATE)) AS age_days, CAST(threshold AS DOUBLE) AS threshold, {end} AS until_w
  FROM eligible e LEFT JOIN band ON date_diff('day', birth_date, CAST(start_time AS DATE)) >= f AND date_diff('day', birth_date, CAST(start_time AS DATE)) < u
), kept AS (
  SELECT o.anaesthetic_key, o.threshold, o.stop_time, o.until_w, r.reading_time, r.value
  FROM own o JOIN reading r USING (anaesthetic_key)
  WHERE r.accepted = 1 AND r.value IS NOT NULL AND r.kind IN ('view', 'click', 'purchase') AND r.reading_time >= o.start_time
    AND (o.until_w IS NULL OR r.reading_time <= o.until_w)
  QUALIFY row_number() OVER (PARTITION BY o.anaesthetic_key, r.reading_time
    ORDER BY CASE r.kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, {'r.value' if direction == 'below' else '-r.value'}) = 1
), stood AS (
  SELECT *, coalesce(lead(reading_time) OVER (PARTITION BY anaesthetic_key ORDER BY reading_time), CASE WHEN stop_time IS NOT NULL THEN until_w END) AS until_time
  FROM kept
), s AS (
  SELECT anaesthetic_key, count(*) AS n,
         sum(CASE WHEN until_time IS NOT NULL AND value {beyond} threshold THEN least(date_diff('second', reading_time, until_time), {60 * stands}) ELSE 0 END) / 60.0 AS m
  FROM stood GROUP BY 1
)
SELECT anaesthetic_key, CAST(age_days AS BIGINT) AS age_days, threshold, coalesce(n, 0) AS readings,
       round(CAST(CASE WHEN threshold IS NOT NULL THEN m END AS DOUBLE), 6) AS minutes_beyond
FROM own LEFT JOIN s USING (anaesthetic_key)
"""


@query(_burden_sql())
def m1_burden(x: Frames) -> DataFrame:
    out = measures.burden(x.subjects(), x.episodes(), x.readings(), kinds_of(x), bands_of(x), stands_minutes=720)
    return rounded(out, "minutes_beyond")


@query(_burden_sql("above", 4320))
def m2_burden_above(x: Frames) -> DataFrame:
    out = measures.burden(x.subjects(), x.episodes(), x.readings(), kinds_of(x), bands_of(x), "above", until_minutes=4320, stands_minutes=720)
    return rounded(out, "minutes_beyond")


@query(
    f"""
WITH {COMMON}, inside AS (
  SELECT e.anaesthetic_key, e.stop_time, r.reading_time, r.value FROM eligible e JOIN reading r USING (anaesthetic_key)
  WHERE r.kind = 'view' AND r.accepted = 1 AND r.reading_time >= e.start_time AND (e.stop_time IS NULL OR r.reading_time <= e.stop_time)
  QUALIFY row_number() OVER (PARTITION BY e.anaesthetic_key, r.reading_time ORDER BY r.value) = 1
), stood AS (
  SELECT *, coalesce(lead(reading_time) OVER (PARTITION BY anaesthetic_key ORDER BY reading_time), stop_time) AS until_time FROM inside
), s AS (
  SELECT anaesthetic_key, count(*) AS n, min(value) AS lowest,
         sum(CASE WHEN until_time IS NOT NULL AND value < 50 THEN least(date_diff('second', reading_time, until_time), 43200) ELSE 0 END) / 60.0 AS m
  FROM stood GROUP BY 1
), a AS (
  SELECT e.anaesthetic_key, r.reading_time, r.value FROM eligible e JOIN reading r USING (anaesthetic_key)
  WHERE r.kind = 'view' AND r.accepted = 1 AND r.reading_time > e.stop_time AND r.reading_time <= e.stop_time + INTERVAL 2880 MINUTE
  QUALIFY row_number() OVER (PARTITION BY e.anaesthetic_key ORDER BY r.reading_time, r.value) = 1
)
SELECT e.anaesthetic_key, coalesce(n, 0) AS readings, round(CAST(m AS DOUBLE), 6) AS minutes_below, lowest, a.reading_time AS arrival_time, a.value AS arrival_temperature
FROM eligible e LEFT JOIN s USING (anaesthetic_key) LEFT JOIN a USING (anaesthetic_key)
"""
)
def m3_cooling(x: Frames) -> DataFrame:
    out = measures.cooling(x.subjects(), x.episodes(), x.readings(), "view", 50.0, stands_minutes=720, recovery_minutes=2880)
    return rounded(out, "minutes_below")


def _within_sql(until: int | None = None) -> str:
    end = "stop_time" if until is None else f"least(stop_time, start_time + INTERVAL {until} MINUTE)"
    return f"""WITH {COMMON}, own AS (SELECT *, {end} AS until_w FROM eligible), inside AS (
  SELECT o.anaesthetic_key, r.reading_time, r.value FROM own o JOIN reading r USING (anaesthetic_key)
  WHERE r.kind IN ('view', 'click', 'purchase') AND r.accepted = 1 AND r.value IS NOT NULL AND r.reading_time >= o.start_time AND (o.until_w IS NULL OR r.reading_time <= o.until_w)
)"""


@query(
    f"""{_within_sql(4320)}, s AS (SELECT anaesthetic_key, count(*) AS n, max(value) AS extreme FROM inside GROUP BY 1),
t AS (SELECT i.anaesthetic_key, min(reading_time) AS extreme_time FROM inside i JOIN s ON s.anaesthetic_key = i.anaesthetic_key AND i.value = extreme GROUP BY 1)
SELECT e.anaesthetic_key, coalesce(n, 0) AS readings, extreme, extreme_time FROM eligible e LEFT JOIN s USING (anaesthetic_key) LEFT JOIN t USING (anaesthetic_key)"""
)
def x1_extreme_in_window(x: Frames) -> DataFrame:
    """The registered measure, by name and version."""
    return registry.measure("extreme_in_window", 1, x.subjects(), x.episodes(), x.readings(), kinds=kinds_of(x).select("kind"), direction="highest", from_minutes=0, until_minutes=4320)


@query(
    f"""{_within_sql()}, s AS (SELECT anaesthetic_key, count(*) AS n, min(reading_time) FILTER (value < 60) AS first_time FROM inside GROUP BY 1)
SELECT e.anaesthetic_key, coalesce(n, 0) AS readings, first_time, round(CAST(date_diff('second', start_time, first_time) / 60.0 AS DOUBLE), 6) AS minutes_to_first FROM eligible e LEFT JOIN s USING (anaesthetic_key)"""
)
def x1_time_to_first_beyond(x: Frames) -> DataFrame:
    """The registered measure, by name and version."""
    out = registry.measure("time_to_first_beyond_threshold", 1, x.subjects(), x.episodes(), x.readings(), kinds=kinds_of(x).select("kind"), threshold=60.0, direction="below", from_minutes=0, until_minutes=None)
    return rounded(out, "minutes_to_first")


@query(
    f"""WITH {COMMON}, s AS (SELECT e.anaesthetic_key, count(*) AS n FROM eligible e JOIN reading r USING (anaesthetic_key)
  WHERE r.kind IN ('error', 'signup') AND r.reading_time >= e.start_time AND r.reading_time <= coalesce(least(e.stop_time, e.start_time + INTERVAL 2880 MINUTE), e.start_time + INTERVAL 2880 MINUTE) GROUP BY 1)
SELECT e.anaesthetic_key, coalesce(n, 0) AS events FROM eligible e LEFT JOIN s USING (anaesthetic_key)"""
)
def x1_count_of_events(x: Frames) -> DataFrame:
    """The registered measure, by name and version."""
    events = x.readings().select("anaesthetic_key", "kind", F.col("reading_time").alias("event_time"))
    kinds = x.spark.createDataFrame([("error",), ("signup",)], "kind string")
    return registry.measure("count_of_events", 1, x.subjects(), x.episodes(), events, kinds=kinds, from_minutes=0, until_minutes=2880)


@query(
    f"""
WITH {COMMON}, times AS (
  SELECT DISTINCT e.anaesthetic_key, e.start_time, e.stop_time, r.reading_time FROM eligible e JOIN reading r USING (anaesthetic_key)
  WHERE r.kind IN ('view', 'click', 'purchase') AND r.accepted = 1 AND r.reading_time >= e.start_time AND (e.stop_time IS NULL OR r.reading_time <= e.stop_time)
), spaced AS (
  SELECT *, coalesce(lead(reading_time) OVER (PARTITION BY anaesthetic_key ORDER BY reading_time), stop_time) AS nxt FROM times
), s AS (
  SELECT anaesthetic_key, count(*) AS n, sum(CASE WHEN nxt IS NOT NULL THEN least(date_diff('second', reading_time, nxt), 86400) END) / 60.0 AS covered,
         max(date_diff('second', reading_time, nxt)) AS between_s, min(date_diff('second', start_time, reading_time)) AS first_s
  FROM spaced GROUP BY 1
), o AS (
  SELECT e.anaesthetic_key, stop_time, date_diff('second', start_time, stop_time) / 60.0 AS span, n, covered, greatest(first_s, between_s) / 60.0 AS longest
  FROM eligible e LEFT JOIN s USING (anaesthetic_key)
)
SELECT anaesthetic_key, round(CAST(span AS DOUBLE), 6) AS window_minutes, coalesce(n, 0) AS readings,
       round(CAST(CASE WHEN stop_time IS NOT NULL THEN coalesce(covered, 0) END AS DOUBLE), 6) AS covered_minutes,
       round(CAST(CASE WHEN span > 0 THEN coalesce(covered, 0) / span END AS DOUBLE), 6) AS share_covered,
       round(CAST(CASE WHEN stop_time IS NOT NULL THEN CASE WHEN n IS NULL THEN span ELSE longest END END AS DOUBLE), 6) AS longest_gap_minutes
FROM o
"""
)
def m4_completeness(x: Frames) -> DataFrame:
    out = measures.completeness(x.subjects(), x.episodes(), x.readings(), kinds_of(x).select("kind"), 1440)
    return rounded(out, "window_minutes", "covered_minutes", "share_covered", "longest_gap_minutes")


@query(
    f"""
WITH {COMMON}, inside AS (
  SELECT e.anaesthetic_key, e.stop_time, r.kind, r.reading_time, r.value FROM eligible e JOIN reading r USING (anaesthetic_key)
  WHERE r.accepted = 1 AND r.reading_time >= e.start_time AND (e.stop_time IS NULL OR r.reading_time <= e.stop_time)
), agent AS (
  SELECT anaesthetic_key, kind, reading_time AS t, min(value) AS c FROM inside WHERE kind IN ('click', 'purchase') GROUP BY ALL
), flow AS (
  SELECT anaesthetic_key, reading_time AS t, min(value) AS f FROM inside WHERE kind = 'view' GROUP BY ALL
), charted AS (SELECT DISTINCT anaesthetic_key, kind FROM agent),
cuts AS (
  SELECT anaesthetic_key, kind, t AS tt FROM agent UNION SELECT c.anaesthetic_key, c.kind, f.t FROM charted c JOIN flow f USING (anaesthetic_key)
), stretch AS (
  SELECT c.*, coalesce(lead(tt) OVER (PARTITION BY c.anaesthetic_key, kind ORDER BY tt), e.stop_time) AS nxt FROM cuts c JOIN eligible e USING (anaesthetic_key)
), standing AS (
  SELECT s.anaesthetic_key, s.kind, s.tt, s.nxt, f.t AS ft, f.f, a.t AS agt, a.c
  FROM stretch s ASOF JOIN flow f ON s.anaesthetic_key = f.anaesthetic_key AND s.tt >= f.t
  ASOF JOIN agent a ON s.anaesthetic_key = a.anaesthetic_key AND s.kind = a.kind AND s.tt >= a.t
  WHERE s.nxt IS NOT NULL
), counted AS (
  SELECT *, greatest(0, least(date_diff('second', tt, nxt), 86400 - date_diff('second', ft, tt), 86400 - date_diff('second', agt, tt))) AS sec FROM standing
), s AS (
  SELECT anaesthetic_key, kind, sum(sec) / 60.0 AS m, sum(f * 1000.0 * c / 100.0 * sec / 60.0) AS v FROM counted GROUP BY ALL
)
SELECT c.anaesthetic_key, c.kind AS agent, round(CAST(coalesce(m, 0) AS DOUBLE), 6) AS minutes, round(CAST(coalesce(v, 0) AS DOUBLE), 3) AS vapour_ml,
       round(CAST(coalesce(v, 0) / CASE c.kind WHEN 'click' THEN 200.0 ELSE 180.0 END AS DOUBLE), 3) AS liquid_ml,
       round(CAST(CASE WHEN c.kind = 'click' THEN coalesce(v, 0) / 200.0 * 0.5 END AS DOUBLE), 3) AS co2e_kg
FROM charted c LEFT JOIN s USING (anaesthetic_key, kind)
"""
)
def m5_two_signal_integral(x: Frames) -> DataFrame:
    vapour = x.spark.createDataFrame([("click", 200.0), ("purchase", 180.0)], "kind string, factor double")
    co2e = x.spark.createDataFrame([("click", 0.5)], "kind string, factor double")
    out = measures.two_signal_integral(x.subjects(), x.episodes(), x.readings(), vapour, co2e, "view", stands_minutes=1440)
    return rounded(rounded(out, "minutes"), "vapour_ml", "liquid_ml", "co2e_kg", digits=3)


_DETAIL = f"""
WITH {COMMON}, young AS (
  SELECT *, CASE WHEN death_date >= CAST(start_time AS DATE) AND death_date <= CAST(start_time AS DATE) + 90 THEN 1 ELSE 0 END AS died
  FROM eligible WHERE date_diff('day', birth_date, CAST(start_time AS DATE)) < 400
), kept AS (
  SELECT y.anaesthetic_key, y.stop_time, r.reading_time, r.value FROM young y JOIN reading r USING (anaesthetic_key)
  WHERE r.kind IN ('view', 'click') AND r.accepted = 1 AND r.reading_time >= y.start_time AND (y.stop_time IS NULL OR r.reading_time <= y.stop_time)
  QUALIFY row_number() OVER (PARTITION BY y.anaesthetic_key, r.reading_time ORDER BY CASE r.kind WHEN 'view' THEN 0 ELSE 1 END, r.value) = 1
), stood AS (
  SELECT *, coalesce(lead(reading_time) OVER (PARTITION BY anaesthetic_key ORDER BY reading_time), stop_time) AS nxt FROM kept
), low AS (
  SELECT anaesthetic_key, CAST(sum(CASE WHEN value < 40 AND nxt IS NOT NULL THEN least(date_diff('second', reading_time, nxt), 300) ELSE 0 END) / 60.0 AS DOUBLE) AS minutes
  FROM stood GROUP BY 1
), detail AS (
  SELECT y.anaesthetic_key, y.patient_key, CAST(year(start_time) AS BIGINT) AS start_year, minutes, died FROM young y LEFT JOIN low USING (anaesthetic_key)
)
"""


def detail_of(x: Frames) -> DataFrame:
    return measures.audit_detail(x.subjects(), x.episodes(), x.readings(), ("view", "click"), under_days=400)


@query(
    _DETAIL
    + """, b(band, minutes_below) AS (VALUES (0, 'no mean pressure recorded'), (1, 'none'), (2, 'under 5 minutes'), (3, '5 to 14 minutes'), (4, '15 minutes or more')),
x AS (SELECT *, CASE WHEN minutes IS NULL THEN 0 WHEN minutes = 0 THEN 1 WHEN minutes < 5 THEN 2 WHEN minutes < 15 THEN 3 ELSE 4 END AS band FROM detail)
SELECT minutes_below, count(x.band) AS anaesthetics, CAST(coalesce(sum(died), 0) AS BIGINT) AS died_within_90_days, count(DISTINCT patient_key) AS children,
       count(DISTINCT CASE WHEN died = 1 THEN patient_key END) AS children_died_within_90_days
FROM b LEFT JOIN x USING (band) GROUP BY band, minutes_below
"""
)
def m6_banded_audit(x: Frames) -> DataFrame:
    return measures.audit(detail_of(x))


@query(_DETAIL + "SELECT anaesthetic_key, round(minutes, 6) AS minutes, died FROM detail")
def m20_audit_detail(x: Frames) -> DataFrame:
    return rounded(detail_of(x), "minutes").select("anaesthetic_key", "minutes", "died")


@query(_DETAIL + "SELECT start_year, count(*) AS anaesthetics FROM detail WHERE minutes IS NULL GROUP BY 1")
def m20_without_reading_by_year(x: Frames) -> DataFrame:
    return detail_of(x).where("minutes IS NULL").groupBy("start_year").agg(F.count(F.lit(1)).alias("anaesthetics"))


_LIVE = """, live AS (
  SELECT * FROM drug d WHERE NOT EXISTS (SELECT 1 FROM drug c WHERE c.amends_key = d.drug_event_key) AND action IS NOT NULL
)"""


@query(
    f"""
WITH {COMMON}{_LIVE}, m(local_key, concept_id, status) AS (
  VALUES ('d0', NULL, 'unmapped'), ('d1', 11, 'mapped'), ('d1', 12, 'mapped'), ('d2', 20, 'mapped'), ('d3', 30, 'mapped'), ('d4', 40, 'mapped'), ('d5', 50, 'mapped')
), c AS (
  SELECT local_key, CASE WHEN count(*) = 1 AND max(status) = 'mapped' THEN max(concept_id) ELSE 0 END AS concept_id, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE max(status) END AS status
  FROM m GROUP BY 1
), n AS (
  SELECT *, lead(given_time) OVER (PARTITION BY order_key, CASE WHEN order_key IS NULL THEN anaesthetic_key END, CASE WHEN order_key IS NULL THEN drug END ORDER BY given_time, drug_event_key) AS ended
  FROM live
)
SELECT drug_event_key, anaesthetic_key, order_key, drug, CAST(coalesce(concept_id, 0) AS BIGINT) AS drug_concept_id, given_time AS started, ended,
       CASE WHEN ended IS NULL THEN 'stop not recorded' END AS stop_reason, coalesce(status, 'unlisted') || ':' || drug AS drug_source_value, amount
FROM n LEFT JOIN c ON c.local_key = n.drug WHERE action IN ('infusion_start', 'rate_change', 'infusion_restart')
"""
)
def m10_exposure_intervals(x: Frames) -> DataFrame:
    return measures.exposure_intervals(x.drugs(), x.drug_map())


@query(
    f"""
WITH {COMMON}, n AS (SELECT *, lead(given_time) OVER (PARTITION BY anaesthetic_key, drug ORDER BY given_time, drug_event_key) AS ended FROM drug WHERE action IS NOT NULL)
SELECT drug_event_key, anaesthetic_key, drug, given_time AS started, ended FROM n WHERE action IN ('infusion_start', 'rate_change', 'infusion_restart')
"""
)
def m11_direct_intervals(x: Frames) -> DataFrame:
    return measures.direct_intervals(x.drugs())


@query(
    f"""
WITH {COMMON}, g AS (SELECT kind, CAST(date_trunc('day', reading_time) AS DATE) AS day, count(*) AS n FROM reading WHERE kind <> 'view' OR value < 20 GROUP BY ALL)
SELECT kind, CAST(day AS VARCHAR) AS day, CASE WHEN n BETWEEN 1 AND 4 THEN NULL ELSE n END AS n FROM g
"""
)
def d1_blanked(x: Frames) -> DataFrame:
    r = x.readings().where("kind <> 'view' OR value < 20")
    return disclosure.blanked(r.groupBy("kind", F.col("reading_time").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")), ["n"])


@query(
    f"""
WITH {COMMON}, g AS (SELECT kind, CAST(reading_time AS DATE) AS day, count(*) AS n, count(*) FILTER (accepted = 0) AS refused FROM reading GROUP BY ALL)
SELECT kind, CAST(day AS VARCHAR) AS day, n - n % 10 AS n, CASE WHEN refused >= 10 THEN refused - refused % 10 END AS refused FROM g WHERE n >= 10
"""
)
def d2_floored(x: Frames) -> DataFrame:
    g = x.readings().groupBy("kind", F.col("reading_time").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("accepted") == 0).alias("refused"))
    return disclosure.floored(g, "n", ["refused"])
