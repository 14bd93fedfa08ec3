"""Queries of standard counts, profiles, quality tests and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ids import dense_numbered, numbered
from tideline.operators.intervals import banded, best_at_time, one_concept, superseded
from tideline.plans import counts, export, profile, quality
from tideline.queries import query
from tideline.sources.driver_frames import COMMON, Frames


@query(
    f"""
WITH {COMMON}, k AS (SELECT anaesthetic_key, count(*) AS n, count(*) FILTER (kind IN ('view', 'click') AND accepted = 1 AND value IS NOT NULL) AS m FROM reading GROUP BY 1)
SELECT CAST(year(start_time) AS BIGINT) AS year, count(*) AS episodes, count(s.patient_key) AS with_subject, count(s.birth_date) AS with_birth_date, count(stop_time) AS with_stop,
       count(*) FILTER (n > 0) AS with_reading, count(*) FILTER (m > 0) AS with_mean
FROM episode e LEFT JOIN subject s USING (patient_key) LEFT JOIN k USING (anaesthetic_key) GROUP BY 1
"""
)
def t1_coverage_by_year(x: Frames) -> DataFrame:
    return counts.coverage_by_year(x.subjects(), x.episodes(), x.readings(), ["view", "click"])


@query(
    f"""
WITH {COMMON}, a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1), b AS (SELECT anaesthetic_key AS k, count(*) AS n FROM episode GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT 'orders' AS frame, count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM a UNION ALL
SELECT 'episodes', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM b UNION ALL SELECT 'lines', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM c
"""
)
def t2_repeated_keys(x: Frames) -> DataFrame:
    return counts.repeated_keys({"orders": (x.table("orders"), "o_custkey"), "episodes": (x.episodes(), "anaesthetic_key"), "lines": (x.table("lineitem"), "l_orderkey")})


@query(
    f"""
WITH {COMMON}
SELECT kind, CAST(year(reading_time) AS BIGINT) AS year, count(*) AS readings, count(*) FILTER (accepted = 1) AS accepted, count(value) AS with_value, count(e.anaesthetic_key) AS with_episode
FROM reading r LEFT JOIN (SELECT anaesthetic_key FROM episode WHERE stop_time IS NOT NULL) e USING (anaesthetic_key) GROUP BY ALL
"""
)
def t3_readings_by_kind(x: Frames) -> DataFrame:
    return counts.readings_by_kind(x.readings(), x.episodes().where("stop_time IS NOT NULL"))


@query(
    """
SELECT event_type AS kind, count(*) FILTER (event_id % 13 = 0 AND event_id % 2 = 0) AS not_held, count(*) FILTER (event_id % 13 = 0 AND event_id % 2 = 1) AS not_a_number,
       count(*) FILTER (event_id % 20 = 0) AS not_accepted
FROM events GROUP BY 1
"""
)
def t4_empty_by_reason(x: Frames) -> DataFrame:
    i = F.col("reading_key").cast("long")
    r = x.readings().withColumns({"value": F.when(i % 13 != 0, F.col("value")), "value_text": F.when((i % 13 == 0) & (i % 2 == 1), "n/a")})
    return counts.empty_by_reason(r)


@query(
    f"""
WITH {COMMON}, f AS (SELECT anaesthetic_key, kind, CAST(floor(epoch(reading_time) / 300) AS BIGINT) AS t FROM reading WHERE kind IN ('view', 'click')), g AS (
  SELECT kind, t, lag(t) OVER (PARTITION BY anaesthetic_key, kind ORDER BY t) AS b FROM f
), m AS (SELECT kind, CAST(year(make_timestamp(t * 1000000)) AS BIGINT) AS year, t - b AS n FROM g WHERE b IS NOT NULL)
SELECT kind, year, CASE WHEN n = 0 THEN 'the same time' WHEN n < 120 THEN 'under 2 minutes' WHEN n <= 300 THEN '2 to 5 minutes' WHEN n <= 900 THEN 'over 5 and up to 15 minutes' ELSE 'over 15 minutes' END AS band, count(*) AS gaps FROM m GROUP BY ALL
"""
)
def t5_gaps(x: Frames) -> DataFrame:
    """On a clock that runs 300 times slower, so that readings fall in every band."""
    slow = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("reading_time").cast("timestamp")) / 300))
    return counts.gaps(x.readings().withColumn("reading_time", slow), ["view", "click"])


@query(
    f"""
WITH {COMMON}
SELECT CAST(year(start_time) AS BIGINT) AS year, count(*) AS readings, count(*) FILTER (reading_time < start_time) AS before_start, count(*) FILTER (reading_time > stop_time) AS after_stop
FROM reading JOIN episode USING (anaesthetic_key) WHERE kind IN ('view', 'click') GROUP BY 1
"""
)
def t6_outside(x: Frames) -> DataFrame:
    return counts.outside(x.readings(), x.episodes(), ["view", "click"])


_ODD = """, o AS (SELECT CAST(day(start_time) AS BIGINT) AS year, count(*) AS n, count(*) FILTER (reading_time < start_time OR reading_time > stop_time) AS m FROM reading JOIN episode USING (anaesthetic_key) WHERE kind IN ('view', 'click') GROUP BY 1),
s AS (SELECT year, m / n AS share, min(m / n) OVER () AS least FROM o)"""


@query(f"WITH {COMMON}{_ODD} SELECT year AS day, round(share, 6) AS share, round(least, 6) AS least FROM s WHERE share - least >= 0.25")
def t7_outside_shares(x: Frames) -> DataFrame:
    """Days of the month stand for years, of which the table has few."""
    rows = x.readings().where("kind IN ('view', 'click')").join(x.episodes().select("anaesthetic_key", "start_time", "stop_time"), "anaesthetic_key")
    t = F.col("reading_time")
    by_day = rows.groupBy(F.dayofmonth("start_time").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("readings"), F.count_if(t < F.col("start_time")).alias("before_start"), F.count_if(t > F.col("stop_time")).alias("after_stop"))
    return counts.outside_shares(by_day, "day").withColumns({"share": F.round("share", 6), "least": F.round("least", 6)})


@query(
    "WITH h AS (SELECT DISTINCT event_type AS kind, CAST(2000 + day(ts) AS BIGINT) AS year FROM events WHERE event_type IN ('view', 'click') AND NOT (event_type = 'view' AND day(ts) IN (3, 9))), c AS (SELECT CAST(2000 + day(ts) AS BIGINT) AS year, count(*) AS n FROM events GROUP BY 1) "
    "SELECT k.kind, c.year FROM (SELECT DISTINCT kind FROM h) k, c WHERE n >= 10 AND NOT EXISTS (SELECT 1 FROM h WHERE h.kind = k.kind AND h.year = c.year)"
)
def t7_absent_kinds(x: Frames) -> DataFrame:
    """Days of the month as years; a kind is taken away on two of them."""
    day = F.dayofmonth("reading_time")
    r = x.readings().where(~((F.col("kind") == "view") & day.isin(3, 9))).withColumn("reading_time", F.make_date(2000 + day, F.lit(1), F.lit(1)))
    cover = x.table("events").groupBy((2000 + F.dayofmonth("ts")).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("episodes"))
    return counts.absent_kinds(r, cover, ["view", "click"])


_DAYS = """WITH d AS (SELECT CAST(dayofmonth(ts) AS BIGINT) AS day, count(*) AS total, count(*) FILTER (event_type = 'view' AND (day(ts) <> 7 OR event_id % 5 = 0)) AS views,
  count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)"""


def _days(x: Frames) -> DataFrame:
    d = F.dayofmonth("ts").cast("long")
    view = (F.col("event_type") == "view") & ((d != 7) | (F.col("event_id") % 5 == 0))
    return x.table("events").groupBy(d.alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(view).alias("views"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(
    _DAYS
    + """, p AS (SELECT day, total, 'views' AS figure, views AS n FROM d UNION ALL SELECT day, total, 'errors', errors FROM d),
s AS (SELECT *, n / total AS share, max(n / total) OVER (PARTITION BY figure) AS best FROM p)
SELECT day, figure, round(share, 6) AS share, round(best, 6) AS best FROM s WHERE share <= 0.5 * best AND best * total - n >= 10
"""
)
def t7_cliffs(x: Frames) -> DataFrame:
    out = counts.cliffs(_days(x), "total", ["views", "errors"], "day")
    return out.withColumns({"share": F.round("share", 6), "best": F.round("best", 6)})


@query(_DAYS + " SELECT day, total, CAST(round(100.0 * views / total, 0) AS BIGINT) AS views_percent, CAST(round(100.0 * errors / total, 0) AS BIGINT) AS errors_percent FROM d")
def t8_shares(x: Frames) -> DataFrame:
    return counts.shares(_days(x), "total", ["views", "errors"])


@query(
    _DAYS
    + """, p AS (SELECT day, total, views AS n, max(views / total) OVER () AS best FROM d), f AS (SELECT day FROM p WHERE n / total <= 0.5 * best AND best * total - n >= 10)
SELECT d.day, total, f.day IS NOT NULL AS flagged, CASE WHEN errors % 7 BETWEEN 1 AND 4 THEN NULL ELSE errors % 7 END AS without_reading FROM d LEFT JOIN f USING (day)
"""
)
def t9_with_coverage(x: Frames) -> DataFrame:
    d = _days(x)
    empty = d.where(F.col("errors") % 7 > 0).select("day", (F.col("errors") % 7).alias("anaesthetics"))
    return counts.with_coverage(d.select("day", "total"), counts.cliffs(d, "total", ["views"], "day"), empty, "day")


# Profiles


@query("SELECT count(*) - count(*) % 10 AS rows FROM lineitem")
def r1_row_count(x: Frames) -> DataFrame:
    return profile.row_count(x.table("lineitem"))


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, CASE WHEN count({c}) = count(DISTINCT {c}) AND count({c}) > 0 THEN 1 ELSE 0 END AS is_unique FROM orders"
        for c in _PROFILED
    )
)
def r2_columns(x: Frames) -> DataFrame:
    return profile.columns(x.table("orders"), _PROFILED)


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) - count(*) % 10 AS rows FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 HAVING count(*) >= 10")
def r3_years(x: Frames) -> DataFrame:
    return profile.years(x.table("orders"), "o_orderdate")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS value, n_name AS label, count(*) - count(*) % 10 AS rows FROM customer_nation GROUP BY 1, 2 HAVING count(*) >= 10".replace("customer_nation", "(SELECT c_nationkey AS s_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"))
def r4_values(x: Frames) -> DataFrame:
    return profile.values(x.table("customer"), "c_nationkey", x.table("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")))


@query(
    f"""
WITH {COMMON}, m AS (SELECT date_diff('minute', start_time, stop_time) AS n FROM episode WHERE stop_time IS NOT NULL)
SELECT CASE WHEN n < 0 THEN 'less than zero minutes' WHEN n < 15 THEN 'under 15 minutes' WHEN n < 30 THEN '15 to 29 minutes' WHEN n < 60 THEN '30 to 59 minutes' WHEN n < 120 THEN '60 to 119 minutes' WHEN n < 240 THEN '120 to 239 minutes'
  WHEN n < 480 THEN '240 to 479 minutes' WHEN n < 1440 THEN '8 to 23 hours' WHEN n < 4320 THEN '1 to 2 days' WHEN n < 10080 THEN '3 to 6 days' ELSE 'a week or more' END AS band, count(*) - count(*) % 10 AS rows
FROM m GROUP BY 1 HAVING count(*) >= 10
"""
)
def r5_spans(x: Frames) -> DataFrame:
    return profile.spans(x.episodes(), "start_time", "stop_time")


@query(
    """
WITH k AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey)
SELECT CASE WHEN n = 1 THEN '1 row' WHEN n = 2 THEN '2 rows' WHEN n <= 5 THEN '3 to 5 rows' WHEN n <= 10 THEN '6 to 10 rows' ELSE '11 or more rows' END AS band, count(*) - count(*) % 10 AS keys FROM k GROUP BY 1 HAVING count(*) >= 10
"""
)
def r6_fanout(x: Frames) -> DataFrame:
    return profile.fanout(x.table("orders"), "o_custkey")


@query(
    """
SELECT l_suppkey AS code, count(*) - count(*) % 10 AS rows, CASE WHEN count(DISTINCT l_orderkey) >= 10 THEN count(DISTINCT l_orderkey) - count(DISTINCT l_orderkey) % 10 END AS episodes, s_name AS label
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, s_name HAVING count(*) >= 10
"""
)
def r7_charted(x: Frames) -> DataFrame:
    return profile.charted(x.table("lineitem"), "l_suppkey", "l_orderkey", x.table("supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("label")))


@query("SELECT value, n - n % 10 AS rows FROM (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 50) WHERE n >= 10")
def r8_top_values(x: Frames) -> DataFrame:
    return profile.top_values(x.table("part"), "p_type")


@query("SELECT count(*) FILTER (o.k IS NOT NULL) AS with_match, count(*) FILTER (o.k IS NULL) AS without_match FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o ON o.k = c_custkey")
def r9_link_probe(x: Frames) -> DataFrame:
    target = x.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return profile.link_probe(x.table("customer").select("c_custkey"), target, "c_custkey")


@query("SELECT count(*) AS rows, count(*) FILTER (l_quantity > 45) AS passing FROM lineitem")
def r9_filter_probe(x: Frames) -> DataFrame:
    return profile.filter_probe(x.table("lineitem"), F.col("l_quantity") > 45)


@query("SELECT count(*) FILTER (event_id % 20 <> 0) AS ones, count(*) FILTER (event_id % 20 = 0) AS zeros, CAST(0 AS BIGINT) AS empty FROM events")
def r9_flag_probe(x: Frames) -> DataFrame:
    return profile.flag_probe(x.readings(), "accepted")


# Quality


@query("SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def q1_repeated(x: Frames) -> DataFrame:
    return quality.repeated(x.table("orders"), ["o_custkey"])


@query(
    "SELECT 'o_orderstatus' AS field, count(*) FILTER (o_orderstatus = 'P') AS empty, CAST(0 AS BIGINT) AS too_long FROM orders UNION ALL "
    "SELECT 'o_orderpriority', CAST(0 AS BIGINT), count(*) FILTER (length(o_orderpriority) > 6) FROM orders"
)
def q2_field_problems(x: Frames) -> DataFrame:
    o = x.table("orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return quality.field_problems(o, [quality.Field("o_orderstatus", required=True), quality.Field("o_orderpriority", width=6)])


@query(
    f"""
WITH {COMMON}
SELECT 'key repeated' AS problem, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'accepted empty', CAST(0 AS BIGINT)
UNION ALL SELECT 'anaesthetic_key not found', count(*) FROM reading r WHERE NOT EXISTS (SELECT 1 FROM eligible e WHERE e.anaesthetic_key = r.anaesthetic_key)
"""
)
def q3_view_problems(x: Frames) -> DataFrame:
    own = x.episodes().join(x.subjects().where("is_test = 0"), "patient_key").where("stop_time IS NULL OR stop_time >= start_time")
    return quality.view_problems(x.readings(), "reading_key", ["accepted"], {"anaesthetic_key": own})


@query("SELECT event_type AS kind, count(*) AS rows FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def q4_outside_vocabulary(x: Frames) -> DataFrame:
    return quality.outside_vocabulary(x.readings(), "kind", x.spark.createDataFrame([("view",), ("click",)], "kind string"))


@query(
    """
WITH u AS (SELECT p_partkey % 50 AS concept_id FROM part), c AS (SELECT p_partkey AS concept_id, CASE WHEN p_size > 25 THEN 'Drug' ELSE 'Device' END AS domain_id, CASE WHEN p_partkey % 3 <> 0 THEN 'S' END AS s FROM part WHERE p_brand <> 'Brand#11')
SELECT 'drug_concept_id' AS field, u.concept_id, count(*) AS rows,
  CASE WHEN u.concept_id = 0 THEN 'unmapped' WHEN c.concept_id IS NULL THEN 'not in the vocabulary' WHEN coalesce(s, '') <> 'S' THEN 'not standard' WHEN domain_id <> 'Drug' THEN 'of another domain' END AS problem
FROM u LEFT JOIN c USING (concept_id) GROUP BY ALL HAVING problem IS NOT NULL
"""
)
def q5_concept_problems(x: Frames) -> DataFrame:
    part = x.table("part")
    used = part.select(F.lit("drug_concept_id").alias("field"), F.lit("Drug").alias("domain"), (F.col("p_partkey") % 50).alias("concept_id"))
    known = part.where("p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("concept_id"), F.when(F.col("p_size") > 25, "Drug").otherwise("Device").alias("domain_id"), F.when(F.col("p_partkey") % 3 != 0, "S").alias("standard_concept"))
    return quality.concept_problems(used, known)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q6_missing_links(x: Frames) -> DataFrame:
    return quality.missing_links(x.table("orders"), "o_custkey", x.table("customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query(
    f"""
WITH {COMMON}
SELECT event_id FROM wk w WHERE NOT EXISTS (SELECT 1 FROM episode e WHERE e.patient_key = w.patient_key AND e.stop_time IS NOT NULL AND CAST(w.ts AS DATE) BETWEEN CAST(e.start_time AS DATE) AND CAST(e.stop_time AS DATE))
"""
)
def q6_outside_period(x: Frames) -> DataFrame:
    p = x.episodes().where("stop_time IS NOT NULL").select("patient_key", F.to_date("start_time").alias("a"), F.to_date("stop_time").alias("b"))
    return quality.outside_period(x.events().withColumn("day", F.to_date("ts")), p, "patient_key", "day", "a", "b").select("event_id")


@query("SELECT count(*) AS written, (SELECT count(*) FROM orders) AS sources FROM orders WHERE o_orderstatus <> 'F' HAVING count(*) < 0.9 * (SELECT count(*) FROM orders)")
def q6_too_few(x: Frames) -> DataFrame:
    o = x.table("orders")
    return quality.too_few(o.where("o_orderstatus <> 'F'"), o)


@query("SELECT o_orderkey, coalesce(n, 0) AS rows FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> 1")
def q6_not_exactly_one(x: Frames) -> DataFrame:
    lines = x.table("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return quality.not_exactly_one(x.table("orders"), lines, "o_orderkey", F.col("l_quantity") > 40)


@query(f"WITH {COMMON} SELECT count(*) FILTER (stop_time < start_time) AS stop_before_start, count(*) FILTER (stop_time IS NULL) AS without_stop FROM episode")
def q7_left_out(x: Frames) -> DataFrame:
    return x.episodes().agg(F.count_if(F.col("stop_time") < F.col("start_time")).alias("stop_before_start"), F.count_if(F.col("stop_time").isNull()).alias("without_stop"))


@query("SELECT max(o_orderkey) AS largest, max(o_orderkey) < 5000000000 AS below_offset FROM orders")
def q8_below_offset(x: Frames) -> DataFrame:
    return quality.below_offset(x.table("orders"), "o_orderkey", 5_000_000_000)


@query(
    """
WITH b AS (SELECT c_custkey, c_nationkey FROM customer), a AS (SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 77 <> 0)
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, 'unexpected' AS side FROM (FROM a EXCEPT ALL FROM b)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), 'missing' FROM (FROM b EXCEPT ALL FROM a)
"""
)
def q9_differences(x: Frames) -> DataFrame:
    b = x.table("customer").select("c_custkey", "c_nationkey")
    a = b.where("c_custkey % 77 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 100 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return quality.differences(a, b)


@query(
    """
WITH s AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, o_orderkey IS NOT NULL AS a, o_orderkey IS NOT NULL AND coalesce(l_quantity > 10, false) AS b, o_orderkey IS NOT NULL AND coalesce(l_quantity > 10, false) AND c_custkey IS NOT NULL AS c
  FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON o_orderkey = l_orderkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey
), n AS (SELECT count(DISTINCT id) AS n0, count(DISTINCT id) FILTER (a) AS n1, count(DISTINCT id) FILTER (b) AS n2, count(DISTINCT id) FILTER (c) AS n3 FROM s)
SELECT 0 AS place, 'source' AS stage, n0 AS kept, CAST(0 AS BIGINT) AS lost FROM n UNION ALL SELECT 1, 'order', n1, n0 - n1 FROM n UNION ALL SELECT 2, 'quantity', n2, n1 - n2 FROM n UNION ALL SELECT 3, 'customer', n3, n2 - n3 FROM n
"""
)
def q10_waterfall(x: Frames) -> DataFrame:
    lines = x.table("lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return quality.waterfall(
        lines,
        "id",
        [
            quality.Stage("order", partner=x.table("orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"), on=("l_orderkey", "o_orderkey")),
            quality.Stage("quantity", condition=F.col("l_quantity") > 10),
            quality.Stage("customer", partner=x.table("customer").where("c_acctbal > 0").select("c_custkey"), on=("o_custkey", "c_custkey")),
        ],
    )


@query()
def q11_fingerprint(x: Frames) -> DataFrame:
    return quality.fingerprint(x.table("lineitem"))


@query(
    """
WITH r AS (SELECT CASE WHEN l_quantity > 40 THEN 'range' ELSE 'null' END AS "check", l_returnflag AS "table", l_linestatus AS field, CASE WHEN l_suppkey % 11 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'did_not_finish' ELSE 'could_not_run' END
  WHEN l_suppkey % 11 = 1 THEN 'not_applicable' WHEN l_discount > 0.05 THEN 'failed' ELSE 'passed' END AS o, CAST(l_linenumber AS VARCHAR) AS category FROM lineitem),
j AS (SELECT *, o IN ('failed', 'could_not_run', 'did_not_finish') AS bad, ("check" = 'range' AND "table" LIKE 'R%') OR "table" = 'N' AS known FROM r)
SELECT category, count(*) AS checks, count(*) FILTER (o = 'passed') AS passed, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'could_not_run') AS could_not_run, count(*) FILTER (o = 'did_not_finish') AS did_not_finish,
  count(*) FILTER (o = 'not_applicable') AS not_applicable, count(*) FILTER (bad AND known) AS expected, count(*) FILTER (bad AND NOT known) AS unexpected FROM j GROUP BY 1
"""
)
def q12_judged_rules(x: Frames) -> DataFrame:
    r = x.table("lineitem").select(
        F.when(F.col("l_quantity") > 40, "range").otherwise("null").alias("check"), F.col("l_returnflag").alias("table"), F.col("l_linestatus").alias("field"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("failed"), F.col("l_linenumber").cast("string").alias("category"),
        (F.col("l_suppkey") % 11 == 0).alias("is_error"), F.when(F.col("l_partkey") % 2 == 0, "Statement timeout reached").otherwise("no such column").alias("error"), F.when(F.col("l_suppkey") % 11 == 1, 1).alias("not_applicable"),
    )
    return quality.judged_rules(r, x.spark.createDataFrame([("RANGE", "r*", None), ("*", "?", "zz"), ("*", "n", None)], "check string, table string, field string"))


@query(
    """
WITH b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT o_custkey, b.n AS before, a.n AS after, CASE WHEN a.n IS NULL THEN 'gone' WHEN b.n IS NULL THEN 'new' ELSE 'changed' END AS change
FROM b FULL JOIN a USING (o_custkey) WHERE a.n IS NULL OR b.n IS NULL OR abs(a.n - b.n) > 0.1 * b.n
"""
)
def q13_changed_counts(x: Frames) -> DataFrame:
    g = lambda c: x.table("orders").where(c).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return quality.changed_counts(g("o_orderstatus <> 'P'"), g("o_orderstatus <> 'O'"), ["o_custkey"], "n")


@query(
    """
WITH b AS (SELECT p_brand AS "table", p_type AS "column", count(*) OVER (PARTITION BY p_brand) AS rows FROM part WHERE p_size < 40 AND p_brand <> 'Brand#11'), a AS (SELECT p_brand AS "table", p_type AS "column", count(*) OVER (PARTITION BY p_brand) AS rows FROM part WHERE p_size > 5 AND p_brand <> 'Brand#22'),
tb AS (SELECT "table", max(rows) AS n FROM b GROUP BY 1), ta AS (SELECT "table", max(rows) AS n FROM a GROUP BY 1)
SELECT "table", CAST(NULL AS VARCHAR) AS "column", CASE WHEN ta.n IS NULL THEN 'gone' WHEN tb.n IS NULL THEN 'new' ELSE 'changed' END AS change FROM tb FULL JOIN ta USING ("table") WHERE ta.n IS NULL OR tb.n IS NULL OR abs(ta.n - tb.n) > 0.1 * tb.n
UNION ALL SELECT DISTINCT "table", "column", 'gone' FROM b WHERE "table" IN (SELECT "table" FROM ta) AND ("table", "column") NOT IN (SELECT ("table", "column") FROM a)
UNION ALL SELECT DISTINCT "table", "column", 'new' FROM a WHERE "table" IN (SELECT "table" FROM tb) AND ("table", "column") NOT IN (SELECT ("table", "column") FROM b)
"""
)
def q14_catalogue_changes(x: Frames) -> DataFrame:
    def catalogue(df: DataFrame) -> DataFrame:
        c = df.select(F.col("p_brand").alias("table"), F.col("p_type").alias("column"))
        return c.distinct().join(c.groupBy("table").agg(F.count(F.lit(1)).alias("rows")), "table")

    part = x.table("part")
    return quality.catalogue_changes(catalogue(part.where("p_size < 40 AND p_brand <> 'Brand#11'")), catalogue(part.where("p_size > 5 AND p_brand <> 'Brand#22'")))


@query(
    f"""
WITH {COMMON}, p AS (SELECT patient_key, CAST(start_time AS DATE) AS a, CAST(start_time AS DATE) + CAST(user_n % 12 AS INTEGER) AS b FROM (SELECT *, CAST(patient_key AS BIGINT) AS user_n FROM episode)),
days AS (SELECT DATE '2024-01-08' + CAST(i AS INTEGER) AS d FROM range(0, 8) t(i)), s AS (SELECT DISTINCT patient_key FROM p)
SELECT patient_key, NOT bool_or(NOT EXISTS (SELECT 1 FROM p WHERE p.patient_key = s.patient_key AND d BETWEEN a AND b)) AS covered FROM s, days GROUP BY 1
"""
)
def q15_covers(x: Frames) -> DataFrame:
    p = x.episodes().select("patient_key", F.to_date("start_time").alias("a")).withColumn("b", F.date_add("a", (F.col("patient_key").cast("long") % 12).cast("int")))
    return quality.covers(p, "patient_key", "a", "b", F.lit("2024-01-08").cast("date"), F.lit("2024-01-15").cast("date"))


# Export


_PAIRS = """, pairs AS (SELECT patient_key, date, row_number() OVER (ORDER BY patient_key, date) AS pair_number FROM (
  SELECT DISTINCT patient_key, CAST(start_time AS DATE) + CAST(CAST(patient_key AS BIGINT) % 3 AS INTEGER) AS date FROM episode)),
found AS (SELECT e.anaesthetic_key, p.pair_number FROM episode e JOIN pairs p ON e.patient_key = p.patient_key AND e.start_time >= p.date - INTERVAL 24 HOUR AND e.start_time < p.date + INTERVAL 48 HOUR),
n AS (SELECT pair_number, count(*) AS n FROM found GROUP BY 1)"""


def _pairs(x: Frames) -> DataFrame:
    return x.episodes().select("patient_key", F.date_add(F.to_date("start_time"), (F.col("patient_key").cast("long") % 3).cast("int")).alias("date"))


def _chosen(x: Frames) -> DataFrame:
    return export.by_keys(x.episodes(), x.episodes().where("stop_time IS NOT NULL").select("anaesthetic_key"))


_CHOSEN = ", chosen AS (SELECT * FROM episode WHERE stop_time IS NOT NULL), num AS (SELECT *, row_number() OVER (ORDER BY start_time, anaesthetic_key) AS episode FROM chosen)"


@query(f"WITH {COMMON}{_CHOSEN} SELECT anaesthetic_key, patient_key, start_time, stop_time FROM chosen")
def e1_by_keys(x: Frames) -> DataFrame:
    return _chosen(x).select("anaesthetic_key", "patient_key", "start_time", "stop_time")


@query(f"WITH {COMMON}{_PAIRS} SELECT anaesthetic_key, min(pair_number) AS pair_number, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS ambiguous FROM found JOIN n USING (pair_number) GROUP BY 1")
def e2_by_subject_dates(x: Frames) -> DataFrame:
    return export.by_subject_dates(x.episodes(), _pairs(x), 24, "marked").select("anaesthetic_key", "pair_number", "ambiguous")


@query(
    f"""
WITH {COMMON}{_PAIRS}, c AS (SELECT count(*) AS pairs, count(*) FILTER (n = 1) AS to_one, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n IS NULL) AS to_none FROM pairs LEFT JOIN n USING (pair_number)),
b AS (SELECT CASE WHEN pairs BETWEEN 1 AND 4 THEN NULL ELSE pairs END AS pairs, CASE WHEN to_one BETWEEN 1 AND 4 THEN NULL ELSE to_one END AS to_one, CASE WHEN ambiguous BETWEEN 1 AND 4 THEN NULL ELSE ambiguous END AS ambiguous, CASE WHEN to_none BETWEEN 1 AND 4 THEN NULL ELSE to_none END AS to_none FROM c)
SELECT *, CAST(round(100.0 * to_one / nullif(pairs, 0), 0) AS BIGINT) AS percent_to_one FROM b
"""
)
def e3_resolution(x: Frames) -> DataFrame:
    return export.resolution(x.episodes(), _pairs(x), 24)


_SECTION = export.Section("pressures", "reading", "reading_time", ("view", "click"), ("start", 60, "stop", -60), ("accepted",))


@query(
    f"WITH {COMMON}{_CHOSEN} SELECT n.episode, r.kind, r.reading_time, r.value, r.accepted FROM reading r JOIN num n USING (anaesthetic_key) WHERE r.kind IN ('view', 'click') AND r.accepted = 1 AND r.reading_time >= n.start_time + INTERVAL 60 MINUTE AND r.reading_time <= n.stop_time - INTERVAL 60 MINUTE"
)
def e4_section_pseudonymised(x: Frames) -> DataFrame:
    return export.sections(_chosen(x), {"reading": x.readings()}, [_SECTION], ["reading_key"])["pressures"]


@query(
    f"WITH {COMMON}{_CHOSEN} SELECT r.kind, count(*) AS rows_charted, count(DISTINCT anaesthetic_key) AS anaesthetics FROM reading r JOIN num n USING (anaesthetic_key) WHERE r.kind IN ('view', 'click') AND r.accepted = 1 AND r.reading_time >= n.start_time + INTERVAL 60 MINUTE AND r.reading_time <= n.stop_time - INTERVAL 60 MINUTE GROUP BY 1"
)
def e5_section_aggregate(x: Frames) -> DataFrame:
    from dataclasses import replace

    return export.section(_chosen(x), x.readings(), replace(_SECTION, aggregate=True))


@query(f"WITH {COMMON}{_CHOSEN} SELECT count(*) AS anaesthetics, count(e.stop_time) AS with_value FROM chosen LEFT JOIN eligible e USING (anaesthetic_key)")
def e6_derived(x: Frames) -> DataFrame:
    from tideline.operators.intervals import eligible

    return export.derived(_chosen(x), eligible(x.episodes(), x.subjects()).select("anaesthetic_key", "stop_time"), "stop_time", aggregate=True)


@query(f"WITH {COMMON}{_CHOSEN} SELECT anaesthetic_key, episode FROM num")
def e7_episode_numbers(x: Frames) -> DataFrame:
    return export.numbered_episodes(_chosen(x))


@query(f"WITH {COMMON} SELECT anaesthetic_key, start_time FROM eligible ORDER BY start_time, anaesthetic_key LIMIT 20")
def l3_earliest(x: Frames) -> DataFrame:
    from tideline.operators.intervals import eligible

    return export.earliest(eligible(x.episodes(), x.subjects()), 20)[0].select("anaesthetic_key", "start_time")


# Primitives


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def w7_numbered(x: Frames) -> DataFrame:
    return numbered(x.table("events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "id")


@query("SELECT event_id, dense_rank() OVER (ORDER BY user_id, event_type) AS id FROM events")
def w6_dense_numbered(x: Frames) -> DataFrame:
    return dense_numbered(x.table("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"]).select("event_id", "id")


@query(
    f"WITH {COMMON} SELECT anaesthetic_key, kind, reading_time, value FROM reading WHERE accepted = 1 QUALIFY row_number() OVER (PARTITION BY anaesthetic_key, date_trunc('day', reading_time) ORDER BY CASE kind WHEN 'view' THEN 0 ELSE 1 END, value, reading_key) = 1"
)
def w1_best_at_time(x: Frames) -> DataFrame:
    r = x.readings().where("accepted = 1").withColumn("day", F.date_trunc("day", "reading_time"))
    first = F.when(F.col("kind") == "view", 0).otherwise(1)
    return best_at_time(r, [first, F.col("value"), F.col("reading_key")], ("anaesthetic_key", "day")).select("anaesthetic_key", "kind", "reading_time", "value")


@query("SELECT p_partkey, label FROM part LEFT JOIN (VALUES (0, 10, 'small'), (10, 30, 'medium'), (30, NULL, 'large')) b(f, u, label) ON p_size >= f AND (u IS NULL OR p_size < u)")
def j3_banded(x: Frames) -> DataFrame:
    bands = x.spark.createDataFrame([(0, 10, "small"), (10, 30, "medium"), (30, None, "large")], "from_days int, until_days int, label string")
    return banded(x.table("part"), bands, "p_size").select("p_partkey", "label")


@query(
    f"WITH {COMMON}, l AS (SELECT anaesthetic_key, drug_event_key, given_time FROM drug WHERE action = 'infusion_stop'), r AS (SELECT anaesthetic_key, reading_time, min(value) AS value FROM reading WHERE kind = 'view' GROUP BY ALL) "
    "SELECT drug_event_key, given_time, reading_time, value FROM l ASOF LEFT JOIN r ON l.anaesthetic_key = r.anaesthetic_key AND l.given_time >= r.reading_time"
)
def j5_as_of(x: Frames) -> DataFrame:
    from tideline.operators.intervals import as_of

    left = x.drugs().where("action = 'infusion_stop'").select("anaesthetic_key", "drug_event_key", "given_time")
    right = x.readings().where("kind = 'view'").groupBy("anaesthetic_key", "reading_time").agg(F.min("value").alias("value"))
    return as_of(left, right, ["anaesthetic_key"], "given_time", "reading_time", ["value"]).select("drug_event_key", "given_time", "reading_time", "value")


@query(f"WITH {COMMON} SELECT drug_event_key, action FROM drug d WHERE NOT EXISTS (SELECT 1 FROM drug c WHERE c.amends_key = d.drug_event_key)")
def j6_superseded(x: Frames) -> DataFrame:
    return superseded(x.drugs(), "drug_event_key", "amends_key").select("drug_event_key", "action")


@query(
    "WITH m AS (SELECT p_name || CAST(p_partkey // 2 AS VARCHAR) AS local_key, p_partkey AS concept_id, CASE WHEN p_partkey % 5 = 0 THEN 'unmapped' ELSE 'mapped' END AS status FROM part) "
    "SELECT local_key, CASE WHEN count(*) = 1 AND max(status) = 'mapped' THEN max(concept_id) ELSE 0 END AS concept_id, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE max(status) END AS status FROM m GROUP BY 1"
)
def a7_one_concept(x: Frames) -> DataFrame:
    m = x.table("part").select(F.concat("p_name", F.floor(F.col("p_partkey") / 2).cast("long").cast("string")).alias("local_key"), F.col("p_partkey").alias("concept_id"), F.when(F.col("p_partkey") % 5 == 0, "unmapped").otherwise("mapped").alias("status"))
    return one_concept(m)
