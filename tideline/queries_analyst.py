"""Queries of the analyst shapes and of text matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.intervals import eligible, windowed
from tideline.plans import analyst, matching
from tideline.queries import query
from tideline.sources.driver_frames import COMMON, Frames


@query(f"WITH {COMMON}, low AS (SELECT DISTINCT anaesthetic_key FROM reading r JOIN episode e USING (anaesthetic_key) WHERE value < 10 AND reading_time >= start_time AND (stop_time IS NULL OR reading_time <= stop_time)) SELECT count(*) AS anaesthetics, count(l.anaesthetic_key) AS with_low FROM episode LEFT JOIN low l USING (anaesthetic_key)")
def m8_share_below(x: Frames) -> DataFrame:
    e = x.episodes().select("anaesthetic_key", F.col("start_time").alias("start"), F.col("stop_time").alias("end"))
    return analyst.share_below(e, x.readings().select("anaesthetic_key", F.col("reading_time").alias("time"), "value"), "anaesthetic_key", 10)


@query("SELECT o_orderstatus AS type, l_returnflag AS device, count(DISTINCT o_orderkey) AS anaesthetics, count(*) AS devices FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def m9_devices_by_type(x: Frames) -> DataFrame:
    e = x.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("type"))
    return analyst.devices_by_type(e, x.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("device")), "k")


@query(
    f"""WITH {COMMON}, f AS (SELECT *, date_diff('minute', start_time, stop_time) AS minutes FROM episode QUALIFY row_number() OVER (PARTITION BY patient_key ORDER BY start_time, anaesthetic_key) = 1),
t AS (SELECT anaesthetic_key, min(reading_time) FILTER (kind = 'view') AS a, min(reading_time) FILTER (kind = 'click') AS b FROM reading GROUP BY 1)
SELECT patient_key, minutes, date_diff('minute', a, b) AS between FROM f LEFT JOIN t USING (anaesthetic_key) WHERE minutes BETWEEN 1 AND 9000""".replace(" AS between", ' AS "between"')
)
def m12_event_intervals(x: Frames) -> DataFrame:
    e = x.episodes().select("patient_key", "anaesthetic_key", F.col("start_time").alias("start"), F.col("stop_time").alias("stop"))
    ev = x.readings().select("anaesthetic_key", "kind", F.col("reading_time").alias("time"))
    return analyst.event_intervals(e, ev, "patient_key", "anaesthetic_key", "view", "click", most=9000)


@query("SELECT l_returnflag || 'x' AS label, strftime(l_shipdate, '%d/%m/%Y') AS given, l_extendedprice AS dose, round(l_extendedprice / nullif(CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS INTEGER) % 7 END, 0), 6) AS per_kg, CASE WHEN l_suppkey % 45 < 37 THEN 'preterm' ELSE 'term' END AS gestation FROM lineitem WHERE l_returnflag = 'R'")
def m13_dose_per_kilogram(x: Frames) -> DataFrame:
    d = x.table("lineitem").select(F.concat("l_returnflag", F.lit("x")).alias("label"), F.col("l_shipdate").alias("time"), F.col("l_extendedprice").alias("dose"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("int") % 7).alias("q"), (F.col("l_suppkey") % 45).alias("weeks"))
    d = d.withColumn("w", F.struct("n", "q"))
    w = d.select("w", F.when(F.col("w.n") != 3, F.col("w.q").cast("string")).alias("weight_text")).distinct()
    out = analyst.dose_per_kilogram(d, w, "w", "r%")
    return out.withColumn("per_kg", F.round("per_kg", 6))


@query("SELECT o_orderpriority AS service, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, count(DISTINCT o_orderkey) AS cases, CAST(sum(date_diff('minute', o_orderdate, l_shipdate)) / 60.0 AS DOUBLE) AS hours FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL ORDER BY year, month, cases DESC, service LIMIT 500")
def m14_utilisation(x: Frames) -> DataFrame:
    c = x.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("service"), F.col("o_orderdate").alias("day"), F.col("o_orderdate").alias("start"))
    return analyst.utilisation(c, x.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("stop")), "k")


@query("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS age_band, p_brand AS grade, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 5")
def m15_by_age_and_grade(x: Frames) -> DataFrame:
    return analyst.by_age_and_grade(x.table("part"), F.col("p_size"), ((10, "small"), (30, "medium")), "large", "p_brand")


@query(
    f"""WITH {COMMON}, c AS (SELECT anaesthetic_key, patient_key FROM episode), f AS (SELECT anaesthetic_key, min(reading_time) AS first_event FROM reading WHERE kind = 'click' GROUP BY 1),
a AS (SELECT patient_key, ts AS at FROM wk WHERE event_type = 'signup'), r AS (SELECT c.*, first_event FROM c LEFT JOIN f USING (anaesthetic_key))
SELECT anaesthetic_key, patient_key, first_event, (SELECT max(a.at) FROM a WHERE a.patient_key = r.patient_key AND a.at <= r.first_event) AS admitted FROM r""".replace("ts AS at", "ts AS tt").replace("a.at", "a.tt")
)
def m16_first_event_then_admission(x: Frames) -> DataFrame:
    c = x.episodes().select("anaesthetic_key", "patient_key")
    ev = x.readings().where("kind = 'click'").select("anaesthetic_key", F.col("reading_time").alias("time"))
    return analyst.first_event_then_admission(c, ev, x.events().where("event_type = 'signup'").select("patient_key", F.col("ts").alias("admitted")), "anaesthetic_key", "patient_key")


@query("SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def m18_emergencies(x: Frames) -> DataFrame:
    c = x.table("orders").select(F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("emergency"), F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("label"))
    return analyst.emergencies(c, "1995-01-01", "1996-01-01")


@query(f"WITH {COMMON} SELECT anaesthetic_key, reading_time, kind, value FROM reading WHERE kind IN ('view', 'error') AND accepted = 1 AND anaesthetic_key IN (SELECT anaesthetic_key FROM episode WHERE stop_time IS NULL)")
def m19_charted_readings(x: Frames) -> DataFrame:
    return analyst.charted_readings(x.episodes().where("stop_time IS NULL"), x.readings(), "anaesthetic_key", ["view", "error"])


@query(
    """WITH c AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'), v AS (SELECT o_orderkey, o_custkey FROM orders),
u AS (SELECT o_custkey, 'case' AS src FROM v WHERE o_orderkey IN (SELECT o_orderkey FROM c) UNION ALL SELECT o_custkey, 'visit only' FROM v WHERE o_custkey NOT IN (SELECT o_custkey FROM c))
SELECT o_custkey, src, count(*) AS n FROM u GROUP BY ALL HAVING count(*) >= 2"""
)
def m21_with_case_or_visit_only(x: Frames) -> DataFrame:
    v = x.table("orders").select("o_orderkey", "o_custkey")
    return analyst.with_case_or_visit_only(x.table("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"), v, "o_custkey", "o_orderkey", 2)


@query(
    f"""WITH {COMMON}, w AS (SELECT patient_key, ts, value FROM wk WHERE event_type = 'purchase' AND event_id % 9 <> 0)
SELECT e.anaesthetic_key, max(w.ts) AS weight_time, arg_max(w.value, (w.ts, w.value)) AS weight FROM episode e LEFT JOIN w ON w.patient_key = e.patient_key AND w.ts < e.start_time AND w.ts >= e.start_time - INTERVAL 10 DAY GROUP BY 1"""
)
def m22_latest_before(x: Frames) -> DataFrame:
    w = x.events().where("event_type = 'purchase'").select("patient_key", F.col("ts").alias("time"), F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("text"))
    return analyst.latest_before(x.episodes().select("anaesthetic_key", "patient_key", F.col("start_time").alias("time")), w, "anaesthetic_key", "patient_key", 10)


@query(f"WITH {COMMON} SELECT anaesthetic_key, count(*) AS n_staff, string_agg(kind, '; ' ORDER BY reading_time, kind) AS staff_list, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS had_handover FROM reading GROUP BY 1")
def m23_staff_lists(x: Frames) -> DataFrame:
    return analyst.staff_lists(x.readings().select("anaesthetic_key", F.col("kind").alias("label"), F.col("reading_time").alias("start")), "anaesthetic_key")


@query(f"WITH {COMMON} SELECT anaesthetic_key, round(avg(value) FILTER (kind = 'view'), 6) AS view, round(avg(value) FILTER (kind = 'click'), 6) AS click FROM reading GROUP BY 1")
def m24_pivoted(x: Frames) -> DataFrame:
    out = analyst.pivoted(x.readings().withColumn("text", F.col("value").cast("string")), "anaesthetic_key", ["view", "click"])
    return out.withColumns({c: F.round(c, 6) for c in ("view", "click")})


@query(f"WITH {COMMON} SELECT patient_key, kind, min(ts) AS era_start, max(ts) AS era_end, count(*) AS n FROM (SELECT patient_key, event_type AS kind, ts FROM wk) GROUP BY ALL")
def a11_eras(x: Frames) -> DataFrame:
    e = x.events().select("patient_key", F.col("event_type").alias("kind"), "ts", F.lit(None).cast("timestamp_ntz").alias("until"))
    return analyst.eras(e, "patient_key", "kind", "ts", "until")


@query(
    f"""WITH {COMMON} SELECT e.anaesthetic_key, CASE WHEN EXISTS (SELECT 1 FROM episode o WHERE o.patient_key = e.patient_key AND o.anaesthetic_key <> e.anaesthetic_key AND o.start_time > e.stop_time AND o.start_time <= e.stop_time + INTERVAL 5 DAY) THEN 1 ELSE 0 END AS returned FROM episode e"""
)
def x_returned_within(x: Frames) -> DataFrame:
    e = x.episodes().select("anaesthetic_key", "patient_key", F.col("start_time").alias("start"), F.col("stop_time").alias("end"))
    return analyst.returned_within(e, "patient_key", "anaesthetic_key", 5)


@query(
    f"""WITH {COMMON}, w AS (SELECT e.anaesthetic_key, min(value) AS lowest, max(value) AS highest, count(*) AS n, date_diff('minute', min(start_time), min(reading_time) FILTER (value < 20)) AS f FROM eligible e JOIN reading r USING (anaesthetic_key)
WHERE accepted = 1 AND reading_time >= start_time AND (stop_time IS NULL OR reading_time <= stop_time) AND kind IN ('view', 'click', 'purchase') GROUP BY 1)
SELECT e.anaesthetic_key, lowest, highest, coalesce(n, 0) AS count, f AS minutes_to_first FROM eligible e LEFT JOIN w USING (anaesthetic_key)"""
)
def x_extremes(x: Frames) -> DataFrame:
    from tideline.queries import kinds_of

    return analyst.extremes(windowed(eligible(x.episodes(), x.subjects())), x.readings(), kinds_of(x).select("kind"), 20)


@query(f"WITH {COMMON} SELECT anaesthetic_key, kind, reading_time, CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END AS amount FROM (SELECT *, lag(value) OVER (PARTITION BY anaesthetic_key, kind ORDER BY reading_time) AS p FROM reading)")
def x_running_amounts(x: Frames) -> DataFrame:
    r = x.readings().select("anaesthetic_key", "kind", F.col("reading_time").alias("time"), F.col("value").alias("total"))
    return analyst.running_amounts(r, "anaesthetic_key").select("anaesthetic_key", "kind", F.col("time").alias("reading_time"), "amount")


_TOKENS = "regexp_extract_all(lower({}), '[a-z]+')"


@query(
    f"""WITH d AS (SELECT p_partkey AS doc, {_TOKENS.format("p_name || ' ' || p_type")} AS t FROM part), q AS (SELECT p_type AS query, {_TOKENS.format('p_type')} AS t FROM (SELECT DISTINCT p_type FROM part)),
p AS (SELECT doc, word, count(*) AS tf FROM (SELECT doc, unnest(t) AS word FROM d) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(t)) AS av FROM d),
s AS (SELECT query, p.doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * len(d.t) / av))) AS score FROM (SELECT query, unnest(t) AS word FROM q) q JOIN p USING (word) JOIN df USING (word) JOIN d ON d.doc = p.doc, n GROUP BY ALL)
SELECT query, doc, round(score, 6) AS score FROM s"""
)
def b2_bm25(x: Frames) -> DataFrame:
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    docs = x.table("part").select(F.col("p_partkey").alias("doc"), tokens(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    asked = x.table("part").select(F.col("p_type").alias("query")).distinct().withColumn("qt", tokens(F.col("query")))
    return matching.bm25(asked, "query", F.col("qt"), docs, "doc", F.col("t")).withColumn("score", F.round("score", 6))


@query()
def b1_b4_matched_phrases(x: Frames) -> DataFrame:
    """Names of parts as phrases against all parts: names count twice, words in order add to the score, a factor by size, the best three."""
    part = x.table("part")
    same = {"spellings": {"colour": "color"}, "abbreviations": {"std": "standard", "promo": "promotional"}, "synonyms": {"tini": "small"}}
    docs = matching.tokenised(part, "p_partkey", F.col("p_partkey").alias("doc"), matching.described(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand"), **same).alias("t"), F.when(F.col("p_size") < 25, 1.0).otherwise(0.8).alias("suits"))
    asked = matching.tokenised(part.select(F.col("p_name").alias("query")).distinct(), "query", "query", matching.words(F.col("query"), **same).alias("qt"))
    scores = matching.bm25(asked, "query", F.col("qt"), docs, "doc", F.col("t")).join(asked, "query").join(docs, "doc")
    ranked = matching.weighted(matching.with_order(scores, F.col("qt"), F.col("t")), F.col("suits"), 6.0, 3.0)
    return matching.best(ranked, "query", "doc", 3).select("query", "doc", "rank", F.round("score", 6).alias("score"), "in_order", "confidence")


@query(f"WITH {COMMON}, o AS (SELECT event_type AS part, CAST(user_id % 3 AS VARCHAR) AS category, CAST(event_id % 2 AS VARCHAR) AS confidence, CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'replaced' ELSE 'refused' END AS outcome FROM events), g AS (SELECT 'part' AS by_, part AS g, outcome FROM o UNION ALL SELECT 'category', category, outcome FROM o UNION ALL SELECT 'confidence', confidence, outcome FROM o) SELECT by_ AS \"by\", g AS \"group\", count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'replaced') AS replaced, count(*) FILTER (outcome = 'refused') AS refused FROM g GROUP BY ALL")
def b5_scoreboard(x: Frames) -> DataFrame:
    i = F.col("event_id") % 3
    o = x.table("events").select(F.col("event_type").alias("part"), (F.col("user_id") % 3).alias("category"), (F.col("event_id") % 2).alias("confidence"), F.when(i == 0, "accepted").when(i == 1, "replaced").otherwise("refused").alias("outcome"))
    return matching.scoreboard(o)
