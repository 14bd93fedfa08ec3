"""Subject, episode, reading and drug frames derived from the star schema's tables, for queries with an SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.time import plus


class Frames:
    """Lazy frames of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        """Events with their person as text and the Monday of their week."""
        e = self.table("events").withColumn("monday", F.date_trunc("week", F.col("ts")).cast("date"))
        key = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("monday", "yyyyMMdd"))
        return e.withColumns({"patient_key": F.col("user_id").cast("string"), "anaesthetic_key": key})

    def subjects(self) -> DataFrame:
        u = F.col("user_id")
        days = lambda x: x.cast("int")
        return self.table("events").select("user_id").distinct().select(
            u.cast("string").alias("patient_key"),
            F.date_sub(F.lit("2024-01-01").cast("date"), days((u * 37) % 900)).alias("birth_date"),
            F.when(u % 11 == 0, F.date_add(F.lit("2024-01-10").cast("date"), days(u % 30))).alias("death_date"),
            F.when(u % 40 == 0, 1).otherwise(0).alias("is_test"),
        )

    def episodes(self) -> DataFrame:
        g = self.events().groupBy("user_id", "patient_key", "monday", "anaesthetic_key").agg(F.min("ts").alias("start_time"), F.max("ts").alias("last"))
        n = F.col("user_id") + F.dayofmonth("monday")
        start = F.col("start_time")
        stop = F.when(n % 7 == 0, None).when(n % 29 == 0, plus(start, hours=-1)).when(n % 5 == 0, plus(start, days=2)).otherwise(plus(F.col("last"), days=1))
        return g.select("anaesthetic_key", "patient_key", "start_time", stop.alias("stop_time"))

    def readings(self) -> DataFrame:
        return self.events().select(
            "anaesthetic_key", F.col("event_type").alias("kind"), F.col("ts").alias("reading_time"), "value",
            F.when(F.col("event_id") % 20 != 0, 1).otherwise(0).alias("accepted"), F.col("event_id").cast("string").alias("reading_key"),
        )

    def drugs(self) -> DataFrame:
        actions = {"signup": "infusion_start", "click": "rate_change", "view": "infusion_pause", "purchase": "infusion_restart", "error": "infusion_stop"}
        action = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])
        i = F.col("event_id")
        return self.events().select(
            i.cast("string").alias("drug_event_key"), "anaesthetic_key", F.when(F.col("user_id") % 3 != 0, F.col("patient_key")).alias("order_key"),
            F.concat(F.lit("d"), (i % 7).cast("string")).alias("drug"), action[F.col("event_type")].alias("action"), F.col("value").alias("amount"),
            F.col("ts").alias("given_time"), F.when(i % 50 == 49, (i - 1).cast("string")).alias("amends_key"),
        )

    def drug_map(self) -> DataFrame:
        """d0 unmapped, d1 twice, d2 to d5 mapped, d6 absent."""
        rows = [("d0", None, "unmapped"), ("d1", 11, "mapped"), ("d1", 12, "mapped"), *[(f"d{k}", 10 * k, "mapped") for k in range(2, 6)]]
        return self.spark.createDataFrame(rows, "local_key string, concept_id long, status string")


COMMON = """
wk AS (
  SELECT *, CAST(date_trunc('week', ts) AS DATE) AS monday, CAST(user_id AS VARCHAR) AS patient_key,
         CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS anaesthetic_key
  FROM events
), subject AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS patient_key, DATE '2024-01-01' - CAST((user_id * 37) % 900 AS INTEGER) AS birth_date,
         CASE WHEN user_id % 11 = 0 THEN DATE '2024-01-10' + CAST(user_id % 30 AS INTEGER) END AS death_date,
         CASE WHEN user_id % 40 = 0 THEN 1 ELSE 0 END AS is_test
  FROM events
), episode AS (
  SELECT anaesthetic_key, patient_key, min(ts) AS start_time,
         CASE WHEN (user_id + day(monday)) % 7 = 0 THEN NULL
              WHEN (user_id + day(monday)) % 29 = 0 THEN min(ts) - INTERVAL 1 HOUR
              WHEN (user_id + day(monday)) % 5 = 0 THEN min(ts) + INTERVAL 2 DAY
              ELSE max(ts) + INTERVAL 1 DAY END AS stop_time
  FROM wk GROUP BY user_id, monday, patient_key, anaesthetic_key
), reading AS (
  SELECT anaesthetic_key, event_type AS kind, ts AS reading_time, value,
         CASE WHEN event_id % 20 <> 0 THEN 1 ELSE 0 END AS accepted, CAST(event_id AS VARCHAR) AS reading_key
  FROM wk
), drug AS (
  SELECT CAST(event_id AS VARCHAR) AS drug_event_key, anaesthetic_key, CASE WHEN user_id % 3 <> 0 THEN patient_key END AS order_key,
         'd' || CAST(event_id % 7 AS VARCHAR) AS drug,
         CASE event_type WHEN 'signup' THEN 'infusion_start' WHEN 'click' THEN 'rate_change' WHEN 'view' THEN 'infusion_pause'
                         WHEN 'purchase' THEN 'infusion_restart' WHEN 'error' THEN 'infusion_stop' END AS action,
         value AS amount, ts AS given_time, CASE WHEN event_id % 50 = 49 THEN CAST(event_id - 1 AS VARCHAR) END AS amends_key
  FROM wk
), eligible AS (
  SELECT e.*, s.birth_date, s.death_date FROM episode e JOIN subject s USING (patient_key)
  WHERE s.is_test = 0 AND (e.stop_time IS NULL OR e.stop_time >= e.start_time)
)
"""
