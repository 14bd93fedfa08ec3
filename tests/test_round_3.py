"""Distances to the microsecond, numbers without a window."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline import queries_checks  # noqa: F401  registers its queries
from tideline.operators.ids import numbered
from tideline.plans import analyst, omop, profile
from tideline.queries import QUERIES


def test_results_around_are_near_to_the_microsecond(spark):
    stop = datetime(2024, 1, 1, 8, 0, 0, 100000)
    episodes = spark.createDataFrame([("e", "p", stop - timedelta(hours=1), stop)], "anaesthetic_key string, patient_key string, start_time timestamp_ntz, stop_time timestamp_ntz")

    def found(side, *times):
        labs = spark.createDataFrame([("p", "k", t, float(i), i) for i, t in enumerate(times)], "patient_key string, kind string, taken_time timestamp_ntz, value double, lab_key long")
        return analyst.result_around(episodes, labs, "k", side, 72).first()["value"]

    assert found("after", stop + timedelta(hours=72)) == 0
    assert found("after", stop + timedelta(hours=72, milliseconds=400)) is None
    start = stop - timedelta(hours=1)
    assert found("before", start - timedelta(hours=72)) == 0
    assert found("before", start - timedelta(hours=72, milliseconds=50)) is None
    assert found("either", start - timedelta(milliseconds=600), start + timedelta(milliseconds=500)) == 1


def test_numbers_with_their_columns_alone(spark):
    df = spark.range(1000).selectExpr("999 - id AS x", "id % 7 AS y", "'long text' AS z").repartition(9)
    got = numbered(df, ["y", "x"], "id", 11, ["x", F.col("y").alias("w")])
    assert got.columns == ["id", "x", "w"]
    assert [(r.w, r.x) for r in got.orderBy("id").collect()] == sorted((r.y, r.x) for r in df.collect())
    assert got.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()[:] == (11, 1010, 1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_block_of_several_files_is_one_cluster(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(0, 960, 1, 6).withColumn("block", F.col("id") % 16).write.partitionBy("block").parquet(path)
    df = spark.read.parquet(path)
    assert len(df.inputFiles()) == 96
    whole, part = (profile.block_sampled(df, percent, pattern="block=[^/]+") for percent in (100, 40))
    assert (whole.blocks, whole.read, part.blocks) == (16, 16, 16) and len(part.rows.inputFiles()) == 6 * part.read
    got = profile.estimated(part, {"all": F.lit(True)}).first()
    assert (got["estimate"], got["standard_error"]) == (960.0, 0.0)  # blocks are equal, files need not be


def test_no_task_gathers_a_block(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "repartition", lambda *_: pytest.fail("rows are dealt by block"))
    assert QUERIES["s8_block_sample"](spark, "/root/testdata/sf0.001").count() == 2


def _small_source(spark):
    visits = spark.createDataFrame([(i, "p", datetime(2024, 1, 1 + i)) for i in range(1, 9)], "visit_key long, patient_key string, admitted timestamp_ntz")
    return {
        "concepts": spark.createDataFrame([("SITE_DIAGNOSIS", "1", 11)], "vocabulary string, code string, concept long"),
        "subjects": spark.createDataFrame([("p", datetime(1990, 1, 1).date(), 1, 0)], "patient_key string, birth_date date, sex long, is_test int"),
        "wards": spark.createDataFrame([("w", "ward")], "ward_key string, label string"),
        "visits": visits.withColumns({"discharged": F.col("admitted"), "ward_key": F.lit("w")}),
        "diagnoses": spark.createDataFrame([(1 + i % 8, i, i % 2, "X") for i in range(40)], "visit_key long, seq int, diagnosis int, icd string"),
    }


def test_identifiers_that_nothing_reads_cost_no_range(spark):
    steps = [next(s for s in omop.CORE if s.target == n) for n in ("person", "care_site", "visit_occurrence", "condition_occurrence")]
    want = omop.run(_small_source(spark), steps)["condition_occurrence"].drop("condition_occurrence_id")
    got = omop.run(_small_source(spark), steps, unread=("condition_occurrence",))["condition_occurrence"]
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 40
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_visits_by_a_whole_number_move_no_dealt_rows(spark, monkeypatch):
    monkeypatch.setattr(omop, "_visits", lambda t: t["v"])
    visits = spark.createDataFrame([("1", 10), ("02", 20), ("x", 30), ("3", 40)], "_visit string, visit_occurrence_id long")
    rows = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "visit_key long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = omop._of_visits(rows.repartition("visit_key").join(rows.distinct(), "visit_key"), {"v": visits})
        assert sorted(map(tuple, got.collect())) == [(1, 10), (3, 40), (3, 40)]  # "02" is another key than 2
        assert "hashpartitioning(cast(visit_key" not in got._jdf.queryExecution().executedPlan().toString()  # by text, rows would be dealt again
        text = omop._of_visits(rows.withColumn("visit_key", F.lpad(F.col("visit_key").cast("string"), 2, "0")), {"v": visits}, how="left")
        assert sorted((r.visit_key, r.visit_occurrence_id or 0) for r in text.collect()) == [("01", 0), ("02", 20), ("03", 0), ("03", 0), ("04", 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_phases_need_no_target_but_the_procedures(spark):
    at = datetime(2024, 1, 1, 8)
    procedures = spark.createDataFrame([(7, "ANAESTHETIC", 1, 1, at, None), (5, "ANAESTHETIC", 2, 1, at, at), (6, "click", 2, 1, at, at), (8, "ANAESTHETIC", None, 1, at, at)], "procedure_occurrence_id long, procedure_source_value string, visit_detail_id long, person_id long, procedure_datetime timestamp_ntz, procedure_end_datetime timestamp_ntz")
    person = spark.createDataFrame([(1, at)], "person_id long, birth_datetime timestamp_ntz")
    got = omop.anaesthetic_phase({"procedure_occurrence": procedures, "person": person})
    assert [tuple(r) for r in got.orderBy("anaesthetic_phase_id").collect()] == [(1, 5, 1, "whole anaesthetic", at, at), (2, 7, 1, "whole anaesthetic", at, None)]
