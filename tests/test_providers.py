"""Details are numbered before their providers are joined, and staff are sorted once, after they are dealt by episode."""

from __future__ import annotations

from datetime import datetime

from tideline.plans import omop


def test_providers_come_after_the_numbers(spark, monkeypatch):
    at, plans = datetime(2024, 1, 1, 8), []
    real = omop.numbered
    monkeypatch.setattr(omop, "numbered", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a, **k))
    t = {
        "concepts": spark.createDataFrame([("SITE_VISIT_DETAIL", "ANAESTHESIA", 4149)], "vocabulary string, code string, concept long"),
        "episodes": spark.createDataFrame([(f"A{k}", k, at, at) for k in range(1, 7)], "anaesthetic_key string, visit_key long, start_time timestamp_ntz, stop_time timestamp_ntz"),
        "visit_occurrence": spark.createDataFrame([(9, 100 + k, 9201, at.date(), at, str(k)) for k in range(1, 6)], "person_id long, visit_occurrence_id long, visit_concept_id long, visit_start_date date, visit_start_datetime timestamp_ntz, visit_source_value string"),
        "provider": spark.createDataFrame([(1, "s1"), (2, "s2")], "provider_id long, provider_source_value string"),
        "episode_staff": spark.createDataFrame([("A1", 2, "s1"), ("A1", 1, "s2"), ("A2", 1, "s2"), ("A2", 1, "s1"), ("A3", 1, "gone"), ("A3", 2, "s1"), ("A4", None, "s2"), ("A4", 1, "s1"), ("A6", 1, "s1")], "anaesthetic_key string, seq int, staff_key string"),
    }
    got = omop.visit_detail(t)
    assert sorted((r.visit_detail_source_value, r.visit_detail_id, r.provider_id) for r in got.collect()) == [("A1", 1, 2), ("A2", 2, 1), ("A3", 3, None), ("A4", 4, 2), ("A5", 5, None)]
    assert len(plans) == 1 and "staff_key" not in plans[0]
    plan = omop.visit_detail(t)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan[: plan.index("REPARTITION_BY_COL")] and "partial_min" not in plan[plan.index("REPARTITION_BY_COL") :]
