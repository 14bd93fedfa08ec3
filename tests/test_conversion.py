"""Conversion steps: what neither a later step nor the query reads is not made, and what is returned stays the same."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tideline import queries_analyst, queries_checks  # noqa: F401  register their queries
from tideline.operators.ids import unnumbered
from tideline.plans import matching, omop
from tideline.queries import QUERIES
from tideline.queries_omop import _STEPS, _TO_DETAIL, source
from tideline.sources.driver_frames import Frames

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("targets", [_TO_DETAIL, (*_TO_DETAIL, "procedure_occurrence")])
def test_a_run_without_providers_reads_no_staff(spark, targets):
    frames = source(Frames(spark, SMALL))
    steps = [_STEPS[t] for t in targets]
    full = omop.run(frames, [_STEPS["provider"], *steps])[targets[-1]]
    got = omop.run({k: v for k, v in frames.items() if k not in ("staff", "episode_staff")}, steps)[targets[-1]]
    assert got.columns == full.columns and got.where("provider_id IS NOT NULL").count() == 0 < full.where("provider_id IS NOT NULL").count()
    assert _rows(got.drop("provider_id")) == _rows(full.drop("provider_id"))


@pytest.mark.parametrize("further", [omop.procedure_events, omop.procedure_surgery])
def test_numbers_go_on_from_rows_without_numbers(spark, further):
    steps = [_STEPS[t] for t in (*_TO_DETAIL, "procedure_occurrence")]
    t = omop.run(source(Frames(spark, SMALL)), steps, unread=("procedure_occurrence",))
    assert "procedure_occurrence_id" not in t["procedure_occurrence"].columns
    assert "rangepartitioning" not in t["procedure_occurrence"]._jdf.queryExecution().executedPlan().toString()
    want = further(omop.run(source(Frames(spark, SMALL)), steps))
    got = further(t)
    assert got.columns == want.columns and _rows(got) == _rows(want)
    assert got.agg({"procedure_occurrence_id": "min"}).first()[0] == t["procedure_occurrence"].count() + 1


def test_roles_need_no_other_doses(spark, monkeypatch):
    want = _rows(QUERIES["o7_infusion_roles"](spark, SMALL))
    monkeypatch.setattr(omop, "CORE", [replace(s, rows=lambda *_: pytest.fail("doses are made and thrown away")) if s.target == "drug_exposure" else s for s in omop.CORE])
    assert _rows(QUERIES["o7_infusion_roles"](spark, SMALL)) == want


def test_words_are_taken_once_in_several_tasks(spark, monkeypatch):
    plans = []
    keep = matching.staged

    def staged(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(matching, "staged", staged)
    got = QUERIES["b1_b4_matched_phrases"](spark, SMALL)
    final = got._jdf.queryExecution().executedPlan().toString()
    assert "[a-z]+" not in final and len([p for p in plans if "[a-z]+" in p]) == 2
    assert all("hashpartitioning" in p for p in plans)


def test_order_is_found_as_before_where_a_word_is_missing(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "x", "b"], 1.0), (["a", "b"], ["b", "a"], 1.0), (["a", "b"], ["a", "x"], 1.0), (["a", "a"], ["a"], 1.0), (["a"], ["a"], 1.0), (["a", "b"], None, 1.0), ([], ["a"], 1.0)], "p array<string>, t array<string>, score double")
    got = matching.with_order(rows, F.col("p"), F.col("t"))
    assert [(r.in_order, r.score) for r in got.collect()] == [(True, 3.0), *[(False, 1.0)] * 6]


@pytest.mark.parametrize("through", [False, True])
def test_pressures_move_once_and_part_at_the_end(spark, through):
    t = omop.run(source(Frames(spark, SMALL)), [_STEPS[s] for s in (*_TO_DETAIL, "procedure_occurrence")])
    more = spark.createDataFrame([("SITE_OBS_SYSTOLIC", "4", 9), ("SITE_OBS_DIASTOLIC", "3", 8)], t["concepts"].schema)  # one code with two concepts, one with a single part
    rows = lambda t: omop.measurement_pressures(t, unnumbered, through)
    got, before = rows(t | {"concepts": t["concepts"].unionByName(more)}), rows(t)
    n = {c: got.where(f"measurement_concept_id = {c}").count() for c in (3004249, 9, 3012888, 8)}
    assert n[3004249] == n[9] > n[3012888] > 0 == n[8] and got.count() == before.count() + n[9]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_known") < plan.index("Join")  # the plan begins with its last step
