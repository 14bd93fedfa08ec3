"""The whole run: rows are dealt once for their join and their numbers, readings are read once, identifiers are counted in words."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.operators import ids
from tideline.plans import omop
from tideline.queries_omop import _counted_rows

AT = datetime(2024, 1, 1, 8)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _source(spark):
    """Forty visits and episodes, of which one visit key and one episode key stand twice, and one of each is gone."""
    key = lambda i: f"A{i:04d}"
    visits = [(i, "p", AT + timedelta(days=i)) for i in range(40) if i != 7] + [(11, "p", AT + timedelta(days=90))]
    episodes = [(key(i), i, i % 3, i % 4, AT + timedelta(days=i), None if i % 5 == 0 else AT + timedelta(days=i, hours=2)) for i in range(40) if i != 9] + [(key(13), 13, 1, 1, AT + timedelta(days=13, hours=5), None)]
    lines = [(i, n) for i in range(42) for n in (3, 1, 2)]
    texts = {1: "110/70", 2: "80", 3: "n/a"}
    return {
        "concepts": spark.createDataFrame([("SITE_DIAGNOSIS", "1", 11), ("SITE_DIAGNOSIS", "1", 12), ("SITE_OBS", "0", 3025315), ("SITE_ANAES_KIND", "1", 41), ("SITE_EVENT_PROC", "click", 71), ("SITE_EVENT_OBS", "view", 61), ("SITE_SETTING", "EVENT_LINK_MARGIN_MINUTES", 30), ("SITE_OBS_SYSTOLIC", "1", 1), ("SITE_OBS_DIASTOLIC", "1", 2), ("SITE_SETTING", "CALCULATED_MEAN_PRESSURE", 1), ("SITE_DRUG_RUNNING", "R", 1), ("SITE_DRUG_STOPPED", "S", 1), ("SITE_DRUG", "1", 5), ("SITE_DRUG", "1", 6)], "vocabulary string, code string, concept long"),
        "subjects": spark.createDataFrame([("p", date(1990, 1, 1), 1, 0)], "patient_key string, birth_date date, sex long, is_test int"),
        "wards": spark.createDataFrame([("w", "ward")], "ward_key string, label string"),
        "visits": spark.createDataFrame([(*v, v[2], "w") for v in visits], "visit_key long, patient_key string, admitted timestamp_ntz, discharged timestamp_ntz, ward_key string"),
        "episodes": spark.createDataFrame(episodes, "anaesthetic_key string, visit_key long, kind int, risk_grade int, start_time timestamp_ntz, stop_time timestamp_ntz"),
        "diagnoses": spark.createDataFrame([(i, n, n % 2, "X") for i, n in lines], "visit_key long, seq int, diagnosis int, icd string"),
        "readings": spark.createDataFrame([(100 - i, n, i, key(i), n % 2, texts[n], AT + timedelta(days=i, minutes=60 * n), "N" if i == 20 else None) for i, n in lines], "sheet_key long, seq int, visit_key long, anaesthetic_key string, kind int, text string, reading_time timestamp_ntz, accepted string"),
        "events": spark.createDataFrame([(key(i), n, "click" if n == 2 else "view", AT + timedelta(days=i, minutes=70 * n)) for i, n in lines], "anaesthetic_key string, seq int, event_kind string, event_time timestamp_ntz"),
        "infusions": spark.createDataFrame([(10 * i + n, i, key(i), 1, "x", "S" if n == 3 else "R", "O", n, AT + timedelta(days=i, hours=n)) for i, n in lines], "given_key long, visit_key long, anaesthetic_key string, drug int, label string, action string, route string, amount int, given_time timestamp_ntz"),
    }


TO_READINGS = [s for s in omop.CORE if s.target in ("person", "care_site", "visit_occurrence", "condition_occurrence", "visit_detail", "procedure_occurrence", "observation") and s.rows is not omop.procedure_surgery]
STEPS = [*TO_READINGS[:-1], *[s for s in omop.CORE if s.rows in omop.OF_READINGS], TO_READINGS[-1], omop.LAYER[1]]


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_in_ranges_have_the_numbers_of_a_total_order(spark, shuffled, monkeypatch):
    want = omop.run(_source(spark), STEPS)
    monkeypatch.setattr(ids, "LEAST_IN_RANGE", 11)
    plans = []
    keep = ids.staged
    monkeypatch.setattr(ids, "staged", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    got = omop.run(_source(spark), STEPS)
    assert set(got) == set(want)
    for s in STEPS:  # numbers of rows that tie in their order, as those of an episode that stands twice, are open
        numbers = [c for c in got[s.target].columns if c == s.key or c in ("procedure_occurrence_id", "measurement_event_id", "observation_event_id")]
        assert _rows(got[s.target].drop(*numbers)) == _rows(want[s.target].drop(*numbers)), s.target
        assert _rows(got[s.target].select(s.key)) == _rows(want[s.target].select(s.key))
        assert got[s.target].groupBy(s.key).count().where("count > 1").count() == 0
    assert sum("rangepartitioning" not in p for p in plans) == 5  # conditions, anaesthetics, events, observations, infusions
    for target, time in (("observation", "observation_datetime"), ("drug_exposure", "drug_exposure_start_datetime"), ("condition_occurrence", "condition_start_date")):
        times = [r[0] for r in got[target].orderBy(f"{target}_id").select(time).collect() if str(r[0]) < "2024-03"]  # without the second visit of a key
        assert times == sorted(times) and len(set(times)) > 30


def test_rows_in_wrong_partitions_get_no_numbers(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("int").alias("_range")).repartition(4, "id")
    with pytest.raises(ValueError, match="by range"):
        ids.numbered(df, ["id"], "n", out=["id"], dealt=ids.Ranges([20, 40]))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 8, 9])
def test_places_of_keys(spark, n):
    ranges = ids.Ranges([f"k{10 * i}" for i in range(1, n + 1)])
    keys = [None, "", "k10", "k100", "k11", "k49", "k50", "k99", "z"]
    got = ranges.placed(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()
    assert {r.k: r._range for r in got} == {k: sum(k is not None and b <= k for b in ranges.least) for k in keys}


def test_keys_of_a_range_sort_by_what_they_do_not_begin_with_alike(spark):
    ranges = ids.Ranges(["A001", "A00100", "A0011é", "A0011éz", "A0011é\U0001f600", "B"])
    keys = [None, "", "A", "A00", "A001", "A0010", "A00100", "A001000", "A0011", "A0011é", "A0011éa", "A0011éy", "A0011éz", "A0011é\uffff", "A0011é\U0001f600", "A2", "B", "Z"]
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k string, n int").repartition(5)
    got = ids.numbered(ranges.dealt(ranges.placed(df, "k")), ["k"], "id", out=["k", "n"], dealt=ranges).collect()
    assert sorted((r.id, r.n) for r in got) == [(n + 1, n) for n in range(len(keys))]


def test_rows_of_their_own_key_need_no_sample_of_their_joins(spark, monkeypatch):
    monkeypatch.setattr(ids, "LEAST_IN_RANGE", 11)
    plans = []
    keep = ids.staged
    rows = spark.createDataFrame([((37 * i) % 101 - 50 if i else None, i % 7) for i in range(101)], "given_key long, visit int")
    monkeypatch.setattr(ids, "staged", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    dealt, ranges = omop._by_own_key(rows.join(rows.select("visit").distinct(), "visit"), rows, "given_key", ids.numbered)
    got = ids.numbered(dealt, ["given_key"], "id", out=["given_key"], dealt=ranges).orderBy("id").collect()
    assert len(ranges.least) >= 3 and "rangepartitioning" not in plans[0]
    keys = [r.given_key for r in got]
    assert [r.id for r in got] == list(range(1, 102)) and keys[0] is None and keys[1:] == sorted(keys[1:])
    assert omop._by_own_key(rows, rows, "given_key", ids.unnumbered)[1] is None


def test_readings_are_read_once_for_several_steps(spark, monkeypatch):
    labels = []
    keep = omop.staged
    monkeypatch.setattr(omop, "staged", lambda df, label: labels.append(label) or keep(df, label))
    t = omop.run(_source(spark), STEPS)
    assert labels.count("readings") == 1 and "_readings" not in t
    before = omop.run(_source(spark), TO_READINGS)
    assert "readings" not in labels[labels.index("readings") + 1 :]
    alone = [s.rows(before, omop.unnumbered) for s in omop.CORE if s.rows in omop.OF_READINGS]
    for k, df in enumerate(alone):
        assert df.count() > 0
        alone[k] = df.select(*[c for c in alone[0].columns if c in df.columns])
    parts = alone[0].unionByName(alone[1], allowMissingColumns=True).unionByName(alone[2], allowMissingColumns=True)
    assert _rows(t["measurement"].drop("measurement_id")) == _rows(parts)
    mean = t["measurement"].where(f"measurement_concept_id = {omop.MEAN_PRESSURE}")
    assert mean.count() == mean.select("visit_detail_id", "measurement_datetime").distinct().count() > 30  # a visit's key that stands twice repeats none


def test_identifiers_are_counted_in_words(spark):
    keys = [0, 1, 63, 64, 65, 127, 128, 5_000_000_001, 5_000_000_002, -1, -64, -65, 2**62, None, None]
    for repeated in ([], [64, 64, 5_000_000_001, -1]):
        df = spark.createDataFrame([(k,) for k in [*keys, *repeated]], "k long").repartition(3)
        assert tuple(_counted_rows(df, "t", "k").first()) == ("t", len(keys) + len(repeated), 13)
    assert tuple(_counted_rows(df.where("false"), "t", "k").first()) == ("t", 0, 0)
    assert tuple(_counted_rows(df, "t", None).first()) == ("t", 19, None)
    many = spark.range(100_000).withColumn("id", F.col("id") + 7)
    assert _counted_rows(many, "t", "id").first().identifiers == 100_000
