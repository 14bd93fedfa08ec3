"""Small hand-made cases of the measures: unknown stays unknown, ties, refused rows, windows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from tideline.functions.text import number, pressures
from tideline.functions.time import completed_years, minutes_between
from tideline.operators.ids import dense_numbered, numbered
from tideline.plans import disclosure, measures, quality, registry

T0 = datetime(2024, 1, 1, 8)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def world(spark):
    subjects = spark.createDataFrame(
        [("p", date(2023, 12, 20), None, 0), ("old", date(1980, 1, 1), None, 0), ("test", date(2023, 12, 20), None, 1)], "patient_key string, birth_date date, death_date date, is_test int"
    )
    episodes = spark.createDataFrame(
        [("a", "p", at(0), at(60)), ("open", "p", at(0), None), ("back", "p", at(60), at(0)), ("none", "p", at(0), at(60)), ("aged", "old", at(0), at(60)), ("t", "test", at(0), at(60))],
        "anaesthetic_key string, patient_key string, start_time timestamp_ntz, stop_time timestamp_ntz",
    )
    rows = [
        ("a", "art", at(0), 30.0, 1), ("a", "cuff", at(0), 80.0, 1), ("a", "art", at(3), 35.0, 1), ("a", "art", at(3), 50.0, 1), ("a", "art", at(20), 50.0, 1),
        ("a", "art", at(21), 10.0, 0), ("a", "art", at(58), 20.0, 1), ("a", "art", at(61), 20.0, 1), ("a", "art", at(59), None, 1),
        ("open", "art", at(0), 30.0, 1), ("open", "art", at(2), 30.0, 1), ("aged", "art", at(0), 10.0, 1), ("t", "art", at(0), 10.0, 1), ("back", "art", at(30), 10.0, 1),
    ]
    readings = spark.createDataFrame(rows, "anaesthetic_key string, kind string, reading_time timestamp_ntz, value double, accepted int")
    kinds = spark.createDataFrame([("art", 1), ("cuff", 2)], "kind string, preference int")
    bands = spark.createDataFrame([(0, 28, 40.0)], "from_days int, until_days int, threshold double")
    return subjects, episodes, readings, kinds, bands


def test_burden(world):
    got = {r["anaesthetic_key"]: (r["threshold"], r["readings"], r["minutes_beyond"]) for r in measures.burden(*world).collect()}
    # a: 3 minutes at 30, 5 of 17 at 35, nothing at 50, 2 at 20; open: 2 minutes, the last reading stands for nothing
    assert got == {"a": (40.0, 4, 10.0), "open": (40.0, 2, 2.0), "none": (40.0, 0, None), "aged": (None, 1, None)}


def test_burden_window_keeps_the_unknown_stop(world):
    got = {r["anaesthetic_key"]: r["minutes_beyond"] for r in measures.burden(*world, until_minutes=1).collect()}
    assert got["open"] == 0.0 and got["a"] == 1.0


def test_overlapping_bands_are_refused(world, spark):
    bands = spark.createDataFrame([(0, 28, 40.0), (20, 50, 45.0)], "from_days int, until_days int, threshold double")
    with pytest.raises(ValueError):
        measures.burden(*world[:4], bands)


def test_completeness(world):
    s, e, r, k, _ = world
    got = {x["anaesthetic_key"]: x for x in measures.completeness(s, e, r, k, 5).collect()}
    assert got["none"]["share_covered"] == 0.0 and got["none"]["longest_gap_minutes"] == 60.0
    assert got["a"]["covered_minutes"] == 3 + 5 + 5 + 2 and got["a"]["longest_gap_minutes"] == 38.0
    assert got["open"]["share_covered"] is None and got["open"]["readings"] == 2


def test_cooling_arrival(world):
    s, e, r, _, _ = world
    got = {x["anaesthetic_key"]: x for x in measures.cooling(s, e, r, "art", 36.0, stands_minutes=15, recovery_minutes=30).collect()}
    assert got["a"]["arrival_temperature"] == 20.0 and got["a"]["lowest"] == 20.0 and got["none"]["minutes_below"] is None


def test_exposure_intervals(spark):
    rows = [("1", "a", None, "d", "infusion_start", at(0), None), ("2", "a", None, "d", "infusion_pause", at(10), None), ("3", "a", None, "d", "infusion_restart", at(20), None), ("4", "a", None, "d", "rate_change", at(25), "9"), ("9", "a", None, "d", "rate_change", at(22), None)]
    drugs = spark.createDataFrame(rows, "drug_event_key string, anaesthetic_key string, order_key string, drug string, action string, given_time timestamp_ntz, amends_key string").selectExpr("*", "1.0D AS amount")
    concepts = spark.createDataFrame([("d", 7, "mapped")], "local_key string, concept_id long, status string")
    got = {r["drug_event_key"]: (r["ended"], r["stop_reason"]) for r in measures.exposure_intervals(drugs, concepts).collect()}
    assert got == {"1": (at(10), None), "3": (at(25), None), "4": (None, "stop not recorded")}


def test_registry_refuses(world):
    s, e, r, k, b = world
    with pytest.raises(ValueError, match="missing"):
        registry.measure("hypotension_burden", 1, s, e, r, kinds=k)
    with pytest.raises(ValueError, match="no choice"):
        registry.measure("hypotension_burden", 1, s, e, r, kinds=k, bands=b, direction="sideways", stands_minutes=5, from_minutes=0, until_minutes=None)
    got = registry.measure("hypotension_burden", 1, s, e, r, kinds=k, bands=b, direction="below", stands_minutes=5, from_minutes=0, until_minutes=None)
    assert got.count() == 4


def test_extreme_and_first_beyond(world):
    s, e, r, k, _ = world
    window = {"kinds": k.select("kind"), "from_minutes": 0, "until_minutes": None}
    low = registry.measure("extreme_in_window", 1, s, e, r, direction="lowest", **window).collect()
    # refused, late and empty readings do not count; an unknown stop leaves the window open; of equal values the first time counts
    assert {x["anaesthetic_key"]: tuple(x)[1:] for x in low} == {"a": (6, 20.0, at(58)), "open": (2, 30.0, at(0)), "none": (0, None, None), "aged": (1, 10.0, at(0))}
    high = registry.measure("extreme_in_window", 1, s, e, r, direction="highest", **window | {"from_minutes": 1, "until_minutes": 20}).collect()
    assert {x["anaesthetic_key"]: tuple(x)[1:] for x in high} == {"a": (3, 50.0, at(3)), "open": (1, 30.0, at(2)), "none": (0, None, None), "aged": (0, None, None)}
    first = registry.measure("time_to_first_beyond_threshold", 1, s, e, r, threshold=25, direction="below", **window).collect()
    assert {x["anaesthetic_key"]: tuple(x)[1:] for x in first} == {"a": (6, at(58), 58.0), "open": (2, None, None), "none": (0, None, None), "aged": (1, at(0), 0.0)}
    above = registry.measure("time_to_first_beyond_threshold", 1, s, e, r, threshold=40, direction="above", **window).collect()
    assert {x["anaesthetic_key"]: tuple(x)[1:] for x in above} == {"a": (6, at(0), 0.0), "open": (2, None, None), "none": (0, None, None), "aged": (1, None, None)}
    with pytest.raises(ValueError, match="no choice"):
        registry.measure("extreme_in_window", 1, s, e, r, direction="deepest", **window)


def test_events_counted(spark, world):
    s, e, *_ = world
    rows = [("a", "x", at(0)), ("a", "x", at(0)), ("a", "y", at(60)), ("a", "x", at(61)), ("a", "x", None), ("a", "z", at(5)), ("open", "y", at(500)), ("t", "x", at(1)), (None, "x", at(1)), ("a", None, at(1))]
    events = spark.createDataFrame(rows, "anaesthetic_key string, kind string, event_time timestamp_ntz")
    kinds = spark.createDataFrame([("x",), ("y",), ("x",)], "kind string")
    got = registry.measure("count_of_events", 1, s, e, events, kinds=kinds, from_minutes=0, until_minutes=None)
    assert {x["anaesthetic_key"]: x["events"] for x in got.collect()} == {"a": 3, "open": 1, "none": 0, "aged": 0}


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_numbers_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x").repartition(partitions)
    assert numbered(df, ["x"]).where("id <> x + 1").count() == 0
    assert dense_numbered(df.selectExpr("x div 10 AS y"), ["y"]).where("id <> y + 1").count() == 0


def test_scalar_traps(spark):
    rows = spark.createDataFrame([("",), ("1.0d",), ("NaN",), (" 2 ",), ("1e3",), ("110/70",), ("110/",), (None,)], "t string")
    assert [r[0] for r in rows.select(number(rows.t)).collect()] == [None, None, None, 2.0, 1000.0, None, None, None]
    assert [tuple(r[0]) for r in rows.select(pressures(rows.t)).collect()][5:7] == [(110.0, 70.0), (110.0, None)]
    d = spark.createDataFrame([(datetime(2024, 1, 1, 8, 0, 50), datetime(2024, 1, 1, 8, 1, 10), date(2020, 2, 29), date(2021, 2, 28), date(2021, 3, 1))], "a timestamp_ntz, b timestamp_ntz, c date, d date, e date")
    assert d.select(minutes_between(d.a, d.b), completed_years(d.c, d.d), completed_years(d.c, d.e)).first()[:] == (1, 0, 1)


def test_disclosure(spark):
    df = spark.createDataFrame([(0, 3), (4, 5), (9, 12), (37, 4)], "n long, m long")
    assert [tuple(r) for r in disclosure.blanked(df, ["n", "m"]).collect()] == [(0, None), (None, 5), (9, 12), (37, None)]
    assert [tuple(r) for r in disclosure.floored(df, "n", ["m"]).collect()] == [(30, None)]


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 100.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0000001), (2, 100.5)], "k int, v double")
    assert sorted((r["k"], r["v"], r["side"]) for r in quality.differences(a, b).collect()) == [("1", "1", "unexpected"), ("2", "100", "unexpected"), ("2", "100.5", "missing")]
