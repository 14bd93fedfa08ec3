"""Tracing, comparison, cohorts, drift, lists, publishing, samples and best matches against brute force on small frames."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.operators import intervals, paths
from tideline.operators.ids import dense_numbered
from tideline.operators.intervals import nearest
from tideline.plans import analyst, counts, disclosure, matching, profile, quality
from tideline.sources import files


def test_traced_counts_several_targets(spark):
    source = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    partner = spark.createDataFrame([(1, 5), (1, 6), (2, 1), (9, 9)], "p int, v int")
    stages = [quality.Stage("join", partner=partner, on=("k", "p")), quality.Stage("v", condition=F.col("v") > 4)]
    assert [tuple(r) for r in quality.waterfall(source, "k", stages).orderBy("place").collect()] == [(0, "source", 3, 0), (1, "join", 2, 1), (2, "v", 1, 1)]
    one = quality.traced(source, "k", stages, 2).first()
    assert (one["source_rows"], one["reached"], one["left_out"], one["target_rows"], one["several"], one["extra"]) == (3, 1, 2, 2, 1, 1)
    assert one["start_agrees"] and one["sums_agree"] and one["matches_the_run"]
    again = source.union(spark.createDataFrame([(1,), (None,)], "k int"))
    assert not quality.traced(again, "k", stages, 2).first()["start_agrees"]
    assert quality.traced(source.where("k > 9"), "k", stages, 0).first()["matches_the_run"]


def test_accounted(spark):
    one = "string step, string target"  # noqa: F841
    traces = spark.createDataFrame(
        [("a", "t", None, True, True, True, 0), ("b", "t", True, True, True, True, 2), ("c", "t", False, True, True, True, 2), ("d", "t", None, True, True, False, 1)],
        "step string, target string, may_repeat boolean, start_agrees boolean, sums_agree boolean, matches_the_run boolean, several long",
    )
    written = spark.createDataFrame([("t", 3), ("u", 1)], "target string, rows long")
    held = spark.createDataFrame([("t", 3), ("w", 1)], "target string, rows long")
    got = {r["step"]: r["outcome"] for r in quality.accounted(traces, written, held).collect()}
    assert got == {"a": "accounted", "b": "fan-out confirmed", "c": "unexplained", "d": "unexplained", "t": "accounted", "u": "unexplained", "w": "unexplained"}


def greedy(found, expected, near):
    """All pairs by distance and text; each is taken if both are free."""
    from collections import Counter

    a, b = Counter(found), Counter(expected)
    for x in list(a):
        n = min(a[x], b.get(x, 0))
        a[x], b[x] = a[x] - n, b[x] - n
    pairs = sorted((sum(abs(p - q) for p, q in zip(x[1:], y[1:], strict=True)), text(x), text(y), x, y) for x in a if a[x] for y in b if b[y] and near(x, y))
    for *_, x, y in pairs:
        n = min(a[x], b[y])
        a[x], b[y] = a[x] - n, b[y] - n
    return sorted([(*x, "unexpected", n) for x, n in a.items() if n] + [(*x, "missing", n) for x, n in b.items() if n])


def text(x):
    return f'{{"t":"{x[0]}","v":"{x[1]}","w":"{x[2]}"}}'


def test_unmatched_is_greedy_matching(spark):
    tol = 1e-6
    near = lambda x, y: x[0] == y[0] and all(abs(p - q) <= tol * max(1.0, abs(q)) for p, q in zip(x[1:], y[1:], strict=True))
    r = random.Random(4)
    for size in (0, 1, 60):
        rows = lambda: [(r.choice("ab"), r.choice([0.5, 1000.0, -2.0]) + r.randrange(-4, 5) * r.choice([4e-7, 1e-4]), 1.0 + r.randrange(3) * 6e-7) for _ in range(size)]
        a, b = rows(), rows()
        schema = "t string, v double, w double"
        got = sorted(tuple(x) for x in quality.unmatched(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), tol).collect())
        assert got == greedy(a, b, near)


def test_unmatched_at_the_rounding_edge_and_nulls(spark):
    schema = "t string, v double"
    a = spark.createDataFrame([("x", 0.4999995), (None, None), ("n", float("nan")), ("y", 1.0)], schema)
    b = spark.createDataFrame([("x", 0.5000005), (None, None), ("n", float("nan")), ("y", None)], schema)
    assert sorted((x["t"], x["side"], x["n"]) for x in quality.unmatched(a, b, 1.1e-6).collect()) == [("y", "missing", 1), ("y", "unexpected", 1)]


def test_changed_bands_and_ties(spark):
    rows = [("k", 2020, "a", 5), ("k", 2020, "b", 5), ("k", 2021, "b", 9), ("k", 2022, "a", 1), ("j", 2020, "b", 1), (None, 2020, "b", 2), ("k", None, "b", 2)]
    g = spark.createDataFrame(rows, "kind string, year long, band string, gaps long")
    assert [tuple(r) for r in counts.changed_bands(g, ["a", "b"]).collect()] == [("k", 2021, "b", "a")]
    assert [tuple(r) for r in counts.changed_bands(g, ["b", "a"]).collect()] == [("k", 2022, "a", "b")]


def test_cliff_at_the_bound(spark):
    """Floored to ten, 0 of 20 may be 9 of 20: 9.3 are missing then, and the year is not flagged."""
    g = spark.createDataFrame([(2020, 100, 100), (2021, 20, 0), (2022, 40, 0)], "year long, n long, f long")
    assert [r["year"] for r in counts.cliffs(g, "n", ["f"], step=10).collect()] == [2022]
    assert {r["year"] for r in counts.cliffs(g, "n", ["f"], step=1).collect()} == {2021, 2022}


def test_listable_types():
    kinds = ["VARCHAR(20)", "varchar", "VARCHAR(MAX)", "NVARCHAR(71)", "TEXT", "NTEXT", "XML", "DATETIME", "FLOAT", "DECIMAL(9,2)", "DECIMAL(9,0)", "numeric(5)", "int", "BIT", "CHAR(0)"]
    assert disclosure.listable([(f"c{i}", k) for i, k in enumerate(kinds)]) == ["c0", "c10", "c11", "c12", "c13"]
    assert disclosure.listable([("PatientName", "INT")]) == []


def test_dense_numbers_keep_null_keys(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), (None, 4), ("b", None)], "k string, v int")
    assert sorted((r["k"] or "", r["v"] or 0, r["id"]) for r in dense_numbered(df, ["k"]).collect()) == [("", 2, 1), ("", 4, 1), ("a", 3, 2), ("b", 0, 3), ("b", 1, 3)]


def test_cohort_backwards_is_lookup_forwards(spark):
    r = random.Random(7)
    base = spark.createDataFrame([(i, r.choice([None, *range(40)])) for i in range(300)], "id int, a int")
    mid = spark.createDataFrame([(i, r.choice([None, *range(12)])) for i in range(40)], "m int, c int")
    end = spark.createDataFrame([(i, f"s{i % 5}") for i in range(12)], "e int, name string")
    cohort = spark.createDataFrame([("s1",), ("s3",), (None,), ("s1",)], "k string")
    steps = [("mid", (("a", "m"),)), ("end", (("c", "e"),))]
    forward = paths.looked_up(base, {"mid": mid, "end": end}, {"name": (steps, "name")}).join(cohort.distinct(), F.col("name") == F.col("k"), "left_semi")
    want = sorted(x["id"] for x in forward.collect())
    for sent in (0, 3, 100_000):
        got = paths.of_cohort(base, {"mid": mid, "end": end}, steps, "name", cohort, "k", sent)
        assert sorted(x["id"] for x in got.collect()) == want and got.columns == base.columns
    assert paths.of_cohort(base, {"mid": mid, "end": end}, steps, "name", cohort.where("k = 'none'"), "k", 0).count() == 0


@pytest.mark.parametrize("side", ["before", "after", "either"])
def test_nearest_in_both_directions(spark, side):
    r = random.Random(1)
    t0 = datetime(2024, 1, 1)
    left = [(i, r.choice("ab"), t0 + timedelta(minutes=r.randrange(600))) for i in range(80)]
    right = sorted({(r.choice("abc"), t0 + timedelta(minutes=r.randrange(0, 600, 7))): i for i in range(40)}.items())
    right = [(k, t, v) for (k, t), v in right]
    got = nearest(spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, u timestamp_ntz, v int"), ("k",), "t", "u", ["v"], 30, 20, side)

    def want(k, t):
        near = [(abs((u - t).total_seconds()), u, v) for kk, u, v in right if kk == k and (u <= t and (t - u).total_seconds() <= 1800 and side != "after" or u >= t and (u - t).total_seconds() <= 1200 and side != "before")]
        return min(near)[2] if near else None

    assert {x["id"]: x["v"] for x in got.collect()} == {i: want(k, t) for i, k, t in left}


def test_top_k_is_the_full_ranking(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, ["the"] + r.choices(words, weights=[1 / (i + 1) for i in range(30)], k=r.randrange(0, 9))) for i in range(200)] + [(900, []), (901, None)], "doc int, t array<string>")
    asked = spark.createDataFrame([(i, ["the"] + r.choices(words + ["absent"], k=r.randrange(0, 4))) for i in range(25)] + [(77, []), (78, ["absent"])], "q int, qt array<string>")
    full = matching.best(matching.bm25(asked, "q", F.col("qt"), docs, "doc", F.col("t")).withColumn("score", F.round("score", 9)), "q", "doc", 4)
    want = sorted((x["q"], x["rank"], x["doc"], round(x["score"], 6)) for x in full.collect())
    got = matching.top_k(asked, "q", F.col("qt"), docs, "doc", F.col("t"), 4)
    assert sorted((x["q"], x["rank"], x["doc"], round(x["score"], 6)) for x in got.collect()) == want


def test_block_sample_reads_fewer_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(1000).repartition(10).write.parquet(path)
    df = spark.read.parquet(path)
    part, whole = profile.block_sampled(df, 30), profile.block_sampled(df, 100)
    assert 1 <= part.read < 10 and len(part.rows.inputFiles()) == part.read and (whole.read, whole.blocks) == (10, 10)
    one = profile.estimated(whole, {"even": F.col("id") % 2 == 0}).first()
    assert (one["figure"], one["estimate"], one["standard_error"]) == ("even", 500.0, 0.0)
    some = profile.estimated(part, {"all": F.lit(True)}).first()
    assert some["estimate"] == pytest.approx(1000, rel=0.05)
    assert profile.estimated(profile.block_sampled(df, 0), {"all": F.lit(True)}).first()["standard_error"] is None


def test_column_profile_has_no_expand(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, None, -0.0), (3, "a", None)], "k int, s string, d double")
    out = profile.columns(df, ["k", "s", "d"])
    assert sorted(tuple(r) for r in out.collect()) == [("d", 3, 1, 1, 0), ("k", 3, 3, 0, 1), ("s", 3, 1, 1, 0)]
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["rows"] for r in profile.columns(df.where("k > 9"), ["k", "s"]).collect()] == [0, 0]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "l.txt").write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.numbered_lines(spark, f"file://{tmp_path}/l.txt")
        assert got.rdd.getNumPartitions() > 1
        assert got.where("line <> CAST(split(value, ' ')[0] AS LONG)").count() == 0 and got.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    ("form", "lines", "says"),
    [
        ("anaesthetic_keys", "patient_key,date\np,2024-01-01\n", "holds pairs"),
        ("anaesthetic_keys", "key\na\n", "line 1: the header"),
        ("anaesthetic_keys", "anaesthetic_key\na\n\nb,c\n", "line 4: not one key"),
        ("anaesthetic_keys", "anaesthetic_key\n" + "k" * 65 + "\n", "line 2: not one key"),
        ("anaesthetic_keys", "anaesthetic_key\nclé\n", "line 2"),
        ("anaesthetic_keys", "anaesthetic_key\n\n", "is empty"),
        ("anaesthetic_keys", "", "is empty"),
        ("anaesthetic_keys", "anaesthetic_key\na\nb\nc\n", "at most 2"),
        ("pairs", "patient_key, date\np,2024-01-01\nq,2024-02-30\n", "line 3: not a patient's key and a date"),
        ("pairs", "patient_key,date\np,2024-01-01,z\n", "line 2"),
    ],
)
def test_lists_are_refused_by_line(spark, tmp_path, form, lines, says):
    path = tmp_path / "list.csv"
    path.write_text(lines)
    with pytest.raises(ValueError, match=says) as error:
        files.read_chosen(spark, f"file://{path}", form, most=2)
    assert "2024" not in str(error.value)


def test_lists_are_read(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿anaesthetic_key\n a \n\n\"b\"\n")
    assert sorted(r[0] for r in files.read_chosen(spark, f"file://{tmp_path}/l.csv").collect()) == ["a", "b"]
    (tmp_path / "p.csv").write_text("patient_key,date\np,2024-01-31\n")
    assert [tuple(map(str, r)) for r in files.read_chosen(spark, f"file://{tmp_path}/p.csv", "pairs").collect()] == [("p", "2024-01-31")]


def test_writers_at_once_publish_in_turn(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    done, n = [], 6
    start = threading.Barrier(n)

    def work(i):
        start.wait()
        done.append(files.publish({"t": spark.range(i + 1)}, {}, root))

    threads = [threading.Thread(target=work, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = files.commits(spark, root)
    assert [k for k, _ in found] == list(range(1, n + 1)) and {r["version"] for _, r in found} == set(done)
    last, record = files.newest(spark, root)
    assert files.published(spark, root, "t").count() == spark.read.parquet(f"{root}/versions/{record['version']}/t").count()
    files.publish({"t": spark.range(50)}, {}, root, base=last)
    with pytest.raises(ValueError, match="another version"):
        files.publish({"t": spark.range(60)}, {}, root, base=last)
    assert files.published(spark, root, "t").count() == 50 and files.published(spark, root, "t", 1).count() >= 1
    (tmp_path / "r/commits" / f"{last + 2:012d}").write_text('{"vers')  # a writer that died
    assert files.newest(spark, root)[0] == last + 1
    gone = files.recovered(spark, root, older_hours=-1)
    assert len(gone) == 1 and files.published(spark, root, "t").count() == 50
    files.publish({"t": spark.range(70)}, {}, root)
    assert files.newest(spark, root)[0] == last + 3 and files.published(spark, root, "t").count() == 70


def test_as_of_strict_and_ahead(spark):
    rng = random.Random(4)
    left = [(n, rng.choice(["a", "b", None]), rng.choice([None, *range(12)])) for n in range(80)]
    right = sorted({(rng.choice("ab"), t) for t in range(12) for _ in range(2) if rng.random() < 0.5}) + [(None, 3), ("a", None)]
    l, r = spark.createDataFrame(left, "n int, k string, t int"), spark.createDataFrame([(k, t, t) for k, t in right], "k string, at int, v int")
    for strict in (False, True):
        for ahead in (False, True):
            got = {x["n"]: x["v"] for x in intervals.as_of(l, r, ("k",), "t", "at", ["v"], strict, ahead).collect()}
            for n, k, t in left:
                near = [u for j, u in right if None not in (j, k, t, u) and j == k and ((u > t or (u == t and not strict)) if ahead else (u < t or (u == t and not strict)))]
                assert got[n] == ((min(near) if ahead else max(near)) if near else None)


def test_returned_within_is_the_pairwise_rule(spark):
    rng = random.Random(9)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = []
    for n in range(120):
        start = rng.randrange(40)
        rows.append((n, rng.choice(["a", "b", "c", None]), day(start), rng.choice([None, day(start + rng.randrange(4)), day(start - 2)])))
    got = {x["key"]: x["returned"] for x in analyst.returned_within(spark.createDataFrame(rows, "key int, who string, start timestamp_ntz, end timestamp_ntz"), "who", "key", 3).collect()}
    for key, who, _, end in rows:
        assert got[key] == int(any(k != key and w == who and None not in (w, end) and end < s <= end + timedelta(days=3) for k, w, s, _ in rows))


def test_latest_weight_is_the_pairwise_rule(spark):
    rng = random.Random(2)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    cases = [(n, rng.choice(["a", "b", None]), rng.choice([None, *map(day, range(30))])) for n in range(60)]
    weights = [(rng.choice(["a", "b", None]), day(rng.randrange(30)), rng.choice(["3", "4.5", "n/a", None])) for _ in range(25)]
    got = analyst.latest_before(spark.createDataFrame(cases, "c int, who string, time timestamp_ntz"), spark.createDataFrame(weights, "who string, time timestamp_ntz, text string"), "c", "who", 5)
    got = {x["c"]: (x["weight_time"], x["weight"] and float(x["weight"])) for x in got.collect()}
    for c, who, time in cases:
        near = [(t, float(x)) for w, t, x in weights if x not in ("n/a", None) and who and time and w == who and time - timedelta(days=5) <= t < time]
        assert got[c] == (max(near) if near else (None, None))
