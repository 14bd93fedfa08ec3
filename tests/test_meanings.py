"""Meanings that SQL does not check: stems and ranked phrases, keys, kinds, ages, comparisons, digests, disclosure."""

from __future__ import annotations

import hashlib
import json
import math
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators.paths import looked_up
from tideline.plans import analyst, disclosure, matching, quality


def brute_stem(w):
    vowel = "(?:[aeiou]|(?<=.)y)"
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if re.search(f"{vowel}[^aeiou].*eed$", w) else w
    else:
        for e in ("ed", "ing"):
            if re.search(f"{vowel}.*{e}$", w):
                w = w[: -len(e)]
                if re.search("(?:at|bl|iz)$", w) or re.fullmatch("[^aeiou]+[aeiouy][^aeiouwxy]", w):
                    w += "e"
                elif re.search(r"([b-df-hj-kmnp-rtv-x])\1$", w):
                    w = w[:-1]
                break
    return w[:-1] + "i" if re.search(f"{vowel}.*y$", w) else w


def test_stems(spark):
    some = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky planned operations dates births yes dyed".split()
    got = [r[0] for r in spark.createDataFrame([(w,) for w in some], "w string").select(matching.stem(F.col("w"))).collect()]
    assert got == [brute_stem(w) for w in some]
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agree", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflate", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky"}
    assert {w: g for w, g in zip(some, got, strict=True) if w in want} == want


def brute_order(phrase, tokens, gap=2):
    def from_(k, at):
        return k == len(phrase) or any(tokens[j] == phrase[k] and from_(k + 1, j) for j in range(at + 1, min(len(tokens), at + gap + 2)))

    return bool(phrase) and any(t == phrase[0] and from_(1, j) for j, t in enumerate(tokens))


def test_ranked_phrases(spark):
    import random

    rng = random.Random(3)
    letters = "stent lead valve pump line".split()
    docs = [(i, [rng.choice(letters) for _ in range(rng.randrange(12))]) for i in range(60)]
    asked = [(q, [rng.choice(letters) for _ in range(rng.randrange(1, 4))]) for q in range(12)]
    d, a = spark.createDataFrame(docs, "doc long, t array<string>"), spark.createDataFrame(asked, "query long, qt array<string>")
    scores = matching.bm25(a, "query", F.col("qt"), d, "doc", F.col("t")).join(a, "query").join(d, "doc")
    ranked = matching.weighted(matching.with_order(scores, F.col("qt"), F.col("t")), F.when(F.col("doc") % 2 == 0, 1.0).otherwise(0.5), 3.0, 1.0)
    got = {(r["query"], r["rank"]): (r["doc"], round(r["score"], 6), r["in_order"], r["confidence"]) for r in matching.best(ranked, "query", "doc", 3).collect()}
    average, want = sum(len(t) for _, t in docs) / len(docs), {}
    for q, qt in asked:
        out = []
        for i, t in docs:
            if set(qt) & set(t):
                s = 0.0
                for w in qt:
                    n, df = t.count(w), sum(w in x for _, x in docs)
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.5 + 0.5 * len(t) / average)) if n else 0
                order = len(qt) > 1 and brute_order(qt, t)
                s = (s + 2 * order) * (1 if i % 2 == 0 else 0.5)
                out.append((-round(s, 9), i, round(s, 6), order, "high" if s >= 3 else "medium" if s >= 1 else "low"))
        for k, (_, i, s, order, level) in enumerate(sorted(out)[:3], 1):
            want[q, k] = (i, s, order, level)
    assert got == want


def test_words_take_the_sites_tables(spark):
    row = spark.range(1).select(matching.described(F.lit("BP colour"), F.lit("dates of birth"), abbreviations={"bp": "blood pressure"}, spellings={"colour": "color"}, synonyms={"birth": "born"})).first()
    assert row[0] == ["blood", "pressure", "color"] * 2 + ["date", "born"]


def test_opaque_keys(spark):
    codes = ["a", 'q"x', "b\\c", "é", "line\nend", "tab\t\x01", None, "zz"]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(text.local_key('s"alt', "MAP", F.col("c")), text.listed_key("s", "M", F.col("c"), ["a"])).collect()
    key = lambda salt, m, c: "k" + hashlib.sha256(json.dumps([salt, m, c], ensure_ascii=False).encode()).hexdigest()[:15]
    assert [r[0] for r in got] == [c and key('s"alt', "MAP", c) for c in codes]
    assert [r[1] for r in got] == [key("s", "M", "a") if c == "a" else c and "unlisted" for c in codes]


def test_kinds_and_first_birthdays(spark):
    kinds = {"mean": ["1", "2"], "systolic": ["3"]}
    got = spark.createDataFrame([("1",), ("3",), ("9",), (None,)], "c string").select(text.closed_kind(F.col("c"), kinds), text.closed_kind(F.col("c"), None), text.closed_kind(F.col("c"), {})).collect()
    assert [tuple(r) for r in got] == [("mean", "other", "other"), ("systolic", "other", "other"), ("other", "other", "other"), ("other", None, "other")]
    days = [(date(2020, 2, 29), date(2021, 2, 28), True), (date(2020, 2, 29), date(2021, 3, 1), False), (date(2020, 5, 5), date(2021, 5, 5), False), (date(2020, 5, 5), date(2021, 5, 4), True)]
    assert [r[0] for r in spark.createDataFrame(days, "b date, a date, w boolean").select(text.under_one_year(F.col("b"), F.col("a"))).collect()] == [w for _, _, w in days]


def test_values_agree_within_a_tolerance(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, 1e9 + 100, "x"), (2, nan, "x"), (3, None, "x"), (4, 0.5, "y"), (5, 2.0, "z")], "k long, v double, s string")
    b = spark.createDataFrame([(1, 1e9, "x"), (2, None, "x"), (3, None, "x"), (4, 0.5000004, "x"), (6, 2.0, "z")], a.schema)
    assert {r["k"]: r["columns"] for r in quality.unlike(a, b, ["k"]).collect()} == {2: ["v"], 4: ["s"], 5: None, 6: None}
    assert quality.canonical(a.where("k in (2, 3)")).select("v").distinct().count() == 2


def test_digests_tell_where_a_null_is(spark):
    digest = lambda rows: quality.fingerprint(spark.createDataFrame(rows, "a string, b string")).first()["digest"]
    assert digest([(None, "a")]) != digest([("a", None)]) and digest([("a", "b"), ("c", None)]) == digest([("c", None), ("a", "b")])


def test_columns_that_are_never_listed():
    cols = [("CITY", "varchar(30)"), ("E_MAIL_EMAIL", "varchar(30)"), ("PHONE_NO", "int"), ("HOME_ADDRESS", "int"), ("ITEM_DESC", "char(5)"), ("CODE", "nvarchar(71)"), ("GRADE", "varchar(70)"), ("N", "int")]
    assert disclosure.listable(cols) == ["CITY", "GRADE", "N"]


def test_audit_over_converted_tables(spark):
    t = lambda h, m, s=0: datetime(2024, 1, 1, h, m, s)
    a = [(1, 10, 5, t(8, 0), t(8, 30)), (2, 11, 27, t(9, 0), None), (3, 12, 28, t(8, 0), t(9, 0)), (4, 10, 3, t(12, 0), t(12, 10)), (5, 13, 0, t(8, 0), t(8, 20))]
    cuff, line = analyst.CUFF_MEAN, analyst.ARTERIAL_MEAN
    m = [
        (1, 1, cuff, t(8, 0), 35.0), (2, 1, cuff, t(8, 4), 50.0), (3, 1, line, t(8, 4), 39.0), (4, 1, cuff, t(8, 20), 41.0), (5, 1, cuff, t(8, 31), 10.0), (6, 1, 7, t(8, 10), 10.0),
        (7, 2, cuff, t(9, 0), 39.0), (8, 4, cuff, t(12, 0), 60.0), (9, 3, cuff, t(8, 0), 1.0),
    ]
    deaths = [(10, date(2024, 3, 31)), (11, date(2024, 3, 31)), (12, date(2024, 1, 2))]
    got = analyst.audit_of_tables(
        spark.createDataFrame(a, "anaesthetic_id long, person_id long, age_days int, start_datetime timestamp_ntz, end_datetime timestamp_ntz"),
        spark.createDataFrame(m, "measurement_id long, measurement_event_id long, measurement_concept_id long, measurement_datetime timestamp_ntz, value_as_number double"),
        spark.createDataFrame([*deaths[:2], (13, date(2024, 4, 1))], "person_id long, death_date date"),
    ).collect()
    # 1: 4 minutes at 35 and 5 at 39 (the arterial one); 2: without an end; 4: never below; 5: no reading, and its death is on day 91
    assert [tuple(r) for r in got] == [("no mean pressure recorded", 1, 0, 1, 0), ("none", 2, 2, 2, 2), ("under 5 minutes", 0, 0, 0, 0), ("5 to 14 minutes", 1, 1, 1, 1), ("15 minutes or more", 0, 0, 0, 0)]


def test_lookups_share_their_first_joins(spark):
    frames = {
        "sheet": spark.createDataFrame([(1, 7, "s1"), (2, 8, "s2")], "sheet long, case_key long, label string"),
        "case": spark.createDataFrame([(7, 70), (8, 80)], "case_key long, visit long"),
        "visit": spark.createDataFrame([(70, "north")], "visit long, ward string"),
    }
    rows = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 9), ("r4", None)], "row string, sheet long")
    sheet, case, visit = ("sheet", (("sheet", "sheet"),)), ("case", (("case_key", "case_key"),)), ("visit", (("visit", "visit"),))
    found = looked_up(rows, frames, {"label": ([sheet], "label"), "visit": ([sheet, case], "visit"), "ward": ([sheet, case, visit], "ward")})
    assert sorted(map(tuple, found.collect())) == [("r1", 1, "s1", 70, "north"), ("r2", 2, "s2", 80, None), ("r3", 9, None, None, None), ("r4", None, None, None, None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 3
    assert looked_up(rows, frames, {"ward": ([sheet, case, visit], "ward")}, "inner").count() == 1
