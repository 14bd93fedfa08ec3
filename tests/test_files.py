"""Reading lists and dictionaries, publishing behind gates, gates and coverage on small frames, phrases in order."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline.plans import counts, matching, omop, quality
from tideline.sources import files


def test_episode_list_counts_bad_lines(spark, tmp_path):
    (tmp_path / "l.csv").write_text("patient_key,date\np1,2024-01-02\np2,nonsense\n,2024-01-03\np1,2024-01-02\n")
    good, bad = files.read_episode_list(spark, str(tmp_path / "l.csv"), pairs=True)
    assert [tuple(r) for r in good.collect()] == [("p1", date(2024, 1, 2))] and bad.first()["rejected"] == 2


def test_dictionary_headings(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("Table Name\tField\tType\tPK\tDefinition\nCASES\t\t\t\tAll cases\nCASES\tKEY\tint\tY\tIdentifier\n")
    rows = files.read_dictionary(spark, str(tmp_path / "d.tsv"), "\t")[0].collect()
    assert sorted((r["table"], r["column"] or "", r["description"], r["key"]) for r in rows) == [("CASES", "", "All cases", None), ("CASES", "KEY", "Identifier", True)]


DICTIONARY = (
    "Entity;Attribute-Name;Data Type;is_pk;Remarks\n"
    "Cases;;;;\"All; cases,\nby day\"\n"
    "CASES;Key;int;x;Identifier\n"
    "cases;KEY;bad-type!;;Second\n"
    "Cases;Day;date;n;\n"
    "9bad;Col;int;;left out\n"
    "Staff;Code;varchar(9);Y;" + "d" * 4100 + "\n"
    ";;;;no names\n"
)


def entries(df):
    return {(r["table"], r["column"]): (r["type"], r["description"], r["key"]) for r in df.collect()}


def test_dictionary_rules(spark, tmp_path):
    (tmp_path / "d.csv").write_text(DICTIONARY)
    got, left = files.read_dictionary(spark, str(tmp_path / "d.csv"))
    held = entries(got)
    assert held == {
        ("Cases", None): (None, "All; cases, by day", None),
        ("Cases", "KEY"): (None, "Second", None),
        ("Cases", "Day"): ("date", None, False),
        ("Staff", "Code"): ("varchar(9)", "d" * 4000, True),
    }
    assert left.first().asDict() == {"skipped": 1, "cut": 1}
    catalogue = spark.createDataFrame([("dbo_CASES", "x", "int"), ("cases", "key", "bigint"), ("STAFF", "other", "int")], "table string, column string, type string")
    kept, missing = files.in_catalogue(got, catalogue)
    assert entries(kept) == {("cases", None): (None, "All; cases, by day", None), ("cases", "key"): ("bigint", "Second", None)} and missing.first()["missing"] == 2


def test_dictionary_with_a_file_of_tables(spark, tmp_path):
    (tmp_path / "d.csv").write_text(DICTIONARY)
    (tmp_path / "t.csv").write_text("TABLE,PRIMARY KEY,COMMENT\ncases,\"day, key\",Told here\nSTAFF,code nowhere,People\nUNKNOWN,a,b\n")
    held = entries(files.read_dictionary(spark, str(tmp_path / "d.csv"), tables=str(tmp_path / "t.csv"))[0])
    assert held[("Cases", None)][1] == "Told here" and held[("Cases", "KEY")][2] is True and held[("Cases", "Day")][2] is True
    assert held[("Staff", None)] == (None, "People", None) and held[("Staff", "Code")][2] is True and len(held) == 5


def test_dictionary_is_refused(spark, tmp_path):
    (tmp_path / "d.csv").write_text("thing,part,about\nA,B,text\n")
    with pytest.raises(ValueError, match="the table and the column"):
        files.read_dictionary(spark, str(tmp_path / "d.csv"))
    with pytest.raises(ValueError, match="no heading nowhere"):
        files.read_dictionary(spark, str(tmp_path / "d.csv"), headings={"table": "nowhere"})
    with pytest.raises(ValueError, match="no field"):
        files.read_dictionary(spark, str(tmp_path / "d.csv"), headings={"size": "part"})
    got = files.read_dictionary(spark, str(tmp_path / "d.csv"), headings={"table": "Thing", "column": "part", "description": "ABOUT"})[0]
    assert entries(got) == {("A", "B"): (None, "text", None)}


def test_a_failed_gate_keeps_what_was_published(spark, tmp_path):
    root = str(tmp_path / "out")
    files.publish({"t": spark.range(3)}, {"none": spark.range(0)}, root)
    with pytest.raises(ValueError, match="bad"):
        files.publish({"t": spark.range(9)}, {"bad": spark.range(2)}, root)
    assert files.published(spark, root, "t").count() == 3
    files.publish({"t": spark.range(5)}, {}, root)
    assert files.published(spark, root, "t").count() == 5


def test_covers(spark):
    rows = [("a", date(2024, 1, 1), date(2024, 1, 5)), ("a", date(2024, 1, 6), date(2024, 1, 9)), ("b", date(2024, 1, 1), date(2024, 1, 5)), ("b", date(2024, 1, 7), date(2024, 1, 9)), ("c", date(2024, 1, 3), date(2024, 1, 9))]
    got = quality.covers(spark.createDataFrame(rows, "s string, x date, y date"), "s", "x", "y", F.lit("2024-01-02").cast("date"), F.lit("2024-01-08").cast("date"))
    assert {r["s"]: r["covered"] for r in got.collect()} == {"a": True, "b": False, "c": False}


def test_a_setting_of_several_rows_stops(spark):
    rows = spark.createDataFrame([("SITE_SETTING", "X", 1), ("SITE_SETTING", "X", 2)], "vocabulary string, code string, concept long")
    with pytest.raises(ValueError):
        omop.setting(rows, "SITE_SETTING", "X")
    assert omop.setting(rows, "SITE_SETTING", "Y") is None


def test_site_rows_win(spark):
    own = spark.createDataFrame([("v", "a", 1), ("v", "b", 2)], "vocabulary string, code string, concept long")
    site = spark.createDataFrame([("V", "a", 9)], own.schema)
    assert sorted(tuple(r) for r in omop.merged_map(own, site).collect()) == [("V", "a", 9), ("v", "b", 2)]


def test_cliffs_compare_at_the_bounds_of_flooring(spark):
    rows = spark.createDataFrame([(2020, 100, 90), (2021, 100, 40), (2022, 100, 80)], "year int, total long, n long")
    assert [r["year"] for r in counts.cliffs(rows, "total", ["n"], step=1).collect()] == [2021]
    assert counts.cliffs(rows, "total", ["n"], step=10).collect() == []


def test_words_and_order(spark):
    row = spark.range(1).select(matching.words(F.lit("The dates of Births and planned operations")).alias("t"), matching.words(F.lit("birth operation")).alias("q"), matching.words(F.lit("operation birth")).alias("r")).withColumns(
        {"yes": matching.in_order(F.col("q"), F.col("t")), "no": matching.in_order(F.col("r"), F.col("t"))}
    )
    got = row.first()
    assert got["t"] == ["date", "birth", "plan", "oper" + "ation"] and got["yes"] and not got["no"]


def test_proposed_rows(spark):
    concepts = spark.createDataFrame([(1, "Propofol", "Drug", "S", "Ingredient"), (2, "propofol old", "Drug", None, "Ingredient"), (3, "Twin", "Drug", "S", "Ingredient"), (4, "twin", "Drug", "S", "Ingredient")], "concept_id long, concept_name string, domain_id string, standard_concept string, concept_class_id string")
    synonyms = spark.createDataFrame([(2, "diprivan")], "concept_id long, synonym string")
    maps = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "concept_id long, target_id long")
    labels = spark.createDataFrame([("a", "PROPOFOL"), ("b", "Diprivan"), ("c", "Twin"), ("d", "nothing")], "code string, label string")
    good, rest = omop.proposed(labels, concepts, synonyms, maps, "Drug")
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1), ("b", 1)]
    assert {r["code"]: r["reason"] for r in rest.collect()} == {"c": "several targets", "d": "no concept has this name"}
