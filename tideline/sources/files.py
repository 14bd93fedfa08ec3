"""Reading source tables, vocabularies and lists, and writing results so that a half-written run is never read."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "decimal": T.DecimalType(18, 4)}


def schema_of(columns: Mapping[str, str]) -> T.StructType:
    return T.StructType([T.StructField(c, TYPES[k]) for c, k in columns.items()])


def read_table(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """A CSV table with a header and declared types; an empty cell is NULL. Types are never inferred."""
    return spark.read.schema(schema_of(columns)).option("header", True).option("nullValue", "").csv(path)


def read_vocabulary(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated vocabulary file without quotes, all text."""
    return spark.read.schema(schema_of(dict.fromkeys(columns, "string"))).option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_episode_list(spark: SparkSession, path: str, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """Episode keys, or (patient_key, date) pairs, and one row with the number of lines that cannot be used."""
    columns = {"patient_key": "string", "date": "string"} if pairs else {"anaesthetic_key": "string"}
    rows = read_table(spark, path, columns)
    if pairs:
        rows = rows.withColumn("date", F.col("date").try_cast("date"))
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return rows.where(good).distinct(), rows.agg(F.count_if(~good).alias("rejected"))


# Headings under which a dictionary's fields are known, how a key is flagged, the longest description, and what names and types look like
HEADINGS = {
    "table": ("TABLE_NAME", "TABLE", "TABLENAME", "TABLE_NM", "TAB_NAME", "ENTITY", "ENTITY_NAME", "OBJECT_NAME"),
    "column": ("COLUMN_NAME", "COLUMN", "COLUMNNAME", "COLUMN_NM", "COL_NAME", "FIELD", "FIELD_NAME", "ATTRIBUTE", "ATTRIBUTE_NAME", "ELEMENT_NAME"),
    "description": ("DESCRIPTION", "COLUMN_DESCRIPTION", "FIELD_DESCRIPTION", "TABLE_DESCRIPTION", "DESC", "DEFINITION", "BUSINESS_DEFINITION", "COMMENT", "COMMENTS", "REMARKS", "NOTES"),
    "type": ("DATA_TYPE", "DATATYPE", "TYPE", "COLUMN_TYPE", "SQL_TYPE", "TYPE_NAME", "FORMAT"),
    "key": ("IS_PRIMARY_KEY", "PRIMARY_KEY", "PRIMARY_KEY_FLAG", "IS_PK", "PK", "PK_FLAG", "KEY", "IS_KEY", "KEY_FLAG", "KEY_COLUMNS"),
}
YES = ("Y", "YES", "TRUE", "T", "1", "X", "PK", "PRIMARY", "PRIMARY KEY")
LONGEST_DESCRIPTION = 4000
PLAIN_NAME = r"^[A-Za-z_][A-Za-z0-9_$#@ ]{0,127}$"
PLAIN_TYPE = r"^[A-Za-z][A-Za-z0-9_ ()]{0,63}$"


def _fields(raw: DataFrame, wanted: tuple[str, ...], own: Mapping[str, str]) -> dict[str, Column]:
    """The trimmed cells of the wanted fields, '' where a heading or a cell is absent; headings are compared without case, spaces, hyphens or underscores at their ends."""
    plain = lambda h: re.sub(r"[^A-Z0-9]+", "_", h.upper()).strip("_")
    have: dict[str, str] = {}
    for c in raw.columns:
        have.setdefault(plain(c), c)
    out = {}
    for name in wanted:
        if name in own and plain(own[name]) not in have:
            raise ValueError(f"the dictionary has no heading {own[name]}, which was named for the {name}")
        hit = next((have[h] for h in ([plain(own[name])] if name in own else HEADINGS[name]) if h in have), None)
        out[name] = F.coalesce(F.trim(F.col("`" + hit.replace("`", "``") + "`")), F.lit("")) if hit else None
    return out


def _cells(spark: SparkSession, path: str, sep: str | None) -> DataFrame:
    """All cells as text under the headings of the first row; the separator that the first line has most often, unless it is named. Rows are numbered in `_row`."""
    if sep is None:
        line = spark.read.text(path).first()
        sep = max(("\t", ",", ";", "|"), key=line[0].count) if line and any(line[0].count(s) for s in "\t,;|") else ","
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[F.col("`" + c.replace("`", "``") + "`").alias(c.lstrip("\ufeff")) for c in raw.columns], F.monotonically_increasing_id().alias("_row"))


def read_dictionary(spark: SparkSession, path: str, sep: str | None = None, tables: str | None = None, headings: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A vendor's data dictionary: table, column, type, description, key (NULL: not said), and one row of skipped and cut.

    Fields are found under any of the known headings, or under the caller's own; without one for tables and one for columns the file is refused. A row without a column
    describes its table. Names are the same in any case and keep the spelling of their table's first row; of several rows of a column the last counts. Rows whose table or
    column is no plain name are left out and counted in skipped; descriptions lose control characters, and longer ones than 4,000 characters are cut and counted. A second
    file of tables may give the tables' descriptions and, as a list of columns, their keys, which then rule over the flags; a key that names an unknown column is not used.
    """
    own = dict(headings or {})
    if unknown := own.keys() - HEADINGS.keys():
        raise ValueError(f"no field of a dictionary: {', '.join(sorted(unknown))}")
    raw = _cells(spark, path, sep)
    f = _fields(raw.drop("_row"), tuple(HEADINGS), own)
    if lacking := [n for n in ("table", "column") if f[n] is None]:
        raise ValueError(f"no heading for the {' and the '.join(lacking)}")
    empty = F.lit("")
    rows = raw.select("_row", *[(empty if c is None else c).alias(n) for n, c in f.items()]).where("table <> '' OR column <> ''")
    named = F.col("table").rlike(PLAIN_NAME) & ((F.col("column") == "") | F.col("column").rlike(PLAIN_NAME))
    text = F.trim(F.regexp_replace("description", r"\s+", " "))
    left = rows.agg(F.count_if(~named).alias("skipped"), F.count_if(named & (F.length(text) > LONGEST_DESCRIPTION)).alias("cut"))
    good = rows.where(named).withColumns({"_t": F.upper("table"), "_c": F.upper("column"), "description": _described("description")})
    spelling = good.groupBy("_t").agg(F.min_by("table", "_row").alias("table"))
    flag = F.when(F.col("key") != "", F.upper("key").isin(*YES))
    kind = F.when(F.col("type").rlike(PLAIN_TYPE), F.col("type"))
    last = good.select("_t", "_c", "_row", F.struct(F.when(F.col("column") != "", F.col("column")).alias("column"), kind.alias("type"), F.col("description"), flag.alias("key")).alias("e"))
    entries = last.groupBy("_t", "_c").agg(F.max_by("e", "_row").alias("e")).select("_t", "_c", "e.*")
    if tables is not None:
        entries = _with_tables(entries, _cells(spark, tables, None), own)
    out = entries.join(spelling, "_t")
    return out.select("table", "column", F.when(F.col("column").isNotNull(), F.col("type")).alias("type"), "description", F.when(F.col("column").isNotNull(), F.col("key")).alias("key")), left


def _described(name: str) -> Column:
    """Text without control characters and runs of spaces, cut; NULL if nothing is left."""
    text = F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r"[\x00-\x08\x0b-\x1f\x7f]", " "), r"\s+", " ")), 1, LONGEST_DESCRIPTION)
    return F.when(text != "", text)


def _with_tables(entries: DataFrame, raw: DataFrame, own: Mapping[str, str]) -> DataFrame:
    """Entries with the descriptions and keys of a file of tables; tables that have no entry are passed over."""
    f = _fields(raw.drop("_row"), ("table", "description", "key"), {k: v for k, v in own.items() if k == "table"})
    if f["table"] is None:
        raise ValueError("no heading for the table in the file of tables")
    told = f["description"] is not None
    rows = raw.select("_row", *[(F.lit("") if c is None else c).alias(n) for n, c in f.items()]).where(F.col("table").rlike(PLAIN_NAME))
    parts = F.filter(F.split(F.upper("key"), r"[\s,;]+"), lambda p: p != "")
    rows = rows.select(F.upper("table").alias("_t"), "_row", _described("description").alias("_d"), parts.alias("_parts"))
    known = entries.where("_c <> ''").groupBy("_t").agg(F.collect_set("_c").alias("_known"))
    usable = F.when((F.size("_parts") > 0) & (F.size(F.array_except("_parts", F.coalesce("_known", F.array().cast("array<string>")))) == 0), F.col("_parts"))
    found = rows.join(known, "_t", "left").groupBy("_t").agg(F.max_by(F.struct("_d"), "_row")["_d"].alias("_d"), F.max_by(usable, F.when(usable.isNotNull(), F.col("_row"))).alias("_key"))
    here = entries.join(found.withColumn("_in", F.lit(True)), "_t", "left")
    key = F.when(F.col("_key").isNotNull(), F.array_contains("_key", F.col("_c"))).otherwise(F.col("key"))
    described = F.when((F.col("_c") == "") & F.col("_in") & F.lit(told), F.col("_d")).otherwise(F.col("description"))
    same = here.select("_t", "_c", "column", "type", described.alias("description"), key.alias("key"))
    if not told:
        return same
    bare = found.where("_d IS NOT NULL").join(entries.select("_t").distinct(), "_t", "left_semi").join(entries.where("_c = ''").select("_t"), "_t", "left_anti")
    none = F.lit(None).cast("string")
    return same.unionByName(bare.select("_t", F.lit("").alias("_c"), none.alias("column"), none.alias("type"), F.col("_d").alias("description"), F.lit(None).cast("boolean").alias("key")))


def in_catalogue(entries: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of tables and columns that catalogue(table, column, type) holds, in its spelling and with its type where the dictionary has none, and one row: missing, the columns it does not hold."""
    c = catalogue.select(F.upper("table").alias("_t"), F.upper("column").alias("_c"), F.col("table").alias("c_table"), F.col("column").alias("c_column"), F.col("type").alias("c_type")).distinct()
    whole = c.groupBy("_t").agg(F.min("c_table").alias("c_table")).select("_t", F.lit("").alias("_c"), "c_table", F.lit(None).cast("string").alias("c_column"), F.lit(None).cast("string").alias("c_type"))
    rows = entries.withColumns({"_t": F.upper("table"), "_c": F.coalesce(F.upper("column"), F.lit(""))}).join(c.unionByName(whole), ["_t", "_c"], "left")
    kept = rows.where("c_table IS NOT NULL").select(F.col("c_table").alias("table"), F.col("c_column").alias("column"), F.coalesce("type", "c_type").alias("type"), "description", "key")
    return kept, rows.agg(F.count_if(F.col("c_table").isNull() & F.col("column").isNotNull()).alias("missing"))


def write_ordered(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in published order, sorted by the first."""
    df.select(*columns).sort(columns[0]).write.parquet(path)


def write_sections(sections: Mapping[str, DataFrame], public: str, private: str, keep: tuple[str, ...] = ("episode_key",)) -> None:
    """One folder for each section; those in `keep` go to the private path and never leave."""
    for name, df in sections.items():
        df.write.parquet(f"{private if name in keep else public}/{name}")


def _file(spark: SparkSession, path: str):
    """The store of a path and the path in it, as Hadoop's objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless one is there; whether it was written. Of several writers one succeeds, and no reader sees a part of a local file.

    On a local or mounted folder a finished file is linked to its name, which fails if the name exists; elsewhere the store's create without overwriting decides.
    """
    fs, p = _file(spark, path)
    if fs.getUri().getScheme() == "file":
        to = p.toUri().getPath()
        os.makedirs(os.path.dirname(to), exist_ok=True)
        draft = f"{to}.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, to)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    try:
        out = fs.create(p, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def commits(spark: SparkSession, root: str) -> list[tuple[int, dict]]:
    """Numbers and records of what was published, oldest first. A record that its writer did not finish counts as absent."""
    fs, folder = _file(spark, f"{root}/commits")
    if not fs.exists(folder):
        return []
    out = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if re.fullmatch(r"\d{12}", name):
            stream = fs.open(status.getPath())
            try:
                record = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue
            finally:
                stream.close()
            out.append((int(name), record))
    return sorted(out, key=lambda c: c[0])


def publish(tables: Mapping[str, DataFrame], gates: Mapping[str, DataFrame], root: str, show: int = 50, base: int | None = None) -> str:
    """Write tables into a new version, run the gates, and only then commit it; a gate with rows stops, and what was published before stays.

    Commits are numbered files that are created only if absent: of two writers that want a number one gets it, and the other takes the next, so that the highest number
    is what was published last, whatever the clocks say. With `base`, the number that the tables were made from, a writer whom another one has overtaken is refused.
    """
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    failed = {name: rows for name, df in gates.items() if (rows := df.limit(show).collect())}
    if failed:
        raise ValueError("gates with rows: " + ", ".join(f"{n} ({len(r)}{'+' if len(r) == show else ''})" for n, r in failed.items()))
    fs, folder = _file(spark, f"{root}/commits")
    fs.mkdirs(folder)
    record = json.dumps({"version": version, "tables": sorted(tables)})
    taken = [int(s.getPath().getName()) for s in fs.listStatus(folder) if re.fullmatch(r"\d{12}", s.getPath().getName())]
    number = base + 1 if base is not None else max(taken, default=0) + 1
    while not created(spark, f"{root}/commits/{number:012d}", record):
        if base is not None:
            raise ValueError(f"another version was published after number {base}")
        number += 1
    return version


def newest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and record of what was published last."""
    found = commits(spark, root)
    if not found:
        raise ValueError(f"nothing is published under {root}")
    return found[-1]


def published(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table of the version that was published last, or of an earlier number."""
    record = newest(spark, root)[1] if number is None else dict(commits(spark, root))[number]
    return spark.read.parquet(f"{root}/versions/{record['version']}/{name}")


def recovered(spark: SparkSession, root: str, older_hours: float = 24) -> list[str]:
    """Remove versions that no commit names and that were begun so many hours ago, such as those of writers that died; their names."""
    fs, folder = _file(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    kept = {record["version"] for _, record in commits(spark, root)}
    before = (time.time() - 3600 * older_hours) * 1000
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in kept and s.getModificationTime() <= before]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value: the lines of a text file, or of each of several, with their numbers from 1.

    A file is read in splits; each knows its place by its first byte, and counts of lines by split, a row each, give its first number. Lines themselves are not shuffled.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a split's ids follow each other
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("file", "_start", "_first", before.alias("_before")), ["file", "_start"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


# Headers of the two forms of a list, the longest key, and the most episodes of a list
HEADERS = {"anaesthetic_keys": "anaesthetic_key", "pairs": "patient_key,date"}
LONGEST_KEY, MOST_EPISODES = 64, 5000


def read_chosen(spark: SparkSession, path: str, form: str = "anaesthetic_keys", most: int | None = MOST_EPISODES) -> DataFrame:
    """The rows of a private list of episodes, as often as they stand there: anaesthetic_key, or patient_key and date.

    A list with another header or form, without a row, with more than `most` rows, or with a line that is no key of printable characters, or no key and date, is refused; the error names
    the file and the line, and no value. Blank lines are passed over but counted. The file is read twice, to judge and to use it, and never gathered.
    """
    name, wanted = path.rsplit("/", 1)[-1], HEADERS[form]
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value").rlike("[^,\\s]"))
    first = lines.orderBy("line").limit(1).collect()
    held = re.sub(r"\s*,\s*", ",", first[0]["value"].strip().lower()) if first else None
    if held is None:
        raise ValueError(f"{name} is empty")
    if held != wanted:
        other = next((f for f, h in HEADERS.items() if h == held), None)
        raise ValueError(f"{name} holds {other}, not {form}" if other else f"{name}, line {first[0]['line']}: the header must be {wanted}")
    cells = F.from_csv(F.col("value"), "a string, b string, c string")
    rows = lines.where(F.col("line") > first[0]["line"]).select("line", cells.alias("c")).select("line", *[F.trim(f"c.{c}").alias(c) for c in "abc"])
    key = F.coalesce((F.length("a") <= LONGEST_KEY) & F.col("a").rlike("^[\\x20-\\x7e]+$"), F.lit(False)) & F.col("c").isNull()
    if form == "anaesthetic_keys":
        good, what, out = key & F.col("b").isNull(), "one key", [F.col("a").alias("anaesthetic_key")]
    else:
        day = F.when(F.col("b").rlike("^\\d{4}-\\d\\d-\\d\\d$"), F.col("b").try_cast("date"))
        good, what, out = key & day.isNotNull(), "a patient's key and a date written as YYYY-MM-DD", [F.col("a").alias("patient_key"), day.alias("date")]
    seen = rows.agg(F.min(F.when(~good, F.col("line"))).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if seen["bad"] is not None:
        raise ValueError(f"{name}, line {seen['bad']}: not {what}")
    if not seen["n"]:
        raise ValueError(f"{name} is empty")
    if most is not None and seen["n"] > most:
        raise ValueError(f"{name} has {seen['n']} rows; at most {most} may be asked for")
    return rows.select(*out)
