"""Profiles of source tables, with counts floored to ten and small groups left out."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.time import minutes_between
from tideline.plans.counts import band_of
from tideline.plans.disclosure import floored

# Bands of minutes and of rows for a key, as labels of the results
SPAN_BANDS = (
    (0, "less than zero minutes"), (15, "under 15 minutes"), (30, "15 to 29 minutes"), (60, "30 to 59 minutes"), (120, "60 to 119 minutes"), (240, "120 to 239 minutes"),
    (480, "240 to 479 minutes"), (1440, "8 to 23 hours"), (4320, "1 to 2 days"), (10080, "3 to 6 days"),
)
FANOUT_BANDS = ((2, "1 row"), (3, "2 rows"), (6, "3 to 5 rows"), (11, "6 to 10 rows"))


def row_count(df: DataFrame, step: int = 10) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg((n - n % step).alias("rows"))


def columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """column, rows, distinct_count, null_count, is_unique: of all columns in one pass.

    Rows become (column, 128-bit digest of the value), counted by both and then by column: memory is bounded by spilling, whatever the number of columns or values.
    """
    value = lambda n: F.col(n) + F.lit(0.0) if dict(df.dtypes)[n] in ("double", "float") else F.col(n)  # noqa: E731  one zero
    digest = lambda n: F.when(F.col(n).isNotNull(), F.struct(F.xxhash64(value(n)).alias("h"), F.xxhash64(F.lit(1), value(n)).alias("g")))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), digest(n).alias("v")) for i, n in enumerate(names)]))
    each = df.select(cells.alias("c")).select("c.i", "c.v.h", "c.v.g").groupBy("i", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    sums = each.groupBy("i").agg(F.sum("n").alias("rows"), F.count("h").alias("distinct_count"), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("null_count"))
    listed = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, column string")
    out = listed.join(sums, "i", "left").fillna(0, ["rows", "distinct_count", "null_count"])  # an empty table has no sums
    held, d = F.col("rows") - F.col("null_count"), F.col("distinct_count")
    return out.select("column", "rows", "distinct_count", "null_count", F.when((held == d) & (d > 0), 1).otherwise(0).alias("is_unique"))


def years(df: DataFrame, column: str) -> DataFrame:
    g = df.where(F.col(column).isNotNull()).groupBy(F.year(column).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    return floored(g, "rows")


def values(df: DataFrame, column: str, labels: DataFrame | None = None, most_distinct: int = 200, defining: bool = False) -> DataFrame | None:
    """value, label, rows, floored; None if the column has more than most_distinct values, or 5,000 for the key of a table of definitions. labels: (code, label)."""
    most_distinct = 5000 if defining else most_distinct
    if df.select(column).distinct().limit(most_distinct + 1).count() > most_distinct:
        return None
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    named = g.join(labels.select(F.col("code").cast("string").alias("value"), "label"), "value", "left") if labels is not None else g.withColumn("label", F.lit(None).cast("string"))
    return floored(named, "rows")


def spans(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows by minutes from start to end in eleven bands."""
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    g = rows.groupBy(band_of(minutes_between(F.col(start), F.col(end)), SPAN_BANDS, "a week or more").alias("band")).agg(F.count(F.lit(1)).alias("rows"))
    return floored(g, "rows")


def fanout(df: DataFrame, key: str) -> DataFrame:
    """Key values by the number of rows that hold each; no key is returned."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    g = per_key.groupBy(band_of(F.col("n"), FANOUT_BANDS, "11 or more rows").alias("band")).agg(F.count(F.lit(1)).alias("keys"))
    return floored(g, "keys")


def charted(rows: DataFrame, code: str, episode: str, labels: DataFrame) -> DataFrame:
    """Codes with a label, rows and distinct episodes, floored. labels: (code, label), one row for each code."""
    g = rows.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(episode).alias("episodes"))
    return floored(g.join(labels, "code", "left"), "rows", ["episodes"])


def top_values(df: DataFrame, column: str, n: int = 50) -> DataFrame:
    """The n most frequent values, most frequent first, ties by value; floored afterwards."""
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return floored(g.orderBy(F.desc("rows"), "value").limit(n), "rows")


def link_probe(cohort: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Cohort rows with and without a partner."""
    hit = cohort.join(target.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.agg(F.count_if(F.col("_hit").isNotNull()).alias("with_match"), F.count_if(F.col("_hit").isNull()).alias("without_match"))


def filter_probe(df: DataFrame, condition: Column) -> DataFrame:
    """Rows read and rows that pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(condition).alias("passing"))


def flag_probe(df: DataFrame, flag: str) -> DataFrame:
    f = F.col(flag)
    return df.agg(F.count_if(f == 1).alias("ones"), F.count_if(f == 0).alias("zeros"), F.count_if(f.isNull()).alias("empty"))


def sampled(df: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    """About that share of the rows; see `scaled` for counts of it."""
    return df.sample(fraction=percent / 100, seed=seed)


def scaled(counts: DataFrame, figures: Sequence[str], percent: float) -> DataFrame:
    """Counts of a sample as those of the whole, to whole rows."""
    return counts.withColumns({c: F.round(F.col(c) * (100 / percent), 0).cast("long") for c in figures})


@dataclass(frozen=True)
class BlockSample:
    """A sample of a table's files: their rows, the blocks that there are and that are read, and the part of a path that names a file's block."""

    rows: DataFrame
    blocks: int
    read: int
    pattern: str = "[^/]*$"


def block_sampled(df: DataFrame, percent: float, seed: int = 1, pattern: str = "[^/]*$") -> BlockSample:
    """Whole blocks of a table that was read from Parquet files, each chosen by a digest of its name and the seed; one at least. Files of the others are not opened.

    A block is the files with the same part of their path by `pattern`, each file alone by default. Only names of files, which the driver lists for any read, are looked at.
    """
    from hashlib import md5

    files: dict[str, list[str]] = {}
    for f in df.inputFiles():
        files.setdefault(re.search(pattern, f)[0], []).append(f)
    share = lambda n: int(md5(f"{seed}:{n}".encode()).hexdigest()[:8], 16) / (1 << 32)
    chosen = [n for n in sorted(files) if share(n) < percent / 100] or sorted(files, key=share)[:1]
    if not chosen:
        return BlockSample(df, 0, 0, pattern)
    rows = df.sparkSession.read.schema(df.schema).format("parquet").load([f for n in chosen for f in sorted(files[n])])
    return BlockSample(rows, len(files), len(chosen), pattern)


def estimated(sample: BlockSample, conditions: Mapping[str, Column]) -> DataFrame:
    """figure, estimate, standard_error: of the rows that meet each condition in the whole table, from their counts in the sample's files.

    A block is a cluster: the error is that of the mean over blocks without replacement; none for a sample of all blocks, NULL for one block of several.
    """
    n, blocks = sample.read, sample.blocks
    by_block = sample.rows.groupBy(F.regexp_extract(F.input_file_name(), sample.pattern, 0).alias("_f")).agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).alias("x")) for k in conditions]))
    sums = by_block.select(cells.alias("c")).groupBy("c.figure").agg(F.sum("c.x").cast("double").alias("s"), F.sum(F.col("c.x").cast("double") * F.col("c.x")).alias("q"))
    listed = sample.rows.sparkSession.createDataFrame([(k,) for k in conditions], "figure string").join(sums, "figure", "left").fillna(0.0, ["s", "q"])  # blocks without rows give none
    variance = F.greatest((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1), F.lit(0.0)) if n > 1 else F.lit(None).cast("double")
    error = F.lit(0.0) if n == blocks else blocks * F.sqrt((1 - n / blocks) * variance / n)
    return listed.select("figure", (F.col("s") * (blocks / n if n else 0)).alias("estimate"), error.alias("standard_error"))
