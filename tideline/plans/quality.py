"""Gates and tests on tables: a gate is a DataFrame of offending rows and passes if it is empty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.sources.staging import staged


def repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


@dataclass(frozen=True)
class Field:
    name: str
    required: bool = False
    width: int | None = None


def field_problems(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """field, empty, too_long: of all fields in one pass; unpivoted from one row."""
    cells = []
    for f in fields:
        c = F.col(f.name)
        cells.append((F.count_if(c.isNull()) if f.required else F.lit(0)).cast("long").alias(f"e_{f.name}"))
        cells.append((F.count_if(F.length(c.cast("string")) > f.width) if f.width else F.lit(0)).cast("long").alias(f"l_{f.name}"))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *cells)
    rows = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"e_{f.name}").alias("empty"), F.col(f"l_{f.name}").alias("too_long")) for f in fields])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def conform(df: DataFrame, schema: T.StructType, flags: Sequence[str] = ()) -> DataFrame:
    """df if it has exactly the schema's columns in order and type; flags that are neither 0 nor 1 make rows fail when read."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if have != want:
        raise ValueError(f"columns are {have}, not {want}")
    bad = lambda c: F.col(c).isNull() | ~F.col(c).isin(0, 1)
    return df.withColumns({c: F.when(bad(c), F.raise_error(F.lit(f"{c} is no flag")).cast("int")).otherwise(F.col(c)) for c in flags}) if flags else df


def view_problems(df: DataFrame, key: str, flags: Sequence[str] = (), links: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """problem, rows: repeated keys, flags that are empty, links that are not found."""
    n = F.count(F.lit(1)).cast("long").alias("rows")
    out = repeated(df, [key]).agg(F.lit("key repeated").alias("problem"), n)
    for c in flags:
        out = out.unionByName(df.where(F.col(c).isNull()).agg(F.lit(f"{c} empty").alias("problem"), n))
    for c, target in (links or {}).items():
        out = out.unionByName(df.where(F.col(c).isNotNull()).join(target.select(c).distinct(), c, "left_anti").agg(F.lit(f"{c} not found").alias("problem"), n))
    return out


def outside_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Values that the vocabulary lacks, with their rows."""
    known = vocabulary.select(F.col(vocabulary.columns[0]).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows")).join(known, column, "left_anti")


def concept_problems(used: DataFrame, concepts: DataFrame) -> DataFrame:
    """used(field, domain, concept_id) against concepts(concept_id, domain_id, standard_concept): field, concept_id, rows, problem. Concept 0 is reported as unmapped."""
    n = used.groupBy("field", "domain", "concept_id").agg(F.count(F.lit(1)).alias("rows"))
    c = n.join(concepts.select("concept_id", "domain_id", "standard_concept", F.lit(1).alias("known")), "concept_id", "left")
    problem = (
        F.when(F.col("concept_id") == 0, "unmapped")
        .when(F.col("known").isNull(), "not in the vocabulary")
        .when(F.coalesce("standard_concept", F.lit("")) != "S", "not standard")
        .when(F.col("domain").isNotNull() & (F.col("domain") != F.col("domain_id")), "of another domain")
    )
    return c.withColumn("problem", problem).where("problem IS NOT NULL").select("field", "concept_id", "rows", "problem")


def missing_links(df: DataFrame, column: str, target: DataFrame, target_column: str, optional: bool = True) -> DataFrame:
    """Rows whose link points at nothing; an empty optional link is no problem."""
    keys = target.select(F.col(target_column).alias(column)).where(F.col(column).isNotNull()).distinct()
    rows = df.where(F.col(column).isNotNull()) if optional else df
    return rows.join(keys, column, "left_anti")


def outside_period(events: DataFrame, periods: DataFrame, subject: str, day: str, start: str, end: str) -> DataFrame:
    """Events on no day of any period of their subject."""
    p = periods.select(F.col(subject).alias("_s"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    return events.join(p, (F.col(subject) == F.col("_s")) & (F.col(day) >= F.col("_a")) & (F.col(day) <= F.col("_b")), "left_anti")


def too_few(written: DataFrame, sources: DataFrame, share: float = 0.9) -> DataFrame:
    """One row with both counts if fewer than `share` of the sources were written, or none."""
    w = written.agg(F.count(F.lit(1)).alias("written"))
    return w.crossJoin(sources.agg(F.count(F.lit(1)).alias("sources"))).where((F.col("written") == 0) | (F.col("written") < share * F.col("sources")))


def not_exactly_one(parents: DataFrame, children: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """Parents with no child row, or several, that meets the condition."""
    own = children.where(condition) if condition is not None else children
    n = own.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return parents.select(key).distinct().join(n, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0))).where("rows <> 1")


def canonical(df: DataFrame) -> DataFrame:
    """All columns as texts that compare across engines: NULL as a word, numbers to six decimals, times without trailing zeros, text trimmed."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.FractionalType):
            written = F.regexp_replace(F.round(c, 6).try_cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
            t = F.coalesce(written, c.cast("string"))  # NaN, infinities and numbers beyond that width are written as they are
        elif isinstance(f.dataType, T.NumericType):
            t = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            t = F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"(\.[0-9]*?)0+$", "$1")
            t = F.rtrim(t, F.lit("."))
        else:
            t = F.trim(c.cast("string"))
        out.append(F.coalesce(t, F.lit("NULL")).alias(f.name))
    return df.select(*out)


def differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of one side alone, as canonical texts, with `side`; repeated rows count."""
    a, b = canonical(found), canonical(expected.select(*found.columns))
    return a.exceptAll(b).withColumn("side", F.lit("unexpected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def same_value(found: Column, expected: Column, number: bool, tolerance: float = 1e-6) -> Column:
    """Whether two values agree: numbers to `tolerance` of the expected one or of 1, if that is more; NULL with NULL alone, NaN with NaN."""
    if not number:
        return found.cast("string").eqNullSafe(expected.cast("string"))
    a, b = found.try_cast("double"), expected.cast("double")
    close = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b))
    return F.when(expected.isNull() | found.isNull(), expected.isNull() & found.isNull()).otherwise(F.coalesce(a.eqNullSafe(b) | close, F.lit(False)))


def unlike(found: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, columns: rows of expected that found lacks (columns NULL), has in excess, or holds with other values, numbers within a relative tolerance."""
    rest = [f for f in expected.schema.fields if f.name not in key]
    a = found.select(*key, F.struct(*[F.col(f.name) for f in rest]).alias("_a"), F.lit(True).alias("_in_a"))
    b = expected.select(*key, F.struct(*[F.col(f.name) for f in rest]).alias("_b"), F.lit(True).alias("_in_b"))
    joined = a.join(b, list(key), "full")
    wrong = F.array_compact(F.array(*[F.when(~same_value(F.col("_a")[f.name], F.col("_b")[f.name], isinstance(f.dataType, T.NumericType)), F.lit(f.name)) for f in rest]))
    out = joined.withColumn("columns", F.when(F.col("_in_a") & F.col("_in_b"), wrong))
    return out.where("columns IS NULL OR size(columns) > 0").select(*key, "columns")


def _scaled(x: Column) -> Column:
    """Values in which the relative tolerance beyond 1 is about an absolute one: x up to 1, and 1 + ln x beyond."""
    return F.when(F.abs(x) <= 1, x).otherwise(F.signum(x) * (1 + F.log(F.abs(x))))


def unmatched(found: DataFrame, expected: DataFrame, tolerance: float = 1e-6, by: int = 3) -> DataFrame:
    """The rows of either side that have no partner on the other, with `side` and `n`; no key is needed, and repeated rows count.

    Rows are partners if their numbers agree as in `same_value` and all other values are equal, NULL with NULL. Equal rows are paired first. What is left, distinct rows
    with their counts, meets by the cells of a grid over its first `by` numbers and the neighbouring cells; the nearest partners are paired, then the nearest of the rest, ties by the
    rows' texts, until none is near. Each round pairs at least the nearest, and every row with its own nearest at once, so that rounds are few.
    """
    names = found.columns
    kinds = dict(expected.dtypes)
    numbers = [c for c in names if isinstance(expected.schema[c].dataType, T.NumericType)]
    both = []
    for df in (found, expected):
        rows = df.select(*[F.col(c).cast("double" if c in numbers else kinds[c]).alias(c) for c in names])
        both.append(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in names]), {"ignoreNullFields": "false"})))
    a, b = both
    j = a.select("row", F.col("n").alias("_a")).join(b.select("row", F.col("n").alias("_b")), "row", "full")
    left = staged(j.select("row", (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("d")).where("d <> 0"), "left")
    sides = [a.drop("n").join(left.where("d > 0"), "row").withColumnRenamed("d", "n"), b.drop("n").join(left.where("d < 0"), "row").withColumn("n", -F.col("d")).drop("d")]

    width, gridded = 2 * tolerance, numbers[:by]

    def placed(df: DataFrame, near: bool) -> DataFrame:
        for i, c in enumerate(gridded):
            cell = F.floor(_scaled(F.col(c)) / width)
            cell = F.when(F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(cell - 1, cell + 1) if near else F.array(cell))
            df = df.withColumn(f"_g{i}", F.explode(cell))
        return df

    x, y = placed(sides[0], True), placed(sides[1], False)
    x = x.select(F.col("row").alias("a"), F.struct(*names).alias("_x"), *[F.col(f"_g{i}").alias(f"_x{i}") for i in range(len(gridded))], *[F.col(c).cast("string").alias(f"_t{i}") for i, c in enumerate(names) if c not in numbers])
    y = y.select(F.col("row").alias("b"), F.struct(*names).alias("_y"), *[F.col(f"_g{i}").alias(f"_y{i}") for i in range(len(gridded))], *[F.col(c).cast("string").alias(f"_u{i}") for i, c in enumerate(names) if c not in numbers])
    on, close, apart = F.lit(True), F.lit(True), F.lit(0.0)
    for i in range(len(gridded)):
        on = on & F.col(f"_x{i}").eqNullSafe(F.col(f"_y{i}"))
    for i, c in enumerate(names):
        if c in numbers:
            close = close & same_value(F.col("_x")[c], F.col("_y")[c], True, tolerance)
            apart = apart + F.coalesce(F.nanvl(F.abs(F.col("_x")[c] - F.col("_y")[c]), F.lit(0.0)), F.lit(0.0))
        else:
            on = on & F.col(f"_t{i}").eqNullSafe(F.col(f"_u{i}"))
    pairs = staged(x.join(y, on).where(close).select("a", "b", apart.alias("apart")).distinct(), "pairs")
    counts = [staged(s.select("row", "n"), "counts") for s in sides]
    while True:
        live = pairs.join(counts[0].withColumnsRenamed({"row": "a", "n": "na"}), "a").join(counts[1].withColumnsRenamed({"row": "b", "n": "nb"}), "b")
        ranked = live.withColumns({p: F.row_number().over(Window.partitionBy(p[1]).orderBy("apart", "a", "b")) for p in ("_a", "_b")})
        taken = staged(ranked.where("_a = 1 AND _b = 1").select("a", "b", F.least("na", "nb").alias("n")), "taken")
        if not taken.limit(1).count():
            break
        counts = [staged(c.join(taken.select(F.col(k).alias("row"), F.col("n").alias("_n")), "row", "left").select("row", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n")).where("n > 0"), "counts") for c, k in zip(counts, ("a", "b"), strict=True)]
    out = [s.drop("n").join(c, "row").select(*names, F.lit(side).alias("side"), "n") for s, c, side in zip(sides, counts, ("unexpected", "missing"), strict=True)]
    return out[0].unionByName(out[1])


@dataclass(frozen=True)
class Stage:
    """One step of a waterfall: a join that must find a partner, or a condition; a name to charge the loss to."""

    name: str
    condition: Column | None = None
    partner: DataFrame | None = None
    on: tuple[str, str] | None = None


def survived(source: DataFrame, key: str, stages: Sequence[Stage]) -> DataFrame:
    """key, reached, targets: how many stages in a row each source row meets at best, and how many of its joined rows meet all of them.

    One join chain of left joins, so that no row goes early; a joined row carries the number of stages it meets in a row, and a key its largest. Rows without a key are not followed.
    """
    rows, met = source, []
    for i, s in enumerate(stages):
        holds = F.lit(True)
        if s.partner is not None:
            left, right = s.on
            partner = s.partner.withColumn(f"_m{i}", F.lit(True)).withColumnRenamed(right, f"_k{i}") if right in rows.columns else s.partner.withColumn(f"_m{i}", F.lit(True))
            rows = rows.join(partner, F.col(left) == F.col(f"_k{i}" if right in rows.columns else right), "left")
            holds = holds & F.col(f"_m{i}").isNotNull()
        if s.condition is not None:
            holds = holds & F.coalesce(s.condition, F.lit(False))
        met.append(holds)
    depth = F.lit(len(stages))
    for i in reversed(range(len(stages))):
        depth = F.when(met[i], depth).otherwise(F.lit(i))
    each = rows.where(F.col(key).isNotNull()).select(F.col(key), depth.alias("_depth"))
    return each.groupBy(key).agg(F.max("_depth").alias("reached"), F.count_if(F.col("_depth") == len(stages)).alias("targets"))


def waterfall(source: DataFrame, key: str, stages: Sequence[Stage]) -> DataFrame:
    """stage, kept, lost: distinct source rows left after each stage, all counted in one pass over one join chain."""
    one = survived(source, key, stages).agg(*[F.count_if(F.col("reached") >= i).alias(f"c{i}") for i in range(len(stages) + 1)])
    names = ["source", *[s.name for s in stages]]
    cells = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("stage"), F.col(f"c{i}").alias("kept"), (F.col(f"c{max(0, i - 1)}") - F.col(f"c{i}")).alias("lost")) for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def traced(source: DataFrame, key: str, stages: Sequence[Stage], written: DataFrame | int) -> DataFrame:
    """One row: source_rows, followed, reached, left_out, target_rows, several, extra, start_agrees, sums_agree, matches_the_run.

    several is the number of source rows with more than one target row, and extra what they have beyond one. The start agrees if the key tells all source rows apart,
    the sums if those that reached the target and those that each stage left out make up the source, and the run if it wrote as many rows (`written`, a table or its count).
    """
    n = len(stages)
    per = survived(source, key, stages)
    lost = [F.count_if(F.col("reached") == i) for i in range(n)]
    whole = F.col("reached") == n
    one = per.agg(
        F.count(F.lit(1)).alias("followed"), F.count_if(whole).alias("reached"), sum(lost, F.lit(0)).alias("_lost"), F.coalesce(F.sum("targets"), F.lit(0)).alias("target_rows"),
        F.count_if(F.col("targets") > 1).alias("several"), F.coalesce(F.sum(F.greatest(F.col("targets") - 1, F.lit(0))), F.lit(0)).alias("extra"),
    )
    held = written.agg(F.count(F.lit(1)).alias("_written")) if isinstance(written, DataFrame) else source.sparkSession.range(1).select(F.lit(written).alias("_written"))
    one = one.crossJoin(source.agg(F.count(F.lit(1)).alias("source_rows"))).crossJoin(held)  # a row each
    return one.select(
        "source_rows", "followed", "reached", (F.col("source_rows") - F.col("reached")).alias("left_out"), "target_rows", "several", "extra", (F.col("followed") == F.col("source_rows")).alias("start_agrees"),
        (F.col("source_rows") == F.col("reached") + F.col("_lost") + (F.col("source_rows") - F.col("followed"))).alias("sums_agree"), (F.col("target_rows") == F.col("_written")).alias("matches_the_run"),
    )


def accounted(traces: DataFrame, written: DataFrame, held: DataFrame) -> DataFrame:
    """step, outcome, reason for every traced step and written table: 'accounted', 'fan-out confirmed' or 'unexplained'.

    traces: rows of `traced` with step, target and may_repeat, which says whether several target rows may come from one source row (NULL: nobody said).
    written(step, target, rows) of all steps, and held(target, rows) of the tables afterwards, must agree by table.
    """
    say = lambda bad, text: F.when(bad, F.lit(text))
    some = F.col("several") > 0
    reason = F.concat_ws(
        "; ", say(~F.col("start_agrees"), "not every source row was followed"), say(~F.col("sums_agree"), "the rows left out and reached do not add up"), say(~F.col("matches_the_run"), "the run wrote another number of rows"),
        say(some & F.col("may_repeat").isNull(), "several target rows, and nothing says whether they may"), say(some & ~F.coalesce("may_repeat", F.lit(True)), "several target rows, which may not be"),
    )
    outcome = F.when(F.col("reason") != "", "unexplained").when(some, "fan-out confirmed").otherwise("accounted")
    steps = traces.withColumn("reason", reason).select("step", outcome.alias("outcome"), "reason")
    by_table = written.groupBy("target").agg(F.sum("rows").alias("_w")).join(held.select("target", F.col("rows").alias("_h")), "target", "full")
    agree = F.coalesce("_w", F.lit(0)) == F.coalesce("_h", F.lit(0))
    tables = by_table.select(F.col("target").alias("step"), F.when(agree, "accounted").otherwise("unexplained").alias("outcome"), F.when(agree, "").otherwise("the steps wrote another number of rows than the table holds").alias("reason"))
    return steps.unionByName(tables)


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, digest: a digest of the rows as a multiset; partial sums only, nothing is sorted. A NULL is hashed as such in its place, since the hash skips it."""
    h = F.xxhash64(*[x for c in df.columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


#: What a rule's result can be, in the order in which its marks count.
OUTCOMES = ("passed", "failed", "could_not_run", "did_not_finish", "not_applicable")


def judged_rules(results: DataFrame, permitted: DataFrame, most_permitted: int = 10_000) -> DataFrame:
    """results(check, table, field, category, failed, is_error, error, not_applicable) by category: checks, one count for each of OUTCOMES, expected and unexpected.

    A rule that failed, could not run or did not finish is expected if a permitted row matches it, and unexpected otherwise. Permitted names
    are patterns of any case with `*` and `?`; an empty field stands for any. is_error, error and not_applicable may be absent.
    """
    if permitted.limit(most_permitted + 1).count() > most_permitted:
        raise ValueError(f"more than {most_permitted} permitted failures")

    def pattern(c: Column) -> Column:
        plain = F.regexp_replace(F.coalesce(c, F.lit("*")), r"([.^$+()\[\]{}|\\])", r"\\$1")
        return F.concat(F.lit("(?is)^"), F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))

    own = {c: F.col(c) if c in results.columns else F.lit(None).cast("string") for c in ("is_error", "error", "not_applicable")}
    yes = lambda c: F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))
    late = F.contains(F.lower(F.coalesce(own["error"].cast("string"), F.lit(""))), F.lit("statement timeout"))
    outcome = F.when(yes(own["is_error"]), F.when(late, "did_not_finish").otherwise("could_not_run")).when(yes(own["not_applicable"]), "not_applicable").when(yes(F.col("failed")), "failed").otherwise("passed")
    rows = results.withColumn("outcome", outcome).withColumn("_bad", F.col("outcome").isin("failed", "could_not_run", "did_not_finish"))
    # The rules' names are few; each is matched once, not each result
    p = F.broadcast(permitted.select(*[pattern(F.col(c)).alias(f"_{c}") for c in ("check", "table", "field")]))
    names = rows.where("_bad").select("check", "table", "field").distinct()
    match = F.expr("coalesce(check, '') RLIKE _check AND coalesce(table, '') RLIKE _table AND coalesce(field, '') RLIKE _field")
    known = names.join(p, match, "left_semi").select(*[F.col(c).alias(f"_{c}") for c in ("check", "table", "field")], F.lit(True).alias("_known"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("check", "table", "field")]
    judged = rows.join(known, same[0] & same[1] & same[2], "left")
    bad, expected = F.col("_bad"), F.col("_known").isNotNull()
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return judged.groupBy(F.coalesce("category", F.lit("no category")).alias("category")).agg(F.count(F.lit(1)).alias("checks"), *counts, F.count_if(bad & expected).alias("expected"), F.count_if(bad & ~expected).alias("unexpected"))


def below_offset(df: DataFrame, key: str, offset: int) -> DataFrame:
    """largest, below_offset: whether the identifiers leave room for a layer that begins at the offset; an empty table does."""
    return df.agg(F.max(key).alias("largest")).withColumn("below_offset", F.coalesce(F.col("largest") < offset, F.lit(True)))


def changed_counts(before: DataFrame, after: DataFrame, keys: Sequence[str], count: str, tenth: float = 0.1) -> DataFrame:
    """keys, before, after, change: rows that are gone, new, or whose count changed by more than a tenth of the earlier one."""
    j = before.select(*keys, F.col(count).alias("before")).join(after.select(*keys, F.col(count).alias("after")), list(keys), "full")
    change = F.when(F.col("after").isNull(), "gone").when(F.col("before").isNull(), "new").when(F.abs(F.col("after") - F.col("before")) > tenth * F.col("before"), "changed")
    return j.withColumn("change", change).where("change IS NOT NULL")


def catalogue_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Catalogues (table, column, rows): tables and columns that are gone or new, and tables whose rows changed by more than a tenth."""
    t = lambda d: d.groupBy("table").agg(F.max("rows").alias("rows"))
    tables = changed_counts(t(before), t(after), ["table"], "rows").select("table", F.lit(None).cast("string").alias("column"), "change")
    both = t(before).join(t(after), "table", "left_semi").select("table")
    cols = before.join(both, "table", "left_semi").select("table", "column").join(after.select("table", "column"), ["table", "column"], "left_anti").withColumn("change", F.lit("gone"))
    new = after.join(both, "table", "left_semi").select("table", "column").join(before.select("table", "column"), ["table", "column"], "left_anti").withColumn("change", F.lit("new"))
    return tables.unionByName(cols).unionByName(new)


def covers(periods: DataFrame, subject: str, start: str, end: str, first: Column, last: Column) -> DataFrame:
    """subject, covered: whether its periods, days with both ends included, hold every day from first to last; gaps and islands by running maximum."""
    own = Window.partitionBy(subject).orderBy(start, end)
    before = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = periods.where((F.col(end) >= first) & (F.col(start) <= last)).withColumn("_gap", F.col(start) > F.date_add(F.greatest(F.coalesce(before, F.date_sub(first, 1)), F.date_sub(first, 1)), 1))
    sums = rows.groupBy(subject).agg((~F.max("_gap") & (F.max(end) >= last)).alias("covered"))
    return periods.select(subject).distinct().join(sums, subject, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
