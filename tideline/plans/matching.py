"""Scoring phrases against many descriptions: stems, BM25 over postings, a bonus for words in order, a factor by type, the best k for each phrase."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.staging import staged

K1, B = 1.2, 0.5

#: Left out by default: words that carry no meaning alone.
STOP = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")

_VOWEL = "(?:[aeiou]|(?<=.)y)"


def stem(word: Column) -> Column:
    """The first step of Porter's stemmer (1980): plurals, then -eed, -ed and -ing with the stem's repair, then a final y. A y is a vowel but at the front."""

    def without(w: Column, ending: str, to: str = "") -> Column:
        return F.regexp_replace(w, f"{ending}$", to)

    plural = F.when(word.endswith("sses") | word.endswith("ies"), without(word, "es")).when(word.endswith("ss"), word).otherwise(without(word, "s"))

    def repaired(s: Column) -> Column:
        twice = s.rlike(r"([b-df-hj-kmnp-rtv-x])\1$")
        short = s.rlike("^[^aeiou]+[aeiouy][^aeiouwxy]$")
        return F.when(s.rlike("(?:at|bl|iz)$") | short, F.concat(s, F.lit("e"))).when(twice, without(s, ".")).otherwise(s)

    verb = F.when(plural.endswith("eed"), F.when(plural.rlike(f"{_VOWEL}[^aeiou].*eed$"), without(plural, "d")).otherwise(plural))
    for ending in ("ed", "ing"):
        verb = verb.when(plural.rlike(f"{_VOWEL}.*{ending}$"), repaired(without(plural, ending)))
    verb = verb.otherwise(plural)
    return F.when(verb.rlike(f"{_VOWEL}.*y$"), without(verb, "y", "i")).otherwise(verb)


def words(text: Column, spellings: Mapping[str, str] | None = None, abbreviations: Mapping[str, str] | None = None, synonyms: Mapping[str, str] | None = None, stop: Sequence[str] = STOP) -> Column:
    """Array of stems of a text's runs of letters, lower-cased, without stop words.

    The caller's tables say which spellings are one word, what an abbreviation stands for (one or more words), and which stems mean the same. They are
    parameters of a site and small: literals of the plan.
    """

    def looked_up(table: Mapping[str, str] | None, w: Column) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), w), w) if table else w

    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    full = F.flatten(F.transform(runs, lambda w: F.split(looked_up(abbreviations, looked_up(spellings, w)), " ")))
    kept = F.filter(full, lambda w: ~w.isin(list(stop)))
    return F.transform(kept, lambda w: looked_up(synonyms, stem(w)))


def described(name: Column, description: Column, **tables) -> Column:
    """The words of a name, which count twice, and of its description."""
    own = words(name, **tables)
    return F.concat(own, own, words(description, **tables))


def tokenised(rows: DataFrame, key: str, *columns: Column | str) -> DataFrame:
    """`columns` of rows, those of `words` among them, written once: stems cost more than what is done with them, so they are made in tasks that rows are dealt to by key, however few files hold them, and never twice."""
    return staged(rows.repartition(key).select(*columns), "tokens")


def postings(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """doc, word, tf, length: a row for each word of each document."""
    rows = docs.select(F.col(doc), F.explode_outer(tokens).alias("word")).where("word IS NOT NULL").groupBy(doc, "word").agg(F.count(F.lit(1)).alias("tf"))
    lengths = docs.select(F.col(doc), F.size(tokens).alias("length"))
    return rows.join(lengths, doc)


def bm25(queries: DataFrame, query: str, query_tokens: Column, docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """query, doc, score of every pair that shares a word: the query's words meet the postings, nothing else is paired."""
    p = postings(docs, doc, tokens)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens)).alias("average"))
    df = p.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select(F.col(query), F.explode_outer(query_tokens).alias("word")).where("word IS NOT NULL")
    hits = asked.join(p, "word").join(df, "word").crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return hits.groupBy(query, doc).agg(F.sum(gain).alias("score"))


def top_k(queries: DataFrame, query: str, query_tokens: Column, docs: DataFrame, doc: str, tokens: Column, k: int) -> DataFrame:
    """query, doc, score, rank: each query's k best documents by BM25, ties by document, without scoring every pair that shares a word.

    Postings are kept with their gains, and words with their number of documents and their highest gain. A query's rarest words, as many as reach k documents, give a score that its k-th best
    document has at least. Words whose highest gains together stay below that cannot lift a document among the best, so their postings are not expanded; the documents of the other words
    are scored in full. A word that most documents share is therefore only looked up for few of them.
    """
    p = postings(docs, doc, tokens)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens)).alias("average"))
    df = p.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    gains = staged(p.join(df, "word").crossJoin(F.broadcast(total)).select("word", F.col(doc).alias("doc"), gain.alias("gain")), "gains")  # one row of totals
    stats = gains.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.max("gain").alias("most"))
    asked = queries.select(F.col(query).alias("q"), F.explode_outer(query_tokens).alias("word")).where("word IS NOT NULL").groupBy("q", "word").agg(F.count(F.lit(1)).alias("times"))
    asked = staged(asked.join(stats, "word"), "asked")  # words that no document has give nothing
    own = Window.partitionBy("q")
    rare = asked.withColumn("_before", F.coalesce(F.sum("df").over(own.orderBy("df", "word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < k)
    partial = rare.join(gains, "word").groupBy("q", "doc").agg(F.sum(F.col("times") * F.col("gain")).alias("s"))
    reached = partial.withColumn("_n", F.row_number().over(own.orderBy(F.desc("s")))).where(F.col("_n") == k).select("q", F.col("s").alias("floor"))
    sums = F.sum(F.col("times") * F.col("most")).over(own.orderBy("most", "word").rowsBetween(Window.unboundedPreceding, 0))
    weighed = asked.withColumn("_sum", sums).join(reached, "q", "left")
    needed = weighed.where(F.col("floor").isNull() | (F.col("_sum") >= F.col("floor") * (1 - 1e-9)))
    candidates = needed.select("q", "word").join(gains.select("word", "doc"), "word").select("q", "doc").distinct()
    scored = candidates.join(asked.select("q", "word", "times"), "q").join(gains, ["word", "doc"]).groupBy("q", "doc").agg(F.round(F.sum(F.col("times") * F.col("gain")), 9).alias("score"))
    return best(scored, "q", "doc", k).select(F.col("q").alias(query), F.col("doc").alias(doc), "score", "rank")


def in_order(phrase: Column, tokens: Column, gap: int = 2) -> Column:
    """Whether the phrase's words stand in tokens in order, with at most `gap` words between neighbours.

    One pass over the tokens keeps, for each beginning of the phrase, the last place where it ends; the latest place is the best for what follows.
    """
    n = F.size(phrase)
    placed = F.transform(tokens, lambda w, i: F.struct(w.alias("word"), (i + 1).alias("place")))
    none = F.transform(phrase, lambda _: F.lit(0))

    def step(ends: Column, token: Column) -> Column:
        def end(old: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(ends, k - 1))
            follows = (k == 0) | ((before > 0) & (token["place"] - before <= gap + 1))
            return F.when((F.get(phrase, k) == token["word"]) & follows, token["place"]).otherwise(old)

        return F.transform(ends, end)

    return F.coalesce(F.get(F.aggregate(placed, none, step), n - 1) > 0, F.lit(False))


def with_order(scores: DataFrame, phrase: Column, tokens: Column, bonus: float = 2.0, gap: int = 2) -> DataFrame:
    """Scores with `in_order`, and `bonus` added where the phrase's words, two at least, stand in order; the order is only looked for where no word is missing."""
    found = scores.withColumn("in_order", (F.size(phrase) > 1) & (F.size(F.array_except(phrase, tokens)) == 0) & in_order(phrase, tokens, gap))
    return found.withColumn("score", F.col("score") + F.when(F.col("in_order"), bonus).otherwise(0.0))


def best(scores: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The k best of each query, by score, ties by document."""
    own = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scores.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def weighted(scores: DataFrame, factor: Column, high: float, medium: float) -> DataFrame:
    """Scores times a factor for how well the type suits, with a level of confidence."""
    s = F.col("score") * factor
    return scores.withColumn("score", s).withColumn("confidence", F.when(F.col("score") >= high, "high").when(F.col("score") >= medium, "medium").otherwise("low"))


def scoreboard(outcomes: DataFrame) -> DataFrame:
    """outcomes(part, category, confidence, outcome) counted three ways: by part, by category and by confidence."""
    out = None
    for c in ("part", "category", "confidence"):
        one = outcomes.groupBy(F.lit(c).alias("by"), F.col(c).cast("string").alias("group")).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "replaced", "refused")])
        out = one if out is None else out.unionByName(one)
    return out
