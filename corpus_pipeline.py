"""Corpus pipeline over documents: language ID, near-duplicates, decontamination, personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again as the next stage's docs. All but the
last return the columns of documents.

Defined results: rows are judged one by one, by their own texts, so that null and repeated ids do no harm. A null text, or one without a letter, goes in the first
stage. Of a group of near-copies the row with the smallest id stays (null last); of rows that are equal in id and text one stays. A text of any length is judged as a
whole. Columns other than those of documents are dropped; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontamination, hyperminhash, language_id, personal_data, sentencepiece_codec
from tideline.llm.common import staged
from tideline.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose best language has a smaller posterior than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the model knows; the others go."""
    model = language_id.fit(docs.where(language_id.learnt(F.col("doc_id"))), "text", "lang", "doc_id")
    judged = language_id.predict(docs, "text", model, keep=tuple(COLUMNS))
    return judged.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-copies: five-word shingles, similarity 0.8."""
    return hyperminhash.one_of_each(docs, words=5, percent=80).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark item."""
    key = F.xxhash64("doc_id", "text")  # a row is judged by its own text, whether its id is null or repeated
    held = decontamination.contaminated(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), doc_id="key").select("key").distinct()
    return docs.join(held, key == F.col("key"), "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    found = personal_data.find(docs, "text", personal_data.fit(docs, "doc_id", "text"))
    out = found.withColumn("text", personal_data.redacted(F.col("text"), F.col("pii_spans")))
    changed = F.size("pii_spans") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its number of pieces, and digests of the ids and of the decoded text."""
    done = sentencepiece_codec.encode_decode(docs, "text", tokenizer_path(), keep=("doc_id", "lang", "source"))
    return done.select(
        "doc_id",
        "lang",
        "source",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("piece_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("piece_text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("language_id", language), ("near_duplicates", near_copies), ("decontamination", decontaminate), ("personal_data", redact), ("sentencepiece", pieces)]

#: The stages learn models and encode text, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
