"""Registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary files of the tokenizer package; read on the driver only.
TOKENIZER = "piece_bpe_32k.model"
PACKED = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import warc

    path = warc.deduplicated_archive(table(spark, sf_dir, "pages"))
    back = warc.read_archives(spark, path, with_payload=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import perspectives

    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import hyperminhash

    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import bwt_repeats

    done = bwt_repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    runs = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    return done.withColumn("removed", runs).withColumn("has_repeats", F.col("n_removed") > 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    done = toxicity.score(docs, "text", model, keep=("doc_id",))
    return done.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import cross_polytope

    return cross_polytope.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import personal_data as pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.find(docs, "text", pii.fit(docs, "doc_id", "text"))
    counts = [F.size(pii.of_kind("pii_base", k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return done.select("doc_id", *counts, F.sha2(pii.written(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import sentencepiece_codec

    done = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), "text", tokenizer_path(), keep=("doc_id",))
    return done.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("piece_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("piece_text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import language_id

    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(language_id.learnt(F.col("doc_id"))), "text", "lang", "doc_id")
    done = language_id.predict(docs, "text", model, keep=("doc_id",))
    return done.select("doc_id", F.coalesce(~language_id.learnt(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import decontamination

    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideline.llm import packing

    with open(public_tokenizers.path(PACKED), encoding="utf-8") as f:  # read on the driver only
        tokenizer = f.read()
    done = packing.packed(table(spark, sf_dir, "documents"), tokenizer)
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm import prefix_trie

    return prefix_trie.trie(prefix_trie.forked(prefix_trie.ordered(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from tideline.llm.oracles import SQL

    return dict(SQL)
