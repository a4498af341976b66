"""The registered queries of the corpus operators, their SQL and their pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from meterlake.llm import centroids, chat_format, conversation_repair, decontaminate, fingerprint, language_id, lm_score, near_dedup, packing, pattern_packing, substring_dedup, toxicity, url_filter
from meterlake.llm.oracle import ORACLE_SQL  # noqa: F401
from meterlake.llm.shared import id_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_bucket(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fingerprint.edited_text(F.col("text"), F.col("next_text")))
    rows = fingerprint.with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select cast(-7 as bigint) conv_id, cast(turn as bigint) turn, role, '{said}' text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.windows(conversations))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: a page is bad if the label under its id says toxic or of low quality."""
    bad = F.when(F.expr("toxic = 1 or quality = 0"), 1).when(F.expr("toxic is not null or quality is not null"), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, id_bucket(F.col("doc_id"), 3) != 1)
    found = language_id.predict(docs, model)
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_bucket(F.col("doc_id"), 7) == 2
    scored = lm_score.score(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), *[c for c in scored.columns if c != "doc_id"])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it contains; clean documents have none."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by a hash of conversation and turn: dropped, emptied, cut, repeated or said by the user."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    fault = F.crc32(key) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    report, turns = conversation_repair.repair(damaged(conversations))
    digests = conversation_repair.digests(turns).withColumnRenamed("conv", "conv_of")
    whole = conversations.select("conv_id").distinct()
    counted = report.withColumnRenamed("conv_id", "conv")
    found = whole.join(counted, whole.conv_id.eqNullSafe(counted.conv), "left").join(digests, whole.conv_id.eqNullSafe(digests.conv_of), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_pattern_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprint": op3_fingerprint,
    "op4_chat_format": op4_chat_format,
    "op5_pack": op5_pack,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_lm_score": op8_lm_score,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroids": op11_centroids,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_pattern_pack": op13_pattern_pack,
    "pipeline": corpus_pipeline.run,
}
