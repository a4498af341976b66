"""A corpus pipeline: each stage reads what the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, language_id, near_dedup, packing, substring_dedup
from meterlake.llm.shared import materialize, row_key


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told (no letters) go; the others stay as they are."""
    model = language_id.fit(docs)
    if not model["langs"]:
        return docs
    found = language_id.predict(docs, model, keep=tuple(docs.columns), names=("__lang", "__score"))
    return found.where(F.col("__lang") != language_id.UNKNOWN).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the least id stays; rows are told apart by id and text."""
    keyed = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    found = near_dedup.near_duplicates(keyed, width=5, percent=80, id_col="__key").select("__key", "component_id")
    least = keyed.select("__key", "doc_id").join(found, "__key").groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("x"))
    stay = keyed.join(least.select("x.__key"), "__key", "left_semi")
    rows, keys = keyed.agg(F.count("*"), F.count_distinct("__key")).first()
    if rows == keys:
        return stay.select(*docs.columns)
    # of rows repeated under one id and text one is taken, the same whenever it is computed: by the text of their other columns, which may be of any type
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    return stay.groupBy("__key", "doc_id", "text").agg(F.min_by(F.struct(*docs.columns), others).alias("x")).select("x.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; documents left empty by it go."""
    cut = substring_dedup.dedup(docs, keep=tuple(docs.columns), names=("__kept", "__words", "__removed")).where("__removed = 0 or __removed < __words")
    text = F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    size = F.when(F.col("__removed") > 0, F.length("__kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[{"text": text, "n_chars": size}.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens that are left, in sequences of at most 2048."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("pack", pack),
]

#: SQL cannot express every stage; tests/llm/test_pipeline.py compares run() with plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
