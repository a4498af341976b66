"""Log files as rows: what is there, what changed, and which of several copies counts. Contents are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.ledger import one_copy


def source_files(spark: SparkSession, path: str, glob: str = "*", like: str | None = None) -> DataFrame:
    """path, name, bytes and changed of the files below ``path``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.col("modificationTime").alias("changed"), F.col("length").alias("bytes"))
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return f if like is None else f.where(F.col("name").rlike(like))


def fingerprints(files: DataFrame, provider: str, parser: str, stable_key: Column | None = None) -> DataFrame:
    """A digest of each file's provider, parser, stable key (its path, or what stays when a tool moves it), size and time, and of its
    write-ahead file's size and time: if it is the same, the file need not be read again. Write-ahead files have no row of their own."""
    of = F.regexp_replace("path", "-wal$", "")
    state = F.struct(F.col("bytes"), F.unix_millis("changed").alias("at"))
    logs = files.where(F.col("path").endswith("-wal")).select(of.alias("path"), state.alias("__wal"))
    main = files.where(~F.col("path").endswith("-wal")).join(logs, "path", "left")
    zero = F.lit(0).cast("long")
    parts = [F.lit(provider), F.lit(parser), F.col("path") if stable_key is None else stable_key, F.col("bytes"), F.unix_millis("changed"), F.coalesce("__wal.bytes", zero), F.coalesce("__wal.at", zero)]
    return main.withColumn("source_fingerprint", F.sha2(F.concat_ws("|", *[x.cast("string") for x in parts]), 256)).drop("__wal")


def to_read(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose digest is not known; what has moved under a stable key is not read again."""
    return files.join(known.select("source_fingerprint").distinct(), "source_fingerprint", "left_anti")


def logs_once(files: DataFrame) -> DataFrame:
    """One of the copies of each log: active before archived, plain before compressed."""
    home = F.regexp_extract("path", r"^(.*?)/(?:sessions|archived_sessions)/", 1)
    shaped = files.withColumn("home", home).withColumn("archived", F.col("path").contains("/archived_sessions/")).withColumn("compressed", F.col("name").endswith(".zst")).withColumn("name", F.regexp_replace("name", r"\.zst$", ""))
    return one_copy(shaped)


def project_folder(name: Column) -> Column:
    """The folder that a project directory's name stands for: ``-a-b`` is ``/a/b``."""
    return F.when(name.startswith("-"), F.translate(name, "-", "/")).otherwise(name)
