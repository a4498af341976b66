"""The gateway's request ledger: reading with a fuse, integrity, and which rows are uploaded under which name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.sources.logs import number, timestamp

_FIELDS = ["in", "out", "cache_read", "cache_write", "reasoning"]
SCHEMA = "t string, agent string, provider string, req string, model string, served string, `in` bigint, `out` bigint, cache_read bigint, cache_write bigint, reasoning bigint, cost double, status int, source string, kind string, route_id string, response_id string, callerKeyId string"


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows raw, r (parsed), ok: a line is well-formed if it is an object with a time, an agent and any tokens."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.trim("value").alias("raw")).where("raw <> ''")
    parsed = lines.withColumn("r", F.when(F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{"), F.from_json("raw", SCHEMA)))
    return parsed.withColumn("ok", F.coalesce(F.col("r.t").isNotNull() & F.col("r.agent").isNotNull() & (F.get_json_object("raw", "$.in").isNotNull() | F.get_json_object("raw", "$.out").isNotNull()), F.lit(False)))


def shape(lines: DataFrame) -> DataFrame:
    """One row: lines, malformed ones, and whether they are so many that the format must have changed. One bad line among many is normal."""
    counts = lines.agg(F.count("*").alias("lines"), F.count_if(~F.col("ok")).alias("malformed"))
    bad, all_lines = F.col("malformed"), F.col("lines")
    return counts.withColumn("drifted", ((bad >= 2) & (bad > 0.05 * all_lines)) | ((bad >= 1) & (bad > 0.5 * all_lines)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed rows of a ledger; refuses to go on if its shape has drifted."""
    lines = ledger_lines(spark, path)
    found = shape(lines).first()  # one row
    if found.drifted:
        raise ValueError(f"{found.malformed} of {found.lines} ledger lines are malformed")
    return lines.where("ok").select("r.*")


def countable(rows: DataFrame) -> DataFrame:
    tokens = sum(F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in _FIELDS[:4])
    return rows.where(~F.coalesce(F.col("kind").isin("model_list", "provider_test"), F.lit(False)) & (F.coalesce("source", F.lit("")) != "probe") & (tokens > 0))


def integrity_issues(rows: DataFrame) -> DataFrame:
    """What is wrong with counted rows: t and issue, one row an issue. A row's first fault of route or time hides its others."""
    route = F.col("route_id").try_cast("double")
    found = F.when(route.isNull() | (route < 0), F.array(F.lit("route"))).when(timestamp(F.col("t")).isNull(), F.array(F.lit("time")))
    signs = F.filter(F.array(*[F.when(F.col(f"`{c}`") < 0, F.lit(f"negative {c}")) for c in _FIELDS[:4]]), lambda x: x.isNotNull())
    single = rows.select("t", F.explode(F.coalesce(found, signs)).alias("issue"))
    seen = F.row_number().over(Window.partitionBy("response_id").orderBy("t"))
    twice = rows.where((F.coalesce("response_id", F.lit("")) != "") & found.isNull()).withColumn("n", seen).where("n > 1").select("t", F.lit("response twice").alias("issue"))
    return single.unionByName(twice)


def from_api(rows: DataFrame) -> DataFrame:
    """Rows of the gateway's API in the ledger's shape."""
    return rows.select(F.col("time").alias("t"), "agent", "provider", F.col("requested_model").alias("req"), "model", F.col("served_model").alias("served"), F.col("input_tokens").alias("in"), F.col("output_tokens").alias("out"), F.col("cache_read_tokens").alias("cache_read"), F.col("cache_write_tokens").alias("cache_write"), F.col("reasoning_tokens").alias("reasoning"), F.col("cost_usd").alias("cost"), "status", "source")


def mapped(rows: DataFrame, agents: DataFrame, fallback: tuple[str, str]) -> DataFrame:
    """Provider and tool of each row's agent; unknown agents have the fallback's."""
    a = agents.select(F.lower("agent").alias("__agent"), "provider_id", "tool_code")
    joined = rows.join(F.broadcast(a), F.lower("agent") == F.col("__agent"), "left").drop("__agent")
    return joined.withColumn("provider_id", F.coalesce("provider_id", F.lit(fallback[0]))).withColumn("tool_code", F.coalesce("tool_code", F.lit(fallback[1])))


def local(rows: DataFrame) -> Column:
    return F.coalesce("callerKeyId", F.lit("")) == ""


def uploads(rows: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of local callers whose agent is known, and how many of each agent are left out."""
    known = agents.select(F.lower("agent").alias("__agent"), F.lit(True).alias("__known"))
    marked = rows.join(F.broadcast(known), F.lower("agent") == F.col("__agent"), "left").withColumn("__keep", F.col("__known").isNotNull() & local(rows))
    return marked.where("__keep").drop("__agent", "__known", "__keep"), marked.where(~F.col("__keep")).groupBy("agent").agg(F.count("*").alias("rows"))


def as_usage(rows: DataFrame) -> DataFrame:
    """Ledger rows as usage rows."""
    model = F.lower(F.trim(F.coalesce("req", "model", "served", F.concat(F.coalesce("provider", F.lit("unknown")), F.lit("/other")))))
    names = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
    out = rows.select(timestamp(F.col("t")).alias("ts"), "agent", model.alias("model"), *[number(F.col(f"`{a}`")).alias(n) for a, n in zip(_FIELDS, names, strict=True)], "cost", "status")
    return out.withColumn("total_tokens", sum(F.col(n) for n in names[:4]))
