"""Usage facts made from the driver's tables: daily facts from lineitem, hourly ones from events."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUSINESS_DAY = date(2001, 6, 15)
EVENT_DAY = date(2024, 1, 30)
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "total_tokens"]


def daily_facts(spark: SparkSession, sf_dir: str, span: tuple[date, date] | None = None, models: bool = True) -> DataFrame:
    """Facts of all days, or of some: then the bounds reach the scan. Without ``models`` nothing is joined: the left join on the part's key, which is unique, neither drops nor doubles a line."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if span is not None:
        line = line.where((F.col("l_shipdate") >= F.lit(datetime.combine(span[0], time.min)).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(datetime.combine(span[1] + timedelta(days=1), time.min)).cast("timestamp_ntz")))
    if models:
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
        line = line.join(part, line.l_partkey == part.p_partkey, "left")
    u = line.select(
        F.to_date("l_shipdate").alias("day"),
        F.col("l_suppkey").cast("long").alias("participant_id"),
        (F.col("l_suppkey") * 10 + F.col("l_linenumber") % 3).cast("long").alias("device_id"),
        F.col("l_returnflag").alias("tool_code"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("provider_id"),
        (F.col("l_orderkey") % 40).cast("long").alias("workdir_id"),
        *([F.col("p_brand").alias("model")] if models else []),
        (F.col("l_quantity").cast("long") * 100).alias("input_tokens"),
        F.floor("l_extendedprice").cast("long").alias("output_tokens"),
        (F.round(F.col("l_discount") * 100).cast("long") * 500).alias("cache_read_tokens"),
        (F.round(F.col("l_tax") * 100).cast("long") * 200).alias("cache_write_tokens"),
        (F.col("l_linenumber").cast("long") * 10).alias("reasoning_tokens"),
        F.when(F.col("l_linestatus") == "F", "exact").otherwise("partial").alias("source_quality"),
    )
    return u.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))


def hourly_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k)
    return e.select(
        "event_id",
        "ts",
        F.to_date("ts").alias("day"),
        F.hour("ts").alias("hour"),
        F.col("user_id").alias("participant_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 3).alias("device_id"),
        F.col("event_type").alias("provider_id"),
        F.concat(F.lit("m"), (F.col("k") % 12).cast("string")).alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        (F.col("k") * 7).alias("cache_read_tokens"),
        (F.col("k") * 3).alias("cache_write_tokens"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").cast("long").alias("participant_id"), F.col("s_name").alias("nickname"), F.col("s_nationkey").alias("team_id"))


#: The same relations in SQL; queries put these before their own text.
SQL_PEOPLE = "p AS (SELECT CAST(s_suppkey AS BIGINT) AS participant_id, s_name AS nickname, s_nationkey AS team_id FROM supplier)"
SQL_DAILY = """u0 AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_suppkey AS BIGINT) AS participant_id,
 CAST(l_suppkey*10 + l_linenumber % 3 AS BIGINT) AS device_id, l_returnflag AS tool_code,
 l_returnflag || '_' || l_linestatus AS provider_id, CAST(l_orderkey % 40 AS BIGINT) AS workdir_id, p_brand AS model,
 CAST(l_quantity AS BIGINT)*100 AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens,
 CAST(round(l_discount*100) AS BIGINT)*500 AS cache_read_tokens, CAST(round(l_tax*100) AS BIGINT)*200 AS cache_write_tokens,
 CAST(l_linenumber AS BIGINT)*10 AS reasoning_tokens,
 CASE WHEN l_linestatus='F' THEN 'exact' ELSE 'partial' END AS source_quality
 FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
u AS (SELECT *, input_tokens+output_tokens+cache_read_tokens+cache_write_tokens AS total_tokens FROM u0),
""" + SQL_PEOPLE
SQL_HOURLY = """e0 AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events),
e1 AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, user_id AS participant_id,
 user_id*10 + event_id % 3 AS device_id, event_type AS provider_id, 'm' || CAST(k % 12 AS VARCHAR) AS model,
 CAST(floor(value*100) AS BIGINT) AS input_tokens, CAST(floor(value*10) AS BIGINT) AS output_tokens,
 k*7 AS cache_read_tokens, k*3 AS cache_write_tokens, CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status FROM e0),
h AS (SELECT *, input_tokens+output_tokens+cache_read_tokens+cache_write_tokens AS total_tokens FROM e1)"""
