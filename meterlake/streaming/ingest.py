"""Hourly snapshots as a stream into stored facts: one composed step a batch.

A snapshot (snapshot_id, sent_at, platform, scope, row_count, total_tokens, fingerprint, items) replaces the hour of one participant, device and
provider. A batch's step checks it, folds items whose keys agree but for case and blanks, lets clients go before plugins and newer snapshots
before older ones, leaves alone what is stored already, replaces the hour's rows, takes rows of other devices out where a cloud provider sent the
same usage, and derives the days again. Tables (``hourly``, ``daily``, ``buckets``; ``outcomes`` by batch) are partitioned by day; a
write puts whole days in place of the old ones and touches no other day. Facts are written before the buckets that
vouch for them, so a batch that is run again, after a failure at any point, ends in the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.lifecycle import COUNTS, bucket_fingerprints, derive_daily, keep_first

#: The platform of plugins, and providers whose usage every device of a person sees.
PLUGIN = "magpie-plugin"
CLOUD = ("cursor_dashboard_usage",)
SCOPE = ["participant_id", "device_id", "day", "hour", "provider_id"]
DAY_SCOPE = [c for c in SCOPE if c != "hour"]
KEY = ["tool_code", "workdir", "model"]
MEASURES = [*COUNTS, "total_tokens"]
FINGERPRINT = {"hour": "number", "tool_code": "text", "workdir": "text", "model": "text", **dict.fromkeys(MEASURES, "number"), "source_fingerprint": "text"}
_SCOPES = "participant_id bigint, device_id bigint, day date, hour int, provider_id string"
_ITEM = f"struct<day:date,hour:int,provider_id:string,tool_code:string,workdir:string,model:string,{','.join(f'{c}:bigint' for c in COUNTS)},source_fingerprint:string>"
SNAPSHOT = f"snapshot_id string, sent_at timestamp, platform string, {_SCOPES}, row_count int, total_tokens bigint, fingerprint string, items array<{_ITEM}>"
_ROW = f"tool_code string, workdir string, model string, {', '.join(f'{c} bigint' for c in MEASURES)}, source_fingerprint string"
TABLES = {
    "hourly": f"{_SCOPES}, {_ROW}, platform string",
    "daily": f"{_SCOPES.replace('hour int, ', '')}, {_ROW.replace(', source_fingerprint string', '')}, hourly_derived boolean",
    "buckets": f"{_SCOPES}, fingerprint string, platform string, sent_at timestamp, row_count int, total_tokens bigint",
}


def prepare(spark: SparkSession, target: str) -> None:
    """Make the tables that are not there yet."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("day").parquet(f"{target}/{name}")


def stored(spark: SparkSession, target: str, name: str, days: DataFrame | None = None) -> DataFrame:
    """A table, or its partitions of some days (those of a batch: fewer than the table's partitions, which the driver lists)."""
    names = [c.split()[0] for c in TABLES[name].split(", ")]
    table = spark.read.schema(TABLES[name]).parquet(f"{target}/{name}").select(*names)
    return table if days is None else table.join(F.broadcast(days), "day", "left_semi").select(*names)


def problem() -> Column:
    """The first reason not to take a snapshot, or null."""
    n = F.coalesce(F.size("items"), F.lit(0))
    out = F.when(F.coalesce("snapshot_id", F.lit("")) == "", "no_id").when(F.col("day").isNull(), "bad_day").when(~F.coalesce(F.col("hour").between(0, 23), F.lit(False)), "bad_hour")
    out = out.when(F.coalesce("provider_id", F.lit("")) == "", "no_provider").when(F.coalesce("fingerprint", F.lit("")) == "", "no_fingerprint")
    out = out.when(F.col("row_count") == 0, "empty").when(F.coalesce("row_count", F.lit(-1)) != n, "bad_count").when(F.coalesce("total_tokens", F.lit(-1)) < 0, "bad_total")
    same = F.forall("items", lambda i: i["day"].eqNullSafe(F.col("day")) & i["hour"].eqNullSafe(F.col("hour")) & i["provider_id"].eqNullSafe(F.col("provider_id")))
    return out.when(~same, "bad_items")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which a device may be null; the right side's keys go."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


def _folded(rows: DataFrame) -> DataFrame:
    shaped = rows.withColumns({c: F.lower(F.trim(c)) for c in ("tool_code", "model")})
    best = F.struct(-F.col("total_tokens"), "source_fingerprint")
    return shaped.groupBy(*SCOPE, *KEY, "platform").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min_by("source_fingerprint", best).alias("source_fingerprint"), F.sum("total_tokens").alias("all")).withColumnRenamed("all", "total_tokens")


def step(batch: DataFrame, number: int, target: str) -> None:
    """Apply one batch of snapshots to the tables below ``target``."""
    spark = batch.sparkSession
    once = keep_first(batch, ["snapshot_id"], F.desc("sent_at"))  # one that comes twice in a batch
    given = once.withColumn("problem", problem()).withColumn("client", F.coalesce(F.trim("platform"), F.lit("")) != PLUGIN).checkpoint()
    days = given.where("problem is null").select("day").distinct().checkpoint()
    good = given.where("problem is null")
    # of a scope's snapshots in the batch one counts: a client's before a plugin's, then the newest
    best = good.groupBy(*SCOPE).agg(F.max_by("snapshot_id", F.struct("client", "sent_at", "snapshot_id")).alias("snapshot_id"))
    chosen = good.join(best.select("snapshot_id"), "snapshot_id", "left_semi")
    buckets = stored(spark, target, "buckets", days)
    was = buckets.select(*SCOPE, F.col("fingerprint").alias("was_fingerprint"), F.col("sent_at").alias("was_sent"), (F.coalesce(F.trim("platform"), F.lit("")) != PLUGIN).alias("was_client"))
    hourly = stored(spark, target, "hourly", days)
    facts = bucket_fingerprints(hourly, SCOPE, FINGERPRINT).select(*SCOPE, F.col("fingerprint").alias("facts_fingerprint"))
    claimed = stored(spark, target, "daily", days).where("not hourly_derived").select(*DAY_SCOPE).distinct().withColumn("claimed", F.lit(True))
    merged = _folded_items(chosen).checkpoint()
    now = bucket_fingerprints(merged, SCOPE, FINGERPRINT).select(*SCOPE, F.col("fingerprint").alias("now_fingerprint"), F.col("total_tokens").alias("now_total"))
    seen = _null_safe(chosen.drop("items"), was, SCOPE, "left")
    for more, keys in ((facts, SCOPE), (claimed, DAY_SCOPE), (now, SCOPE)):
        seen = _null_safe(seen, more, keys, "left")
    stale = (F.col("client") == F.col("was_client")) & (F.col("sent_at") < F.col("was_sent"))
    outranked = ~F.col("client") & (F.coalesce("was_client", F.lit(False)) | F.coalesce("claimed", F.lit(False)))
    noop = (F.col("now_fingerprint") == F.col("was_fingerprint")) & (F.col("facts_fingerprint").isNull() | (F.col("facts_fingerprint") == F.col("now_fingerprint")))
    status = F.when(outranked, "outranked").when(stale, "stale").when(noop, "noop").otherwise("applied")
    judged = seen.withColumn("status", status).checkpoint()
    applied = judged.where("status = 'applied'")
    new = _null_safe(merged, applied.select(*SCOPE, "sent_at"), SCOPE, "inner")
    cloud = F.col("provider_id").isin(*CLOUD)
    natural = ["participant_id", "day", "hour", "provider_id", *KEY]
    # the newest of several devices' rows for one cloud usage, of this batch and then against what is stored
    new = new.where(~cloud).unionByName(keep_first(new.where(cloud), natural, F.desc("sent_at"), "device_id")).drop("sent_at").checkpoint()
    others = new.where(cloud).select(*natural, F.col("device_id").alias("__by")).distinct()
    kept = _null_safe(hourly, applied.select(*SCOPE), SCOPE, "left_anti")
    gone = kept.join(others, natural).where(~F.col("device_id").eqNullSafe(F.col("__by"))).select(*hourly.columns).checkpoint()
    after = _null_safe(kept, gone.select(*SCOPE, *KEY), [*SCOPE, *KEY], "left_anti").unionByName(new.select(*hourly.columns))
    changed = applied.select(*DAY_SCOPE).union(gone.select(*DAY_SCOPE)).distinct().checkpoint()
    touched = changed.select("day").distinct()
    if touched.limit(1).count():
        _put(after.join(F.broadcast(touched), "day", "left_semi").select(*hourly.columns), target, "hourly")
        derive(spark, target, changed)
        rows = applied.select(*SCOPE, F.col("now_fingerprint").alias("fingerprint"), "platform", "sent_at", "row_count", F.col("now_total").alias("total_tokens"))
        left = _null_safe(buckets, applied.select(*SCOPE), SCOPE, "left_anti")
        _put(left.unionByName(rows).join(F.broadcast(touched), "day", "left_semi").select(*buckets.columns), target, "buckets")
    told = judged.select("snapshot_id", "status").unionByName(given.where("problem is not null").select("snapshot_id", F.col("problem").alias("status")))
    told = told.unionByName(good.join(best.select("snapshot_id"), "snapshot_id", "left_anti").select("snapshot_id", F.lit("superseded").alias("status")))
    told.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/outcomes")


def _folded_items(chosen: DataFrame) -> DataFrame:
    i = chosen.select(*SCOPE, "platform", F.explode("items").alias("i"))
    counts = [F.greatest(F.coalesce(F.col(f"i.{c}"), F.lit(0)), F.lit(0)).alias(c) for c in COUNTS]
    rows = i.select(*SCOPE, "platform", *[F.coalesce(F.col(f"i.{c}"), F.lit("")).alias(c) for c in KEY], *counts, F.coalesce("i.source_fingerprint", F.lit("")).alias("source_fingerprint"))
    return _folded(rows.withColumn("total_tokens", sum((F.col(c) for c in COUNTS if c != "reasoning_tokens"), F.lit(0).cast("long"))))


def derive(spark: SparkSession, target: str, changed: DataFrame) -> None:
    """Derive the days of changed scopes from the stored hours; rows of their own that no hour stands behind stay unless derived."""
    days = changed.select("day").distinct()
    daily = stored(spark, target, "daily", days)
    hours = _null_safe(stored(spark, target, "hourly", days), changed, DAY_SCOPE, "left_semi")
    fresh = derive_daily(hours, [*DAY_SCOPE, *KEY])
    marked = _null_safe(daily, changed.withColumn("__changed", F.lit(True)), DAY_SCOPE, "left")
    kept = marked.where("__changed is null or not hourly_derived").drop("__changed")
    kept = _null_safe(kept, fresh.select(*DAY_SCOPE, *KEY), [*DAY_SCOPE, *KEY], "left_anti")
    _put(kept.unionByName(fresh.select(*daily.columns)).select(*daily.columns), target, "daily")


def _put(rows: DataFrame, target: str, name: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{target}/{name}")


def ingest(snapshots: DataFrame, target: str, checkpoint: str):
    """Run the step over a stream of snapshots until nothing new is there."""
    prepare(snapshots.sparkSession, target)
    return snapshots.writeStream.foreachBatch(lambda batch, number: step(batch, number, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
