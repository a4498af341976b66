"""What a changed price reaches, and pricing stored facts anew where it does; stored windows that a write makes stale."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.pricing import candidates, price_name, with_cost


def affected_models(models: DataFrame, changed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of the names in ``models`` (column model) those that the changed prices (column model) can reach: under the price's own name, under an
    alias (source, target) of it, and under whatever name the resolver tries one of these for."""
    own = changed.select(price_name(F.col("model")).alias("name")).where("name <> ''").distinct()
    by_alias = aliases.select(price_name(F.col("source")).alias("source"), price_name(F.col("target")).alias("name")).join(own, "name").select(F.col("source").alias("name"))
    names = own.union(by_alias).distinct()
    tried = models.select("model").distinct().select("model", F.explode(candidates(F.col("model"))).alias("name"))
    return tried.join(names, "name", "left_semi").select("model").distinct()


def put_price(custom: DataFrame, price: DataFrame) -> DataFrame:
    """Custom prices with those of ``price`` (model and rates) in place of older ones; a model without a name is refused by leaving it out."""
    new = price.withColumn("model", price_name(F.col("model"))).where("model <> ''")
    return custom.join(new.select("model"), "model", "left_anti").unionByName(new, allowMissingColumns=True)


def drop_price(custom: DataFrame, aliases: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Custom prices and aliases without those of ``models``: an alias of a dropped price goes with it, if that price was there."""
    gone = custom.join(models.select(price_name(F.col("model")).alias("model")).distinct(), "model", "left_semi").select("model")
    left = aliases.withColumn("__target", price_name(F.col("target"))).join(gone.withColumnRenamed("model", "__target"), "__target", "left_anti").drop("__target")
    return custom.join(gone, "model", "left_anti"), left


def put_alias(aliases: DataFrame, new: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases with those of ``new`` (source, target) in place of older ones, and the refused ones with a reason: no name, the same name, or a target without a price."""
    named = new.select(price_name(F.coalesce("source", F.lit(""))).alias("source"), price_name(F.coalesce("target", F.lit(""))).alias("target"))
    known = prices.select(F.col("model").alias("target"), F.lit(True).alias("__priced")).distinct()
    reason = F.when(F.col("source") == "", "no_source").when(F.col("target") == "", "no_target").when(F.col("source") == F.col("target"), "same").when(F.col("__priced").isNull(), "no_price")
    judged = named.join(known, "target", "left").withColumn("reason", reason)
    good = judged.where("reason is null").groupBy("source").agg(F.min("target").alias("target"))
    kept = aliases.select("source", "target").join(good.select("source"), "source", "left_anti")
    return kept.unionByName(good), judged.where("reason is not null").select("source", "target", "reason")


def reprice(facts: DataFrame, models: DataFrame, prices: DataFrame) -> DataFrame:
    """Facts of the given models with costs by ``prices``; the others keep what they have. Columns stay as they are."""
    marked = facts.join(models.select("model", F.lit(True).alias("__hit")), "model", "left")
    again = with_cost(marked.where("__hit").drop("cost", "cost_quality"), prices)
    return marked.where("__hit is null").select(*facts.columns).unionByName(again.select(*facts.columns))


def reprice_stored(path: str, models: DataFrame, prices: DataFrame, partition: str = "day") -> int:
    """Price stored facts anew, writing only the partitions that have one of the models; gives their number."""
    spark = models.sparkSession
    facts = spark.read.parquet(path)
    hit = facts.join(models.select("model").distinct(), "model", "left_semi").select(partition).distinct().checkpoint()
    reached = hit.count()
    if reached:
        # a row a partition, fewer than the driver lists: found at run time, they reach the scan; each is written beside the old one and put in its place when it is done
        touched = facts.join(F.broadcast(hit), partition, "left_semi")
        reprice(touched, models, prices).select(*facts.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return reached


def stale_windows(windows: DataFrame, days: DataFrame, today: date, now: datetime) -> DataFrame:
    """What a write to some days (column day) does to stored results: their key, state and expires_at.

    A result (key, first_day, last_day, tolerance_ms, expires_at) over a window that has a written day is ``stale``, and so is one without
    any bound; a missing bound is open. One that tolerates some delay ``expires`` instead if only today was written.
    Closed windows meet the written days by day; open ones only have to reach the last or first of these.
    """
    written = days.select("day").where("day is not null").distinct()
    ends = written.agg(F.min("day").alias("__from"), F.max("day").alias("__to"), F.min(F.col("day") == F.lit(today)).alias("__today"), F.lit(0).alias("__one"))  # one row
    closed = windows.where("first_day is not null and last_day is not null and first_day <= last_day")
    hits = closed.select("key", F.explode(F.sequence("first_day", "last_day")).alias("day")).join(written, "day", "left_semi").select("key").distinct().withColumn("__hit", F.lit(True))
    at = windows.withColumn("__one", F.lit(0)).join(F.broadcast(ends), "__one").join(hits, "key", "left")
    upto = F.coalesce(F.col("first_day") <= F.col("__to"), F.lit(True)) & F.coalesce(F.col("last_day") >= F.col("__from"), F.lit(True))
    hit = F.when(F.col("first_day").isNotNull() & F.col("last_day").isNotNull(), F.coalesce("__hit", F.lit(False))).otherwise(upto)
    grace = F.lit(now).cast("timestamp") + F.make_dt_interval(secs=F.col("tolerance_ms") / 1000)
    patient = (F.coalesce("tolerance_ms", F.lit(0)) > 0) & F.col("__today")
    state = F.when(F.col("__from").isNull(), "kept").when(patient, "expires").when(hit, "stale").otherwise("kept")
    return at.select("key", state.alias("state"), F.when(state == "expires", F.least("expires_at", grace)).otherwise(F.col("expires_at")).alias("expires_at"))


