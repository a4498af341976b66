"""Prices and costs. Prices are per million tokens; costs are summed as doubles and rounded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Provider prefixes under which a model's price may be listed.
PREFIXES = ("openai", "anthropic", "google", "meta-llama", "qwen", "deepseek", "mistralai")
QUALITIES = ("exact_price", "estimated_price", "unknown_price")
RATES = ["input_rate", "output_rate", "cache_read_rate", "cache_write_rate"]


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounds half up; a hair is added so that a sum that ends in 5 rounds alike in whatever order it was added."""
    return F.round(c + 1e-10, digits)


def price_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^~", ""), "^openrouter/", "")


def price_map(remote: DataFrame, custom: DataFrame, aliases: DataFrame) -> DataFrame:
    """Custom prices go over remote ones; an alias (source, target) goes over both if its target has a price. One aggregate decides all three:
    by kind, then by what an alias' target would have, then the least rates."""
    both = remote.select("model", *RATES, F.lit(-1).alias("own")).unionByName(custom.select("model", *RATES, F.lit(-2).alias("own"))).withColumn("model", price_name(F.col("model")))
    a = aliases.select(price_name(F.col("source")).alias("source"), price_name(F.col("target")).alias("target")).where("source <> target")
    named = a.join(both, a.target == both.model).select(F.col("source").alias("model"), F.lit(-3).alias("kind"), "own", *RATES)
    rows = both.select("model", F.col("own").alias("kind"), "own", *RATES).unionByName(named)
    return rows.groupBy("model").agg(F.min(F.struct("kind", "own", *RATES)).alias("r")).select("model", *[f"r.{c}" for c in RATES])


def candidates(model: Column) -> Column:
    """The model itself, then without its provider, then under each known provider: whole names first, bare ones after."""
    name = price_name(model)
    bare = F.element_at(F.split(name, "/"), -1)
    return F.array(name, bare, *[F.concat(F.lit(f"{p}/"), n) for n in (name, bare) for p in PREFIXES])


def with_cost(usage: DataFrame, prices: DataFrame, model_col: str = "model", summed: bool = False) -> DataFrame:
    """Adds cost (null without a price) and cost_quality. Models are resolved once each, not row by row; ``summed`` says that ``usage`` has been summed to few rows that all
    differ, which are then resolved themselves, so that they are made once."""
    if summed:
        tried = usage.select("*", F.posexplode(candidates(F.col(model_col))).alias("at", "__name"))
        met = tried.join(prices.select(F.col("model").alias("__priced"), *RATES), F.col("__name") == F.col("__priced"), "left")
        hit = F.when(F.col("__priced").isNotNull(), F.struct("at", *RATES))
        joined = met.groupBy(*usage.columns).agg(F.min(hit).alias("__hit")).select(*usage.columns, "__hit.*")
    else:
        models = usage.select(F.col(model_col).alias("__model")).distinct()
        tried = models.select("__model", F.posexplode(candidates(F.col("__model"))).alias("at", "model"))
        found = tried.join(prices, "model").groupBy("__model").agg(F.min(F.struct("at", *RATES)).alias("r")).select("__model", "r.*")
        joined = usage.join(found, F.col(model_col).eqNullSafe(F.col("__model")), "left").drop("__model")
    cost = (
        F.col("input_tokens") * F.col("input_rate")
        + F.col("output_tokens") * F.col("output_rate")
        + F.col("cache_read_tokens") * F.coalesce("cache_read_rate", "input_rate")
        + F.col("cache_write_tokens") * F.coalesce("cache_write_rate", "input_rate")
    ) / 1e6
    kind = F.when(F.col("at").isNull(), QUALITIES[2]).when(F.col("at") == 0, QUALITIES[0]).otherwise(QUALITIES[1])
    return joined.withColumn("cost", cost).withColumn("cost_quality", kind).drop("at", *RATES)


def cost_summary(costed: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Known cost (null if every row lacks a price), tokens without a price, worst quality."""
    worst = F.max(F.when(F.col("cost_quality") == QUALITIES[2], 2).when(F.col("cost_quality") == QUALITIES[1], 1).otherwise(0))
    return costed.groupBy(*keys).agg(
        rounded(F.sum("cost"), digits).alias("cost"),
        F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col("total_tokens"))), F.lit(0)).alias("missing_tokens"),
        F.element_at(F.array(*map(F.lit, QUALITIES)), worst + 1).alias("cost_quality"),
    )


def missing_prices(costed: DataFrame) -> DataFrame:
    return costed.where("cost is null").groupBy("model").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("rows"), F.max("day").alias("last_seen"))
