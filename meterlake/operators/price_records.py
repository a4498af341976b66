"""Price records as they come: custom ones, a catalogue's, and what is shown of them. Prices here are per token until they are made public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators.pricing import QUALITIES, missing_prices, price_name, rounded

#: Names of a record's prices, by what they are called per million tokens, per token, and in a catalogue.
NAMES = {
    "input_price": ("inputCostPerMTok", "inputCostPerToken", "input_cost_per_token"), "output_price": ("outputCostPerMTok", "outputCostPerToken", "output_cost_per_token"),
    "cache_read_price": ("cacheReadCostPerMTok", "cacheReadCostPerToken", "cache_read_input_token_cost"), "cache_write_price": ("cacheWriteCostPerMTok", "cacheWriteCostPerToken", "cache_creation_input_token_cost"),
}


def _amount(text: Column) -> Column:
    """A number of 0 or more; anything else is null."""
    n = text.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (n >= 0) & (n < float("inf")), n)


def normalized(records: DataFrame, json: str = "record", source: str = "custom") -> DataFrame:
    """Prices of JSON records: the first of the names that is there counts, those per million tokens are divided if that name is there at all; a
    bad or negative price is 0, and reasoning has no price of its own."""
    def price(million: str, token: str, plain: str) -> Column:
        per_million = F.get_json_object(json, f"$.{million}")
        value = F.coalesce(_amount(F.coalesce(per_million, F.get_json_object(json, f"$.{token}"), F.get_json_object(json, f"$.{plain}"))), F.lit(0.0))
        there = F.array_contains(F.json_object_keys(json), million)
        return F.when(F.coalesce(there, F.lit(False)), value / 1e6).otherwise(value)

    text = lambda name, default: F.coalesce(F.nullif(F.get_json_object(json, f"$.{name}"), F.lit("")), F.lit(default))
    return records.select(price_name(F.get_json_object(json, "$.model")).alias("model"), *[price(*names).alias(c) for c, names in NAMES.items()], F.lit(0.0).alias("reasoning_price"), text("source", source).alias("source"), text("updatedAt", "").alias("updated_at"))


def catalogue(models: DataFrame, json: str = "record", fetched: str = "") -> DataFrame:
    """Prices of a catalogue's models (JSON with id, name, pricing): those without a prompt and a completion price are left out; a missing cache price is the prompt's."""
    at = lambda path: _amount(F.get_json_object(json, f"$.{path}"))
    prompt, completion = at("pricing.prompt"), at("pricing.completion")
    name = F.coalesce(F.nullif(F.get_json_object(json, "$.id"), F.lit("")), F.get_json_object(json, "$.canonical_slug"), F.lit(""))
    longest = F.coalesce(F.nullif(at("context_length"), F.lit(0.0)), at("top_provider.context_length"), F.lit(0.0))
    return models.where(prompt.isNotNull() | completion.isNotNull()).select(
        price_name(name).alias("model"), F.coalesce(F.get_json_object(json, "$.name"), F.lit("")).alias("display_name"), F.coalesce(prompt, F.lit(0.0)).alias("input_price"), F.coalesce(completion, F.lit(0.0)).alias("output_price"),
        F.coalesce(at("pricing.input_cache_read"), prompt, F.lit(0.0)).alias("cache_read_price"), F.coalesce(at("pricing.input_cache_write"), prompt, F.lit(0.0)).alias("cache_write_price"), F.lit(0.0).alias("reasoning_price"),
        longest.cast("long").alias("max_input_tokens"), F.coalesce(at("top_provider.max_completion_tokens"), F.lit(0.0)).cast("long").alias("max_output_tokens"), F.lit("openrouter").alias("source"), F.lit(fetched).alias("updated_at"),
    )


def public(prices: DataFrame) -> DataFrame:
    """Prices per million tokens with six digits."""
    rates = [rounded(F.coalesce(c, F.lit(0.0)) * 1e6).alias(c.replace("price", "rate")) for c in NAMES]
    return prices.select("model", *rates, F.coalesce(F.nullif("source", F.lit("")), F.lit("builtin")).alias("source"))


def listed(remote: DataFrame, custom: DataFrame, aliases: DataFrame, costed: DataFrame) -> DataFrame:
    """All that a price page lists, by kind: remote and custom prices, aliases (model, target) and models in use without a price (by tokens)."""
    shown = public(remote).withColumn("kind", F.lit("remote")).unionByName(public(custom).withColumn("kind", F.lit("custom")))
    named = aliases.select(price_name(F.col("source")).alias("model"), price_name(F.col("target")).alias("target"), F.lit("alias").alias("kind"))
    missing = missing_prices(costed).select("model", "total_tokens", F.lit("missing").alias("kind"))
    return shown.unionByName(named, allowMissingColumns=True).unionByName(missing, allowMissingColumns=True)


def to_rates(prices: DataFrame) -> DataFrame:
    """What the resolver of prices takes: rates per million tokens."""
    return prices.select("model", *[(F.col(c) * 1e6).alias(c.replace("price", "rate")) for c in NAMES])


def known_sum(*columns: Column) -> Column:
    """The sum of what is known; null if nothing is."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))


def summed_again(rows: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Rows of costs that were summed before (cost, cost_quality, missing_tokens) summed to fewer keys: the cost is null unless a row has one, and the worst quality of rows that
    have a cost, or lack a price, counts."""
    rank = F.when((F.col("missing_tokens") > 0) | (F.col("cost_quality") == QUALITIES[2]), 2).when(F.col("cost").isNotNull() & (F.col("cost_quality") == QUALITIES[1]), 1).when(F.col("cost").isNotNull(), 0)
    quality = F.element_at(F.array(*map(F.lit, QUALITIES)), F.max(rank) + 1)
    return rows.groupBy(*keys).agg(rounded(F.sum("cost"), digits).alias("cost"), F.sum("missing_tokens").alias("missing_tokens"), F.coalesce(quality, F.lit("")).alias("cost_quality"))
