"""From usage events to stored facts: folding, deduplication, fingerprints, scope replacement.

A scope is (day, hour, provider). Replacing scopes is an anti-join and a union, so it is idempotent and
order-free; rows of scopes that a scan did not touch stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCOPE = ["day", "hour", "provider_id"]
COUNTS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]


def token_number(c: Column) -> Column:
    """Non-negative whole number; anything else is 0."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < 9.2e18), F.floor(x + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def model_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def usage_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in cols])


def merged_trace(c: str) -> Column:
    """Of the distinct non-empty values none, the only one, or a digest of all."""
    values = F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return F.when(F.size(values) == 0, "").when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.sha2(F.array_join(values, "|"), 256))


def fold_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Sum events into items; the quality is exact only if all events are."""
    present = [c for c in COUNTS if c in events.columns]
    folded = events.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in present], F.count("*").alias("events"))
    return folded.withColumn("total_tokens", sum((F.col(c) for c in present if c != "reasoning_tokens"), F.lit(0)))


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row of each key; rows with a null key all stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | null).drop("__n")


def canonical_row(fields: dict[str, str], omit_missing: bool = False) -> Column:
    """JSON object of a row with its keys in order and no blanks; what is missing is null, or left out. Kinds are text or number."""
    def value(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "number":
            return F.coalesce(c.cast("string"), F.lit("null"))
        # a text in an array of its own is written with all that JSON escapes, then taken out of the brackets
        inside = F.to_json(F.array(c.cast("string")))
        return F.when(c.isNull(), "null").otherwise(F.substring(inside, F.lit(2), F.length(inside) - 2))

    parts = [F.when(F.lit(not omit_missing) | F.col(n).isNotNull(), F.concat(F.lit(f'"{n}":'), value(n, k))) for n, k in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def bucket_fingerprints(items: DataFrame, scope: list[str], fields: dict[str, str], omit_missing: bool = False) -> DataFrame:
    """Rows, tokens and digest of each bucket; a bucket's rows are one cell, so a bucket is an hour or a day of one provider. Days leave out the hour and what is missing."""
    rows = F.array_join(F.array_sort(F.collect_list(canonical_row(fields, omit_missing))), ",")
    return items.groupBy(*scope).agg(F.count("*").alias("row_count"), F.sum("total_tokens").alias("total_tokens"), F.sha2(F.concat(F.lit("["), rows, F.lit("]")), 256).alias("fingerprint"))


def replace_scopes(stored: DataFrame, incoming: DataFrame, scope: list[str] = SCOPE, touched: DataFrame | None = None) -> DataFrame:
    """Stored rows of touched scopes give way to the incoming ones; touched scopes without rows become empty."""
    touched = (incoming if touched is None else touched).select(*scope).distinct()
    return stored.join(touched, scope, "left_anti").unionByName(incoming.join(touched, scope, "left_semi"), allowMissingColumns=True)


def derive_daily(hourly: DataFrame, keys: list[str], zero_cost_is_missing: bool = True) -> DataFrame:
    """Sum hours to days; a cost that sums to 0 counts as missing unless told otherwise."""
    out = [F.sum(c).alias(c) for c in (*COUNTS, "total_tokens") if c in hourly.columns]
    if "cost" in hourly.columns:
        cost = F.sum(F.coalesce("cost", F.lit(0.0)))
        out.append((F.nullif(cost, F.lit(0.0)) if zero_cost_is_missing else cost).alias("cost"))
    return hourly.groupBy(*keys).agg(*out, F.lit(True).alias("hourly_derived"))


def compare_buckets(client: DataFrame, server: DataFrame, scope: list[str]) -> DataFrame:
    """missing (on the server), different, matched, or server_only."""
    c, s = client.select(*scope, F.col("fingerprint").alias("mine")), server.select(*scope, F.col("fingerprint").alias("theirs"))
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "server_only").when(F.col("mine") == F.col("theirs"), "matched").otherwise("different")
    return c.join(s, scope, "full").select(*scope, status.alias("status"))


def writer_precedence(plugin: DataFrame, client_hourly: DataFrame, client_daily: DataFrame) -> DataFrame:
    """Rows of a plugin that no client claims, by the hour or by the day."""
    free = plugin.join(client_hourly.select(*SCOPE).distinct(), SCOPE, "left_anti")
    return free.join(client_daily.select("day", "provider_id").distinct(), ["day", "provider_id"], "left_anti")


def preserve_failed(previous: DataFrame, current: DataFrame, failed: list[str]) -> DataFrame:
    """Current rows, and the previous rows of providers that failed to read."""
    return current.where(~F.col("provider_id").isin(failed)).unionByName(previous.where(F.col("provider_id").isin(failed)), allowMissingColumns=True)
