"""Fixed-grid quota windows, peak multipliers, late buckets and at-most-once application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def grid_window(ts: Column, unit: str, n: int, offset_minutes: int = 0) -> Column:
    """Number of the n-hour (epoch aligned), n-day or n-week (Monday aligned) window of a timestamp."""
    day = F.unix_date(F.to_date(ts + F.make_dt_interval(mins=F.lit(offset_minutes))))
    if unit == "hour":
        return F.floor(F.unix_seconds(ts.cast("timestamp")) / (n * 3600)).cast("long")
    if unit == "day":
        return F.floor(day / n).cast("long")
    if unit == "week":
        return F.floor(F.floor((day + 3) / 7) / n).cast("long")
    raise ValueError(f"unknown unit {unit}")


def in_minutes(minute: Column, windows: list[tuple[int, int]]) -> Column:
    """Whether a minute of the day is in one of the windows; one whose end is not after its start wraps midnight."""
    out = F.lit(False)
    for a, z in windows:
        out = out | (((minute >= a) & (minute < z)) if a < z else ((minute >= a) | (minute < z)))
    return out


def charged(ts: Column, tokens: Column, peaks: list[tuple[int, int]], multiplier: float) -> Column:
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(in_minutes(minute, peaks), F.ceil(tokens * max(1.0, multiplier))).otherwise(tokens).cast("long")


def late_split(deltas: DataFrame, current: Column, key: str) -> DataFrame:
    """Tokens of closed windows count for the lifetime alone."""
    return deltas.groupBy(key).agg(F.sum("tokens").alias("lifetime_tokens"), F.coalesce(F.sum(F.when(current, F.col("tokens"))), F.lit(0)).alias("window_tokens"))


def apply_once(deltas: DataFrame, last: DataFrame, key: str = "key_id") -> DataFrame:
    """Deltas whose sequence number is beyond the key's last; buckets of one round share a number and all count."""
    return deltas.join(last.select(key, "last_seq"), key, "left").where(F.col("seq") > F.coalesce("last_seq", F.lit(-1))).drop("last_seq")


def bursts(events: DataFrame, key: str, gap_seconds: int = 1) -> DataFrame:
    """Number of the burst of each event: a longer pause begins a new one."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    begins = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order) <= gap_seconds * 1_000_000, 0).otherwise(1)
    return events.withColumn("begins", begins).withColumn("burst", F.sum("begins").over(order)).drop("begins")


def quota_view(lanes: DataFrame, used: DataFrame, key: str = "lane_id") -> DataFrame:
    """What is left of each lane's budget."""
    joined = lanes.join(used, key, "left")
    left = F.greatest(F.col("budget_tokens") - F.coalesce("used_tokens", F.lit(0)), F.lit(0))
    return joined.select(key, "budget_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), left.alias("available"), (left == 0).alias("exhausted"))


def rolled_ledger(usage: DataFrame, key: str, window: Column) -> DataFrame:
    """Each key's last window with its tokens, and the tokens of all windows: a new window begins at 0."""
    by = usage.groupBy(key, window.alias("window")).agg(F.sum("total_tokens").alias("t"))
    return by.groupBy(key).agg(F.max_by("t", "window").alias("window_tokens"), F.max("window").alias("last"), F.sum("t").alias("lifetime_tokens")).withColumnRenamed("last", "window")


def minutes_until_flip(minute: Column, windows: list[tuple[int, int]]) -> Column:
    """Minutes until a schedule opens or closes; 1440 if it never does within a day."""
    now = in_minutes(minute, windows)
    later = F.filter(F.sequence(F.lit(1), F.lit(1439)), lambda m: in_minutes((minute + m) % 1440, windows) != now)
    return F.coalesce(F.get(later, 0), F.lit(1440))


def gate(schedule: list[tuple[int, int]] | None = None) -> Column:
    """Why a request is turned away, the first reason that applies, or ``pass``.

    Reads lane_state (null: no such lane), lane_models, model, minute, lane_budget, lane_settled, key_cap, key_charged,
    key_concurrency and key_inflight; a limit of 0 is none.
    """
    def reached(limit: str, value: str) -> Column:
        return (F.col(limit) > 0) & (F.col(value) >= F.col(limit))

    named = (F.size("lane_models") > 0) & ~F.array_contains("lane_models", "*") & ~F.array_contains("lane_models", F.col("model"))
    out = F.when(F.col("lane_state").isNull(), "lane_removed").when(F.col("lane_state") == "paused", "lane_paused").when(F.col("lane_state") != "active", "lane_suspended")
    out = out.when(F.col("model").isNotNull() & named, "model_not_in_lane")
    if schedule:
        out = out.when(~in_minutes(F.col("minute"), schedule), "lane_closed")
    return out.when(reached("lane_budget", "lane_settled"), "lane_exhausted").when(reached("key_cap", "key_charged"), "key_cap").when(reached("key_concurrency", "key_inflight"), "concurrency").otherwise("pass")


def merged_deltas(confirmed: DataFrame, inflight: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Sums by key of what is confirmed and what is on its way; restoring it twice from both gives the same."""
    both = confirmed.select(key, *cols).unionByName(inflight.select(key, *cols))
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols], F.count("*").alias("deltas"))


def online(beats: DataFrame, key: str, now, within_seconds: int = 120, ts: str = "ts") -> DataFrame:
    """Whether each key's last heartbeat is recent."""
    return beats.groupBy(key).agg((F.max(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(within_seconds))).alias("online"))


def unexpired(claims: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    return claims.where(F.col(expires).isNull() | (F.col(expires) > F.lit(now)))


def claim_rates(claims: DataFrame, every: str = "1 minute", most: int = 6, key: str = "key_id", ts: str = "ts") -> DataFrame:
    """Claims of each key in each interval, and whether they are within the limit."""
    by = claims.groupBy(key, F.window(ts, every).alias("w")).agg(F.count("*").alias("claims"))
    return by.select(key, F.col("w.start").alias("minute"), "claims", (F.col("claims") <= most).alias("allowed"))


def recent(usage: DataFrame, today, days: int = 35) -> DataFrame:
    """Rows of the last days; older history is left to what is stored."""
    return usage.where(F.col("day") > F.date_sub(F.lit(today), days))
