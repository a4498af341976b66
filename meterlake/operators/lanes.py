"""Shares, their lanes and claims: what is left of budgets, slots and keys.

A share (share_id, state, title, models, tz_minutes, last_heartbeat, policy, lanes) has nested lanes, which are exploded once; a share without lanes has one by
its policy. Claims and ledger rows are summed by lane or key first and then joined, so a lane with very many claims is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators.quota import grid_window

DEFAULT = "default"
ONLINE_SECONDS = 120
WINDOWS = "array<struct<start_m:int,end_m:int>>"
LANE = f"struct<id:string,title:string,models:array<string>,state:string,budget_tokens:bigint,max_claims:int,unit:string,n:int,schedule:{WINDOWS}>"
SHARES = f"share_id bigint, state string, title string, models array<string>, tz_minutes int, last_heartbeat timestamp, policy struct<budget:bigint,max_claims:int,key_max_tokens:bigint,key_auto:boolean,key_concurrency:int>, lanes array<{LANE}>"


def _now(now) -> Column:
    return F.lit(now).cast("timestamp")


def lane_window(now, unit: Column, n: Column, tz_minutes: Column) -> Column:
    """Number of a lane's current window; days and weeks are those of its owner's zone."""
    at = _now(now)
    return F.when(unit == "hour", grid_window(at, "hour", n)).when(unit == "week", grid_window(at, "week", n, tz_minutes)).otherwise(grid_window(at, "day", n, tz_minutes))


def effective_lanes(shares: DataFrame, now) -> DataFrame:
    """One row for each lane: share columns, lane, its current window, whether its schedule is open now."""
    p = F.col("policy")
    models = F.when(F.size("models") > 0, F.col("models")).otherwise(F.array(F.lit("*")))
    only = F.struct(F.lit(DEFAULT).alias("id"), F.coalesce("title", F.lit(DEFAULT)).alias("title"), models.alias("models"), F.lit("active").alias("state"), p["budget"].alias("budget_tokens"), p["max_claims"].alias("max_claims"), F.lit("day").alias("unit"), F.lit(1).alias("n"), F.array().cast(WINDOWS).alias("schedule")).cast(LANE)
    lanes = F.when(F.size("lanes") > 0, F.col("lanes")).otherwise(F.array(only))
    each = shares.select("share_id", F.col("state").alias("share_state"), "tz_minutes", "last_heartbeat", "policy", F.explode(lanes).alias("lane"))
    zone = F.coalesce("tz_minutes", F.lit(0))
    minute = F.pmod(F.floor(F.unix_seconds(_now(now)) / 60) + zone, F.lit(1440))
    inside = F.exists("lane.schedule", lambda w: F.when(w["start_m"] < w["end_m"], (minute >= w["start_m"]) & (minute < w["end_m"])).otherwise((minute >= w["start_m"]) | (minute < w["end_m"])))
    opened = F.coalesce(F.size("lane.schedule") <= 0, F.lit(True)) | F.coalesce(inside, F.lit(False))
    return each.withColumn("window", lane_window(now, F.col("lane.unit"), F.greatest(F.coalesce("lane.n", F.lit(1)), F.lit(1)), zone)).withColumn("scheduled", opened)


def active_claims(claims: DataFrame, now) -> DataFrame:
    """Claims that hold a slot: valid and not run out; those without a lane are of the default one."""
    live = claims.where((F.col("state") == "valid") & (F.col("expires_at") > _now(now)))
    return live.withColumn("lane_id", F.coalesce(F.nullif("lane_id", F.lit("")), F.lit(DEFAULT)))


def lane_views(shares: DataFrame, claims: DataFrame, ledger: DataFrame, now) -> DataFrame:
    """What each lane has left: slots, tokens of its current window, and whether it is open. ``ledger``: share_id, lane_id, window, tokens; other windows' tokens do not count."""
    lanes = effective_lanes(shares, now).withColumn("lane_id", F.col("lane.id"))
    held = active_claims(claims, now).groupBy("share_id", "lane_id").agg(F.count("*").alias("held"))
    spent = ledger.groupBy("share_id", "lane_id", "window").agg(F.sum("tokens").alias("tokens"))
    joined = lanes.join(held, ["share_id", "lane_id"], "left").join(spent, ["share_id", "lane_id", "window"], "left")
    settled, budget, active = F.coalesce("tokens", F.lit(0)), F.col("lane.budget_tokens"), F.col("lane.state") == "active"
    return joined.select(
        "share_id", "lane_id", "window", budget.alias("budget_tokens"), settled.alias("settled_tokens"), F.greatest(budget - settled, F.lit(0)).alias("available_tokens"),
        (active & F.col("scheduled") & (settled >= budget)).alias("exhausted"), (active & F.col("scheduled")).alias("open"), F.greatest(F.col("lane.max_claims") - F.coalesce("held", F.lit(0)), F.lit(0)).cast("long").alias("slots_left"),
    )


def share_views(shares: DataFrame, claims: DataFrame, now) -> DataFrame:
    """Slots left of each share, over all of its lanes, and whether its owner was heard of lately."""
    held = active_claims(claims, now).groupBy("share_id").agg(F.count("*").alias("held"))
    online = F.unix_millis(_now(now)) - F.coalesce(F.unix_millis("last_heartbeat"), F.lit(0)) < ONLINE_SECONDS * 1000
    left = F.greatest(F.col("policy.max_claims") - F.coalesce("held", F.lit(0)), F.lit(0)).cast("long")
    return shares.join(held, "share_id", "left").select("share_id", "state", left.alias("slots_left"), online.alias("online"))


def key_cap(policy: Column, lane: Column) -> Column:
    """Most tokens of one key in a window: an even share of the lane, or the policy's number within the lane's budget."""
    budget = F.coalesce(lane["budget_tokens"], F.lit(1))
    fair = F.greatest(F.floor(F.greatest(budget, F.lit(1)) / F.greatest(F.coalesce(lane["max_claims"], F.lit(1)), F.lit(1))), F.lit(1))
    fixed = F.least(F.coalesce(F.nullif(policy["key_max_tokens"], F.lit(0)), F.lit(1)), budget)
    return F.when(F.coalesce(policy["key_auto"], F.lit(False)), fair).otherwise(fixed).cast("long")


def claim_views(claims: DataFrame, shares: DataFrame, key_ledger: DataFrame, now) -> DataFrame:
    """Each claim with its lane as it is now, its key's cap and what the key was charged in the lane's current window.

    ``key_ledger``: share_id, lane_id, key_id, window, charged. A claim whose share or lane is gone has no cap; a valid one that has run out is expired.
    """
    lanes = effective_lanes(shares, now).select("share_id", F.col("lane.id").alias("lane_id"), "lane", "policy", "window")
    own = claims.withColumn("lane_id", F.coalesce(F.nullif("lane_id", F.lit("")), F.lit(DEFAULT))).join(lanes, ["share_id", "lane_id"], "left")
    spent = key_ledger.groupBy("share_id", "lane_id", "key_id", "window").agg(F.sum("charged").alias("charged"))
    joined = own.join(spent, ["share_id", "lane_id", "key_id", "window"], "left")
    state = F.when((F.col("state") == "valid") & (F.col("expires_at") <= _now(now)), "expired").otherwise(F.col("state"))
    cap, charged = F.when(F.col("lane").isNotNull(), key_cap(F.col("policy"), F.col("lane"))), F.when(F.col("lane").isNotNull(), F.coalesce("charged", F.lit(0)))
    return joined.select("key_id", "share_id", "lane_id", state.alias("state"), F.col("lane.state").alias("lane_state"), cap.alias("key_max_tokens"), charged.alias("key_charged_tokens"), F.when(cap.isNotNull(), F.greatest(cap - charged, F.lit(0))).alias("key_left_tokens"))
