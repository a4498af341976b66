"""Figures derived from usage aggregates: levels, rhythm, splits, deltas, overviews and pages.

Every function aggregates first and puts windows over what is left; windows over a whole result
(`over()` without keys) run only after such an aggregate. Nulls count as no usage.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.operators.analytics import ranked, ratio

TOTAL = "total_tokens"
NIGHT, EVENING, WORK = (0, 360), (1080, 1440), (570, 1110)


def _total() -> Column:
    return F.coalesce(F.sum(TOTAL), F.lit(0)).alias(TOTAL)


def day_totals(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys, "day").agg(_total())


def quartile_levels(totals: DataFrame, *keys: str) -> DataFrame:
    """Level 0-4 of each value among its key's non-zero ones: nearest-rank quartiles, or fourths of the greatest below eight."""
    used = F.when(F.col(TOTAL) > 0, F.col(TOTAL))
    of_key = Window.partitionBy(*keys)
    x = totals.withColumn("n", F.count(used).over(of_key)).withColumn("most", F.max(used).over(of_key))
    x = x.withColumn("r", F.row_number().over(of_key.orderBy(F.asc_nulls_last(used))))
    for i, p in enumerate((0.25, 0.5, 0.75)):
        x = x.withColumn(f"q{i}", F.max(F.when(F.col("r") == F.floor(F.lit(p) * (F.col("n") - 1)) + 1, used)).over(of_key))
    quartile = 1 + sum((F.col(TOTAL) > F.col(f"q{i}")).cast("int") for i in range(3))
    linear = F.least(F.lit(4), F.ceil(4 * F.col(TOTAL) / F.col("most")).cast("int"))
    level = F.when(F.coalesce(F.col(TOTAL), F.lit(0)) <= 0, 0).when(F.col("n") < 8, linear).otherwise(quartile)
    return x.select(*keys, "day", TOTAL, level.cast("int").alias("level"))


def heat_levels(totals: DataFrame, levels: int = 4) -> DataFrame:
    """Shade of each value against the greatest: fourths up to four levels, a square-root scale beyond."""
    share = F.col(TOTAL) / F.max(TOTAL).over(Window.partitionBy())
    fourths = F.when(share > 0.75, 4).when(share > 0.5, 3).when(share > 0.25, 2).otherwise(1)
    rooted = F.greatest(F.lit(1), F.least(F.lit(levels), F.ceil(F.sqrt(share) * levels).cast("int")))
    return totals.withColumn("level", F.when(F.col(TOTAL) > 0, fourths if levels <= 4 else rooted).otherwise(0).cast("int"))


def overlap(hour: Column, span: tuple[int, int]) -> Column:
    """Part of an hour that lies in a span of minutes of the day; a span may cross midnight."""
    start, end = span
    parts = [(start, end)] if start < end else [(start, 1440), (0, end)]
    return sum(F.greatest(F.lit(0), F.least(F.lit(z), hour * 60 + 60) - F.greatest(F.lit(a), hour * 60)) for a, z in parts) / 60


def rhythm(hourly: DataFrame, *keys: str, work: tuple[int, int] = WORK) -> DataFrame:
    """Per key: peak hour (the earliest among equals), shares of night, evening and work time, and the first two fitting tags."""
    by_hour = hourly.groupBy(*keys, "hour").agg(_total())
    t, h = F.col(TOTAL), F.col("hour")
    parts = {n: F.sum(t * overlap(h, s)).alias(n) for n, s in (("night", NIGHT), ("evening", EVENING), ("work", work))}
    out = by_hour.groupBy(*keys).agg(_total(), F.max_by("hour", F.struct(t, -h)).alias("peak_hour"), *parts.values())
    share = {n: ratio(F.col(n), t, 4) for n in parts}
    tags = F.filter(F.array(*[F.when(share[n] >= least, F.lit(n)) for n, least in (("night", 0.20), ("evening", 0.35), ("work", 0.60))]), lambda x: x.isNotNull())
    return out.select(*keys, F.when(t > 0, F.col("peak_hour")).otherwise(-1).cast("int").alias("peak_hour"), *[c.alias(f"{n}_share") for n, c in share.items()], F.array_join(F.slice(tags, 1, 2), " ").alias("tags"))


def weekday_rhythm(usage: DataFrame) -> DataFrame:
    by = usage.groupBy(F.weekday("day").cast("int").alias("weekday")).agg(_total())
    everything = Window.partitionBy()
    return by.select("weekday", TOTAL, ratio(F.col(TOTAL), F.sum(TOTAL).over(everything)).alias("share"), (F.col("weekday") == F.max_by("weekday", F.struct(F.col(TOTAL), -F.col("weekday"))).over(everything)).alias("is_peak"))


def week_split(usage: DataFrame, *keys: str) -> DataFrame:
    """Whole percents of workdays and weekends, and what kind of week that is."""
    off = F.weekday("day") >= 5
    out = usage.groupBy(*keys).agg(_total(), F.coalesce(F.sum(F.when(~off, F.col(TOTAL))), F.lit(0)).alias("w"))
    workday = F.when(F.col(TOTAL) > 0, F.floor(F.col("w") * 100.0 / F.col(TOTAL) + 0.5)).otherwise(0).cast("long")
    weekend = F.when(F.col(TOTAL) > 0, 100 - workday).otherwise(0).cast("long")
    return out.select(*keys, workday.alias("workday_percent"), weekend.alias("weekend_percent"), F.when(workday >= 80, "workday").when(weekend >= 35, "weekend").otherwise("balanced").alias("archetype"))


def period_delta(usage: DataFrame, key: str, current: tuple[date, date], previous: tuple[date, date]) -> DataFrame:
    """Whole percent by which a key's usage changed; none if either period is empty or nothing changed."""

    def within(span):
        return F.coalesce(F.sum(F.when(F.col("day").between(*map(F.lit, span)), F.col(TOTAL))), F.lit(0))

    x = usage.groupBy(key).agg(within(current).alias("tokens"), within(previous).alias("previous_tokens"))
    cur, prev = F.col("tokens"), F.col("previous_tokens")
    percent = F.floor((cur - prev) * 100.0 / prev + 0.5).cast("long")
    return x.withColumn("delta_percent", F.when((prev > 0) & (cur > 0) & (cur != prev), F.when(percent == -100, -99).otherwise(percent)))


def month_over_month(usage: DataFrame, key: str, before: date, top: int = 8) -> DataFrame:
    """The last two complete months before ``before`` for the ``top`` keys of the later one."""
    last = before.replace(day=1) - timedelta(days=1)
    spans = [(last.replace(day=1), last)]
    spans.append(((spans[0][0] - timedelta(days=1)).replace(day=1), spans[0][0] - timedelta(days=1)))
    return ranked(period_delta(usage.where(F.col("day").between(F.lit(spans[1][0]), F.lit(last))), key, *spans), key, "tokens").where(F.col("rank") <= top)


def contributions(usage: DataFrame, group: str, key: str) -> DataFrame:
    """Share of each key in its group's total."""
    by = usage.groupBy(group, key).agg(_total())
    return by.withColumn("contribution", ratio(F.col(TOTAL), F.sum(TOTAL).over(Window.partitionBy(group))))


def overview(usage: DataFrame, key: str, today: date) -> DataFrame:
    """Per key: total, today, the last seven days, active days, last day used, number of models."""
    day = F.col("day")

    def when(cond):
        return F.coalesce(F.sum(F.when(cond, F.col(TOTAL))), F.lit(0))

    used = F.when(F.col(TOTAL) > 0, day)
    return usage.groupBy(key).agg(_total(), when(day == F.lit(today)).alias("today"), when(day.between(F.lit(today - timedelta(days=6)), F.lit(today))).alias("week"), F.count_distinct(used).alias("active_days"), F.max(used).alias("last_used_day"), F.count_distinct("model").alias("models"))


def percentiles(usage: DataFrame, key: str) -> DataFrame:
    """Whole percent of the others' places that a key's rank leaves behind."""
    r = ranked(usage.groupBy(key).agg(_total()), key).withColumn("n", F.count("*").over(Window.partitionBy()))
    return r.select(key, "rank", F.floor((F.col("n") - F.col("rank")) * 100.0 / F.col("n") + 0.5).cast("long").alias("percentile"))


def page(usage: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """One page of keys by total; a number past the end gives the last page."""
    r = ranked(usage.groupBy(key).agg(_total()), key).withColumn("pages", F.ceil(F.count("*").over(Window.partitionBy()) / size))
    at = F.greatest(F.lit(1), F.least(F.lit(number), F.col("pages")))
    return r.where(F.ceil(F.col("rank") / size) == at).drop("pages")


def next_keys(usage: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The ``size`` keys after a cursor, ascending."""
    return usage.where(F.col(key) > after).select(key).distinct().orderBy(key).limit(size)


def source_figures(usage: DataFrame) -> DataFrame:
    """One row: number of active sources, the one with most usage, the day with most usage."""
    sets = usage.where(F.col(TOTAL) > 0).groupingSets([["provider_id"], ["day"]], "provider_id", "day")
    by = sets.agg(_total(), (F.grouping("provider_id") == 0).alias("of_source"))

    def first(name: str, of: Column) -> Column:
        return F.min_by(name, F.when(of, F.struct(-F.col(TOTAL), name)))

    of = F.col("of_source")
    return by.agg(F.count_if(of).alias("active_sources"), first("provider_id", of).alias("top_source"), first("day", ~of).alias("peak_day"))
