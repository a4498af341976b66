"""Aggregates over usage facts: boards, trends, ranks, streaks, shares, quality, teams.

Each function takes DataFrames and returns one. Aggregates come before joins with names, windows come
after aggregates (so they sort few rows), ties are broken by the id in ascending order, and ratios go
through try_divide. No function collects.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "total_tokens"]


def in_range(df: DataFrame, span: tuple[date, date] | None, col: str = "day") -> DataFrame:
    return df if span is None else df.where(F.col(col).between(F.lit(span[0]), F.lit(span[1])))


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def sums(cols=TOKENS) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols]


def totals_by(df: DataFrame, *keys: str, cols=TOKENS) -> DataFrame:
    return df.groupBy(*keys).agg(*sums(cols))


def ranked(df: DataFrame, key: str, measure: str = "total_tokens", within: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Position after sorting by ``measure`` descending, then ``key``; counted from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*(within or [])).orderBy(F.desc(measure), key)).cast("long"))


def ranked_apart(df: DataFrame, key: str | list[str], measure: str = "total_tokens", ranges: int = 64, out: str = "rank", running: str | None = None) -> DataFrame:
    """As :func:`ranked` over all rows, without a window over all rows: rows are dealt into ranges of the measure by its quantiles, numbered in each, and moved
    on by the number of rows in the ranges before; ``running`` names a column for the sum of the measure up to the row. Rows of one value share a range, and so a task.
    The rows are written once, as three passes read them."""
    rows = df.checkpoint()
    found = rows.agg(F.percentile_approx(measure, [i / ranges for i in range(1, ranges)], 10_000).alias("m")).first().m
    cuts = sorted(set(found or []), reverse=True)  # fewer than ``ranges`` numbers
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b > F.col(measure))) if cuts else F.lit(0)
    dealt = rows.withColumn("__range", at)
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"), F.sum(measure).alias("s"))  # ``ranges`` rows at most
    before = sizes.select("__range", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("__n"), F.coalesce(F.sum("s").over(whole), F.lit(0)).alias("__s"))
    order = Window.partitionBy("__range").orderBy(F.desc(measure), *([key] if isinstance(key, str) else key))
    placed = dealt.withColumn(out, F.row_number().over(order))
    if running:
        placed = placed.withColumn(running, F.sum(measure).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(F.broadcast(before), "__range").withColumn(out, (F.col(out) + F.col("__n")).cast("long"))
    if running:
        joined = joined.withColumn(running, F.col(running) + F.col("__s"))
    return joined.drop("__range", "__n", "__s")


def quality() -> Column:
    """exact only if every row is exact."""
    return F.when(F.max(F.when(F.col("source_quality") != "exact", 1).otherwise(0)) == 1, "partial").otherwise("exact").alias("source_quality")


def dominant() -> Column:
    """Which of the four token kinds is largest; the first of equals."""
    kinds = [("input", "input_tokens"), ("output", "output_tokens"), ("cache-read", "cache_read_tokens"), ("cache-write", "cache_write_tokens")]
    top = F.greatest(*[F.col(c) for _, c in kinds])
    out = F.when(top <= 0, "no-usage")
    for name, c in kinds:
        out = out.when(F.col(c) == top, name)
    return out.alias("dominant")


def leaderboard(usage: DataFrame, people: DataFrame) -> DataFrame:
    board = usage.groupBy("participant_id").agg(*sums(), quality())
    board = board.join(people.select("participant_id", "nickname"), "participant_id")
    return ranked(board, "participant_id").select("participant_id", "nickname", *TOKENS, "source_quality", dominant(), "rank")


def top_in_group(usage: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k largest keys of each group; Spark limits each task's groups before the shuffle."""
    return ranked(totals_by(usage, group, key, cols=["total_tokens"]), key, within=[group]).where(F.col("rank") <= k)


def period_sums(usage: DataFrame, periods: dict[str, tuple[date, date] | None], measure: str = "total_tokens") -> list[Column]:
    day = F.col("day")
    return [F.coalesce(F.sum(F.col(measure) if span is None else F.when(day.between(F.lit(span[0]), F.lit(span[1])), F.col(measure))), F.lit(0)).alias(name) for name, span in periods.items()]


def bucket(grain: str, col: str = "day") -> Column:
    """First day of the day's bucket; weeks begin on Monday."""
    return F.col(col) if grain == "day" else F.to_date(F.date_trunc(grain, F.col(col)))


def trend(usage: DataFrame, grain: str, cols=TOKENS, col: str = "day") -> DataFrame:
    return usage.withColumn("period_start", bucket(grain, col)).groupBy("period_start").agg(*sums(cols))


def calendar(df_session, span: tuple[date, date]) -> DataFrame:
    return df_session.sql(f"select explode(sequence(date'{span[0]}', date'{span[1]}')) day")


def dense_daily(usage: DataFrame, span: tuple[date, date]) -> DataFrame:
    """One row a day, zero where nothing was used."""
    spark = usage.sparkSession
    daily = in_range(usage, span).groupBy("day").agg(F.sum("total_tokens").alias("total_tokens"), F.count_distinct("participant_id").alias("active"))
    return calendar(spark, span).join(daily, "day", "left").select("day", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.coalesce("active", F.lit(0)).alias("active"))


def hourly_rhythm(hourly: DataFrame) -> DataFrame:
    hours = hourly.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    by_hour = hourly.groupBy("hour").agg(F.sum("total_tokens").alias("total_tokens"), F.count_distinct("day").alias("days"))
    return hours.join(by_hour, "hour", "left").select("hour", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.coalesce("days", F.lit(0)).alias("days"))


def weekday_hours(hourly: DataFrame) -> DataFrame:
    """Monday is 0."""
    return hourly.groupBy(F.weekday("day").alias("weekday"), "hour").agg(F.sum("total_tokens").alias("total_tokens"))


def streaks(usage: DataFrame, key: str = "participant_id") -> DataFrame:
    """Current (up to the last active day) and best run of consecutive active days, by gaps and islands."""
    days = usage.where("total_tokens > 0").select(key, "day").distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.count("*").alias("length"), F.max("day").alias("last"))
    return runs.groupBy(key).agg(F.max_by("length", "last").alias("current_streak"), F.max("length").alias("best_streak"), F.sum("length").alias("active_days"), F.max("last").alias("last_day"))


def peak_day(usage: DataFrame, key: str = "participant_id") -> DataFrame:
    """Day with the largest total, the earliest of equals."""
    daily = totals_by(usage, key, "day", cols=["total_tokens"])
    first = Window.partitionBy(key).orderBy(F.desc("total_tokens"), "day")
    return daily.withColumn("n", F.row_number().over(first)).where("n = 1").select(key, F.col("day").alias("peak_day"), F.col("total_tokens").alias("peak_tokens"))


def month_ranks(usage: DataFrame) -> DataFrame:
    monthly = totals_by(usage.withColumn("month", bucket("month")), "month", "participant_id", cols=["total_tokens"])
    return ranked(monthly, "participant_id", within=["month"]).withColumn("participants", F.count("*").over(Window.partitionBy("month")))


def percentile_of(rank: Column, n: Column) -> Column:
    return F.floor((n - rank) / n * 100 + 0.5).cast("long")


def concentration(usage: DataFrame, cuts=(1, 5, 10)) -> DataFrame:
    """Share of each month's largest people. Totals are a plain aggregate; only the largest, which tasks limit before the shuffle, are ranked."""
    monthly = totals_by(usage.withColumn("month", bucket("month")), "month", "participant_id", cols=["total_tokens"])
    total = monthly.groupBy("month").agg(F.sum("total_tokens").alias("all"), F.count("*").alias("participants"))
    first = ranked(monthly, "participant_id", within=["month"]).where(F.col("rank") <= max(cuts))
    largest = first.groupBy("month").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("total_tokens")).otherwise(0)).alias(f"t{k}") for k in cuts])
    return total.join(largest, "month").select("month", F.col("all").alias("total_tokens"), "participants", *[ratio(F.col(f"t{k}"), F.col("all")).alias(f"top{k}_share") for k in cuts])


def share_of_total(usage: DataFrame, key: str) -> DataFrame:
    t = totals_by(usage, key, cols=["total_tokens"])
    return t.withColumn("share", ratio(F.col("total_tokens"), F.sum("total_tokens").over(Window.partitionBy())))


def named_series(usage: DataFrame, name: str, top: int = 6, least_share: float = 0.25, most: int = 8) -> DataFrame:
    """Monthly totals by name; the ``top`` names, and names that ever had ``least_share`` of a month, up to ``most``; others fold."""
    monthly = totals_by(usage.withColumn("month", bucket("month")), "month", name, cols=["total_tokens"])
    share = F.try_divide(F.col("total_tokens").cast("double"), F.sum("total_tokens").over(Window.partitionBy("month")))
    names = monthly.withColumn("share", share).groupBy(name).agg(F.sum("total_tokens").alias("all"), F.max("share").alias("peak"))
    order = Window.orderBy(F.desc("all"), name)
    names = names.withColumn("r", F.row_number().over(order)).where((F.col("r") <= top) | (F.col("peak") >= least_share))
    kept = names.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(name, F.lit(True).alias("kept"))
    folded = monthly.join(kept, name, "left").withColumn("name", F.when(F.col("kept"), F.col(name)).otherwise("other"))
    return folded.groupBy("month", "name").agg(F.sum("total_tokens").alias("total_tokens"))


def fold_rest(usage: DataFrame, key: str, n: int) -> DataFrame:
    """The n largest and the sum of the rest as ``other``."""
    r = ranked(totals_by(usage, key, cols=["total_tokens"]), key)
    return r.withColumn("name", F.when(F.col("rank") <= n, F.col(key)).otherwise("other")).groupBy("name").agg(F.sum("total_tokens").alias("total_tokens"))


def pareto(usage: DataFrame, key: str = "participant_id") -> DataFrame:
    r = ranked_apart(totals_by(usage, key, cols=["total_tokens"]), key, running="__upto")
    all_of = r.agg(F.sum("total_tokens").alias("__all"), F.lit(0).alias("__one"))  # one row
    joined = r.withColumn("__one", F.lit(0)).join(F.broadcast(all_of), "__one")
    return joined.withColumn("cumulative_share", ratio(F.col("__upto"), F.col("__all"))).drop("__upto", "__all", "__one")


def neighbours(usage: DataFrame, key: str = "participant_id") -> DataFrame:
    """Each rank with its distance to the ones before and after it; ranks meet their neighbours by number."""
    r = ranked_apart(totals_by(usage, key, cols=["total_tokens"]), key)
    ahead, behind = (r.select((F.col("rank") + step).alias("rank"), F.col("total_tokens").alias(name)) for step, name in ((1, "__ahead"), (-1, "__behind")))
    joined = r.join(ahead, "rank", "left").join(behind, "rank", "left")
    return joined.select(key, "total_tokens", "rank", (F.col("__ahead") - F.col("total_tokens")).alias("gap_ahead"), (F.col("total_tokens") - F.col("__behind")).alias("gap_behind"))


def daily_leaders(usage: DataFrame) -> DataFrame:
    daily = ranked(totals_by(usage, "day", "participant_id", cols=["total_tokens"]), "participant_id", within=["day"])
    return daily.groupBy("participant_id").agg(F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("days_leading"), F.count("*").alias("days_active"))


def quality_counters(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider_id").agg(F.count("*").alias("rows"), F.count_if(F.col("source_quality") != "exact").alias("non_exact"), F.count_if(F.col("model").isNull() | (F.col("model") == "unknown")).alias("unknown_model"), F.count_if(F.col("total_tokens") == 0).alias("empty"))


def abnormal_days(usage: DataFrame, factor: float = 3.0) -> DataFrame:
    daily = totals_by(usage, "day", cols=["total_tokens"])
    return daily.withColumn("mean", F.avg("total_tokens").over(Window.partitionBy())).where(F.col("total_tokens") > factor * F.col("mean")).select("day", "total_tokens", F.round("mean", 4).alias("mean_tokens"))


def several_devices(usage: DataFrame) -> DataFrame:
    return usage.groupBy("participant_id").agg(F.count_distinct("device_id").alias("devices")).where("devices > 1")


def member_stats(usage: DataFrame, people: DataFrame, current: tuple[date, date], previous: tuple[date, date]) -> DataFrame:
    """Per member the two windows' active days and tokens, how the member moved, and the cohort."""
    now, then = F.col("day").between(F.lit(current[0]), F.lit(current[1])), F.col("day").between(F.lit(previous[0]), F.lit(previous[1]))
    used = in_range(usage, (previous[0], current[1])).groupBy("participant_id").agg(
        F.count_distinct(F.when(now, F.col("day"))).alias("active_days"), F.count_distinct(F.when(then, F.col("day"))).alias("previous_days"), F.coalesce(F.sum(F.when(now, F.col("total_tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(then, F.col("total_tokens"))), F.lit(0)).alias("previous_tokens")
    )
    m = people.join(used, "participant_id", "left").na.fill(0, ["active_days", "previous_days", "tokens", "previous_tokens"])
    a, b = F.col("active_days"), F.col("previous_days")
    kind = F.when((a == 0) & (b == 0), "absent").when(b == 0, "new").when(a == 0, "paused").when(a > b, "rising").when(a < b, "falling").otherwise("steady")
    cohort = F.when(a >= 3, "steady").when(a > 0, "light").otherwise("none")
    return m.select("participant_id", "team_id", "active_days", "previous_days", "tokens", "previous_tokens", kind.alias("kind"), cohort.alias("cohort"))


def team_rollup(members: DataFrame) -> DataFrame:
    return members.groupBy("team_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("active_days") > 0).alias("active"), (F.count_if(F.col("active_days") > 0) - F.count_if(F.col("previous_days") > 0)).alias("delta_active"), F.sum("tokens").alias("tokens"), F.count_if(F.col("cohort") == "steady").alias("steady"), F.count_if(F.col("cohort") == "light").alias("light"), F.count_if(F.col("kind") == "new").alias("new_members"), F.count_if(F.col("kind") == "paused").alias("paused")
    )


def tool_combos(usage: DataFrame) -> DataFrame:
    tools = usage.groupBy("participant_id").agg(F.array_sort(F.collect_set("tool_code")).alias("tools")).where(F.size("tools") > 1)
    return tools.groupBy(F.array_join("tools", " + ").alias("combo")).agg(F.count("*").alias("members"))
