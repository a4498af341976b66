"""Boards with breakdowns, ledger views, quality and team reports over usage facts.

Breakdowns come from one aggregate at the finest grain that is then rolled up, or from grouping sets, so
that facts are shuffled once. Windows without keys run on aggregates only (a row a person, device, team or day).
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.operators.analytics import TOKENS, in_range, ranked, ratio, sums
from meterlake.operators.pricing import rounded

TOTAL = "total_tokens"


def _total(name: str = TOTAL) -> Column:
    return F.coalesce(F.sum(TOTAL), F.lit(0)).alias(name)


def listed(name: str, measure: str = TOTAL, top: int | None = None) -> Column:
    """Names of a group with their measure, the largest first, as ``name=measure`` joined by commas."""
    order = F.array_sort(F.collect_list(F.struct((-F.col(measure)).alias("m"), F.col(name).cast("string").alias("n"))))
    order = order if top is None else F.slice(order, 1, top)
    return F.array_join(F.transform(order, lambda x: F.concat(x["n"], F.lit("="), (-x["m"]).cast("string"))), ",")


def board_with_models(usage: DataFrame, people: DataFrame, top: int = 10) -> DataFrame:
    """The board with each person's largest models."""
    by_model = usage.groupBy("participant_id", "model").agg(_total())
    board = by_model.groupBy("participant_id").agg(F.sum(TOTAL).alias("t"), F.count("*").alias("n_models"), listed("model", top=top).alias("models")).withColumnRenamed("t", TOTAL)
    return ranked(board.join(people.select("participant_id", "nickname"), "participant_id"), "participant_id")


def board_with_cost(costed: DataFrame, people: DataFrame) -> DataFrame:
    """The board with known cost and the tokens that have no price; ``costed`` has total_tokens and cost by person and model."""
    known = rounded(F.sum("cost"))
    board = costed.groupBy("participant_id").agg(_total(), known.alias("cost"), F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col(TOTAL))), F.lit(0)).alias("missing_tokens"))
    return ranked(board.join(people.select("participant_id", "nickname"), "participant_id"), "participant_id")


def cache_hit_rate(usage: DataFrame, *keys: str) -> DataFrame:
    """Tokens read from the cache among all that were put in."""
    t = usage.groupBy(*keys).agg(F.sum("input_tokens").alias("i"), F.sum("cache_read_tokens").alias("c"))
    return t.select(*keys, ratio(F.col("c"), F.col("i") + F.col("c")).alias("cache_hit_rate"))


def cache_savings(by_model: DataFrame, prices: DataFrame) -> DataFrame:
    """What reading from the cache saved, by model, in the prices' currency: the difference to the input price where the model has a price of its
    own, with a tenth of the input price for a missing cache price, and 1.35 a million tokens without any price."""
    joined = by_model.join(prices.select("model", "input_rate", "cache_read_rate"), "model", "left")
    per_token = F.when(F.col("input_rate").isNull(), F.lit(1.35)).when(F.col("cache_read_rate").isNull(), F.col("input_rate") * 0.9).otherwise(F.greatest(F.col("input_rate") - F.col("cache_read_rate"), F.lit(0.0)))
    return joined.select("model", "cache_read_tokens", F.round(F.col("cache_read_tokens") * per_token / 1e6, 6).alias("saved"))


def day_hours(hourly: DataFrame, day: date) -> DataFrame:
    """The 24 hours of a day, zero where nothing was used; no rows if the day has none at all."""
    on = hourly.where(F.col("day") == F.lit(day))
    by = on.groupBy("hour").agg(_total(), F.count_distinct("participant_id").alias("active"))
    any_row = on.select(F.lit(1).alias("one")).limit(1)
    hours = any_row.select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return hours.join(by, "hour", "left").select("hour", F.coalesce(TOTAL, F.lit(0)).alias(TOTAL), F.coalesce("active", F.lit(0)).alias("active"))


def ranking_with_provider(usage: DataFrame) -> DataFrame:
    """People by total, and the provider that each uses most (the first by name among equals)."""
    by = usage.groupBy("participant_id", "provider_id").agg(_total())
    return ranked(by.groupBy("participant_id").agg(F.min_by("provider_id", F.struct(-F.col(TOTAL), "provider_id")).alias("primary_provider"), F.sum(TOTAL).alias("t")).withColumnRenamed("t", TOTAL), "participant_id")


def source_stats(usage: DataFrame, span: tuple[date, date]) -> DataFrame:
    """Per provider: total, share, people with usage, rows, and the largest day."""
    by_day = in_range(usage, span).groupBy("provider_id", "day").agg(_total(), F.count("*").alias("rows"))
    people = in_range(usage, span).where(F.col(TOTAL) > 0).groupBy("provider_id").agg(F.count_distinct("participant_id").alias("active_participants"))
    stats = by_day.groupBy("provider_id").agg(F.min_by("day", F.struct(-F.col(TOTAL), "day")).alias("peak_day"), F.sum("rows").alias("rows"), F.sum(TOTAL).alias("t")).withColumnRenamed("t", TOTAL)
    stats = stats.withColumn("share", ratio(F.col(TOTAL), F.sum(TOTAL).over(Window.partitionBy())))
    return stats.join(people, "provider_id", "left").withColumn("active_participants", F.coalesce("active_participants", F.lit(0)))


def source_trend(usage: DataFrame, end: date, days: int) -> DataFrame:
    """Every provider's total on each of the last days, zero where nothing was used."""
    span = (end - timedelta(days=days - 1), end)
    by = in_range(usage, span).groupBy("provider_id", "day").agg(_total())
    grid = usage.select("provider_id").distinct().select("provider_id", F.explode(F.sequence(F.lit(span[0]), F.lit(span[1]))).alias("day"))
    return grid.join(by, ["provider_id", "day"], "left").withColumn(TOTAL, F.coalesce(TOTAL, F.lit(0)))


#: A day's share of its total from which each kind of tokens is conspicuous.
ANOMALIES = {"input-heavy": (("input_tokens",), 0.7), "output-heavy": (("output_tokens",), 0.45), "cache-heavy": (("cache_read_tokens", "cache_write_tokens"), 0.35), "reasoning-heavy": (("reasoning_tokens",), 0.25)}


def composition_anomalies(usage: DataFrame) -> DataFrame:
    """Days on which a kind of tokens has an unusual share, with the kinds."""
    daily = usage.groupBy("day").agg(*sums())
    kinds = F.filter(F.array(*[F.when(ratio(sum(F.col(c) for c in cols), F.col(TOTAL)) >= least, F.lit(kind)) for kind, (cols, least) in ANOMALIES.items()]), lambda x: x.isNotNull())
    return daily.withColumn("kinds", F.array_join(kinds, ",")).where("kinds <> ''").select("day", TOTAL, "kinds")


def anomaly_groups(anomalies: DataFrame, top: int = 5) -> DataFrame:
    """The largest days of each kind of anomaly."""
    each = anomalies.select("day", TOTAL, F.explode(F.split("kinds", ",")).alias("kind"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(TOTAL), "day"))).where(F.col("n") <= top)


def price_coverage(costed: DataFrame, *keys: str) -> DataFrame:
    """Tokens with and without a price, and the share that has one."""
    known = F.coalesce(F.sum(F.when(F.col("cost").isNotNull(), F.col(TOTAL))), F.lit(0))
    t = costed.groupBy(*keys).agg(known.alias("known_tokens"), _total())
    return t.select(*keys, "known_tokens", (F.col(TOTAL) - F.col("known_tokens")).alias("missing_tokens"), ratio(F.col("known_tokens"), F.col(TOTAL)).alias("coverage"))


def devices(usage: DataFrame, people: DataFrame) -> DataFrame:
    """Devices with their person's name and the last day seen."""
    seen = usage.groupBy("device_id", "participant_id").agg(F.max("day").alias("last_seen"), F.count("*").alias("rows"))
    return seen.join(people.select("participant_id", "nickname"), "participant_id", "left")


def stale(devices: DataFrame, today: date, days: int = 14) -> DataFrame:
    """Devices not seen for more than ``days`` days."""
    return devices.withColumn("days_since", F.date_diff(F.lit(today), "last_seen")).where(F.col("days_since") > days)


def team_tools(usage: DataFrame, people: DataFrame) -> DataFrame:
    by = usage.groupBy("participant_id", "tool_code").agg(_total()).where(F.col(TOTAL) > 0)
    return by.join(people, "participant_id").groupBy("team_id", "tool_code").agg(F.count("*").alias("users"), F.sum(TOTAL).alias("t")).withColumnRenamed("t", TOTAL)


def day_rollup(usage: DataFrame, current: tuple[date, date], previous: tuple[date, date]) -> DataFrame:
    """Active people on each day of two windows, and which window it is."""
    span = in_range(usage, (min(current[0], previous[0]), max(current[1], previous[1])))
    window = F.when(F.col("day").between(*map(F.lit, current)), "current").when(F.col("day").between(*map(F.lit, previous)), "previous")
    return span.withColumn("window", window).where("window is not null and total_tokens > 0").groupBy("window", "day").agg(F.count_distinct("participant_id").alias("active"), F.sum(TOTAL).alias("t")).withColumnRenamed("t", TOTAL)


def team_members(people: DataFrame, teams: DataFrame) -> DataFrame:
    """Members of each known team, and one row without a team for those who have none."""
    known = people.join(teams.select("team_id", F.lit(True).alias("known")), "team_id", "left")
    return known.groupBy(F.when(F.col("known"), F.col("team_id")).alias("team_id")).agg(F.count("*").alias("members"))


def story_focus(rollup: DataFrame) -> DataFrame:
    """The team to tell about: the one with most members that are new or have paused (of equals the one with more that have
    paused), else the one that lost most active members; no row if nothing changed anywhere."""
    churn = F.col("new_members") + F.col("paused")
    order = Window.partitionBy().orderBy(F.desc("churn"), F.desc("paused"), "delta_active", "team_id")
    moved = rollup.select("team_id", churn.alias("churn"), "paused", "delta_active").where("churn > 0 or delta_active <> 0")
    return moved.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def summary(usage: DataFrame, tops: dict[str, int]) -> DataFrame:
    """The totals and the largest names of each field, one row a field and name: one pass over the facts by grouping sets."""
    fields = list(tops)
    sets = usage.groupingSets([[], *[[f] for f in fields]], *fields).agg(_total(), F.grouping_id().alias("g"))
    all_bits = (1 << len(fields)) - 1
    field, name, most = F.when(F.col("g") == all_bits, "total"), F.when(F.col("g") == all_bits, ""), F.when(F.col("g") == all_bits, 1)
    for i, f in enumerate(fields):
        of = F.col("g") == all_bits - (1 << (len(fields) - 1 - i))
        field, name, most = field.when(of, f), name.when(of, F.col(f).cast("string")), most.when(of, tops[f])
    named = sets.select(field.alias("field"), name.alias("name"), most.alias("most"), TOTAL)
    return ranked(named, "name", within=["field"]).where(F.col("rank") <= F.col("most")).drop("most")


def detail_window(usage: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """Rows by day and total, both descending, from an offset: Spark keeps offset + limit rows a task."""
    return usage.groupBy("day", *keys).agg(_total()).orderBy(F.desc("day"), F.desc(TOTAL), *keys).offset(offset).limit(limit)


def grouped(usage: DataFrame, field: str, limit: int | None = None) -> DataFrame:
    """Totals by a field, the largest first, at most ``limit``."""
    by = usage.groupBy(F.col(field).alias("name")).agg(*sums(), F.count("*").alias("rows"))
    return by if limit is None else by.orderBy(F.desc(TOTAL), "name").limit(limit)


def last_days(daily: DataFrame, end: date, days: int, *cols: str) -> DataFrame:
    """One row: sums of daily figures over the last days."""
    return in_range(daily, (end - timedelta(days=days - 1), end)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols], F.count("*").alias("days"))


def trend_with_detail(usage: DataFrame, bucket: Column, field: str, top: int = 3) -> DataFrame:
    """Buckets of time, each with its largest names."""
    by = usage.groupBy(bucket.alias("period_start"), field).agg(_total())
    return by.groupBy("period_start").agg(listed(field, top=top).alias("largest"), F.sum(TOTAL).alias("t")).withColumnRenamed("t", TOTAL)


def drill_down(usage: DataFrame, grain: str, start: date) -> DataFrame:
    """The parts of one period: days of a week, weeks of a month, months of a year."""
    finer = {"week": "day", "month": "week", "year": "month"}[grain]
    inside = usage.where(F.date_trunc(grain, "day") == F.date_trunc(grain, F.lit(start)))
    return inside.groupBy(F.to_date(F.date_trunc(finer, "day")).alias("period_start")).agg(*sums())


def stacked_points(usage: DataFrame, bucket: Column, split: str, measure: Column, top: int = 7) -> DataFrame:
    """A measure by time and the largest names of a split; the others fold into one."""
    by = usage.groupBy(bucket.alias("period"), F.col(split).cast("string").alias("split")).agg(measure.alias("value"))
    kept = ranked(by.groupBy("split").agg(F.sum("value").alias("v")), "split", "v").where(F.col("rank") <= top).select("split", F.lit(True).alias("kept"))
    return by.join(kept, "split", "left").groupBy("period", F.when(F.col("kept"), F.col("split")).otherwise("Other").alias("series")).agg(F.sum("value").alias("value"))


def share_card(usage: DataFrame, field: str) -> DataFrame:
    """Share of each name to four places; everything has 1 where there is no usage at all."""
    by = usage.groupBy(F.col(field).alias("name")).agg(_total())
    whole = F.sum(TOTAL).over(Window.partitionBy())
    return by.withColumn("share", F.round(F.when(whole == 0, 1.0).otherwise(F.col(TOTAL) / whole), 4))


def week_series(daily: DataFrame) -> DataFrame:
    """Weekly sums of daily totals, with the largest number of active people of a day."""
    return daily.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.max("active").alias("active"), F.sum(TOTAL).alias("t")).withColumnRenamed("t", TOTAL)


def insights(usage: DataFrame) -> DataFrame:
    """One row: share of the first five people, the weekday with most usage, people with usage, share of weekends."""
    by = usage.groupBy("participant_id", F.weekday("day").alias("weekday")).agg(_total())
    people = ranked(by.groupBy("participant_id").agg(_total()), "participant_id").agg(ratio(F.sum(F.when(F.col("rank") <= 5, F.col(TOTAL))), F.sum(TOTAL)).alias("top5_share"), F.count_if(F.col(TOTAL) > 0).alias("active"))
    days = by.groupBy("weekday").agg(_total()).agg(F.min_by("weekday", F.struct(-F.col(TOTAL), "weekday")).alias("peak_weekday"), ratio(F.sum(F.when(F.col("weekday") >= 5, F.col(TOTAL))), F.sum(TOTAL)).alias("weekend_share"))
    return people.withColumn("one", F.lit(0)).join(days.withColumn("one", F.lit(0)), "one").drop("one")  # one row each


def person_options(people: DataFrame) -> DataFrame:
    return people.select("participant_id", "nickname").orderBy("nickname", "participant_id")


def all_totals(usage: DataFrame) -> DataFrame:
    return usage.agg(*sums(TOKENS), F.count("*").alias("rows"))
