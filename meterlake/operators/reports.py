"""Whole answers: boards, profiles, series, rankings and counters with all of their fields in one result.

Breakdowns are grouping sets of one aggregate: facts are read and shuffled once, pre-summed by each task; lists have a row for each name that a person uses.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.operators.analytics import TOKENS, bucket, calendar, dominant, in_range, percentile_of, ranked, ranked_apart, ratio, streaks
from meterlake.operators.pricing import cost_summary

TOTAL = "total_tokens"
#: Order of a team's members by how they moved.
KINDS = ("paused", "absent", "falling", "new", "rising", "steady")


def breakdowns(usage: DataFrame, key: str, names: dict[str, int | None], extra: list[Column] = ()) -> DataFrame:
    """By ``key``: the six sums, quality, last day, ``extra`` aggregates, and for each name column the list ``name=total,...``, largest first, cut to its number if one is given."""
    cols = list(names)
    sets = usage.groupingSets([[key, c] for c in cols] + [[key]], key, *cols)
    worst = F.max(F.when(F.col("source_quality") != "exact", 1).otherwise(0))
    rows = sets.agg(*[F.sum(c).alias(c) for c in TOKENS], worst.alias("__worst"), F.max("day").alias("__last"), *extra, *[F.grouping(c).alias(f"__{c}") for c in cols])
    whole = F.lit(True)
    for c in cols:
        whole = whole & (F.col(f"__{c}") == 1)
    extras = [c for c in rows.columns if c not in {key, *cols, *TOKENS, "__worst", "__last", *(f"__{c}" for c in cols)}]

    def lists(c: str) -> Column:
        each = F.array_sort(F.collect_list(F.when(F.col(f"__{c}") == 0, F.struct((-F.col(TOTAL)).alias("m"), F.col(c).cast("string").alias("n")))))
        each = each if names[c] is None else F.slice(each, 1, names[c])
        return F.array_join(F.transform(each, lambda x: F.concat(x["n"], F.lit("="), (-x["m"]).cast("string"))), ",").alias(f"{c}_list")

    one = [F.max(F.when(whole, F.col(c))).alias(f"_{c}") for c in [*TOKENS, "__worst", "__last", *extras]]
    out = rows.groupBy(key).agg(*one, *[lists(c) for c in cols])
    quality = F.when(F.col("___worst") == 1, "partial").otherwise("exact").alias("source_quality")
    return out.select(key, *[F.col(f"_{c}").alias(c) for c in [*TOKENS, *extras]], quality, F.col("___last").alias("last_day"), *[f"{c}_list" for c in cols])


def full_board(usage: DataFrame, people: DataFrame, top_models: int = 10, costed: DataFrame | None = None) -> DataFrame:
    """The board with every field: sums, quality, last day, lists of tools, folders and models, the dominant kind of tokens, rank; a tie goes to the name, then the id.

    ``costed`` (sums by person and model, with costs) adds known cost, tokens without a price and the worst quality of prices.
    """
    board = breakdowns(usage, "participant_id", {"tool_code": None, "workdir_id": None, "model": top_models}).join(people.select("participant_id", "nickname"), "participant_id")
    if costed is not None:
        board = board.join(cost_summary(costed, "participant_id"), "participant_id", "left")
    return ranked_apart(board.withColumn("dominant", dominant()), ["nickname", "participant_id"])


def source_board(usage: DataFrame, people: DataFrame, k: int = 10, top_models: int = 3) -> DataFrame:
    """The k largest people of each provider with their models, and on each row the provider's total and people and the total of all providers.

    Spark limits each task's providers to k people before the shuffle; models are listed for the people that are left.
    """
    by_model = usage.groupBy("provider_id", "participant_id", "model").agg(F.sum(TOTAL).alias("t"))
    each = by_model.groupBy("provider_id", "participant_id").agg(F.sum("t").alias(TOTAL))
    sources = each.groupBy("provider_id").agg(F.sum(TOTAL).alias("provider_tokens"), F.count("*").alias("participants"))
    sources = sources.withColumn("all_tokens", F.sum("provider_tokens").over(Window.partitionBy()))  # a row a provider
    first = ranked(each, "participant_id", within=["provider_id"]).where(F.col("rank") <= k)
    order = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("m"), F.col("model").alias("n")))), 1, top_models)
    lists = by_model.join(first.select("provider_id", "participant_id"), ["provider_id", "participant_id"], "left_semi").groupBy("provider_id", "participant_id").agg(F.array_join(F.transform(order, lambda x: F.concat(x["n"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("models"))
    return first.join(lists, ["provider_id", "participant_id"]).join(sources, "provider_id").join(people.select("participant_id", "nickname"), "participant_id", "left")


def shares(usage: DataFrame, *names: str) -> DataFrame:
    """Totals and shares by each of several columns in one pass: rows of dimension, name, total and share."""
    sets = usage.groupingSets([[n] for n in names], *names)
    which = F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(n)) for n in names])
    rows = sets.agg(which.alias("dimension"), F.sum(TOTAL).alias("t")).select("dimension", F.coalesce(*[F.col(n).cast("string") for n in names]).alias("name"), F.col("t").alias(TOTAL))
    return rows.withColumn("share", ratio(F.col(TOTAL), F.sum(TOTAL).over(Window.partitionBy("dimension"))))


def profiles(usage: DataFrame, people: DataFrame) -> DataFrame:
    """Everybody's profile: totals, lists, peak day, streaks, rank and percentile among all with usage."""
    base = breakdowns(usage, "participant_id", {"provider_id": None, "model": 10})
    daily = usage.groupBy("participant_id", "day").agg(F.sum(TOTAL).alias("t"))
    # one partitioning by person: days, their runs and the peak
    runs = streaks(daily.withColumnRenamed("t", TOTAL))
    peak = daily.groupBy("participant_id").agg(F.min_by(F.struct("day", "t"), F.struct(-F.col("t"), "day")).alias("p"))
    joined = base.join(runs.drop("last_day"), "participant_id", "left").join(peak, "participant_id").join(people.select("participant_id", "nickname"), "participant_id")
    out = ranked(joined, "participant_id").withColumn("people", F.count("*").over(Window.partitionBy()))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("participant_id", "nickname", *TOKENS, "provider_id_list", "model_list", F.col("p.day").alias("peak_day"), F.col("p.t").alias("peak_tokens"), zero("current_streak"), zero("best_streak"), zero("active_days"), "rank", percentile_of(F.col("rank"), F.col("people")).alias("percentile"))


def daily_series(usage: DataFrame, costed: DataFrame, span: tuple[date, date]) -> DataFrame:
    """One row a day of a span: tokens, active people, known cost, tokens without a price; zero (and no cost) where nothing was used. ``costed`` has day, model sums with cost and cost_quality."""
    used = in_range(usage, span).groupBy("day").agg(F.sum(TOTAL).alias(TOTAL), F.count_distinct(F.when(F.col(TOTAL) > 0, F.col("participant_id"))).alias("active"))
    costs = cost_summary(in_range(costed, span), "day")
    days = calendar(usage.sparkSession, span).join(used, "day", "left").join(costs, "day", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return days.select("day", zero(TOTAL), zero("active"), F.coalesce("cost", F.lit(0.0)).alias("cost"), zero("missing_tokens"), F.coalesce("cost_quality", F.lit("")).alias("cost_quality"))


def cost_view(costed: DataFrame, *keys: str) -> DataFrame:
    """A ledger's summary with costs: sums, known cost, worst quality, and the list of models without a price (``name=tokens``, the largest first). ``costed`` has sums by model and the keys."""
    missing = F.array_sort(F.collect_list(F.when(F.col("cost").isNull() & (F.col(TOTAL) > 0), F.struct((-F.col(TOTAL)).alias("m"), F.col("model").alias("n")))))
    listed = F.array_join(F.transform(missing, lambda x: F.concat(x["n"], F.lit("="), (-x["m"]).cast("string"))), ",")
    out = costed.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in TOKENS], listed.alias("unpriced"))
    named = out.select(*keys, *[F.col(f"_{c}").alias(c) for c in TOKENS], "unpriced")
    return named.join(cost_summary(costed, *keys), list(keys))


def paged_ranking(usage: DataFrame, people: DataFrame, page: int, size: int) -> DataFrame:
    """One page of the ranking (the last one if ``page`` is beyond it): sums, devices, lists, and the page's numbers on each row."""
    board = breakdowns(usage, "participant_id", {"tool_code": None, "provider_id": None, "model": 10})
    devices = usage.groupBy("participant_id").agg(F.count_distinct("device_id").alias("devices"))
    joined = board.join(devices, "participant_id").join(people.select("participant_id", "nickname"), "participant_id", "left")
    numbered = ranked_apart(joined, "participant_id")
    rows = numbered.agg(F.count("*").alias("n"), F.lit(0).alias("__one"))
    pages = F.greatest(F.ceil(F.col("n") / size), F.lit(1))
    meta = rows.select("__one", F.col("n").alias("total_rows"), pages.alias("pages"), F.greatest(F.least(F.lit(page), pages), F.lit(1)).alias("page"))
    out = numbered.withColumn("__one", F.lit(0)).join(F.broadcast(meta), "__one").drop("__one")
    return out.where((F.col("rank") > (F.col("page") - 1) * size) & (F.col("rank") <= F.col("page") * size))


def period_page(usage: DataFrame, grain: str, offset: int, limit: int) -> DataFrame:
    """A page of people's usage by period, the newest period first and in it the largest total; ``place`` counts from 1 over all. Tasks keep no more rows than the page's end."""
    by = usage.groupBy(bucket(grain).alias("period_start"), "participant_id").agg(*[F.sum(c).alias(c) for c in TOKENS])
    order = [F.desc("period_start"), F.desc(TOTAL), F.col("participant_id")]
    page = by.orderBy(*order).limit(offset + limit)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("place") > offset)


def quality_report(usage: DataFrame) -> DataFrame:
    """Counters of what is amiss, over all and by provider and quality: provider_id and source_quality are null in rows that sum over them."""
    unknown = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown")) == "unknown"
    sets = usage.groupingSets([[], ["provider_id"], ["source_quality"]], "provider_id", "source_quality")
    return sets.agg(F.count("*").alias("rows"), F.count_if(unknown("model")).alias("unknown_model"), F.count_if(unknown("workdir_id")).alias("unknown_workdir"), F.count_if(F.coalesce("source_fingerprint", F.lit("")) == "").alias("no_fingerprint"), F.count_if(F.col("source_quality") != "exact").alias("not_exact"))


def team_page(members: DataFrame, usage: DataFrame, current: tuple[date, date], previous: tuple[date, date]) -> DataFrame:
    """A row for each team, one for people without a team and one for all (scope: team, untagged, org), with active people by day: members, active, steady, light, moved, tokens, and of each window
    the largest number of people active on one day."""
    span = in_range(usage, (min(current[0], previous[0]), max(current[1], previous[1]))).where(F.col(TOTAL) > 0)
    window = F.when(F.col("day").between(*map(F.lit, current)), "now").when(F.col("day").between(*map(F.lit, previous)), "then")
    seen = span.select("participant_id", "day", window.alias("window")).where("window is not null").distinct().join(members.select("participant_id", "team_id"), "participant_id")
    scope = lambda df: df.select("*", F.explode(F.array(F.struct(F.when(F.col("team_id").isNull(), "untagged").otherwise("team").alias("scope"), F.col("team_id").alias("id")), F.struct(F.lit("org").alias("scope"), F.lit(None).cast(dict(df.dtypes)["team_id"]).alias("id")))).alias("s"))
    by_day = scope(seen).groupBy("s", "window", "day").agg(F.count("*").alias("n"))
    peaks = by_day.groupBy("s").agg(F.coalesce(F.max(F.when(F.col("window") == "now", F.col("n"))), F.lit(0)).alias("peak_active"), F.coalesce(F.max(F.when(F.col("window") == "then", F.col("n"))), F.lit(0)).alias("previous_peak"))
    count = lambda c: F.count_if(c)
    sums = scope(members).groupBy("s").agg(F.count("*").alias("members"), count(F.col("active_days") > 0).alias("active"), count(F.col("previous_days") > 0).alias("previous_active"), count(F.col("cohort") == "steady").alias("steady"), count(F.col("cohort") == "light").alias("light"), *[count(F.col("kind") == k).alias(f"{k}_members") for k in KINDS], F.sum("tokens").alias("tokens"))
    out = sums.join(peaks, sums.s.eqNullSafe(peaks.s), "left").drop(peaks.s)
    return out.select("s.scope", F.col("s.id").alias("team_id"), *[c for c in sums.columns if c != "s"], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("peak_active", "previous_peak")])


def ordered_members(members: DataFrame, people: DataFrame) -> DataFrame:
    """Members of each team in order: by how they moved, then more active days, then name; ``place`` counts from 1."""
    kind = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)), F.lit(99))
    named = members.join(people.select("participant_id", "nickname"), "participant_id")
    order = Window.partitionBy("team_id").orderBy(kind, F.desc("active_days"), "nickname", "participant_id")
    return named.withColumn("place", F.row_number().over(order).cast("long"))


def drill_down(usage: DataFrame, grain: str, start: date, hourly: DataFrame | None = None) -> DataFrame:
    """The next finer grain within a period: a day's hours, a week's days, a month's weeks, a year's months; the largest sum first among equal periods."""
    first = start
    ends = {"day": 1, "week": 7}
    last = first + timedelta(days=ends[grain] - 1) if grain in ends else (date(first.year + first.month // 12, first.month % 12 + 1, 1) if grain == "month" else date(first.year + 1, 1, 1)) - timedelta(days=1)
    finer = {"day": "hour", "week": "day", "month": "week", "year": "month"}[grain]
    rows = in_range(hourly if finer == "hour" else usage, (first, last))
    period = F.col("hour").cast("string") if finer == "hour" else F.col("day").cast("string") if finer == "day" else F.to_date(F.date_trunc(finer, F.col("day"))).cast("string")
    cols = [c for c in TOKENS if c in rows.columns]
    out = rows.groupBy(period.alias("period")).agg(*[F.sum(c).alias(c) for c in cols])
    return out.withColumn("share", ratio(F.col(TOTAL), F.sum(TOTAL).over(Window.partitionBy())))


def day_bounds(usage: DataFrame, span: tuple[date, date] | None) -> DataFrame:
    """First and last day of a range: its own, or those that occur."""
    if span is None:
        return usage.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return usage.sparkSession.sql(f"select date'{span[0]}' first_day, date'{span[1]}' last_day")


def latest_day(events: DataFrame, zone: str, ts: str = "ts", kinds: tuple[str, ...] = ("kind", "eventKind", "usageEventKind")) -> DataFrame:
    """The local day of the last event with a time that was not an error free of charge; no row if there is none."""
    free = F.lit(False)
    for c in kinds:
        if c in events.columns:
            free = free | (F.coalesce(c, F.lit("")) == "USAGE_EVENT_KIND_ERRORED_NOT_CHARGED")
    last = events.where(~free).agg(F.max(ts).alias("t")).where("t is not null")
    return last.select(F.to_date(F.from_utc_timestamp(F.col("t").cast("timestamp"), zone)).alias("day"))
