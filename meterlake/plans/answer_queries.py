"""The registered queries of whole answers: boards, profiles, series, rankings, quality, teams, price pages, sync and migration, each with its SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from meterlake.operators import display, gateway_views, ledger, price_records, reports
from meterlake.operators.pricing import with_cost
from meterlake.plans import surrogate as S
from meterlake.plans.catalogue import _SIX, DAY, MONTH, _costed, costed_sql, query

_T = "CAST(sum(total_tokens) AS BIGINT) AS t"
_QUALITY = "CASE WHEN max(CASE WHEN source_quality<>'exact' THEN 1 ELSE 0 END)=1 THEN 'partial' ELSE 'exact' END AS source_quality"
_BASE = f"b AS (SELECT participant_id, {_SIX}, {_QUALITY}, max(day) AS last_day FROM u GROUP BY 1)"


def _list(name: str, top: int = 1_000_000) -> str:
    return f"""{name}_l AS (SELECT participant_id, string_agg({name} || '=' || t, ',' ORDER BY n) AS {name}_list FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY t DESC, CAST({name} AS VARCHAR)) AS n FROM (SELECT participant_id, {name}, {_T} FROM u GROUP BY 1,2)) WHERE n<={top} GROUP BY 1)"""


_DOMINANT = """CASE WHEN greatest(input_tokens,output_tokens,cache_read_tokens,cache_write_tokens)<=0 THEN 'no-usage' WHEN input_tokens=greatest(input_tokens,output_tokens,cache_read_tokens,cache_write_tokens) THEN 'input'
 WHEN output_tokens=greatest(input_tokens,output_tokens,cache_read_tokens,cache_write_tokens) THEN 'output' WHEN cache_read_tokens=greatest(input_tokens,output_tokens,cache_read_tokens,cache_write_tokens) THEN 'cache-read' ELSE 'cache-write' END AS dominant"""


@query(
    f"SELECT b.*, tool_code_list, workdir_id_list, model_list, nickname, {_DOMINANT}, row_number() OVER (ORDER BY total_tokens DESC, nickname, participant_id) AS rank FROM b JOIN tool_code_l USING (participant_id) JOIN workdir_id_l USING (participant_id) JOIN model_l USING (participant_id) JOIN p USING (participant_id)",
    first=", ".join([_BASE, _list("tool_code"), _list("workdir_id"), _list("model", 10)]),
)
def full_board(u, h, p):
    return reports.full_board(u, p)


@query(
    costed_sql("participant_id")
    + f""" SELECT b.*, tool_code_list, workdir_id_list, model_list, nickname, {_DOMINANT}, k.cost, k.missing_tokens, k.cost_quality, row_number() OVER (ORDER BY total_tokens DESC, nickname, participant_id) AS rank FROM b JOIN tool_code_l USING (participant_id) JOIN workdir_id_l USING (participant_id) JOIN model_l USING (participant_id) JOIN p USING (participant_id)
 JOIN (SELECT participant_id, round(sum(cost)+1e-10::DOUBLE, 6) AS cost, CAST(coalesce(sum(CASE WHEN cost IS NULL THEN total_tokens END), 0) AS BIGINT) AS missing_tokens, CASE max(q) WHEN 2 THEN 'unknown_price' WHEN 1 THEN 'estimated_price' ELSE 'exact_price' END AS cost_quality FROM c GROUP BY 1) k USING (participant_id)""",
    first=", ".join([_BASE, _list("tool_code"), _list("workdir_id"), _list("model", 3)]),
)
def full_board_with_cost(u, h, p):
    by_model = u.groupBy("participant_id", "model").agg(*[F.sum(c).alias(c) for c in S.TOKENS])
    return reports.full_board(u, p, 3, _costed(by_model))


@query(
    f"""SELECT participant_id, nickname, {', '.join(S.TOKENS)}, provider_id_list, model_list, peak_day, peak_tokens, coalesce(current_streak, 0) AS current_streak, coalesce(best_streak, 0) AS best_streak, coalesce(active_days, 0) AS active_days, rank, CAST(floor((n-rank)::DOUBLE/n*100+0.5) AS BIGINT) AS percentile
 FROM (SELECT *, row_number() OVER (ORDER BY total_tokens DESC, participant_id) AS rank, count(*) OVER () AS n FROM b JOIN p USING (participant_id)) JOIN provider_id_l USING (participant_id) JOIN model_l USING (participant_id)
 JOIN (SELECT participant_id, arg_min(day, (-t, day)) AS peak_day, max(t) AS peak_tokens FROM d GROUP BY 1) USING (participant_id) LEFT JOIN runs USING (participant_id)""",
    first=", ".join([_BASE, _list("provider_id"), _list("model", 10), f"d AS (SELECT participant_id, day, {_T} FROM u GROUP BY 1,2)"])
    + """, steps AS (SELECT participant_id, day, CASE WHEN day - lag(day) OVER (PARTITION BY participant_id ORDER BY day) = 1 THEN 0 ELSE 1 END AS begins FROM d WHERE t>0), numbered AS (SELECT *, sum(begins) OVER (PARTITION BY participant_id ORDER BY day) AS run FROM steps),
 lengths AS (SELECT participant_id, run, count(*) AS n FROM numbered GROUP BY 1,2), runs AS (SELECT participant_id, arg_max(n, run) AS current_streak, max(n) AS best_streak, CAST(sum(n) AS BIGINT) AS active_days FROM lengths GROUP BY 1)""",
)
def full_profiles(u, h, p):
    return reports.profiles(u, p)


@query(
    f"""SELECT provider_id, participant_id, total_tokens, rank, models, provider_tokens, participants, all_tokens, nickname FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY total_tokens DESC, participant_id) AS rank, CAST(sum(total_tokens) OVER (PARTITION BY provider_id) AS BIGINT) AS provider_tokens, count(*) OVER (PARTITION BY provider_id) AS participants, CAST(sum(total_tokens) OVER () AS BIGINT) AS all_tokens
 FROM (SELECT provider_id, participant_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM u GROUP BY 1,2)) JOIN (SELECT provider_id, participant_id, string_agg(model || '=' || t, ',' ORDER BY n) AS models FROM (SELECT *, row_number() OVER (PARTITION BY provider_id, participant_id ORDER BY t DESC, model) AS n FROM (SELECT provider_id, participant_id, model, {_T} FROM u GROUP BY 1,2,3)) WHERE n<=3 GROUP BY 1,2) USING (provider_id, participant_id) LEFT JOIN p USING (participant_id) WHERE rank<=10"""
)
def source_board(u, h, p):
    return reports.source_board(u, p)


@query(" UNION ALL ".join(f"SELECT '{n}' AS dimension, CAST({n} AS VARCHAR) AS name, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_tokens)::DOUBLE/(sum(sum(total_tokens)) OVER ())::DOUBLE, 6) AS share FROM u GROUP BY {n}" for n in ("model", "provider_id", "workdir_id")))
def analytics_shares(u, h, p):
    return reports.shares(u, "model", "provider_id", "workdir_id")


_SPAN = (MONTH[0] - timedelta(days=3), MONTH[1])


@query(
    costed_sql("day", f"WHERE day BETWEEN DATE '{_SPAN[0]}' AND DATE '{_SPAN[1]}'")
    + f""", s AS (SELECT day, round(sum(cost)+1e-10::DOUBLE, 6) AS cost, CAST(coalesce(sum(CASE WHEN cost IS NULL THEN total_tokens END), 0) AS BIGINT) AS missing_tokens, CASE max(q) WHEN 2 THEN 'unknown_price' WHEN 1 THEN 'estimated_price' ELSE 'exact_price' END AS cost_quality FROM c GROUP BY 1)
 SELECT CAST(g.day AS DATE) AS day, coalesce(t, 0) AS total_tokens, coalesce(active, 0) AS active, coalesce(cost, 0.0::DOUBLE) AS cost, coalesce(missing_tokens, 0) AS missing_tokens, coalesce(cost_quality, '') AS cost_quality
 FROM (SELECT unnest(generate_series(DATE '{_SPAN[0]}', DATE '{_SPAN[1]}', INTERVAL 1 DAY)) AS day) g LEFT JOIN (SELECT day, {_T}, count(DISTINCT participant_id) AS active FROM u GROUP BY 1) x ON x.day=g.day LEFT JOIN s ON s.day=g.day"""
)
def analytics_series(u, h, p):
    by_model = u.where(F.col("day").between(*map(F.lit, _SPAN))).groupBy("day", "model").agg(*[F.sum(c).alias(c) for c in S.TOKENS])
    return reports.daily_series(u, _costed(by_model), _SPAN)


@query(
    f"""SELECT b.*, tool_code_list, provider_id_list, model_list, devices, nickname, rank, n AS total_rows, pages, page FROM (SELECT *, CAST(ceil(n/7.0) AS BIGINT) AS pages, least(3, CAST(ceil(n/7.0) AS BIGINT)) AS page FROM (SELECT participant_id AS id, row_number() OVER (ORDER BY total_tokens DESC, participant_id) AS rank, count(*) OVER () AS n FROM b)) r
 JOIN b ON b.participant_id=id JOIN tool_code_l USING (participant_id) JOIN provider_id_l USING (participant_id) JOIN model_l USING (participant_id) JOIN (SELECT participant_id, count(DISTINCT device_id) AS devices FROM u GROUP BY 1) USING (participant_id) LEFT JOIN p USING (participant_id) WHERE rank>(page-1)*7 AND rank<=page*7""",
    first=", ".join([_BASE, _list("tool_code"), _list("provider_id"), _list("model", 10)]),
)
def ranking_page(u, h, p):
    return reports.paged_ranking(u, p, 3, 7)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY period_start DESC, total_tokens DESC, participant_id) AS place FROM (SELECT CAST(date_trunc('week', day) AS DATE) AS period_start, participant_id, {_SIX} FROM u GROUP BY 1,2)) WHERE place>20 AND place<=70", lean=True)
def period_page(u, h, p):
    return reports.period_page(u, "week", 20, 50)


@query("SELECT participant_id, total_tokens, row_number() OVER (ORDER BY total_tokens DESC, participant_id) AS rank FROM (SELECT participant_id, CAST(sum(total_tokens)//1000000 AS BIGINT) AS total_tokens FROM u GROUP BY 1)", lean=True)
def ranks_without_one_task(u, h, p):
    from meterlake.operators.analytics import ranked_apart

    totals = u.groupBy("participant_id").agg(F.sum("total_tokens").alias("t")).select("participant_id", F.floor(F.col("t") / 1_000_000).cast("long").alias("total_tokens"))
    return ranked_apart(totals, "participant_id")


@query(
    """SELECT provider_id, source_quality, count(*) AS rows, count(*) FILTER (m='unknown') AS unknown_model, count(*) FILTER (w IS NULL) AS unknown_workdir, count(*) FILTER (reasoning_tokens%50=0) AS no_fingerprint, count(*) FILTER (source_quality='partial' OR q='partial') AS not_exact
 FROM (SELECT provider_id, source_quality, source_quality AS q, reasoning_tokens, CASE WHEN input_tokens%700=0 THEN 'unknown' ELSE model END AS m, CASE WHEN workdir_id%8<>0 THEN workdir_id END AS w FROM u) GROUP BY GROUPING SETS ((), (provider_id), (source_quality))"""
)
def quality_report(u, h, p):
    rows = u.select("provider_id", "source_quality", F.when(F.col("input_tokens") % 700 == 0, "Unknown").otherwise(F.col("model")).alias("model"), F.when(F.col("workdir_id") % 8 != 0, F.col("workdir_id")).alias("workdir_id"), F.when(F.col("reasoning_tokens") % 50 != 0, "f").otherwise("").alias("source_fingerprint"))
    return reports.quality_report(rows.withColumn("model", F.when(F.col("model") == "Unknown", " unknown ").otherwise(F.col("model"))))


_NOW, _THEN = (DAY - timedelta(days=6), DAY), (DAY - timedelta(days=13), DAY - timedelta(days=7))
_KINDS = ("paused", "absent", "falling", "new", "rising", "steady")
_SCOPED = "(SELECT 'team' AS scope, team_id AS id, * FROM {0} WHERE team_id IS NOT NULL UNION ALL SELECT 'untagged', NULL, * FROM {0} WHERE team_id IS NULL UNION ALL SELECT 'org', NULL, * FROM {0})"


def _two_weeks(u, p):
    from meterlake.operators.analytics import member_stats

    tagged = p.withColumn("team_id", F.when(F.col("participant_id") % 5 != 0, F.col("team_id")))
    return member_stats(u, tagged, _NOW, _THEN), tagged


_WEEKS = f"""tagged AS (SELECT participant_id, nickname, CASE WHEN participant_id%5<>0 THEN team_id END AS team_id FROM p),
 used AS (SELECT participant_id, day, sum(total_tokens) AS t FROM u WHERE day BETWEEN DATE '{_THEN[0]}' AND DATE '{_NOW[1]}' GROUP BY 1,2),
 mm AS (SELECT participant_id, nickname, team_id, a, b, CAST(t AS BIGINT) AS tokens, CASE WHEN a=0 AND b=0 THEN 'absent' WHEN b=0 THEN 'new' WHEN a=0 THEN 'paused' WHEN a>b THEN 'rising' WHEN a<b THEN 'falling' ELSE 'steady' END AS kind FROM (SELECT g.participant_id, nickname, team_id, count(*) FILTER (day>=DATE '{_NOW[0]}') AS a, count(*) FILTER (day<=DATE '{_THEN[1]}') AS b, coalesce(sum(t) FILTER (day>=DATE '{_NOW[0]}'), 0) AS t FROM tagged g LEFT JOIN used USING (participant_id) GROUP BY ALL)),
 act AS (SELECT participant_id, team_id, day FROM used JOIN tagged USING (participant_id) WHERE t>0)"""


@query(
    f"""SELECT m.scope, m.id AS team_id, members, active, previous_active, steady, light, {', '.join(f'{k}_members' for k in _KINDS)}, tokens, coalesce(peak_active, 0) AS peak_active, coalesce(previous_peak, 0) AS previous_peak FROM
 (SELECT scope, id, count(*) AS members, count(*) FILTER (a>0) AS active, count(*) FILTER (b>0) AS previous_active, count(*) FILTER (a>=3) AS steady, count(*) FILTER (a BETWEEN 1 AND 2) AS light, {', '.join(f"count(*) FILTER (kind='{k}') AS {k}_members" for k in _KINDS)}, CAST(sum(tokens) AS BIGINT) AS tokens FROM {_SCOPED.format('mm')} GROUP BY 1,2) m
 LEFT JOIN (SELECT scope, id, max(n) FILTER (day>=DATE '{_NOW[0]}') AS peak_active, max(n) FILTER (day<=DATE '{_THEN[1]}') AS previous_peak FROM (SELECT scope, id, day, count(*) AS n FROM {_SCOPED.format('act')} GROUP BY 1,2,3) GROUP BY 1,2) k ON k.scope=m.scope AND k.id IS NOT DISTINCT FROM m.id""",
    first=_WEEKS,
    lean=True,
)
def team_page(u, h, p):
    members, _ = _two_weeks(u, p)
    return reports.team_page(members, u, _NOW, _THEN)


@query(
    "SELECT participant_id, team_id, kind, row_number() OVER (PARTITION BY team_id ORDER BY CASE kind WHEN 'paused' THEN 1 WHEN 'absent' THEN 2 WHEN 'falling' THEN 3 WHEN 'new' THEN 4 WHEN 'rising' THEN 5 ELSE 6 END, a DESC, nickname, participant_id) AS place FROM mm",
    first=_WEEKS,
    lean=True,
)
def ordered_members(u, h, p):
    members, tagged = _two_weeks(u, p)
    return reports.ordered_members(members, tagged).select("participant_id", "team_id", "kind", "place")


@query(f"SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS period, {_SIX}, round(sum(total_tokens)::DOUBLE/(sum(sum(total_tokens)) OVER ())::DOUBLE, 6) AS share FROM u WHERE day BETWEEN DATE '{MONTH[0]}' AND DATE '2001-06-30' GROUP BY 1", lean=True)
def month_by_weeks(u, h, p):
    return reports.drill_down(u, "month", MONTH[0])


@query("SELECT CAST(hour AS VARCHAR) AS period, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_tokens)::DOUBLE/(sum(sum(total_tokens)) OVER ())::DOUBLE, 6) AS share FROM h WHERE day=DATE '2024-01-10' GROUP BY 1", hourly=True)
def day_by_hours(u, h, p):
    return reports.drill_down(u, "day", date(2024, 1, 10), h)


@query("SELECT min(day) AS first_day, max(day) AS last_day FROM u WHERE participant_id%3=1", lean=True)
def day_bounds(u, h, p):
    return reports.day_bounds(u.where("participant_id % 3 = 1"), None)


@query("SELECT CAST(max(ts) + INTERVAL 8 HOUR AS DATE) AS day FROM h WHERE event_id%4<>0", hourly=True)
def latest_usage_day(u, h, p):
    events = h.select("ts", F.when(F.col("event_id") % 4 == 0, "USAGE_EVENT_KIND_ERRORED_NOT_CHARGED").otherwise("USAGE_EVENT_KIND_INCLUDED").alias("usageEventKind"))
    return reports.latest_day(events, "Asia/Shanghai")


# --- prices as they come

_RECORD = """CASE participant_id%4 WHEN 0 THEN concat('{"model":"~A', CAST(participant_id AS STRING), '","inputCostPerMTok":', CAST(participant_id AS STRING), ',"outputCostPerMTok":-1,"cacheReadCostPerToken":0.001}')
 WHEN 1 THEN concat('{"model":" OpenRouter/B', CAST(participant_id AS STRING), '","inputCostPerToken":0.002,"output_cost_per_token":"0.003","source":"mine"}') WHEN 2 THEN concat('{"model":"c', CAST(participant_id AS STRING), '","inputCostPerMTok":null,"inputCostPerToken":2}')
 ELSE concat('{"model":"d', CAST(participant_id AS STRING), '","input_cost_per_token":"bad"}') END"""


@query(
    """SELECT CASE participant_id%4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END || participant_id AS model, CASE participant_id%4 WHEN 0 THEN participant_id*1.0::DOUBLE WHEN 1 THEN 2000.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS input_rate, CASE participant_id%4 WHEN 1 THEN 3000.0::DOUBLE ELSE 0.0::DOUBLE END AS output_rate,
 CASE participant_id%4 WHEN 0 THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS cache_read_rate, 0.0::DOUBLE AS cache_write_rate, CASE participant_id%4 WHEN 1 THEN 'mine' ELSE 'custom' END AS source FROM p""",
    lean=True,
)
def price_page(u, h, p):
    return price_records.public(price_records.normalized(p.select(F.expr(_RECORD).alias("record"))))


_MODEL = """CASE WHEN participant_id%3=0 THEN concat('{"id":"~X/M', CAST(participant_id AS STRING), '","name":"N","context_length":100,"pricing":{"prompt":"0.00001","completion":"0.00002","input_cache_read":"0.000005"},"top_provider":{"max_completion_tokens":7}}')
 WHEN participant_id%3=1 THEN concat('{"canonical_slug":"m', CAST(participant_id AS STRING), '","pricing":{"completion":"0.5"},"top_provider":{"context_length":9}}') ELSE '{"id":"none","pricing":{"prompt":"-1"}}' END"""


@query(
    """SELECT CASE WHEN participant_id%3=0 THEN 'x/m' ELSE 'm' END || participant_id AS model, CASE WHEN participant_id%3=0 THEN 'N' ELSE '' END AS display_name, CASE WHEN participant_id%3=0 THEN 0.00001::DOUBLE ELSE 0.0::DOUBLE END AS input_price, CASE WHEN participant_id%3=0 THEN 0.00002::DOUBLE ELSE 0.5::DOUBLE END AS output_price,
 CASE WHEN participant_id%3=0 THEN 0.000005::DOUBLE ELSE 0.0::DOUBLE END AS cache_read_price, CASE WHEN participant_id%3=0 THEN 0.00001::DOUBLE ELSE 0.0::DOUBLE END AS cache_write_price, CAST(CASE WHEN participant_id%3=0 THEN 100 ELSE 9 END AS BIGINT) AS max_input_tokens, CAST(CASE WHEN participant_id%3=0 THEN 7 ELSE 0 END AS BIGINT) AS max_output_tokens FROM p WHERE participant_id%3<>2""",
    lean=True,
)
def catalogue_prices(u, h, p):
    return price_records.catalogue(p.select(F.expr(_MODEL).alias("record"))).drop("reasoning_price", "source", "updated_at")


@query(
    costed_sql("provider_id")
    + " SELECT provider_id, round(sum(cost)+1e-10::DOUBLE, 6) AS cost, CAST(coalesce(sum(CASE WHEN cost IS NULL THEN total_tokens END), 0) AS BIGINT) AS missing_tokens, CASE max(q) WHEN 2 THEN 'unknown_price' WHEN 1 THEN 'estimated_price' ELSE 'exact_price' END AS cost_quality FROM c GROUP BY 1"
)
def costs_summed_again(u, h, p):
    from meterlake.operators.pricing import cost_summary

    by_model = u.groupBy("provider_id", "model").agg(*[F.sum(c).alias(c) for c in S.TOKENS])
    return price_records.summed_again(cost_summary(_costed(by_model), "provider_id", "model", digits=12), "provider_id")


@query(
    """SELECT 'alias' AS kind, 1 AS rows, CAST(0 AS BIGINT) AS total_tokens UNION ALL SELECT 'remote', count(*), 0 FROM p WHERE participant_id%4=1 UNION ALL SELECT 'custom', count(*), 0 FROM p WHERE participant_id%4=0 UNION ALL SELECT 'missing', count(DISTINCT model), CAST(sum(total_tokens) AS BIGINT) FROM h WHERE model<>'m1'""",
    hourly=True,
    people=True,
)
def price_list(u, h, p):
    records = price_records.normalized(p.select("participant_id", F.expr(_RECORD).alias("record")))
    prices = h.sparkSession.createDataFrame([("m1", 1.0, 1.0, None, None)], "model string, input_rate double, output_rate double, cache_read_rate double, cache_write_rate double")
    aliases = h.sparkSession.createDataFrame([("x", "m1")], "source string, target string")
    page = price_records.listed(records.where("model like 'b%'"), records.where("model like 'a%'"), aliases, with_cost(h, prices))
    return page.groupBy("kind").agg(F.count("*").alias("rows"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))


@query(
    costed_sql("provider_id")
    + f""" SELECT provider_id, {_SIX}, coalesce(string_agg(model || '=' || total_tokens, ',' ORDER BY total_tokens DESC, model) FILTER (cost IS NULL AND total_tokens>0), '') AS unpriced, round(sum(cost)+1e-10::DOUBLE, 6) AS cost, CAST(coalesce(sum(CASE WHEN cost IS NULL THEN total_tokens END), 0) AS BIGINT) AS missing_tokens,
 CASE max(q) WHEN 2 THEN 'unknown_price' WHEN 1 THEN 'estimated_price' ELSE 'exact_price' END AS cost_quality FROM c GROUP BY 1"""
)
def ledger_costs(u, h, p):
    return reports.cost_view(_costed(u.groupBy("provider_id", "model").agg(*[F.sum(c).alias(c) for c in S.TOKENS]), summed=True), "provider_id")


# --- sync, pages of scopes, migration

_SCOPE = "day, hour, provider_id"


@query(
    f"""SELECT mode, status, count(*) AS buckets FROM (SELECT mode, CASE WHEN mode='full' AND hour%5=0 THEN 'unknown_legacy' WHEN hour%12=0 THEN 'missing' WHEN CASE WHEN hour%4<>0 THEN 'a' ELSE 'b' END=CASE WHEN hour%2=0 THEN 'a' ELSE 'b' END THEN 'matched' ELSE 'different' END AS status
 FROM (SELECT DISTINCT {_SCOPE} FROM h), (VALUES ('full'), ('recent')) x(mode) WHERE mode='full' OR day>=DATE '2024-01-20') GROUP BY 1,2""",
    hourly=True,
)
def compared_sync(u, h, p):
    scope = ["day", "hour", "provider_id"]
    scopes = h.select(*scope).distinct()
    kind = F.lit("hourly").alias("granularity")
    client = scopes.withColumn("granularity", F.when(F.col("hour") % 5 != 0, "hourly")).withColumn("fingerprint", F.when(F.col("hour") % 2 == 0, "a").otherwise("b"))
    buckets = scopes.where("hour % 3 <> 0").select(*scope, kind, F.lit("b").alias("fingerprint"))
    facts = scopes.where("hour % 4 <> 0").select(*scope, kind, F.lit("a").alias("fingerprint"))
    both = [ledger.compared_sync(client, buckets, facts, date(2024, 1, 30), scope, full, 10).select(F.lit(mode).alias("mode"), "status") for full, mode in ((True, "full"), (False, "recent"))]
    return both[0].union(both[1]).groupBy("mode", "status").agg(F.count("*").alias("buckets"))


@query(f"SELECT {_SCOPE}, TRUE AS more FROM (SELECT {_SCOPE} FROM h WHERE event_id%2=0 UNION SELECT {_SCOPE} FROM h WHERE event_id%3=0) WHERE ({_SCOPE})>(DATE '2024-01-10', 5, 'click') ORDER BY {_SCOPE} LIMIT 40", hourly=True)
def scope_page(u, h, p):
    return ledger.scope_page([h.where("event_id % 2 = 0"), h.where("event_id % 3 = 0")], ["day", "hour", "provider_id"], (date(2024, 1, 10), 5, "click"), 40)


@query(
    """SELECT event_id, total_tokens, CASE WHEN event_id%2=0 THEN sha256('legacy|' || event_id) ELSE 'f' END AS source_fingerprint, CASE WHEN event_id%2=0 THEN 'legacy' ELSE 'r' END AS raw_source_ref,
 CASE WHEN event_id%3=0 OR event_id%5=0 THEN round(CASE WHEN model='m1' THEN (input_tokens+output_tokens+cache_read_tokens+cache_write_tokens)/1e6::DOUBLE ELSE -1.0::DOUBLE END, 9) ELSE 5.0::DOUBLE END AS cost, CASE WHEN event_id%3=0 OR event_id%5=0 THEN CASE WHEN model='m1' THEN 'exact_price' ELSE 'unknown_price' END ELSE 'estimated_price' END AS cost_quality FROM h""",
    hourly=True,
)
def migrated_rows(u, h, p):
    spark, i = h.sparkSession, F.col("event_id")
    old = h.withColumns({"source_fingerprint": F.when(i % 2 != 0, "f"), "raw_source_ref": F.when(i % 2 != 0, "r"), "cost": F.lit(5.0), "cost_quality": F.when(i % 5 != 0, "estimated_price"), "total_tokens": F.col("total_tokens") + F.when(i % 3 == 0, 1).otherwise(0)})
    prices = spark.createDataFrame([("m1", 1.0, 1.0, None, None)], "model string, input_rate double, output_rate double, cache_read_rate double, cache_write_rate double")
    found = ledger.migrated(old, "event_id", prices)
    return found.select("event_id", "total_tokens", "source_fingerprint", "raw_source_ref", F.round(F.coalesce("cost", F.lit(-1.0)), 9).alias("cost"), "cost_quality")


@query(
    """SELECT day, provider_id, count(*) AS row_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sha256('[' || string_agg(j, ',' ORDER BY j) || ']') AS fingerprint FROM (SELECT *, '{"eventId":' || event_id || CASE WHEN event_id%3=0 THEN '' ELSE ',"model":"' || model || '"' END || ',"totalTokens":' || total_tokens || '}' AS j FROM h) GROUP BY 1,2""",
    hourly=True,
)
def daily_fingerprints(u, h, p):
    from meterlake.operators.lifecycle import bucket_fingerprints

    rows = h.select("day", "provider_id", "total_tokens", F.col("event_id").alias("eventId"), F.when(F.col("event_id") % 3 != 0, F.col("model")).alias("model"), F.col("total_tokens").alias("totalTokens"))
    return bucket_fingerprints(rows, ["day", "provider_id"], {"eventId": "number", "model": "text", "totalTokens": "number"}, omit_missing=True)


# --- gateway views: a tenth of the requests are probes, some are ahead of today

_TODAY = date(2024, 1, 28)
_JUDGED = """j AS (SELECT day, hour, provider_id AS source, CASE WHEN event_id%9=0 THEN 'unknown/other' ELSE model END AS model, CASE WHEN event_id%6=0 THEN 0 ELSE total_tokens END AS t, CASE WHEN event_id%6=0 THEN 0.0::DOUBLE ELSE input_tokens/1e6::DOUBLE END AS c, CAST(status>=400 AS BIGINT) AS e
 FROM h WHERE event_id%10<>0 AND (event_id%6<>0 OR status>=400) AND day<=DATE '2024-01-28')"""


def _gateway(h):
    i = F.col("event_id")
    tokens = [F.when(i % 6 == 0, 0).otherwise(F.col(c)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens")]
    return h.select("day", "hour", F.col("provider_id").alias("source"), F.when(i % 9 == 0, "").otherwise(F.upper("model")).alias("model"), *tokens, (F.col("input_tokens") / 1e6).alias("cost"), "status", F.when(i % 10 == 0, "probe").otherwise("chat").alias("kind"), (i % 6 != 0).alias("counted"))


def _named(names):
    return F.array_join(F.transform(names, lambda x: F.concat_ws(":", x["name"], x["total_tokens"].cast("string"), x["calls"].cast("string"), x["errors"].cast("string"))), ",")


_NAMES = "(SELECT day, string_agg({0} || ':' || t || ':' || n || ':' || e, ',' ORDER BY t DESC, {0}) AS {0}s FROM (SELECT day, {0}, CAST(sum(t) AS BIGINT) AS t, count(*) AS n, CAST(sum(e) AS BIGINT) AS e FROM j GROUP BY 1,2) GROUP BY 1)"


@query(
    f"SELECT d.day, total_tokens, calls, errors, cost, sources, models FROM (SELECT day, CAST(sum(t) AS BIGINT) AS total_tokens, count(*) AS calls, CAST(sum(e) AS BIGINT) AS errors, round(sum(c), 6) AS cost FROM j GROUP BY 1 ORDER BY 1 DESC LIMIT 20) d JOIN {_NAMES.format('source')} USING (day) JOIN {_NAMES.format('model')} USING (day)",
    hourly=True,
    first=_JUDGED,
)
def gateway_days(u, h, p):
    days = gateway_views.summaries(_gateway(h), _TODAY, most_days=20)
    return days.select("day", "total_tokens", "calls", "errors", "cost", _named(F.col("sources")).alias("sources"), _named(F.col("models")).alias("models"))


def _points(metric, split, grain, sql):
    def f(u, h, p):
        shown = gateway_views.points(gateway_views.summaries(_gateway(h), _TODAY, grain), metric, split, grain)
        return shown.select("label", "name", F.round(F.col("value").cast("double") + 1e-9, 5).alias("value"), F.round(F.col("total").cast("double") + 1e-9, 5).alias("total"))

    f.__name__ = f"chart_{metric}_by_{split}_and_{grain}"
    key = "lpad(CAST(hour AS VARCHAR), 2, '0')" if grain == "hour" else "strftime(day, '%m/%d')"
    own = f"own AS (SELECT {grain}, {key} AS label, {split} AS name, CAST({sql} AS DOUBLE) AS value FROM j {'WHERE day=DATE %s2024-01-28%s' % (chr(39), chr(39)) if grain == 'hour' else ''} GROUP BY 1,2,3)"
    empty = f" UNION ALL SELECT lpad(CAST(range AS VARCHAR), 2, '0'), '', 0.0::DOUBLE, 0.0::DOUBLE FROM range(24) WHERE range NOT IN (SELECT hour FROM own)" if grain == "hour" else ""
    query(f"SELECT label, name, round(value+1e-9::DOUBLE, 5) AS value, round(sum(value) OVER (PARTITION BY {grain})+1e-9::DOUBLE, 5) AS total FROM own{empty}", hourly=True, first=f"{_JUDGED}, {own}")(f)


for _args in (("tokens", "model", "day", "sum(t)"), ("calls", "source", "hour", "count(*)"), ("cost", "source", "day", "round(sum(c), 6)")):
    _points(*_args)


@query("SELECT day, provider_id, model, workdir_id, count(*) AS rows, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM u WHERE participant_id=7 AND day BETWEEN DATE '2001-06-01' AND DATE '2001-06-15' GROUP BY 1,2,3,4", span=MONTH)
def person_days(u, h, p):
    from meterlake.operators.rules import in_scope

    return in_scope(u, MONTH, participant_id=7).groupBy("day", "provider_id", "model", "workdir_id").agg(F.count("*").alias("rows"), F.sum("total_tokens").alias("total_tokens"))


@query("SELECT event_id, CASE WHEN event_id%7=0 THEN '-' WHEN event_id%5=0 THEN '< $0.01' ELSE '$' || CASE WHEN input_tokens>=1000 THEN CAST(input_tokens//1000 AS VARCHAR) || ',' || lpad(CAST(input_tokens%1000 AS VARCHAR), 3, '0') ELSE CAST(input_tokens AS VARCHAR) END || '.25' END AS usd FROM h WHERE input_tokens<1000000", hourly=True)
def dollars(u, h, p):
    i = F.col("event_id")
    value = F.when(i % 7 == 0, None).when(i % 5 == 0, 0.004).otherwise(F.col("input_tokens") + 0.25)
    return h.where("input_tokens < 1000000").select("event_id", display.usd(value).alias("usd"))


@query("SELECT reason, count(*) AS clients FROM (SELECT CASE event_id%8 WHEN 0 THEN 'missing_client_protocol' WHEN 1 THEN 'malformed_client_protocol' WHEN 2 THEN 'malformed_client_protocol' WHEN 3 THEN 'client_protocol_too_old' WHEN 4 THEN 'client_protocol_too_new' WHEN 5 THEN 'newer_client_available' ELSE '' END AS reason FROM h) GROUP BY 1", hourly=True)
def client_compatibility(u, h, p):
    i = F.col("event_id") % 8
    protocol = F.when(i == 0, None).when(i == 1, "x").when(i == 2, "1.5").when(i == 3, "1").when(i == 4, "9").otherwise("3")
    version = F.when(i == 5, "1.9.12-beta").when(i == 6, "1.10.0").otherwise("")
    return h.groupBy(display.compatibility(protocol, version, 2, 4, "1.10.0")["reason"].alias("reason")).agg(F.count("*").alias("clients"))
