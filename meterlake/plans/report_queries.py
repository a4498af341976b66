"""The registered queries of boards, ledger views and display figures, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meterlake.operators import analytics as A
from meterlake.operators import boards as B
from meterlake.operators import display as D
from meterlake.operators import pricing as C
from meterlake.operators import rules as R
from meterlake.plans import surrogate as S
from meterlake.plans.catalogue import _COSTED, _MEMBERS, _NOW, _THEN, _costed, _members, costed_sql, query
from meterlake.plans.ranges import resolve_range

DAY, MONTH = S.BUSINESS_DAY, resolve_range("this_month", S.BUSINESS_DAY)
_T = "CAST(sum(total_tokens) AS BIGINT) AS total_tokens"
_SIX = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in S.TOKENS)
_RATIO = "round(coalesce(({a})::DOUBLE/nullif(({b})::DOUBLE,0),0),6)"
_BETWEEN = "day BETWEEN DATE '{}' AND DATE '{}'".format
_TEXT = "string_agg({n} || '=' || t, ',' ORDER BY t DESC, {n})".format


@query(f"""SELECT participant_id, nickname, total_tokens, n_models, models, row_number() OVER (ORDER BY total_tokens DESC, participant_id) AS rank FROM (
 SELECT participant_id, CAST(sum(t) AS BIGINT) AS total_tokens, count(*) AS n_models, {_TEXT(n='model')} FILTER (r<=10) AS models FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY t DESC, model) AS r FROM (SELECT participant_id, model, CAST(sum(total_tokens) AS BIGINT) AS t FROM u WHERE {_BETWEEN(*MONTH)} GROUP BY 1,2)) GROUP BY 1) JOIN (SELECT participant_id, nickname FROM p) USING (participant_id)""", span=MONTH)
def board_with_models(u, h, p):
    return B.board_with_models(A.in_range(u, MONTH), p)


@query(costed_sql("participant_id", f"WHERE {_BETWEEN(*MONTH)}") + f"""SELECT participant_id, nickname, total_tokens, cost, missing_tokens, row_number() OVER (ORDER BY total_tokens DESC, participant_id) AS rank FROM (SELECT participant_id, {_T}, round(sum(cost)+1e-10::DOUBLE,6) AS cost,
 CAST(coalesce(sum(CASE WHEN cost IS NULL THEN total_tokens END),0) AS BIGINT) AS missing_tokens FROM c GROUP BY 1) JOIN (SELECT participant_id, nickname FROM p) USING (participant_id)""", span=MONTH)
def board_with_cost(u, h, p):
    by_model = A.totals_by(A.in_range(u, MONTH), "participant_id", "model")
    return B.board_with_cost(_costed(by_model), p)


@query(f"SELECT provider_id, {_RATIO.format(a='sum(cache_read_tokens)', b='sum(input_tokens)+sum(cache_read_tokens)')} AS cache_hit_rate FROM u GROUP BY 1", lean=True)
def cache_hit_rate(u, h, p):
    return B.cache_hit_rate(u, "provider_id")


@query("""SELECT model, cache_read_tokens, round(cache_read_tokens*(CASE WHEN n IS NULL OR n%5=0 THEN 1.35::DOUBLE WHEN n%2=0 THEN n*0.5::DOUBLE*0.9::DOUBLE ELSE greatest(n*0.5::DOUBLE-n*0.05::DOUBLE,0) END)/1e6,6) AS saved
 FROM (SELECT model, CAST(substr(model,7) AS INTEGER) AS n, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens FROM u GROUP BY 1,2)""")
def cache_savings(u, h, p):
    n = F.col("id")
    prices = u.sparkSession.range(1, 100).where("id % 5 <> 0").select(F.concat(F.lit("Brand#"), n.cast("string")).alias("model"), (n * 0.5).alias("input_rate"), F.when(n % 2 == 1, n * 0.05).alias("cache_read_rate"))
    return B.cache_savings(u.groupBy("model").agg(F.sum("cache_read_tokens").alias("cache_read_tokens")), prices)


def _hours(name, day):
    def f(u, h, p):
        return B.day_hours(h, day)

    f.__name__ = name
    query(f"SELECT CAST(r.range AS INTEGER) AS hour, CAST(coalesce(sum(total_tokens),0) AS BIGINT) AS total_tokens, count(DISTINCT participant_id) AS active FROM range(24) r LEFT JOIN (SELECT * FROM h WHERE day=DATE '{day}') x ON x.hour=r.range WHERE EXISTS (SELECT 1 FROM h WHERE day=DATE '{day}') GROUP BY 1", hourly=True)(f)


_hours("hours_of_day", date(2024, 1, 15))
_hours("hours_of_empty_day", date(2030, 1, 1))


@query(f"SELECT participant_id, primary_provider, total_tokens, row_number() OVER (ORDER BY total_tokens DESC, participant_id) AS rank FROM (SELECT participant_id, arg_min(provider_id, (-t, provider_id)) AS primary_provider, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT participant_id, provider_id, CAST(sum(total_tokens) AS BIGINT) AS t FROM u GROUP BY 1,2) GROUP BY 1)", lean=True)
def ranking_with_provider(u, h, p):
    return B.ranking_with_provider(u)


@query(f"""SELECT provider_id, peak_day, rows, total_tokens, {_RATIO.format(a='total_tokens', b='sum(total_tokens) OVER ()')} AS share, active_participants FROM (
 SELECT provider_id, arg_min(day, (-t, day)) AS peak_day, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT provider_id, day, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS t FROM u WHERE {_BETWEEN(*MONTH)} GROUP BY 1,2) GROUP BY 1)
 JOIN (SELECT provider_id, count(DISTINCT CASE WHEN total_tokens>0 THEN participant_id END) AS active_participants FROM u WHERE {_BETWEEN(*MONTH)} GROUP BY 1) USING (provider_id)""", span=MONTH, lean=True)
def source_stats(u, h, p):
    return B.source_stats(u, MONTH)


@query("SELECT provider_id, day, CAST(coalesce(sum(total_tokens),0) AS BIGINT) AS total_tokens FROM (SELECT provider_id, CAST(unnest(generate_series(DATE '2001-06-02', DATE '2001-06-15', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT provider_id FROM u)) LEFT JOIN u USING (provider_id, day) GROUP BY 1,2", lean=True)
def source_trend(u, h, p):
    return B.source_trend(u, DAY, 14)


_ANOMALIES = f"""(SELECT day, total_tokens, concat_ws(',', CASE WHEN i>=0.7 THEN 'input-heavy' END, CASE WHEN o>=0.45 THEN 'output-heavy' END, CASE WHEN c>=0.35 THEN 'cache-heavy' END, CASE WHEN r>=0.25 THEN 'reasoning-heavy' END) AS kinds
 FROM (SELECT day, {_T}, {', '.join(f"{_RATIO.format(a=a, b='sum(total_tokens)')} AS {n}" for n, a in (('i', 'sum(input_tokens)'), ('o', 'sum(output_tokens)'), ('c', 'sum(cache_read_tokens)+sum(cache_write_tokens)'), ('r', 'sum(reasoning_tokens)')))} FROM u GROUP BY 1))"""


@query(f"SELECT * FROM {_ANOMALIES} WHERE kinds<>''", lean=True)
def composition_anomalies(u, h, p):
    return B.composition_anomalies(u)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY total_tokens DESC, day) AS n FROM (SELECT day, total_tokens, unnest(string_split(kinds, ',')) AS kind FROM {_ANOMALIES} WHERE kinds<>'')) WHERE n<=5", lean=True)
def anomaly_groups(u, h, p):
    return B.anomaly_groups(B.composition_anomalies(u))


@query(f"SELECT day, total_tokens, round(mean,4) AS mean_tokens FROM (SELECT *, avg(total_tokens) OVER () AS mean FROM (SELECT participant_id, day, {_T} FROM u WHERE participant_id=7 GROUP BY 1,2)) WHERE total_tokens>1.5*mean", lean=True)
def abnormal_days_of_person(u, h, p):
    return A.abnormal_days(u.where("participant_id = 7"), 1.5)


def _coverage(key):
    def f(u, h, p):
        return B.price_coverage(_costed(A.totals_by(u, key, "model")) if key != "model" else _costed(A.totals_by(u, "model")), key)

    f.__name__ = f"price_coverage_by_{key.removesuffix('_id')}"
    query(_COSTED + f"SELECT {key}, k AS known_tokens, total_tokens-k AS missing_tokens, {_RATIO.format(a='k', b='total_tokens')} AS coverage FROM (SELECT {key}, {_T}, CAST(coalesce(sum(CASE WHEN cost IS NOT NULL THEN total_tokens END),0) AS BIGINT) AS k FROM c GROUP BY 1)")(f)


for _key in ("participant_id", "day", "model"):
    _coverage(_key)

_DEVICES = "(SELECT device_id, participant_id, max(day) AS last_seen, count(*) AS rows FROM u GROUP BY 1,2)"


@query(f"SELECT participant_id, device_id, last_seen, rows, nickname FROM {_DEVICES} LEFT JOIN p USING (participant_id)", lean=True)
def admin_devices(u, h, p):
    return B.devices(u, p)


@query(f"SELECT participant_id, device_id, last_seen, rows, nickname, CAST(DATE '2001-11-20' - last_seen AS INTEGER) AS days_since FROM {_DEVICES} LEFT JOIN p USING (participant_id) WHERE DATE '2001-11-20' - last_seen > 30", lean=True)
def stale_devices(u, h, p):
    return B.stale(B.devices(u, p), date(2001, 11, 20), 30)


@query("SELECT version, count(*) AS devices, version IN ('v1.2.0', '1.9.9-beta.1') AS outdated FROM (SELECT CASE device_id%3 WHEN 0 THEN 'v1.2.0' WHEN 1 THEN '1.10.0' ELSE '1.9.9-beta.1' END AS version FROM (SELECT DISTINCT device_id FROM u)) GROUP BY 1", lean=True)
def fleet_versions(u, h, p):
    version = F.when(F.col("device_id") % 3 == 0, "v1.2.0").when(F.col("device_id") % 3 == 1, "1.10.0").otherwise("1.9.9-beta.1")
    return D.fleet_versions(u.select("device_id").distinct().withColumn("version", version), "1.10.0")


@query("""SELECT label, count(*) AS devices FROM (SELECT CASE device_id%5 WHEN 0 THEN 'Windows · x64' WHEN 1 THEN 'macOS · arm64' WHEN 2 THEN 'Linux · x64' WHEN 3 THEN 'plan9' ELSE '-' END AS label FROM (SELECT DISTINCT device_id FROM u)) GROUP BY 1""", lean=True)
def platform_labels(u, h, p):
    text = F.get(F.array(*[F.lit(x) for x in ("windows-x64", "darwin-aarch64", "linux-x86_64", "plan9", "")]), (F.col("device_id") % 5).cast("int"))
    return u.select("device_id").distinct().groupBy(D.platform(text).alias("label")).agg(F.count("*").alias("devices"))


@query(f"SELECT team_id, tool_code, count(*) AS users, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT participant_id, tool_code, CAST(sum(total_tokens) AS BIGINT) AS t FROM u GROUP BY 1,2 HAVING sum(total_tokens)>0) JOIN p USING (participant_id) GROUP BY 1,2", lean=True)
def team_tools(u, h, p):
    return B.team_tools(u, p)


@query(f"SELECT CASE WHEN day>=DATE '{_NOW[0]}' THEN 'current' ELSE 'previous' END AS \"window\", day, count(DISTINCT participant_id) AS active, {_T} FROM u WHERE {_BETWEEN(_THEN[0], _NOW[1])} AND total_tokens>0 GROUP BY 1,2", lean=True)
def team_day_rollup(u, h, p):
    now, then = (tuple(map(date.fromisoformat, x)) for x in (_NOW, _THEN))
    return B.day_rollup(u, now, then)


@query("SELECT CASE WHEN team_id<10 THEN team_id END AS team_id, count(*) AS members FROM p GROUP BY 1", lean=True)
def team_management(u, h, p):
    return B.team_members(p, p.where("team_id < 10").select("team_id").distinct())


@query(_MEMBERS + "SELECT team_id, a+b AS churn, b AS paused, d AS delta_active FROM (SELECT team_id, count(*) FILTER (kind='new') AS a, count(*) FILTER (kind='paused') AS b, count(*) FILTER (active_days>0)-count(*) FILTER (previous_days>0) AS d FROM m GROUP BY 1) WHERE a+b>0 OR d<>0 ORDER BY a+b DESC, b DESC, d, team_id LIMIT 1", lean=True)
def team_story_focus(u, h, p):
    return B.story_focus(A.team_rollup(_members(u, p)))


@query(_MEMBERS + f"SELECT team_id, tokens, {_RATIO.format(a='tokens', b='sum(tokens) OVER ()')} AS share FROM (SELECT team_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY 1)", lean=True)
def team_token_share(u, h, p):
    from pyspark.sql.window import Window

    return A.team_rollup(_members(u, p)).select("team_id", "tokens", A.ratio(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())).alias("share"))


@query(f"""SELECT field, name, total_tokens, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY total_tokens DESC, name) AS rank FROM (SELECT 'total' AS field, '' AS name, 1 AS most, {_T} FROM u
 UNION ALL SELECT 'provider_id', provider_id, 5, {_T} FROM u GROUP BY 2 UNION ALL SELECT 'workdir_id', CAST(workdir_id AS VARCHAR), 10, {_T} FROM u GROUP BY 2 UNION ALL SELECT 'model', model, 10, {_T} FROM u GROUP BY 2)) WHERE rank<=most""")
def ledger_summary(u, h, p):
    return B.summary(u, {"provider_id": 5, "workdir_id": 10, "model": 10})


@query(f"SELECT workdir_id AS name, {_SIX}, count(*) AS rows FROM u GROUP BY 1 ORDER BY total_tokens DESC, 1 LIMIT 20", lean=True)
def ledger_workdirs(u, h, p):
    return B.grouped(u, "workdir_id", 20)


@query(f"SELECT day, provider_id, workdir_id, {_T} FROM u GROUP BY 1,2,3 ORDER BY day DESC, total_tokens DESC, provider_id, workdir_id LIMIT 50 OFFSET 25", lean=True)
def ledger_detail_window(u, h, p):
    return B.detail_window(u, ["provider_id", "workdir_id"], 25, 50)


@query(f"SELECT {_SIX}, count(*) AS rows FROM u", lean=True)
def ledger_totals(u, h, p):
    return B.all_totals(u)


for _field in ("model", "tool_code", "provider_id"):
    def _grouped(u, h, p, field=_field):
        return B.grouped(u, field)

    _grouped.__name__ = f"group_by_{_field.removesuffix('_id').removesuffix('_code')}"
    query(f"SELECT {_field} AS name, {_SIX}, count(*) AS rows FROM u GROUP BY 1")(_grouped)


@query(f"SELECT CAST(coalesce(sum(total_tokens),0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(calls),0) AS BIGINT) AS calls, count(*) AS days FROM (SELECT day, {_T}, count(*) AS calls FROM h GROUP BY 1) WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'", hourly=True)
def gateway_last_days(u, h, p):
    daily = h.groupBy("day").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("calls"))
    return B.last_days(daily, S.EVENT_DAY, 7, "total_tokens", "calls")


def _trend_detail(grain):
    def f(u, h, p):
        return B.trend_with_detail(u, A.bucket(grain), "workdir_id")

    f.__name__ = f"trend_with_detail_{grain}"
    query(f"SELECT period_start, {_TEXT(n='workdir_id::VARCHAR')} FILTER (r<=3) AS largest, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY period_start ORDER BY t DESC, workdir_id::VARCHAR) AS r FROM (SELECT CAST(date_trunc('{grain}', day) AS DATE) AS period_start, workdir_id, CAST(sum(total_tokens) AS BIGINT) AS t FROM u GROUP BY 1,2)) GROUP BY 1", lean=True)(f)


for _grain in ("day", "week", "month"):
    _trend_detail(_grain)


def _drill(grain, finer, start):
    def f(u, h, p):
        return B.drill_down(u, grain, start)

    f.__name__ = f"drill_down_{grain}"
    query(f"SELECT CAST(date_trunc('{finer}', day) AS DATE) AS period_start, {_SIX} FROM u WHERE date_trunc('{grain}', day)=date_trunc('{grain}', DATE '{start}') GROUP BY 1", lean=True)(f)


for _args in (("week", "day", date(2001, 6, 15)), ("month", "week", date(2001, 6, 15)), ("year", "month", date(2001, 6, 15))):
    _drill(*_args)


@query(f"SELECT model AS name, total_tokens, round(CASE WHEN sum(total_tokens) OVER ()=0 THEN 1 ELSE total_tokens::DOUBLE/(sum(total_tokens) OVER ())::DOUBLE END,4) AS share FROM (SELECT model, {_T} FROM u GROUP BY 1)")
def share_card(u, h, p):
    return B.share_card(u, "model")


def _stacked(name, split, measure, sql):
    def f(u, h, p):
        return B.stacked_points(h, F.col("hour"), split, measure())

    f.__name__ = f"stacked_{name}"
    query(f""", b AS (SELECT hour AS period, CAST({split} AS VARCHAR) AS split, CAST({sql} AS BIGINT) AS value FROM h GROUP BY 1,2), k AS (SELECT split FROM (SELECT split, row_number() OVER (ORDER BY sum(value) DESC, split) AS r FROM b GROUP BY 1) WHERE r<=7)
 SELECT period, CASE WHEN k.split IS NULL THEN 'Other' ELSE b.split END AS series, CAST(sum(value) AS BIGINT) AS value FROM b LEFT JOIN k ON b.split=k.split GROUP BY 1,2""", hourly=True)(f)


_stacked("tokens_by_model", "model", lambda: F.sum("total_tokens"), "sum(total_tokens)")
_stacked("calls_by_source", "provider_id", lambda: F.count("*"), "count(*)")


@query(f"SELECT CAST(date_trunc('week', day) AS DATE) AS week, max(active) AS active, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT day, count(DISTINCT participant_id) AS active, sum(total_tokens) AS t FROM u GROUP BY 1) GROUP BY 1", lean=True)
def week_series(u, h, p):
    return B.week_series(u.groupBy("day").agg(F.sum("total_tokens").alias("total_tokens"), F.count_distinct("participant_id").alias("active")))


@query(f""", r AS (SELECT *, row_number() OVER (ORDER BY t DESC, participant_id) AS k FROM (SELECT participant_id, sum(total_tokens) AS t FROM u GROUP BY 1)), w AS (SELECT CAST((dayofweek(day)+6)%7 AS INTEGER) AS d, sum(total_tokens) AS t FROM u GROUP BY 1)
 SELECT {_RATIO.format(a='sum(CASE WHEN k<=5 THEN t END)', b='sum(t)')} AS top5_share, count(*) FILTER (t>0) AS active, (SELECT arg_min(d, (-t, d)) FROM w) AS peak_weekday, (SELECT {_RATIO.format(a='sum(CASE WHEN d>=5 THEN t END)', b='sum(t)')} FROM w) AS weekend_share FROM r""", lean=True)
def insights(u, h, p):
    return B.insights(u)


@query("SELECT participant_id, nickname FROM p", lean=True)
def participant_options(u, h, p):
    return B.person_options(p)


_WHOLE = "CAST(CAST(floor(round(coalesce(({a})::DOUBLE/nullif(total_tokens::DOUBLE,0),0),12)*100+0.5) AS INTEGER) AS VARCHAR)"
_PARTS = ", ".join(f"CASE WHEN {a}>0 THEN '{n} ' || {_WHOLE.format(a=a)} || '%' END" for n, a in (("in", "input_tokens"), ("out", "output_tokens"), ("cache", "cache_read_tokens+cache_write_tokens"), ("reasoning", "reasoning_tokens")))


@query(f"SELECT participant_id, CASE WHEN total_tokens=0 THEN 'none' ELSE concat_ws(' · ', {_PARTS}) END AS composition FROM (SELECT participant_id, {_SIX} FROM u GROUP BY 1)", lean=True)
def composition_text(u, h, p):
    return A.totals_by(u, "participant_id").select("participant_id", D.composition_text().alias("composition"))


@query(f"""SELECT workdir_id, CASE WHEN total_tokens>=1000000000 THEN regexp_replace(printf('%.1f', round(total_tokens/1e9,1)), '\\.0$', '') || 'B' WHEN total_tokens>=1000000 THEN regexp_replace(printf('%.1f', round(total_tokens/1e6,1)), '\\.0$', '') || 'M' WHEN total_tokens>=1000 THEN regexp_replace(printf('%.1f', round(total_tokens/1e3,1)), '\\.0$', '') || 'K' ELSE total_tokens::VARCHAR END AS compact,
 printf('%.1f', round(total_tokens*100.0::DOUBLE/(sum(total_tokens) OVER ())::DOUBLE,1)) || '%' AS contribution FROM (SELECT workdir_id, {_T} FROM u GROUP BY 1)""", lean=True)
def formatted_figures(u, h, p):
    from pyspark.sql.window import Window

    by = A.totals_by(u, "workdir_id", cols=["total_tokens"])
    return by.select("workdir_id", D.compact(F.col("total_tokens")).alias("compact"), D.contribution_text(F.col("total_tokens"), F.sum("total_tokens").over(Window.partitionBy())).alias("contribution"))


@query("SELECT participant_id, CAST(('0x' || substr(sha256(participant_id::VARCHAR),1,4))::BIGINT % 6 AS INTEGER) AS colour FROM p", lean=True)
def avatar_colours(u, h, p):
    return p.select("participant_id", D.hash_number(F.col("participant_id").cast("string"), 6).alias("colour"))


@query(f"SELECT participant_id, total_tokens, 'Workdir ' || row_number() OVER (PARTITION BY participant_id ORDER BY total_tokens DESC, workdir_id) AS label FROM (SELECT participant_id, workdir_id, {_T} FROM u GROUP BY 1,2)", lean=True)
def redacted_workdirs(u, h, p):
    return D.redacted_workdirs(A.totals_by(u, "participant_id", "workdir_id", cols=["total_tokens"]))


@query(f"SELECT participant_id, provider_id, total_tokens, greatest(2.0::DOUBLE, round(total_tokens*100.0::DOUBLE/(sum(total_tokens) OVER (PARTITION BY participant_id))::DOUBLE,4)) AS width FROM (SELECT participant_id, provider_id, {_T} FROM u GROUP BY 1,2) WHERE total_tokens>0", lean=True)
def segment_widths(u, h, p):
    return D.segment_widths(A.totals_by(u, "participant_id", "provider_id", cols=["total_tokens"]))


@query(costed_sql() + "SELECT model, round(sum(cost)/sum(total_tokens)::DOUBLE*1e8,4) AS per_100m FROM c GROUP BY 1")
def price_per_100m(u, h, p):
    return _costed(A.totals_by(u, "model")).select("model", D.price_per_100m(F.col("cost"), F.col("total_tokens")).alias("per_100m"))


@query(costed_sql("provider_id") + f"SELECT provider_id, round(sum(cost)+1e-10::DOUBLE,6) AS cost, {_T} FROM c GROUP BY 1")
def cost_by_provider(u, h, p):
    return C.cost_summary(_costed(A.totals_by(u, "provider_id", "model")), "provider_id").drop("missing_tokens", "cost_quality").join(A.totals_by(u, "provider_id", cols=["total_tokens"]), "provider_id")


@query(f"SELECT day, participant_id, provider_id, {_T} FROM u WHERE {_BETWEEN('2001-05-01', '2001-05-31')} AND provider_id='R_F' AND participant_id IN (3,5,7) GROUP BY 1,2,3", span=(date(2001, 5, 1), date(2001, 5, 31)), lean=True)
def scoped_rows(u, h, p):
    return A.totals_by(R.in_scope(u, (date(2001, 5, 1), date(2001, 5, 31)), provider_id="R_F", participant_id=[3, 5, 7], tool_code=None), "day", "participant_id", "provider_id", cols=["total_tokens"])


@query(f"SELECT model, provider_id, {_T} FROM u WHERE lower(model) LIKE '%#2%' AND lower(provider_id) LIKE '%a\\_%' ESCAPE '\\' GROUP BY 1,2")
def substring_filters(u, h, p):
    return A.totals_by(R.containing(u, model="D#2", provider_id="a_"), "model", "provider_id", cols=["total_tokens"])


@query(f"SELECT day, {_T} FROM u WHERE day<=DATE '1996-01-01' GROUP BY 1", lean=True)
def not_ahead(u, h, p):
    return A.totals_by(R.not_ahead(u, date(1996, 1, 1)), "day", cols=["total_tokens"])


@query(f"SELECT day, {_T} FROM u WHERE day IN (SELECT DISTINCT day FROM u ORDER BY day DESC LIMIT 90) GROUP BY 1", lean=True)
def newest_days(u, h, p):
    return A.totals_by(R.newest_days(u, 90), "day", cols=["total_tokens"])


@query(f"SELECT provider_id, {_T}, count(*) AS rows FROM h WHERE provider_id NOT IN ('view','click') AND total_tokens>0 GROUP BY 1", hourly=True)
def countable_requests(u, h, p):
    kind = F.when(F.col("provider_id") == "view", "probe").when(F.col("provider_id") == "click", "model_list")
    return R.countable(h.withColumn("kind", kind)).groupBy("provider_id").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("rows"))


@query("SELECT day, hour, count(*) AS rows FROM (SELECT CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai' AS TIMESTAMP) AS t FROM h) x, LATERAL (SELECT CAST(t AS DATE) AS day, CAST(hour(t) AS INTEGER) AS hour) GROUP BY 1,2", hourly=True)
def local_days(u, h, p):
    return h.groupBy(R.local_day(F.col("ts"), "Asia/Shanghai").alias("day"), R.local_hour(F.col("ts"), "Asia/Shanghai").alias("hour")).agg(F.count("*").alias("rows"))


@query("SELECT CASE WHEN participant_id%10=0 THEN 'no_workdir' ELSE 'ok' END AS status, count(*) AS rows FROM u GROUP BY 1", lean=True)
def validated_items(u, h, p):
    marked = u.withColumn("workdir", F.when(F.col("participant_id") % 10 == 0, "").otherwise("w"))
    return marked.groupBy(F.coalesce(F.nullif(F.array_join(R.problems(["provider_id", "workdir"]), ","), F.lit("")), F.lit("ok")).alias("status")).agg(F.count("*").alias("rows"))


@query("SELECT participant_id, sha256(CASE participant_id%3 WHEN 0 THEN 'virtual:Desk:T ' || participant_id WHEN 1 THEN 'c:/home/work' ELSE '' END || ':' || participant_id) AS workdir_hash, CASE participant_id%3 WHEN 0 THEN 'T ' || participant_id WHEN 1 THEN 'Work' ELSE 'root' END AS workdir_name FROM p", lean=True)
def workdir_identities(u, h, p):
    kind = F.col("participant_id") % 3
    folder = F.when(kind == 0, F.concat(F.lit("virtual:Desk:T "), F.col("participant_id").cast("string"))).when(kind == 1, "C:\\Home\\Work//").otherwise("//")
    digest, name = R.workdir_identity(folder, F.col("participant_id"))
    return p.select("participant_id", digest.alias("workdir_hash"), name.alias("workdir_name"))


@query("SELECT participant_id, CASE WHEN participant_id%4=0 THEN 'alias ' || participant_id ELSE nickname END AS nickname, team_id FROM p", lean=True)
def alias_names(u, h, p):
    aliases = p.where("participant_id % 4 = 0").select("participant_id", F.concat(F.lit("alias "), F.col("participant_id").cast("string")).alias("alias"))
    return R.with_alias(p, aliases, "participant_id", "nickname")
