"""The registered usage queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators import analytics as A
from meterlake.operators import lifecycle as L
from meterlake.operators import pricing as C
from meterlake.operators import quota as Q
from meterlake.plans import surrogate as S
from meterlake.plans.ranges import resolve_range

DAY = S.BUSINESS_DAY
MONTH = resolve_range("this_month", DAY)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_SIX = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in S.TOKENS)
_TOTAL = "CAST(sum(total_tokens) AS BIGINT) AS total_tokens"
_IN_MONTH = f"day BETWEEN DATE '{MONTH[0]}' AND DATE '{MONTH[1]}'"


def query(sql: str, hourly: bool = False, span=None, lean: bool = False, first: str = "", people: bool = False):
    """Register a function of (daily, hourly, people) under its own name; ``first`` has further relations that the SQL needs, ``people`` those of the participants.

    ``span`` limits what is read of the daily facts to some days, ``lean`` leaves the model out and the join that finds it: that is a left join on the parts' unique key, which no line is lost or doubled by.
    """

    def register(f):
        def run(spark, sf_dir: str) -> DataFrame:
            return f(S.daily_facts(spark, sf_dir, span, not lean), S.hourly_facts(spark, sf_dir), S.participants(spark, sf_dir))

        QUERIES[f.__name__] = run
        given = [S.SQL_HOURLY if hourly else S.SQL_DAILY, *([S.SQL_PEOPLE] if people and hourly else []), *([first] if first else [])]
        ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if first else ''}{', '.join(given)}{'' if sql.startswith(',') else ' '}{sql}"
        return f

    return register


_BOARD = f"""SELECT b.participant_id, nickname, {', '.join(S.TOKENS)}, source_quality,
 CASE WHEN greatest(input_tokens,output_tokens,cache_read_tokens,cache_write_tokens)<=0 THEN 'no-usage'
 WHEN input_tokens=greatest(input_tokens,output_tokens,cache_read_tokens,cache_write_tokens) THEN 'input'
 WHEN output_tokens=greatest(input_tokens,output_tokens,cache_read_tokens,cache_write_tokens) THEN 'output'
 WHEN cache_read_tokens=greatest(input_tokens,output_tokens,cache_read_tokens,cache_write_tokens) THEN 'cache-read' ELSE 'cache-write' END AS dominant,
 row_number() OVER (ORDER BY total_tokens DESC, b.participant_id) AS rank
 FROM (SELECT participant_id, {_SIX}, CASE WHEN max(CASE WHEN source_quality<>'exact' THEN 1 ELSE 0 END)=1 THEN 'partial' ELSE 'exact' END AS source_quality
 FROM u WHERE {{where}} GROUP BY 1) b JOIN p USING (participant_id)"""


@query(_BOARD.format(where=_IN_MONTH), span=MONTH, lean=True)
def public_leaderboard(u, h, p):
    return A.leaderboard(A.in_range(u, MONTH), p)


@query(_BOARD.format(where="TRUE"), lean=True)
def leaderboard_all(u, h, p):
    return A.leaderboard(u, p)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY total_tokens DESC, participant_id) AS rank FROM (SELECT provider_id, participant_id, {_TOTAL} FROM u GROUP BY 1,2)) WHERE rank<=10", lean=True)
def source_leaderboard_topk(u, h, p):
    return A.top_in_group(u, "provider_id", "participant_id", 10)


_PERIODS = {n: resolve_range(n, DAY) for n in ("today", "yesterday", "this_week", "last_week", "this_month", "last_month", "all")}
_PERIOD_SQL = ", ".join(f"CAST(coalesce(sum({'total_tokens' if s is None else f'''CASE WHEN day BETWEEN DATE '{s[0]}' AND DATE '{s[1]}' THEN total_tokens END'''}),0) AS BIGINT) AS {n}" for n, s in _PERIODS.items())


@query(f"SELECT {_PERIOD_SQL}, count(DISTINCT participant_id) AS participants FROM u", lean=True)
def board_summary(u, h, p):
    return u.agg(*A.period_sums(u, _PERIODS), F.count_distinct("participant_id").alias("participants"))


@query(f"SELECT participant_id, {_PERIOD_SQL} FROM u GROUP BY 1")
def participant_summary(u, h, p):
    return u.groupBy("participant_id").agg(*A.period_sums(u, _PERIODS))


def _detail(key):
    def f(u, h, p):
        return A.totals_by(u, "participant_id", key)

    f.__name__ = f"participant_detail_by_{key.removesuffix('_id').removesuffix('_code')}"
    query(f"SELECT participant_id, {key}, {_SIX} FROM u GROUP BY 1,2")(f)


def _trend(grain):
    def f(u, h, p):
        return A.trend(u.where("participant_id = 7"), grain)

    def g(u, h, p):
        return A.totals_by(u.withColumn("period_start", A.bucket(grain)), "period_start", "participant_id")

    def k(u, h, p):
        return A.trend(u, grain)

    for name, fun, sel, where in ((f"participant_trend_{grain}", f, "", "WHERE participant_id=7"), (f"admin_usage_{grain}", g, ", participant_id", ""), (f"local_trend_{grain}", k, "", "")):
        fun.__name__ = name
        query(f"SELECT CAST(date_trunc('{grain}', day) AS DATE) AS period_start{sel}, {_SIX} FROM u {where} GROUP BY 1{', 2' if sel else ''}")(fun)


for _key in ("day", "model", "workdir_id", "provider_id", "tool_code"):
    _detail(_key)
for _grain in ("day", "week", "month"):
    _trend(_grain)


@query("SELECT CAST(r.range AS INTEGER) AS hour, CAST(coalesce(sum(total_tokens),0) AS BIGINT) AS total_tokens, count(DISTINCT day) AS days FROM range(24) r LEFT JOIN h ON h.hour=r.range GROUP BY 1", hourly=True)
def hourly_rhythm(u, h, p):
    return A.hourly_rhythm(h)


@query(f"SELECT CAST((dayofweek(day)+6)%7 AS INTEGER) AS weekday, hour, {_TOTAL} FROM h GROUP BY 1,2", hourly=True)
def hourly_by_weekday(u, h, p):
    return A.weekday_hours(h)


@query("""SELECT participant_id, arg_max(length, last) AS current_streak, max(length) AS best_streak, CAST(sum(length) AS BIGINT) AS active_days, max(last) AS last_day FROM
 (SELECT participant_id, count(*) AS length, max(day) AS last FROM (SELECT participant_id, day, day - CAST(row_number() OVER (PARTITION BY participant_id ORDER BY day) AS INTEGER) AS island
 FROM (SELECT DISTINCT participant_id, day FROM u WHERE total_tokens>0)) GROUP BY participant_id, island) GROUP BY 1""", lean=True)
def profile_streaks(u, h, p):
    return A.streaks(u)


@query(f"SELECT participant_id, day AS peak_day, total_tokens AS peak_tokens FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY total_tokens DESC, day) AS n FROM (SELECT participant_id, day, {_TOTAL} FROM u GROUP BY 1,2)) WHERE n=1")
def profile_peak_day(u, h, p):
    return A.peak_day(u)


_RANKED = f"SELECT *, row_number() OVER (PARTITION BY month ORDER BY total_tokens DESC, participant_id) AS rank FROM (SELECT CAST(date_trunc('month', day) AS DATE) AS month, participant_id, {_TOTAL} FROM u GROUP BY 1,2)"


@query(f"SELECT *, count(*) OVER (PARTITION BY month) AS participants FROM ({_RANKED})", lean=True)
def monthly_ranks(u, h, p):
    return A.month_ranks(u)


@query(f"SELECT month, {_TOTAL}, count(*) AS participants, " + ", ".join(f"round(sum(CASE WHEN rank<={k} THEN total_tokens ELSE 0 END)::DOUBLE/sum(total_tokens)::DOUBLE,6) AS top{k}_share" for k in (1, 5, 10)) + f" FROM ({_RANKED}) GROUP BY 1", lean=True)
def concentration_monthly(u, h, p):
    return A.concentration(u)


@query(f"SELECT model, total_tokens, round(total_tokens::DOUBLE/(sum(total_tokens) OVER ())::DOUBLE,6) AS share FROM (SELECT model, {_TOTAL} FROM u GROUP BY 1)")
def analytics_models_share(u, h, p):
    return A.share_of_total(u, "model")


@query("SELECT CAST(d.day AS DATE) AS day, CAST(coalesce(sum(total_tokens),0) AS BIGINT) AS total_tokens, count(DISTINCT participant_id) AS active FROM (SELECT unnest(generate_series(DATE '2000-06-16', DATE '2001-06-15', INTERVAL 1 DAY)) AS day) d LEFT JOIN u ON u.day=CAST(d.day AS DATE) GROUP BY 1", span=(DAY.replace(year=2000, day=16), DAY), lean=True)
def heatmap_365(u, h, p):
    return A.dense_daily(u, (DAY.replace(year=2000, day=16), DAY))


def _series(name):
    def f(u, h, p):
        return A.named_series(u, name)

    f.__name__ = f"monthly_named_series_{name.removesuffix('_id')}"
    query(f""", m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, {name} AS name, {_TOTAL} FROM u GROUP BY 1,2),
 n AS (SELECT name, sum(total_tokens) AS all_t, max(s) AS peak FROM (SELECT *, total_tokens::DOUBLE/(sum(total_tokens) OVER (PARTITION BY month))::DOUBLE AS s FROM m) GROUP BY 1),
 k AS (SELECT name FROM (SELECT *, row_number() OVER (ORDER BY all_t DESC, name) AS r2 FROM (SELECT *, row_number() OVER (ORDER BY all_t DESC, name) AS r FROM n) WHERE r<=6 OR peak>=0.25) WHERE r2<=8)
 SELECT month, CASE WHEN k.name IS NULL THEN 'other' ELSE CAST(m.name AS VARCHAR) END AS name, {_TOTAL} FROM m LEFT JOIN k USING (name) GROUP BY 1,2""")(f)


for _key in ("model", "provider_id"):
    _series(_key)


@query(f", r AS (SELECT *, row_number() OVER (ORDER BY total_tokens DESC, model) AS rank FROM (SELECT model, {_TOTAL} FROM u GROUP BY 1)) SELECT CASE WHEN rank<=8 THEN model ELSE 'other' END AS name, {_TOTAL} FROM r GROUP BY 1")
def top_n_other(u, h, p):
    return A.fold_rest(u, "model", 8)


_ALL_RANKED = f", r AS (SELECT *, row_number() OVER (ORDER BY total_tokens DESC, participant_id) AS rank FROM (SELECT participant_id, {_TOTAL} FROM u GROUP BY 1)) "


@query(_ALL_RANKED + "SELECT *, round((sum(total_tokens) OVER (ORDER BY rank))::DOUBLE/(sum(total_tokens) OVER ())::DOUBLE,6) AS cumulative_share FROM r")
def pareto(u, h, p):
    return A.pareto(u)


@query(_ALL_RANKED + "SELECT *, lag(total_tokens) OVER (ORDER BY rank)-total_tokens AS gap_ahead, total_tokens-lead(total_tokens) OVER (ORDER BY rank) AS gap_behind FROM r")
def rank_neighbours(u, h, p):
    return A.neighbours(u)


@query(f"SELECT participant_id, CAST(sum(CASE WHEN rank=1 THEN 1 ELSE 0 END) AS BIGINT) AS days_leading, count(*) AS days_active FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total_tokens DESC, participant_id) AS rank FROM (SELECT day, participant_id, {_TOTAL} FROM u GROUP BY 1,2)) GROUP BY 1")
def rank_stats(u, h, p):
    return A.daily_leaders(u)


@query("SELECT provider_id, count(*) AS rows, count(*) FILTER (source_quality<>'exact') AS non_exact, count(*) FILTER (model IS NULL OR model='unknown') AS unknown_model, count(*) FILTER (total_tokens=0) AS empty FROM u GROUP BY 1")
def quality_counters(u, h, p):
    return A.quality_counters(u)


@query(f"SELECT day, total_tokens, round(mean,4) AS mean_tokens FROM (SELECT *, avg(total_tokens) OVER () AS mean FROM (SELECT day, {_TOTAL} FROM u GROUP BY 1)) WHERE total_tokens>3*mean")
def abnormal_days(u, h, p):
    return A.abnormal_days(u)


@query("SELECT participant_id, count(DISTINCT device_id) AS devices FROM u GROUP BY 1 HAVING count(DISTINCT device_id)>1")
def multi_device(u, h, p):
    return A.several_devices(u)


_NOW, _THEN = ("2001-06-02", "2001-06-15"), ("2001-05-19", "2001-06-01")
_MEMBERS = f""", g AS (SELECT participant_id, count(DISTINCT CASE WHEN day>=DATE '{_NOW[0]}' THEN day END) AS a, count(DISTINCT CASE WHEN day<=DATE '{_THEN[1]}' THEN day END) AS b,
 CAST(coalesce(sum(CASE WHEN day>=DATE '{_NOW[0]}' THEN total_tokens END),0) AS BIGINT) AS t, CAST(coalesce(sum(CASE WHEN day<=DATE '{_THEN[1]}' THEN total_tokens END),0) AS BIGINT) AS pt FROM u WHERE day BETWEEN DATE '{_THEN[0]}' AND DATE '{_NOW[1]}' GROUP BY 1),
 m AS (SELECT p.participant_id, team_id, coalesce(a,0) AS active_days, coalesce(b,0) AS previous_days, coalesce(t,0) AS tokens, coalesce(pt,0) AS previous_tokens,
 CASE WHEN coalesce(a,0)=0 AND coalesce(b,0)=0 THEN 'absent' WHEN coalesce(b,0)=0 THEN 'new' WHEN coalesce(a,0)=0 THEN 'paused' WHEN a>b THEN 'rising' WHEN a<b THEN 'falling' ELSE 'steady' END AS kind,
 CASE WHEN coalesce(a,0)>=3 THEN 'steady' WHEN coalesce(a,0)>0 THEN 'light' ELSE 'none' END AS cohort FROM p LEFT JOIN g USING (participant_id)) """


def _members(u, p):

    return A.member_stats(u, p, tuple(map(date.fromisoformat, _NOW)), tuple(map(date.fromisoformat, _THEN)))


@query(_MEMBERS + "SELECT * FROM m")
def team_member_stats(u, h, p):
    return _members(u, p)


@query(_MEMBERS + "SELECT team_id, count(*) AS members, count(*) FILTER (active_days>0) AS active, count(*) FILTER (active_days>0)-count(*) FILTER (previous_days>0) AS delta_active, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (cohort='steady') AS steady, count(*) FILTER (cohort='light') AS light, count(*) FILTER (kind='new') AS new_members, count(*) FILTER (kind='paused') AS paused FROM m GROUP BY 1", span=tuple(map(date.fromisoformat, (_THEN[0], _NOW[1]))), lean=True)
def team_rollup(u, h, p):
    return A.team_rollup(_members(u, p))


@query("SELECT combo, count(*) AS members FROM (SELECT participant_id, string_agg(tool_code, ' + ' ORDER BY tool_code) AS combo FROM (SELECT DISTINCT participant_id, tool_code FROM u) GROUP BY 1 HAVING count(*)>1) GROUP BY 1")
def team_tool_combos(u, h, p):
    return A.tool_combos(u)


def _costed(u, summed: bool = False):
    """Brands are priced by number: every fifth is not, every seventh has its own price, some only under a provider."""
    spark = u.sparkSession
    n = F.col("id")
    rates = [(n * 0.5).alias("input_rate"), (n * 1.5).alias("output_rate"), (n * 0.05).alias("cache_read_rate"), F.when(n % 2 == 0, n * 0.6).alias("cache_write_rate")]
    brands = spark.range(1, 56)
    name = F.when(n % 4 == 0, F.concat(F.lit("openai/brand#"), n.cast("string"))).otherwise(F.concat(F.lit("brand#"), n.cast("string")))
    remote = brands.where("id % 5 <> 0").select(name.alias("model"), *rates)
    custom = brands.where("id % 7 = 0").select(F.concat(F.lit("brand#"), n.cast("string")).alias("model"), *[F.lit(v).alias(c) for c, v in zip(C.RATES, (2.0, 4.0, 0.2, 0.4), strict=True)])
    aliases = spark.createDataFrame([("brand#15", "brand#13")], "source string, target string")
    return C.with_cost(u, C.price_map(remote, custom, aliases), summed=summed)


_COSTED = """, n AS (SELECT range AS id FROM range(1,56)),
 l AS (SELECT *, lower(model) AS lm, CAST(substr(model, 7) AS INTEGER) AS b FROM u),
 k AS (SELECT *, CASE WHEN lm='brand#15' THEN 13 ELSE b END AS b2 FROM l),
 r AS (SELECT *, CASE WHEN b2%7=0 THEN 'c' WHEN b2%5=0 THEN 'n' WHEN b2%4=0 THEN 'e' ELSE 'r' END AS kind FROM k),
 c AS (SELECT *, CASE WHEN kind='n' THEN NULL WHEN kind='c' THEN (input_tokens*2.0::DOUBLE+output_tokens*4.0::DOUBLE+cache_read_tokens*0.2::DOUBLE+cache_write_tokens*0.4::DOUBLE)/1e6
 ELSE (input_tokens*(b2*0.5::DOUBLE)+output_tokens*(b2*1.5::DOUBLE)+cache_read_tokens*(b2*0.05::DOUBLE)+cache_write_tokens*(CASE WHEN b2%2=0 THEN b2*0.6::DOUBLE ELSE b2*0.5::DOUBLE END))/1e6 END AS cost,
 CASE kind WHEN 'n' THEN 2 WHEN 'e' THEN 1 ELSE 0 END AS q FROM r) """


def costed_sql(key: str = "", where: str = "") -> str:
    """Costs of tokens that are summed by model (and a key) before they are priced."""
    keys = f"{key}, model" if key else "model"
    return f", a AS (SELECT {keys}, {_SIX} FROM u {where} GROUP BY ALL)" + _COSTED.replace(" FROM u)", " FROM a)")


@query(costed_sql() + "SELECT model, round(sum(cost)+1e-10::DOUBLE,6) AS cost, CAST(coalesce(sum(CASE WHEN cost IS NULL THEN total_tokens END),0) AS BIGINT) AS missing_tokens, CASE max(q) WHEN 2 THEN 'unknown_price' WHEN 1 THEN 'estimated_price' ELSE 'exact_price' END AS cost_quality FROM c GROUP BY 1")
def cost_by_model(u, h, p):
    return C.cost_summary(_costed(A.totals_by(u, "model"), summed=True), "model")


@query(_COSTED + f"SELECT model, {_TOTAL}, count(*) AS rows, max(day) AS last_seen FROM c WHERE cost IS NULL GROUP BY 1")
def missing_price_models(u, h, p):
    return C.missing_prices(_costed(u))


@query(f"SELECT day, provider_id, model, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('input_tokens', 'output_tokens', 'cache_read_tokens', 'cache_write_tokens', 'total_tokens'))}, TRUE AS hourly_derived FROM h GROUP BY 1,2,3", hourly=True)
def hourly_to_daily(u, h, p):
    return L.derive_daily(h, ["day", "provider_id", "model"])


@query("SELECT event_id, participant_id, total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, day, hour ORDER BY total_tokens DESC, event_id) AS n FROM h) WHERE n=1", hourly=True)
def keep_max_dedup(u, h, p):
    return L.keep_first(h, ["participant_id", "day", "hour"], F.desc("total_tokens"), "event_id").select("event_id", "participant_id", "total_tokens")


@query("SELECT day, hour, provider_id, count(*) AS row_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sha256('[' || string_agg(j, ',' ORDER BY j) || ']') AS fingerprint FROM (SELECT *, '{\"eventId\":' || event_id || ',\"model\":\"' || model || '\",\"totalTokens\":' || total_tokens || '}' AS j FROM h) GROUP BY 1,2,3", hourly=True)
def bucket_fingerprints(u, h, p):
    named = h.withColumnsRenamed({"event_id": "eventId"}).withColumn("totalTokens", F.col("total_tokens"))
    return L.bucket_fingerprints(named, L.SCOPE, {"eventId": "number", "model": "text", "totalTokens": "number"})


@query("SELECT 'even' AS side, event_id FROM h WHERE event_id%2=0 AND (day,hour,provider_id) NOT IN (SELECT (day,hour,provider_id) FROM h WHERE event_id%2=1) UNION ALL SELECT 'odd', event_id FROM h WHERE event_id%2=1", hourly=True)
def replace_scopes(u, h, p):
    stored, incoming = (h.where(f"event_id % 2 = {v}").withColumn("side", F.lit(n)) for v, n in ((0, "even"), (1, "odd")))
    return L.replace_scopes(stored, incoming).select("side", "event_id")


def _grid(unit, n, sql):
    def f(u, h, p):
        return h.groupBy("participant_id", Q.grid_window(F.col("ts"), unit, n).alias("window")).agg(F.sum("total_tokens").alias("total_tokens"))

    f.__name__ = f"quota_grid_{unit}"
    query(f"SELECT participant_id, CAST({sql} AS BIGINT) AS \"window\", {_TOTAL} FROM h GROUP BY 1,2", hourly=True)(f)


_grid("hour", 5, "floor(epoch(ts)/18000)")
_grid("day", 3, "floor(datediff('day', DATE '1970-01-01', day)/3)")
_grid("week", 2, "floor(floor((datediff('day', DATE '1970-01-01', day)+3)/7)/2)")


@query("SELECT participant_id, CAST(sum(CASE WHEN m>=1320 OR m<120 THEN ceil(total_tokens*1.5) ELSE total_tokens END) AS BIGINT) AS charged FROM (SELECT *, hour(ts)*60+minute(ts) AS m FROM h) GROUP BY 1", hourly=True)
def quota_peak_multiplier(u, h, p):
    return h.groupBy("participant_id").agg(F.sum(Q.charged(F.col("ts"), F.col("total_tokens"), [(1320, 120)], 1.5)).alias("charged"))


@query("SELECT participant_id, CAST(sum(total_tokens) AS BIGINT) AS lifetime_tokens, CAST(coalesce(sum(CASE WHEN day>=DATE '2024-01-24' THEN total_tokens END),0) AS BIGINT) AS window_tokens FROM h GROUP BY 1", hourly=True)
def late_bucket_split(u, h, p):
    return Q.late_split(h.withColumn("tokens", F.col("total_tokens")), F.col("day") >= F.lit("2024-01-24").cast("date"), "participant_id")


@query("SELECT participant_id, event_id, CAST(sum(b) OVER (PARTITION BY participant_id ORDER BY ts, event_id) AS BIGINT) AS burst FROM (SELECT *, CASE WHEN epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY participant_id ORDER BY ts, event_id)<=3600000000 THEN 0 ELSE 1 END AS b FROM h)", hourly=True)
def activity_bursts(u, h, p):
    return Q.bursts(h, "participant_id", 3600).select("participant_id", "event_id", "burst")


@query(f"SELECT day, provider_id, {_TOTAL}, count(*) AS calls, count(*) FILTER (status>=400) AS errors FROM h GROUP BY 1,2", hourly=True)
def gateway_day_summary(u, h, p):
    return h.groupBy("day", "provider_id").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("calls"), F.count_if(F.col("status") >= 400).alias("errors"))


@query("SELECT day, participant_id FROM u WHERE provider_id LIKE 'A%' EXCEPT SELECT day, participant_id FROM u WHERE provider_id LIKE 'R%'")
def scope_except(u, h, p):
    return u.where("provider_id like 'A%'").select("day", "participant_id").subtract(u.where("provider_id like 'R%'").select("day", "participant_id"))


@query(f"SELECT day, participant_id, nickname, provider_id, model, {_SIX} FROM u LEFT JOIN p USING (participant_id) WHERE {_IN_MONTH} GROUP BY 1,2,3,4,5")
def export_daily(u, h, p):
    return A.totals_by(A.in_range(u, MONTH).join(p, "participant_id", "left"), "day", "participant_id", "nickname", "provider_id", "model")
