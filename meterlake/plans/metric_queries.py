"""The registered queries of derived figures, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from meterlake.operators import metrics as M
from meterlake.plans import surrogate as S
from meterlake.plans.catalogue import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]
_T = "CAST(sum(total_tokens) AS BIGINT) AS total_tokens"
_NOW, _THEN = (date(2001, 5, 1), date(2001, 5, 31)), (date(2001, 4, 1), date(2001, 4, 30))


@query(f"""SELECT participant_id, day, total_tokens, CAST(CASE WHEN total_tokens<=0 THEN 0 WHEN n<8 THEN least(4, ceil(4*total_tokens::DOUBLE/most)) ELSE 1 + (total_tokens>v[1+floor(0.25*(n-1))::INT])::INT + (total_tokens>v[1+floor(0.5*(n-1))::INT])::INT + (total_tokens>v[1+floor(0.75*(n-1))::INT])::INT END AS INTEGER) AS level
 FROM (SELECT participant_id, day, {_T} FROM u GROUP BY 1,2) JOIN (SELECT participant_id, list(total_tokens ORDER BY total_tokens) AS v, count(*) AS n, max(total_tokens) AS most
 FROM (SELECT participant_id, day, {_T} FROM u GROUP BY 1,2) WHERE total_tokens>0 GROUP BY 1) USING (participant_id)""")
def activity_levels(u, h, p):
    return M.quartile_levels(M.day_totals(u, "participant_id"), "participant_id")


def _heat(levels, sql):
    def f(u, h, p):
        return M.heat_levels(M.day_totals(u), levels)

    f.__name__ = f"heat_levels_{levels}"
    query(f"SELECT day, total_tokens, CAST({sql} AS INTEGER) AS level FROM (SELECT *, total_tokens::DOUBLE/max(total_tokens) OVER () AS s FROM (SELECT day, {_T} FROM u GROUP BY 1))")(f)


_heat(4, "CASE WHEN total_tokens<=0 THEN 0 WHEN s>0.75 THEN 4 WHEN s>0.5 THEN 3 WHEN s>0.25 THEN 2 ELSE 1 END")
_heat(7, "CASE WHEN total_tokens<=0 THEN 0 ELSE greatest(1, least(7, ceil(sqrt(s)*7))) END")


@query(f"""SELECT participant_id, CAST(CASE WHEN t>0 THEN peak ELSE -1 END AS INTEGER) AS peak_hour, night_share, evening_share, work_share,
 array_to_string(list_filter([CASE WHEN night_share>=0.2 THEN 'night' END, CASE WHEN evening_share>=0.35 THEN 'evening' END, CASE WHEN work_share>=0.6 THEN 'work' END], lambda x: x IS NOT NULL)[1:2], ' ') AS tags
 FROM (SELECT participant_id, sum(total_tokens) AS t, arg_min(hour, (-total_tokens, hour)) AS peak,
 round(coalesce(sum(CASE WHEN hour<6 THEN total_tokens ELSE 0 END)::DOUBLE/nullif(sum(total_tokens),0),0),4) AS night_share,
 round(coalesce(sum(CASE WHEN hour>=18 THEN total_tokens ELSE 0 END)::DOUBLE/nullif(sum(total_tokens),0),0),4) AS evening_share,
 round(coalesce(sum(CASE WHEN hour IN (9,18) THEN total_tokens*0.5::DOUBLE WHEN hour BETWEEN 10 AND 17 THEN total_tokens::DOUBLE ELSE 0 END)/nullif(sum(total_tokens),0),0),4) AS work_share
 FROM (SELECT participant_id, hour, {_T} FROM h GROUP BY 1,2) GROUP BY 1)""", hourly=True)
def hour_rhythm(u, h, p):
    return M.rhythm(h, "participant_id")


@query(f"SELECT weekday, total_tokens, round(total_tokens::DOUBLE/(sum(total_tokens) OVER ())::DOUBLE,6) AS share, row_number() OVER (ORDER BY total_tokens DESC, weekday)=1 AS is_peak FROM (SELECT CAST((dayofweek(day)+6)%7 AS INTEGER) AS weekday, {_T} FROM u GROUP BY 1)")
def weekday_rhythm(u, h, p):
    return M.weekday_rhythm(u)


@query("""SELECT participant_id, w AS workday_percent, e AS weekend_percent, CASE WHEN w>=80 THEN 'workday' WHEN e>=35 THEN 'weekend' ELSE 'balanced' END AS archetype FROM (SELECT participant_id, w, CASE WHEN t>0 THEN 100-w ELSE 0 END AS e
 FROM (SELECT participant_id, sum(total_tokens) AS t, CAST(CASE WHEN sum(total_tokens)>0 THEN floor(sum(CASE WHEN isodow(day)<6 THEN total_tokens ELSE 0 END)*100.0::DOUBLE/sum(total_tokens)::DOUBLE+0.5) ELSE 0 END AS BIGINT) AS w FROM u GROUP BY 1))""")
def week_split(u, h, p):
    return M.week_split(u, "participant_id")


def _delta(key: str, where: str = "") -> str:
    return f"""SELECT {key}, tokens, previous_tokens, CASE WHEN tokens>0 AND previous_tokens>0 AND tokens<>previous_tokens THEN CASE WHEN d=-100 THEN -99 ELSE d END END AS delta_percent
 FROM (SELECT *, CAST(floor((tokens-previous_tokens)*100.0::DOUBLE/nullif(previous_tokens,0)::DOUBLE+0.5) AS BIGINT) AS d FROM (SELECT {key},
 CAST(coalesce(sum(CASE WHEN day BETWEEN DATE '{_NOW[0]}' AND DATE '{_NOW[1]}' THEN total_tokens END),0) AS BIGINT) AS tokens,
 CAST(coalesce(sum(CASE WHEN day BETWEEN DATE '{_THEN[0]}' AND DATE '{_THEN[1]}' THEN total_tokens END),0) AS BIGINT) AS previous_tokens FROM u {where} GROUP BY 1))"""


@query(_delta("participant_id"))
def period_delta(u, h, p):
    return M.period_delta(u, "participant_id", _NOW, _THEN)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY tokens DESC, model) AS rank FROM ({_delta('model', f'''WHERE day BETWEEN DATE '{_THEN[0]}' AND DATE '{_NOW[1]}' ''')})) WHERE rank<=8")
def month_over_month(u, h, p):
    return M.month_over_month(u, "model", S.BUSINESS_DAY)


@query(f"SELECT *, round(total_tokens::DOUBLE/(sum(total_tokens) OVER (PARTITION BY workdir_id))::DOUBLE,6) AS contribution FROM (SELECT workdir_id, model, {_T} FROM u GROUP BY 1,2)")
def workdir_contributions(u, h, p):
    return M.contributions(u, "workdir_id", "model")


@query(f"""SELECT provider_id, {_T}, CAST(coalesce(sum(CASE WHEN day=DATE '2001-06-15' THEN total_tokens END),0) AS BIGINT) AS today, CAST(coalesce(sum(CASE WHEN day BETWEEN DATE '2001-06-09' AND DATE '2001-06-15' THEN total_tokens END),0) AS BIGINT) AS week,
 count(DISTINCT CASE WHEN total_tokens>0 THEN day END) AS active_days, max(CASE WHEN total_tokens>0 THEN day END) AS last_used_day, count(DISTINCT model) AS models FROM u GROUP BY 1""")
def provider_overview(u, h, p):
    return M.overview(u, "provider_id", S.BUSINESS_DAY)


_R = f"(SELECT *, row_number() OVER (ORDER BY total_tokens DESC, participant_id) AS rank, count(*) OVER () AS n FROM (SELECT participant_id, {_T} FROM u GROUP BY 1))"


@query(f"SELECT participant_id, rank, CAST(floor((n-rank)*100.0::DOUBLE/n::DOUBLE+0.5) AS BIGINT) AS percentile FROM {_R}")
def rank_percentiles(u, h, p):
    return M.percentiles(u, "participant_id")


def _page(name, number):
    def f(u, h, p):
        return M.page(u, "participant_id", number, 4)

    f.__name__ = name
    query(f"SELECT participant_id, total_tokens, rank FROM {_R} WHERE ceil(rank/4.0)=greatest(1, least({number}, ceil(n/4.0)))")(f)


_page("admin_page_2", 2)
_page("admin_page_past_end", 1_000_000)


@query("SELECT DISTINCT participant_id FROM u WHERE participant_id>3 ORDER BY 1 LIMIT 5")
def keyset_page(u, h, p):
    return M.next_keys(u, "participant_id", 3, 5)


@query(f"SELECT a.*, b.* FROM (SELECT count(*) AS active_sources, arg_min(provider_id, (-total_tokens, provider_id)) AS top_source FROM (SELECT provider_id, {_T} FROM u WHERE total_tokens>0 GROUP BY 1)) a, (SELECT arg_min(day, (-total_tokens, day)) AS peak_day FROM (SELECT day, {_T} FROM u WHERE total_tokens>0 GROUP BY 1)) b")
def source_figures(u, h, p):
    return M.source_figures(u)


@query("")
def union_distinct(u, h, p):
    return u.select("participant_id", "day").union(h.select("participant_id", "day")).distinct()


ORACLE_SQL["union_distinct"] = f"WITH {S.SQL_DAILY}, {S.SQL_HOURLY} SELECT participant_id, day FROM u UNION SELECT participant_id, day FROM h"
