"""The registered queries of stored facts: ledgers, uploads, reconciliation, attempts and sessions, each with its SQL.

Events stand for requests; the two halves of them (even and odd ids) stand for what is stored and what comes in.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meterlake.operators import ledger as K
from meterlake.operators import lifecycle as L
from meterlake.operators import quota as Q
from meterlake.plans.catalogue import query

_T = "CAST(sum(total_tokens) AS BIGINT) AS total_tokens"
_SCOPE = "day, hour, provider_id"


def _halves(h):
    return h.where("event_id % 2 = 0"), h.where("event_id % 2 = 1")


@query(f"SELECT DISTINCT {_SCOPE} FROM h WHERE event_id%2=1 AND event_id%10 NOT IN (SELECT DISTINCT event_id%10 FROM h WHERE event_id%2=0 OR event_id%10<5)", hourly=True)
def dirty_scopes(u, h, p):
    marked = h.withColumn("source_fingerprint", F.col("event_id") % 10)
    return K.dirty_scopes(marked.where("event_id % 2 = 1"), marked.where("event_id % 2 = 0 or event_id % 10 < 5"))


@query(f"SELECT provider_id, count(*) AS scopes, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(t) AS BIGINT) AS total_tokens, min(day) AS first_day, max(day) AS last_day FROM (SELECT {_SCOPE}, count(*) AS n, sum(total_tokens) AS t FROM h WHERE ({_SCOPE}) NOT IN (SELECT ({_SCOPE}) FROM h WHERE event_id%7=0) GROUP BY ALL) GROUP BY 1", hourly=True)
def preserved_scopes(u, h, p):
    return K.preserved_scopes(h, h.where("event_id % 7 = 0"))


_CHANGED = "(SELECT * FROM h WHERE event_id%3=0 AND (event_id%2=1 OR event_id%5=0))"


def _requests(h):
    r = h.withColumnRenamed("event_id", "request_id")
    stored = r.where("request_id % 2 = 0").withColumn("digest", F.lit("a"))
    return stored, r.where("request_id % 3 = 0").withColumn("digest", F.when(F.col("request_id") % 5 == 0, "b").otherwise("a"))


@query(f"SELECT event_id AS request_id, total_tokens FROM {_CHANGED}", hourly=True)
def changed_requests(u, h, p):
    return K.changed_requests(*_requests(h)).select("request_id", "total_tokens")


@query("SELECT event_id%2=0 AND NOT (event_id%3=0 AND event_id%5=0) AS kept, count(*) AS rows FROM h WHERE event_id%2=0 OR event_id%3=0 AND (event_id%2=1 OR event_id%5=0) GROUP BY 1", hourly=True)
def request_upsert(u, h, p):
    stored, incoming = _requests(h)
    changed = K.changed_requests(stored, incoming).withColumn("kept", F.lit(False))
    return K.upserted(stored.withColumn("kept", F.lit(True)), changed).groupBy("kept").agg(F.count("*").alias("rows"))


@query(f"SELECT {_SCOPE} FROM h WHERE event_id%2=0 AND event_id%3=0 AND event_id%5=0 UNION SELECT {_SCOPE} FROM {_CHANGED} UNION (SELECT {_SCOPE} FROM h WHERE event_id%2=0 EXCEPT SELECT {_SCOPE} FROM h WHERE provider_id<>'error')", hourly=True)
def affected_scopes(u, h, p):
    stored, incoming = _requests(h)
    return K.affected_scopes(stored, K.changed_requests(stored, incoming), h.where("provider_id <> 'error'"))


@query("""SELECT * FROM (SELECT day, provider_id, model, CASE WHEN i>=0 AND o>=0 THEN i ELSE 0 END AS input_tokens, CASE WHEN i>=0 AND o>=0 THEN o ELSE 0 END AS output_tokens FROM (SELECT day, provider_id, model, a.input_tokens-coalesce(b.input_tokens,0) AS i, a.output_tokens-coalesce(b.output_tokens,0) AS o
 FROM (SELECT day, provider_id, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM h WHERE event_id%2=0 GROUP BY 1,2,3) a LEFT JOIN (SELECT day, provider_id, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM h WHERE event_id%2=1 GROUP BY 1,2,3) b USING (day, provider_id, model))) WHERE input_tokens>0 OR output_tokens>0""", hourly=True)
def residual_split(u, h, p):
    old, live = (x.select("day", "provider_id", "model", "input_tokens", "output_tokens") for x in _halves(h))
    keys = ["day", "provider_id", "model"]
    return K.residual(old.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")), live, keys)


@query(f"SELECT a.scopes, b.matches, NOT (a.scopes>=10 AND b.matches=0) AS sound FROM (SELECT count(*) AS scopes FROM (SELECT {_SCOPE} FROM h WHERE event_id%2=0 INTERSECT SELECT {_SCOPE} FROM h WHERE event_id%2=1)) a, (SELECT count(*) AS matches FROM (SELECT event_id FROM h WHERE event_id%2=0 INTERSECT SELECT event_id FROM h WHERE event_id%2=1)) b", hourly=True)
def overlap_guard(u, h, p):
    return K.overlap_is_sound(*_halves(h), L.SCOPE, ["event_id"])


@query(f"SELECT participant_id, day, {_T}, arg_max(model, event_id) FILTER (event_id%3<>0) AS model FROM (SELECT * FROM h) GROUP BY 1,2", hourly=True)
def merged_local_items(u, h, p):
    rows = h.select("participant_id", "day", "event_id", "total_tokens", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("model")).alias("model"))
    return K.merged_items(rows, ["participant_id", "day"], ["model"], "event_id")


@query("""SELECT lower(provider_id) AS provider_id, day, hour, arg_min(model, (-total_tokens, event_id)) AS model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM h GROUP BY 1,2,3""", hourly=True)
def merged_collisions(u, h, p):
    rows = h.select(F.when(F.col("event_id") % 2 == 0, F.upper("provider_id")).otherwise(F.concat(F.lit(" "), "provider_id")).alias("provider_id"), "day", "hour", "model", "event_id", "total_tokens")
    return K.merged_collisions(rows, ["provider_id", "day", "hour"], ["model"], "event_id")


@query("SELECT participant_id, day, device_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, day ORDER BY ts DESC, event_id) AS n FROM h) WHERE n=1", hourly=True)
def newest_upload(u, h, p):
    return K.newest_upload(h, ["participant_id", "day"], "ts", "event_id").select("participant_id", "day", "device_id", "event_id")


@query("SELECT status, count(*) AS snapshots FROM (SELECT CASE WHEN hour=23 THEN 'bad_hour' WHEN hour=22 THEN 'bad_count' WHEN hour=21 THEN 'bad_total' WHEN hour=20 THEN 'empty' WHEN hour=19 THEN 'bad_items' ELSE 'ok' END AS status FROM (SELECT DISTINCT day, hour, provider_id FROM h)) GROUP BY 1", hourly=True)
def snapshot_checks(u, h, p):
    from meterlake.operators import rules as R

    at = F.concat_ws(" ", F.col("day").cast("string"), F.col("hour").cast("string"), "provider_id")
    items = h.withColumn("snapshot", at).withColumn("provider_id", F.when(F.col("hour") == 19, "other").otherwise(F.col("provider_id")))
    said = K.bucket_snapshots(h).withColumn("snapshot", at).withColumn("hour", F.when(F.col("hour") == 23, 24).otherwise(F.col("hour")))
    said = said.withColumn("row_count", F.when(F.col("hour") == 20, 0).otherwise(F.col("row_count") + F.when(F.col("hour") == 22, 1).otherwise(0))).withColumn("total_tokens", F.when(F.col("hour") == 21, -1).otherwise(F.col("total_tokens") + 1))
    return R.snapshot_status(said, items, L.SCOPE, "snapshot").groupBy("status").agg(F.count("*").alias("snapshots"))


@query("SELECT count(*) AS buckets, count(*) FILTER (hour<>23) AS accepted, count(*) FILTER (hour=23) AS rejected FROM (SELECT DISTINCT day, hour, provider_id FROM h)", hourly=True)
def batch_results(u, h, p):
    return K.batch_results(h.select(*L.SCOPE).distinct().withColumn("status", F.when(F.col("hour") == 23, "bad_hour").otherwise("ok")))


@query("""SELECT status, count(*) AS actions FROM (SELECT CASE WHEN hour=0 THEN 'invalid' WHEN provider_id='view' THEN 'absent' WHEN hour%3=0 THEN 'conflict' WHEN hour%2=0 THEN 'pruned' ELSE 'rebuilt' END AS status FROM (SELECT DISTINCT day, hour, provider_id FROM h)) GROUP BY 1""", hourly=True)
def reconcile_summary(u, h, p):
    return K.outcome_counts(_outcomes(h))


def _outcomes(h):
    scopes = h.select(*L.SCOPE).distinct()
    actions = scopes.withColumn("action", F.when(F.col("hour") == 0, "grow").when(F.col("hour") % 2 == 0, "prune").otherwise("rebuild")).withColumn("expected", F.when(F.col("hour") % 3 == 0, "old").otherwise("now"))
    return K.reconcile(actions, scopes.where("provider_id <> 'view'").withColumn("digest", F.lit("now")), L.SCOPE)


@query(f"SELECT provider_id, count(*) AS rows, {_T} FROM h WHERE NOT (hour<>0 AND provider_id<>'view' AND hour%3<>0 AND hour%2=0) GROUP BY 1", hourly=True)
def reconcile_pruned(u, h, p):
    return K.pruned(h, _outcomes(h), L.SCOPE).groupBy("provider_id").agg(F.count("*").alias("rows"), F.sum("total_tokens").alias("total_tokens"))


@query("SELECT kind, count(*) AS entries FROM (SELECT DISTINCT day, provider_id, CASE WHEN provider_id='view' THEN NULL ELSE hour END AS hour, CASE WHEN provider_id='view' THEN 'daily' ELSE 'hourly' END AS kind FROM h) GROUP BY 1", hourly=True)
def manifest_kinds(u, h, p):
    hours = h.select("day", "provider_id", "hour").distinct()
    days = h.where("provider_id = 'view'").select("day", "provider_id", F.lit(None).cast("int").alias("hour")).distinct()
    return K.manifest_kinds(hours.unionByName(days)).groupBy("kind").agg(F.count("*").alias("entries"))


@query(f"SELECT {_SCOPE} FROM (SELECT DISTINCT {_SCOPE} FROM h) WHERE day<=DATE '2024-01-28' AND provider_id NOT IN ('view','error')", hourly=True)
def prunable_scopes(u, h, p):
    return K.prunable(h.select(*L.SCOPE).distinct(), date(2024, 1, 30), ["view", "error"])


@query(f"SELECT {_SCOPE} FROM (SELECT DISTINCT {_SCOPE} FROM h) WHERE day>DATE '2023-12-26' ORDER BY day DESC, hour, provider_id LIMIT 250", hourly=True)
def recent_states(u, h, p):
    return K.recent_states(h.select(*L.SCOPE).distinct(), date(2024, 1, 30), 35, 250, "hour", "provider_id")


@query(f"SELECT {_SCOPE} FROM (SELECT {_SCOPE}, count(*) AS n, count(*) FILTER (event_id%50<>0) AS m FROM h GROUP BY ALL) WHERE n<>m", hourly=True)
def dirty_buckets(u, h, p):
    prints = [x.groupBy(*L.SCOPE).agg(F.count("*").cast("string").alias("fingerprint")) for x in (h, h.where("event_id % 50 <> 0"))]
    return K.dirty_buckets(*prints, L.SCOPE).select(*L.SCOPE)


@query("SELECT CASE WHEN m.n=t.n THEN 'matched' WHEN m.n IS NULL THEN 'server_only' WHEN t.n IS NULL THEN 'missing' ELSE 'different' END AS status, count(*) AS buckets FROM (SELECT day, hour, provider_id, count(*) AS n FROM h WHERE event_id%9<>0 GROUP BY ALL) m FULL JOIN (SELECT day, hour, provider_id, count(*) AS n FROM h WHERE event_id%8<>0 GROUP BY ALL) t USING (day, hour, provider_id) GROUP BY 1", hourly=True)
def compared_buckets(u, h, p):
    prints = [x.groupBy(*L.SCOPE).agg(F.count("*").cast("string").alias("fingerprint")) for x in (h.where("event_id % 9 <> 0"), h.where("event_id % 8 <> 0"))]
    return L.compare_buckets(*prints, L.SCOPE).groupBy("status").agg(F.count("*").alias("buckets"))


@query("SELECT provider_id, count(*) AS rows FROM h WHERE NOT (participant_id=7 AND device_id=70) AND NOT (participant_id=7 AND provider_id='view' AND (day, hour, provider_id) IN (SELECT (day, hour, provider_id) FROM h WHERE participant_id=7 AND device_id=70 AND provider_id='view')) GROUP BY 1", hourly=True)
def without_device(u, h, p):
    return K.without_device(h, 7, 70, F.col("provider_id") == "view", L.SCOPE).groupBy("provider_id").agg(F.count("*").alias("rows"))


@query("SELECT provider_id, count(*) AS rows FROM h WHERE participant_id=7 GROUP BY 1", hourly=True)
def removed_counts(u, h, p):
    return K.removed_counts(h, 7)


@query("SELECT provider_id, CASE WHEN provider_id='view' THEN 'partial' ELSE 'exact' END AS source_quality, count(*) AS rows FROM h WHERE provider_id='view' AND day<DATE '2024-01-10' OR provider_id<>'view' AND day>=DATE '2024-01-10' GROUP BY 1,2", hourly=True)
def missing_providers(u, h, p):
    rows = h.select("provider_id", "day").withColumn("source_quality", F.lit("exact"))
    now = rows.where("day >= date'2024-01-10' and provider_id <> 'view'")
    return K.missing_providers(rows.where("day < date'2024-01-10'"), now, ["view", "click"]).groupBy("provider_id", "source_quality").agg(F.count("*").alias("rows"))


@query("SELECT day, CAST(sum(CASE WHEN day>=DATE '2024-01-20' THEN total_tokens*2 ELSE total_tokens END) AS BIGINT) AS total_tokens FROM h WHERE day<DATE '2024-01-25' OR day>=DATE '2024-01-20' GROUP BY 1", hourly=True)
def merged_summaries(u, h, p):
    daily = h.groupBy("day").agg(F.sum("total_tokens").alias("total_tokens"))
    return K.merged_summaries(daily.where("day < date'2024-01-25'"), daily.where("day >= date'2024-01-20'").withColumn("total_tokens", F.col("total_tokens") * 2))


@query(f"SELECT {_SCOPE}, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, {_T}, count(*) AS calls, count(*) FILTER (status>=400) AS errors FROM h GROUP BY ALL", hourly=True)
def request_buckets(u, h, p):
    return K.request_buckets(h)


@query(f"SELECT {_SCOPE}, count(*) AS row_count, {_T} FROM h GROUP BY ALL", hourly=True)
def bucket_snapshots(u, h, p):
    return K.bucket_snapshots(h)


@query("SELECT logical_request_id, attempt_index, CASE WHEN logical_request_id%2=0 THEN 'dir ' || logical_request_id END AS directory, greatest(input_tokens-cache_read_tokens-cache_write_tokens,0) AS input_tokens FROM (SELECT *, event_id//4 AS logical_request_id, event_id%4 AS attempt_index, row_number() OVER (PARTITION BY event_id//4 ORDER BY event_id%4 DESC) AS n FROM h WHERE provider_id<>'error') WHERE n=1", hourly=True)
def completed_attempts(u, h, p):
    request = F.floor(F.col("event_id") / 4)
    attempts = h.select(request.alias("logical_request_id"), (F.col("event_id") % 4).alias("attempt_index"), F.when(F.col("provider_id") == "error", "failed").otherwise("completed").alias("status"), request.alias("session_id"), "input_tokens", "cache_read_tokens", "cache_write_tokens")
    sessions = h.select(request.alias("id")).distinct().where("id % 2 = 0").withColumn("directory", F.concat(F.lit("dir "), F.col("id").cast("string")))
    return K.completed_attempts(attempts, sessions).select("logical_request_id", "attempt_index", "directory", "input_tokens")


@query("SELECT count(*) AS messages FROM h WHERE participant_id%5<>0", hourly=True)
def not_imported(u, h, p):
    messages = h.select(F.col("participant_id").alias("session_id"), "event_id")
    return K.not_imported(messages, messages.where("session_id % 5 = 0").select("session_id")).agg(F.count("*").alias("messages"))


_SESSIONS = "SELECT event_id AS session_id, participant_id AS root, 'w' || event_id AS cwd, ts AS created_at, ts + INTERVAL 7 HOUR AS ended_at FROM h WHERE event_id%10=0 AND event_id%70<>0"


@query(f"""SELECT t.event_id AS trace_id, arg_max(s.session_id, (created_at, s.session_id)) AS session_id, arg_max(cwd, (created_at, s.session_id)) AS cwd FROM (SELECT * FROM h WHERE event_id%10<>0) t LEFT JOIN ({_SESSIONS}) s ON s.root=t.participant_id AND created_at - INTERVAL 5 SECOND<=t.ts AND t.ts<=ended_at GROUP BY 1""", hourly=True)
def traces_within_sessions(u, h, p):
    traces = h.where("event_id % 10 <> 0").select(F.col("event_id").alias("trace_id"), F.col("participant_id").alias("root"), F.col("ts").alias("started_at"))
    sessions = h.where("event_id % 10 = 0").select(F.col("event_id").alias("id"), F.col("participant_id").alias("root"), F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("cwd"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("last_activity_at"), F.expr("ts + interval 7 hours").alias("updated_at"), F.when(F.col("event_id") % 70 == 0, F.col("ts")).alias("deleted_at"))
    return K.within_sessions(traces, sessions).select("trace_id", "session_id", "cwd")


@query("""SELECT key_id, minute, claims, claims<=2 AS allowed FROM (SELECT participant_id AS key_id, date_trunc('hour', ts) AS minute, count(*) AS claims FROM h GROUP BY 1,2)""", hourly=True)
def claim_rates(u, h, p):
    return Q.claim_rates(h.select(F.col("participant_id").alias("key_id"), "ts"), "1 hour", 2)


@query("""SELECT participant_id, CAST(max(w) AS BIGINT) AS "window", CAST(sum(t) FILTER (w=last) AS BIGINT) AS window_tokens, CAST(sum(t) AS BIGINT) AS lifetime_tokens FROM (SELECT *, max(w) OVER (PARTITION BY participant_id) AS last FROM (SELECT participant_id, floor(epoch(ts)/18000) AS w, sum(total_tokens) AS t FROM h GROUP BY 1,2)) GROUP BY 1""", hourly=True)
def rolled_windows(u, h, p):
    return Q.rolled_ledger(h, "participant_id", Q.grid_window(F.col("ts"), "hour", 5))


@query("""SELECT reason, count(*) AS requests FROM (SELECT CASE WHEN participant_id%11=0 THEN 'lane_removed' WHEN participant_id%7=0 THEN 'lane_paused' WHEN participant_id%13=0 THEN 'lane_suspended' WHEN model NOT IN ('m1','m2','m3','m4','m5','m6') THEN 'model_not_in_lane' WHEN NOT (hour(ts)*60+minute(ts)>=480 OR hour(ts)*60+minute(ts)<120) THEN 'lane_closed' WHEN total_tokens>=20000 THEN 'lane_exhausted' WHEN input_tokens>=15000 THEN 'key_cap' WHEN event_id%17=0 THEN 'concurrency' ELSE 'pass' END AS reason FROM h) GROUP BY 1""", hourly=True)
def gate_decisions(u, h, p):
    state = F.when(F.col("participant_id") % 11 == 0, F.lit(None)).when(F.col("participant_id") % 7 == 0, "paused").when(F.col("participant_id") % 13 == 0, "stopped").otherwise("active")
    requests = h.select("event_id", "model", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), state.alias("lane_state"), F.array(*[F.lit(f"m{i}") for i in range(1, 7)]).alias("lane_models"), F.lit(20000).alias("lane_budget"), F.col("total_tokens").alias("lane_settled"), F.lit(15000).alias("key_cap"), F.col("input_tokens").alias("key_charged"), F.lit(1).alias("key_concurrency"), F.when(F.col("event_id") % 17 == 0, 1).otherwise(0).alias("key_inflight"))
    return requests.groupBy(Q.gate([(480, 120)]).alias("reason")).agg(F.count("*").alias("requests"))


@query("SELECT m AS minute, CASE WHEN m>=1320 THEN 1440-m+120 WHEN m<120 THEN 120-m WHEN m<600 THEN 600-m WHEN m<660 THEN 660-m ELSE 1320-m END AS minutes FROM (SELECT DISTINCT hour(ts)*60+minute(ts) AS m FROM h)", hourly=True)
def schedule_flips(u, h, p):
    return h.select((F.hour("ts") * 60 + F.minute("ts")).alias("minute")).distinct().select("minute", Q.minutes_until_flip(F.col("minute"), [(1320, 120), (600, 660)]).alias("minutes"))


@query("SELECT participant_id AS key_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS requests FROM h WHERE event_id%2=0 OR event_id>1000 GROUP BY 1", hourly=True)
def applied_deltas(u, h, p):
    d = h.select(F.col("participant_id").alias("key_id"), F.col("event_id").alias("seq"), "total_tokens", "event_id")
    confirmed, inflight = d.where("event_id % 2 = 0"), d.where("event_id % 2 = 1")
    again = Q.apply_once(inflight, inflight.select("key_id").distinct().withColumn("last_seq", F.lit(1000)))
    return Q.merged_deltas(confirmed, again, "key_id", ["total_tokens"]).withColumnRenamed("deltas", "requests")


@query("SELECT participant_id, max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR AS online FROM h WHERE ts<=TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1", hourly=True)
def online_owners(u, h, p):
    from datetime import datetime

    now = datetime(2024, 1, 30, 12)
    return Q.online(h.where(F.col("ts") <= F.lit(now).cast("timestamp_ntz")), "participant_id", now, 24 * 3600)


@query("SELECT day, count(*) AS rows FROM h WHERE day>DATE '2024-01-30'-10 GROUP BY 1", hourly=True)
def recent_window(u, h, p):
    return Q.recent(h, date(2024, 1, 30), 10).groupBy("day").agg(F.count("*").alias("rows"))
