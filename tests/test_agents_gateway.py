"""Agent logs, gateway ledgers, files, ledger operators and display figures on small fixtures."""

import hashlib
import hmac
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators import display as D
from meterlake.operators import ledger as K
from meterlake.operators import lifecycle as L
from meterlake.operators import quota as Q
from meterlake.operators import rules as R
from meterlake.sources import agents, files, gateway, logs
from meterlake.streaming import usage_stream


def write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return str(path.parent)


def openai(prompt, completion, cached=0, reasoning=0):
    return {"prompt_tokens": prompt, "completion_tokens": completion, "prompt_tokens_details": {"cached_tokens": cached}, "completion_tokens_details": {"reasoning_tokens": reasoning}}


def test_role_logs_keep_their_model(spark, tmp_path):
    at = "2026-06-10T08:00:00Z"
    rows = [{"role": "assistant", "type": "model_change", "model": "Sonnet"}, {"role": "assistant", "timestamp": at, "cwd": "/w", "usage": {"inputTokens": 12, "output_tokens": 3}}, {"role": "user", "usage": {"input_tokens": 100}}, {"role": "assistant", "timestamp": at, "usage": {"input_tokens": 0}}]
    write(tmp_path / "s" / "a.jsonl.deleted.1", {"role": "assistant", "model": "x", "timestamp": at, "usage": {"prompt_tokens": 5}})
    write(tmp_path / "s" / "a.jsonl.bak", {"role": "assistant", "model": "x", "timestamp": at, "usage": {"prompt_tokens": 7}})
    where = write(tmp_path / "s" / "a.jsonl", *rows)
    got = sorted((r.session_id, r.model, r.total_tokens, r.workdir) for r in agents.role_sessions(spark, where).collect())
    assert got == [("a", "sonnet", 15, "/w"), ("a", "x", 5, None)]


def test_traces_and_transcripts(spark, tmp_path):
    answer = lambda **k: json.dumps([{"model": "M", "usage": openai(**k)}])
    head = lambda i, status="ok": {"traceId": f"t{i}", "workerPid": 1, "startedAt": "2026-06-08T12:00:00Z", "status": status}
    span = lambda **k: {"type": "generation", "toolOutput": answer(**k)}
    where = write(tmp_path / "d" / "trace_1.json", {"trace": head(1) | {"sessionId": "s1"}, "spans": [{"type": "agent"}, span(prompt=15, completion=3, cached=5), {"type": "generation", "toolOutput": "{broken"}]})
    write(tmp_path / "d" / "trace_2.json", {"trace": head(2, "error"), "spans": [span(prompt=1, completion=1)]})
    write(tmp_path / "d" / "trace_3.json", {"trace": head(3) | {"modelInfo": [{"model": "", "usage": openai(4, 4)}]}, "spans": []})
    whole = agents.traces(spark, where)
    assert sorted((r.trace_id, r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens) for r in whole.collect()) == [("t1", "m", 10, 3, 5), ("t3", "unknown", 4, 4, 0)]
    ended = [{"type": "trace_start", "trace": head(4, "running")}, {"type": "span_start", "span": span(prompt=9, completion=9)}, {"type": "span_end", "span": span(prompt=8, completion=2, reasoning=1)}]
    write(tmp_path / "e" / "trace_5.jsonl", *ended)
    lines = write(tmp_path / "e" / "trace_4.jsonl", *ended, {"type": "trace_end", "trace": head(4)})
    assert [(r.trace_id, r.input_tokens, r.reasoning_tokens) for r in agents.trace_lines(spark, lines).collect()] == [("t4", 8, 1)]
    said = {"type": "message", "messageId": "m", "sessionId": "s1", "timestamp": 1780920060000, "providerData": {"model": "g", "rawUsage": openai(20, 4, 5, 8)}}
    told = agents.transcripts(spark, write(tmp_path / "f" / "x.jsonl", said, said | {"timestamp": None}))
    both = agents.traced_usage(whole, told)
    assert sorted((r.session_id or "", r.total_tokens) for r in both.collect()) == [("", 8), ("s1", 24)]


def test_rows_of_stores_and_events(spark):
    data = json.dumps({"role": "assistant", "modelID": "A", "tokens": {"input": 5, "output": 6, "reasoning": 1, "cache": {"read": 7, "write": 8}}, "time": {"created": 1780920060000}, "path": {"cwd": "/w"}})
    rows = spark.createDataFrame([("s", data), ("s", json.dumps({"role": "user"})), ("s", None)], "session_id string, data string")
    assert [(r.model, r.total_tokens, r.workdir) for r in agents.stored_messages(rows).collect()] == [("a", 26, "/w")]
    flat = spark.createDataFrame([(json.dumps({"input_tokens": 1, "timestamp": "2026-01-01T00:00:00Z", "session_id": "q"}),), (json.dumps({"input_tokens": 1, "timestamp": "soon"}),)], "data string")
    assert [(r.session_id, r.total_tokens, r.model) for r in agents.stored_usage(flat).collect()] == [("q", 1, "unknown")]
    events = spark.createDataFrame([("1780920060000", "default", (1, 2, 0, 0)), ("x", "b", (1, 0, 0, 0)), ("1780920060000", "b", None)], "timestamp string, model string, tokenUsage struct<inputTokens:long,outputTokens:long,cacheReadTokens:long,cacheWriteTokens:long>")
    assert [(r.model, r.total_tokens, r.workdir) for r in agents.dashboard_events(events, "me").collect()] == [("auto", 3, "virtual:me")]


def test_quota_windows(spark):
    schema = "data struct<level:string,limits:array<struct<type:string,unit:int,percentage:double,nextResetTime:long>>>"
    rows = [(("pro", [("TOKENS_LIMIT", 6, 2.0, 20), ("tokens_limit", None, 1.0, 10), ("OTHER", 3, 9.0, 1)]),), (("free", [("CREDIT_LIMIT", 1, 4.0, 30), ("CREDIT_LIMIT", 1, 3.0, None)]),)]
    got = sorted((r.level, r.window, r.percentage) for r in agents.quota_windows(spark.createDataFrame(rows, schema)).collect())
    assert got == [("free", "five_hour", 3.0), ("free", "weekly", 4.0), ("pro", "five_hour", 1.0), ("pro", "weekly", 2.0)]


def test_quota_details(spark):
    schema = "data struct<level:string,limits:array<struct<type:string,unit:int,percentage:double,nextResetTime:long,usageDetails:array<struct<modelCode:string,usage:long>>>>>"
    rows = [(("pro", [("TOKENS_LIMIT", 3, 2.0, 20, [("a", 1), ("b", 2), (None, 9), ("a", 5)]), ("TOKENS_LIMIT", 6, 1.0, 10, None)]),)]
    got = {r.window: r.details for r in agents.quota_windows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"five_hour": {"a": 5, "b": 2}, "weekly": None}


def test_gateway_ledger(spark, tmp_path):
    row = lambda i, **k: {"t": f"2026-01-01T00:00:{i:02d}Z", "agent": "Codex", "in": 5, "out": 1, "route_id": 1, "response_id": f"r{i}"} | k
    where = write(tmp_path / "g" / "usage.jsonl", *[row(i) for i in range(30)], row(31, response_id="r3"), row(32, route_id="no"), row(33, out=-4), row(34, kind="probe", source="probe"), row(35, agent="z", callerKeyId="k"), '{"t": "cut')
    rows = gateway.read_ledger(spark, where)
    assert rows.count() == 35 and gateway.countable(rows).count() == 34
    issues = gateway.integrity_issues(gateway.countable(rows))
    assert sorted(r.issue for r in issues.collect()) == ["negative out", "response twice", "route"]
    known = spark.createDataFrame([("codex", "codex_local", "codex")], "agent string, provider_id string, tool_code string")
    kept, left_out = gateway.uploads(rows, known)
    assert kept.count() == 34 and [tuple(r) for r in left_out.collect()] == [("z", 1)]
    assert {r.provider_id for r in gateway.mapped(rows, known, ("gateway", "gateway")).collect()} == {"codex_local", "gateway"}
    assert gateway.as_usage(rows).agg(F.sum("total_tokens")).first()[0] == 6 * 34 + 5
    with pytest.raises(ValueError, match="2 of 3"):
        gateway.read_ledger(spark, write(tmp_path / "h" / "usage.jsonl", row(1), "{x", "[]"))


def test_files_and_copies(spark, tmp_path):
    for p in ("sessions/a.jsonl", "archived_sessions/a.jsonl", "archived_sessions/b.jsonl.zst", "archived_sessions/b.jsonl"):
        write(tmp_path / "home" / p, "x")
    found = files.fingerprints(files.source_files(spark, str(tmp_path / "home"), like="jsonl"), "codex", "1")
    once = files.logs_once(found)
    assert sorted(r.path.split("/home/")[1] for r in once.collect()) == ["archived_sessions/b.jsonl", "sessions/a.jsonl"]
    assert files.to_read(found, found).count() == 0 and files.to_read(found, found.limit(1)).count() == 3
    assert found.select("source_fingerprint").distinct().count() == 4
    # equal size and time, another path: another digest, unless the key is stable; a write-ahead file counts
    day = datetime(2026, 1, 1)
    state = spark.createDataFrame([("/r/a.db", day, 5), ("/r/b.db", day, 5), ("/r/b.db-wal", day, 7)], "path string, changed timestamp, bytes long")
    digest = lambda *x: hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()
    ms = 1767225600000
    assert {r.path: r.source_fingerprint for r in files.fingerprints(state, "c", "1").collect()} == {"/r/a.db": digest("c", 1, "/r/a.db", 5, ms, 0, 0), "/r/b.db": digest("c", 1, "/r/b.db", 5, ms, 7, ms)}
    moved = files.fingerprints(state.where("path = '/r/a.db'"), "c", "1", F.element_at(F.split("path", "/"), -1))
    assert files.to_read(moved.withColumn("path", F.lit("/old/a.db")), moved).count() == 0
    assert spark.range(1).select(files.project_folder(F.lit("-Users-a-b"))).first()[0] == "/Users/a/b"


def test_compaction_and_replay(spark, tmp_path):
    use = lambda i, o: {"input_tokens": i, "output_tokens": o, "total_tokens": i + o}
    record = lambda r, i, o: {"type": "token_usage_record", "payload": {"response_id": r, "usage": use(i, o)}}
    count = {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": use(7, 7)}}}
    named = lambda r: {"type": "compacted", "payload": {"compaction_response_id": r}}
    where = write(tmp_path / "c" / "s.jsonl", {"type": "session_meta", "payload": {"id": "s"}}, record("a", 5, 1), record("b", 7, 7), count, record("c", 9, 9), named("a"), named("b"))
    assert [(r.session_id, r.response_id, r.input_tokens) for r in logs.compacted_usage(spark, where).collect()] == [("s", "a", 5)]
    at = lambda s: datetime(2026, 1, 1, 0, s // 60, s % 60)
    schema = "file string, line long, session_id string, ts timestamp, parent_id string, forked_at timestamp, burst_at timestamp, n int"
    rows = [("P", i, "p", at(i), None, None, None, v) for i, v in enumerate([1, 2, 3, 4])]
    rows += [("C", i, "c", at(100 + i), "p", at(1), None, v) for i, v in enumerate([1, 2, 3, 4])]  # the parent's third came after the fork
    rows += [("D", i, "d", at(s), "p", at(50), None, v) for i, (s, v) in enumerate([(60, 8), (660, 9)])]  # nothing agrees and no burst: all its own
    rows += [("E", 0, "e", at(60), "p", None, None, 7)]
    rows += [("F", i, "f", at(s), "gone", None, at(60), 1) for i, s in enumerate([60, 61, 62, 64, 64])]  # a burst of an unknown parent
    rows += [("G", i, "g", at(s), "p", None, at(60), v) for i, (s, v) in enumerate([(60, 1), (61, 9), (62, 3)])]  # what agrees goes, the rest stays in spite of the burst
    own = K.without_replay(spark.createDataFrame(rows, schema), ["n"])
    assert sorted((r.file, r.line) for r in own.collect()) == [("C", 2), ("C", 3), ("D", 0), ("D", 1), ("E", 0), ("F", 3), ("F", 4), ("G", 1), ("G", 2), *(("P", i) for i in range(4))]


def test_upserts_apply_once(spark):
    schema = "key string, day int, provider_id string, workdir_id int, model string, n int, source_fingerprint string, hourly_derived boolean"
    stored = spark.createDataFrame([("a", 1, "p", 1, "unknown", 1, "f1", False), ("b", 1, "p", 2, "m", 2, "f2", True), ("c", 1, "p", 3, "m", 3, "f3", False), ("d", 2, "p", 3, "m", 4, "f4", False), ("x", 2, "p", 4, "m", 5, "", False), ("y", 2, "p", 5, "m", 6, None, False)], schema)
    rows = [("e", 1, "p", 1, "m", 10, "f5", False, "h1"), ("b", 1, "p", 2, "m", 20, "f2", False, "h1"), ("g", 1, "p", 9, "m", 30, "f3", False, "h1"), ("k", 3, "p", 9, "m", 60, "", False, "h1"), ("k", 3, "p", 9, "m", 61, "", False, "h1"), ("z", 1, "p", 3, "m", 50, "f9", False, "h0")]
    batch = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", batch_hash string, seq int")
    applied = spark.createDataFrame([("h0",)], "batch_hash string")
    once = K.legacy_upsert(stored, batch, applied, "key")
    # c had g's fingerprint, a was e without a name; an empty fingerprint puts nothing out; of two rows for k the last counts
    assert sorted((r.key, r.n) for r in once.collect()) == [("b", 2), ("d", 4), ("e", 10), ("g", 30), ("k", 61), ("x", 5), ("y", 6)]
    batch = batch.drop("seq")
    snapshot = batch.where("key in ('b', 'e')").drop("batch_hash")
    stored = stored.where("key in ('a', 'b', 'c', 'd')")
    daily = K.daily_upsert(stored, snapshot, "key", ["day", "provider_id"])
    assert sorted((r.key, r.n) for r in daily.collect()) == [("b", 2), ("d", 4), ("e", 10)]
    assert sorted(map(tuple, K.daily_upsert(daily, snapshot, "key", ["day", "provider_id"]).collect())) == sorted(map(tuple, daily.collect()))


def test_validation_and_forbidden_fields(spark):
    schema = "day string, provider_id string, source_quality string, total_tokens long, input_tokens string, raw_source_ref string"
    items = spark.createDataFrame([("2026-01-01", "a", "exact", 5, "5", "x" * 300), ("2026-1-1", "", "odd", -1, "-3", "r")], schema)
    good, bad = R.split_valid(items, ["provider_id"])
    assert good.count() == 1 and sorted(bad.first().problems) == ["bad_day", "bad_quality", "bad_total", "no_provider_id"]
    traced = items.withColumn("raw_source_ref", F.concat(F.lit("  "), "raw_source_ref")).withColumns({"hour": F.lit(None).cast("int"), "provider_version": F.lit(" 1.2 "), "parser_version": F.lit("")})
    public = R.public_item(traced.withColumn("source_quality", F.lit("")), ["day", "hour", "input_tokens", "raw_source_ref", "parser_version", "source_quality", "absent"]).collect()
    assert [(r.hour, r.input_tokens, r.total_tokens, r.raw_source_ref, r.parser_version, r.source_quality) for r in public] == [(0, 5, 5, "x" * 160, "1.2", "unknown"), (0, 0, 0, "r", "1.2", "unknown")]
    nested = T.StructType.fromDDL("a int, b struct<Prompt:string, c:array<struct<cwd:string>>>")
    assert R.forbidden_fields(nested, {"prompt", "cwd"}) == ["b.Prompt", "b.c.cwd"]
    assert R.clamp(None, 1, 500, 50) == 50 and R.clamp(9999, 1, 500, 50) == 500


def test_identities_versions_and_addresses(spark):
    people = spark.createDataFrame([(i,) for i in range(1, 30)], "participant_id long")
    got = {r.participant_id: r for r in D.daily_identity(people, "2026-01-01", "salt", ["Ada", "Bo"]).collect()}
    for i in got:
        assert got[i].public_id == hmac.new(b"salt", f"{i}|2026-01-01".encode(), hashlib.sha256).hexdigest()[:16]
    assert len({r.name for r in got.values()}) == 29
    one = spark.createDataFrame([("169.254.1.1, 10.0.0.2", "v1.10.0-rc.1"), ("169.254.1.1", "1.9")], "a string, v string")
    assert [(r.x, r.y) for r in one.select(D.primary_address(F.col("a")).alias("x"), D.version_numbers(F.col("v")).alias("y")).collect()] == [("10.0.0.2", [1, 10, 0]), ("169.254.1.1", [1, 9, 0])]


def test_folding_tracing_and_writers(spark):
    events = spark.createDataFrame([("k", 1, 2, "b", "exact"), ("k", 3, 4, "a", "partial"), ("j", 1, 1, "", "exact")], "key string, input_tokens long, output_tokens long, ref string, source_quality string")
    assert sorted(tuple(r) for r in L.fold_events(events, ["key"]).collect()) == [("j", 1, 1, 1, 2), ("k", 4, 6, 2, 10)]
    traced = {r.key: r.t for r in events.groupBy("key").agg(L.merged_trace("ref").alias("t")).collect()}
    assert traced == {"j": "", "k": hashlib.sha256(b"a|b").hexdigest()}
    scope = "day int, hour int, provider_id string"
    plugin = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (3, 0, "b")], scope)
    left = L.writer_precedence(plugin, spark.createDataFrame([(1, 0, "a")], scope), spark.createDataFrame([(2, None, "a")], scope))
    assert sorted((r.day, r.hour, r.provider_id) for r in left.collect()) == [(1, 1, "a"), (3, 0, "b")]
    odd = spark.createDataFrame([('a"\\\n\u0001', None)], "t string, n int").select(L.canonical_row({"t": "text", "n": "number"}).alias("j")).first().j
    assert json.loads(odd) == {"n": None, "t": 'a"\\\n\u0001'}
    before = spark.createDataFrame([("a", 1), ("b", 2)], "provider_id string, n int")
    assert sorted(map(tuple, L.preserve_failed(before, before.where("n = 3"), ["b"]).collect())) == [("b", 2)]
    lanes = spark.createDataFrame([("l", 10), ("m", 5)], "lane_id string, budget_tokens long")
    assert sorted((r.lane_id, r.available, r.exhausted) for r in Q.quota_view(lanes, spark.createDataFrame([("m", 7)], "lane_id string, used_tokens long")).collect()) == [("l", 10, False), ("m", 0, True)]


def test_a_day_in_two_batches_loses_nothing(spark, tmp_path):
    for i in range(2):
        where = write(tmp_path / "in" / f"{i}.json", {"id": i, "day": "2026-01-01", "version": i})
    target = str(tmp_path / "out")
    for run in range(2):  # the second run finds nothing new
        usage_stream.store_days(usage_stream.read_events(spark, where, "id int, day date, version int", 1), target, str(tmp_path / "cp")).awaitTermination(60)
        stored = spark.read.parquet(target)
        assert sorted(r.id for r in stored.collect()) == [0, 1]
    assert [r.id for r in usage_stream.newest_snapshots(stored, ["day"], "version").collect()] == [1]
