"""Log readers, ranges, lifecycle and streams on small fixtures."""

import json
from datetime import date

from meterlake.operators import lifecycle as L
from meterlake.plans.ranges import resolve_range
from meterlake.sources import logs
from meterlake.streaming import usage_stream


def lines(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return str(path.parent)


def test_cumulative_counts_become_differences(spark, tmp_path):
    at = "2026-01-01T10:00:00Z"
    count = lambda i, o, t: {"input_tokens": i, "output_tokens": o, "cached_input_tokens": 10, "total_tokens": t}
    where = lines(tmp_path / "a" / "s.jsonl", {"timestamp": at, "session_id": "s", "cwd": "/w", "model": " GPT ", "token_count": count(100, 20, 120)}, "{broken", {"timestamp": at, "token_count": count(150, 30, 180)}, {"timestamp": at, "token_count": count(5, 1, 6)})
    got = logs.cumulative_sessions(spark, where).orderBy("dedup_key").collect()
    assert [(r.input_tokens, r.output_tokens, r.cache_read_tokens, r.model, r.workdir, r.session_id) for r in got] == [(90, 20, 10, "gpt", "/w", "s"), (50, 10, 0, "gpt", "/w", "s"), (0, 1, 10, "gpt", "/w", "s")]


def test_last_usage_counts_for_inherited_and_missing_totals(spark, tmp_path):
    use = lambda i, o: {"input_tokens": i, "output_tokens": o, "total_tokens": i + o}
    row = lambda **info: {"timestamp": "2026-01-01T10:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": info}}
    meta = {"type": "session_meta", "payload": {"id": "s", "cwd": "/w"}}
    where = lines(tmp_path / "l" / "s.jsonl", meta, row(total_token_usage=use(1000, 100), last_token_usage=use(30, 3)), row(total_token_usage=use(1000, 100), last_token_usage=use(30, 3)), row(last_token_usage=use(7, 2)), row(total_token_usage=use(1050, 110)))
    got = logs.cumulative_sessions(spark, where).orderBy("dedup_key").collect()
    assert [(r.input_tokens, r.output_tokens) for r in got] == [(30, 3), (7, 2), (50, 10)]


def test_last_row_of_a_message_counts(spark, tmp_path):
    use = lambda o, **k: {"input_tokens": 1, "output_tokens": o} | k
    row = lambda o, **k: {"timestamp": "2026-01-01T10:00:00Z", "session_id": "s", "message": {"id": "m", "model": "X", "usage": use(o, **k)}}
    where = lines(tmp_path / "b" / "s.jsonl", row(5), row(9, iterations=[{"type": "advisor_message", "model": "Y", "input_tokens": 3, "output_tokens": 4}, {"type": "other", "model": "Z", "input_tokens": 1}]))
    got = sorted((r.dedup_key, r.model, r.total_tokens) for r in logs.message_sessions(spark, where).collect())
    assert got == [("m", "x", 10), ("m:advisor:0", "y", 7)]


def test_seed_and_version(spark, tmp_path):
    use = lambda s, n: {"type": "message", "seq": s, "time": "2026-01-01T10:00:00Z", "data": {"message": {"source": {"model": "m"}}, "usage": {"inputTokens": n, "outputTokens": 1}}}
    where = lines(tmp_path / "c" / "ok.jsonl", {"type": "session", "version": 0, "id": "i", "cwd": "/w"}, use(1, 10), {"type": "session/end-seed", "seq": 2}, use(3, 20))
    lines(tmp_path / "c" / "bad.jsonl", {"type": "session", "version": 1, "id": "j"}, use(1, 99))
    assert [(r.session_id, r.total_tokens) for r in logs.seeded_sessions(spark, where).collect()] == [("i", 21)]


def test_replacing_scopes_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "a", 6), (2, 0, "b", 7)], "day int, hour int, provider_id string, n int")
    new = spark.createDataFrame([(1, 0, "a", 8)], old.schema)
    once = L.replace_scopes(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, L.replace_scopes(once, new).collect())) == [(1, 0, "a", 8), (1, 1, "a", 6), (2, 0, "b", 7)]


def test_ranges():
    day = date(2026, 3, 4)
    assert resolve_range("this_week", day) == (date(2026, 3, 2), day)
    assert resolve_range("last_month", day) == (date(2026, 2, 1), date(2026, 2, 28))
    assert resolve_range("what", day) == (day, day) and resolve_range("all", day) is None
    assert resolve_range("today", day, "2026-01-01", "2026-01-02") == (date(2026, 1, 1), date(2026, 1, 2))


def test_stream_of_hours_and_duplicates(spark, tmp_path):
    rows = [{"id": i % 3, "ts": f"2026-01-01T1{i % 2}:00:00", "provider_id": "a", "total_tokens": 1} for i in range(6)]
    where = lines(tmp_path / "in" / "1.json", *rows)
    events = usage_stream.read_events(spark, where, "id int, ts timestamp, provider_id string, total_tokens long")
    for name, df, mode, n in (("hours", usage_stream.hourly_totals(events), "complete", 2), ("once", usage_stream.once_each(events, ["id"]), "append", 3)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(name).count() == n
