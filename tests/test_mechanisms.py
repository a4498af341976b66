"""Merged identities, forks, compressed logs, deep values, pinned folders, re-pricing, stale windows, key ledgers and CSV files on small fixtures."""

import csv
import io
import json
import os
import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from meterlake.operators import attribution, deepfind, identity, repricing
from meterlake.sinks import usage_csv
from meterlake.sources import logs
from meterlake.streaming import share_ledger


def test_identities_join_through_others(spark):
    rng = random.Random(1)
    keys = {i: [f"k{rng.randint(0, 90)}" for _ in range(rng.randint(0, 2))] for i in range(120)}
    order = list(range(200, 260))
    rng.shuffle(order)
    keys |= {v: [f"c{i}", f"c{i + 1}"] for i, v in enumerate(order)}  # one long chain in no order
    keys |= {i: ["hub"] for i in range(300, 340)} | {400: None, 401: ["", "x"], 402: ["", "y"]}
    rows = [(i, f"m{i}", i % 7, i % 5, i % 3, i % 11, k) for i, k in keys.items()]
    df = spark.createDataFrame(rows, "event_id long, model string, input_tokens long, output_tokens long, reasoning_tokens long, total_output_tokens long, identities array<string>").repartition(7)
    group = {i: i for i in keys}
    for _ in keys:
        by_key = {}
        for i, ks in keys.items():
            for k in ks or []:
                if k:
                    by_key[k] = min(by_key.get(k, i), group[i])
        group = {i: min([group[i], *(by_key[k] for k in ks or [] if k)]) for i, ks in keys.items()}
    want = {}
    for i, _, a, b, c, d, _ in rows:
        want.setdefault(group[i], []).append((a, b, c, d))
    got = {r.event_id: (r.events, r.model, r.input_tokens, r.total_output_tokens) for r in identity.merged_events(df, ["model"], ["input_tokens", "output_tokens", "reasoning_tokens", "total_output_tokens"]).collect()}

    def merged(k, v):
        most = [max(x) for x in zip(*v, strict=True)]
        return len(v), f"m{k}", most[0], max(most[3], most[1] + most[2]) if len(v) > 1 else most[3]

    assert got == {k: merged(k, v) for k, v in want.items()}
    assert identity.merged_events(df.limit(0), ["model"], ["input_tokens", "output_tokens", "reasoning_tokens", "total_output_tokens"]).count() == 0


def log(path: Path, *records, packed: int = 0, cut: int = 0):
    """Write records as lines; packed: so many in each frame; cut: so many bytes are missing at the end."""
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(r) + "\n" for r in records]
    if packed:
        data = b"".join(zstandard.ZstdCompressor().compress("".join(lines[i : i + packed]).encode()) for i in range(0, len(lines), packed))
        path.write_bytes(data[: len(data) - cut])
    else:
        path.write_text("".join(lines))
    return str(path.parent)


def use(i, o):
    return {"input_tokens": i, "output_tokens": o, "total_tokens": i + o}


def meta(name, at="2026-01-01T10:00:00Z", **more):
    return {"timestamp": at, "type": "session_meta", "payload": {"id": name, "cwd": f"/{name}"} | more}


def count(at, i, o):
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": use(i, o)}}}


def at(minute, second=0.0):
    return f"2026-01-01T10:{minute:02}:{second:06.3f}Z"


def test_forks_count_once_from_the_log_on(spark, tmp_path):
    home = tmp_path / "sessions"
    log(home / "p.jsonl", meta("p"), count(at(1), 10, 1), count(at(2), 20, 2), count(at(9), 30, 3))
    log(home / "fork.jsonl", meta("f", at(5), forked_from_id="p"), count(at(5, 0.1), 10, 1), count(at(5, 0.2), 20, 2), count(at(6), 30, 3))  # the third came after the fork
    log(home / "far.jsonl", meta("g", at(5), forked_from_id="p"), count(at(20), 7, 1), count(at(30), 8, 1))  # ten minutes apart: all its own
    log(home / "one.jsonl.zst", meta("o", at(5), forked_from_id="p"), count(at(20), 9, 1), packed=10)  # a single event
    spawned = {"source": {"subagent": {"thread_spawn": {"parent_thread_id": "unknown"}}}}
    log(home / "burst.jsonl", meta("b", at(1), **spawned), count(at(1, 59.9), 10, 1), count(at(2, 0.1), 10, 1), count(at(2, 6), 10, 1))
    log(home / "plain.jsonl", meta("q", source="cli"), count(at(1, 59.9), 4, 1), count(at(2, 0.1), 5, 1))
    got = sorted((r.session_id, r.input_tokens) for r in logs.cumulative_sessions(spark, str(home)).collect())
    assert got == [("b", 10), ("f", 30), ("g", 7), ("g", 8), ("o", 9), ("p", 10), ("p", 20), ("p", 30), ("q", 4), ("q", 5)]


def test_records_that_compactions_swallow(spark, tmp_path):
    def record(name, i, o):
        return {"timestamp": at(3), "type": "token_usage_record", "payload": {"response_id": name, "usage": use(i, o)}}

    def compacted(name):
        return {"type": "compacted", "payload": {"compaction_response_id": name}}

    turn = {"type": "turn_context", "payload": {"model": " GPT-X "}}
    rows = [meta("s"), turn, record("a", 5, 1), compacted("a"), count(at(4), 5, 1)]  # named before the count came: both count
    rows += [record("b", 7, 7), count(at(5), 7, 7), compacted("b")]  # the count has it already
    rows += [compacted("c"), record("c", 9, 9)]  # named before
    rows += [record("d", 3, 3), record("d", 4, 4), compacted("d")]  # the first of one response
    rows += [record("e", 6, 6), record("f", 1, 1), count(at(6), 6, 6), compacted("e"), record("g", 2, 2)]  # e was not the latest; f and g are never named
    where = log(tmp_path / "s.jsonl", *rows)
    got = {r.response_id: (r.session_id, r.model, r.workdir, r.total_tokens, str(r.ts)) for r in logs.compacted_usage(spark, where).collect()}
    assert got == {k: ("s", "gpt-x", "/s", n, "2026-01-01 10:03:00") for k, n in (("a", 6), ("c", 18), ("d", 6), ("e", 12))}
    assert sum(r.total_tokens for r in logs.all_session_usage(spark, where).collect()) == 42 + 6 + 14 + 12


def test_wire_logs_without_a_time_have_the_files(spark, tmp_path):
    where = tmp_path / "sessions" / "g" / "s1" / "wire.jsonl"
    use = {"inputOther": 5, "output": 2, "inputCacheRead": 1, "inputCacheCreation": 0}
    log(where, {"type": "usage.record", "model": "K", "usage": use, "time": 1767225600000}, {"type": "usage.record", "model": "K", "usage": use, "time": 12}, {"type": "other"})
    os.utime(where, (1700000000, 1700000000))
    got = sorted((str(r.ts), r.session_id, r.total_tokens) for r in logs.record_sessions(spark, str(tmp_path)).collect())
    assert got == [("2023-11-14 22:13:20", "s1", 8), ("2026-01-01 00:00:00", "s1", 8)]


def test_ranges_of_cards_and_boards():
    from meterlake.plans import ranges

    day = date(2026, 3, 4)
    assert [ranges.share_bounds(p, day) for p in ("today", "this_week", "last_week", "this_month", "last_month", "7d", "30d", "other")] == [(day, day), (date(2026, 3, 2), day), (date(2026, 2, 23), date(2026, 3, 1)), (date(2026, 3, 1), day), (date(2026, 2, 1), date(2026, 2, 28)), (date(2026, 2, 26), day), (date(2026, 2, 3), day), (day, day)]
    assert [ranges.share_grain(p) for p in ("today", "7d", "this_week", "30d", "last_month", "last_week", "all", "x")] == ["hour", "day", "day", "week", "week", "day", "month", "day"]
    assert ranges.board_range("last7") == {"range": "last7"} and ranges.board_range("2026-01-01..") == {"range": "custom", "start": "2026-01-01"} and ranges.board_range("..") == {"range": "custom"}
    for bad in ("", "week", "2026-13-01..", "2026-01-01", "2026-1-1..2026-01-02"):
        with pytest.raises(ValueError):
            ranges.board_range(bad)


def test_logs_of_many_frames_and_torn_tails(spark, tmp_path):
    rows = [{"type": "session", "version": 0, "id": "i", "cwd": "/w"}] + [{"type": "message", "seq": s, "time": "2026-01-01T10:00:00Z", "data": {"message": {"source": {"model": "m"}}, "usage": {"inputTokens": 10**s, "outputTokens": 1}}} for s in range(1, 6)]
    total = lambda where: sum(r.total_tokens for r in logs.seeded_sessions(spark, where, exact_names=True).collect())
    plain = total(log(tmp_path / "a" / "x" / "session.jsonl", *rows))
    assert plain == 111_115 == total(log(tmp_path / "b" / "x" / "session.jsonl.zstd", *rows, packed=2))
    # the last frame is torn: its rows do not count, those before do; names must be exact
    where = log(tmp_path / "c" / "x" / "session.jsonl.zstd", *rows, packed=2, cut=3)
    log(tmp_path / "c" / "x" / "session.jsonl.zstd.bak", *rows, packed=2)
    assert total(where) == 1_113
    # of a torn archive what can be decoded counts; bytes that are no frame give nothing
    many = [meta("z")] + [count(f"2026-01-01T10:{i % 60:02}:00.{i:06}Z", 1 + i, 1) for i in range(30_000)]
    home = tmp_path / "d"
    log(home / "z.jsonl.zst", *many, packed=40_000)
    (home / "junk.jsonl.zst").write_bytes(b"no frame at all")
    whole = logs.cumulative_sessions(spark, str(home)).count()
    cut = home / "z.jsonl.zst"
    cut.write_bytes(cut.read_bytes()[:-50_000])
    assert whole == 30_000 > logs.cumulative_sessions(spark, str(home)).count() > 1000


def find(v, names):
    if isinstance(v, dict):
        for k in sorted(v, key=str.encode):
            if k in names and isinstance(v[k], str):
                return v[k]
            if found := find(v[k], names):
                return found
    if isinstance(v, list):
        for x in v:
            if found := find(x, names):
                return found
    return ""


def total(v, names):
    if isinstance(v, dict):
        return sum((x if isinstance(x, int | float) and not isinstance(x, bool) else 0) if k in names else total(x, names) for k, x in v.items())
    return sum(total(x, names) for x in v) if isinstance(v, list) else 0


def test_deep_values_as_plain_recursion(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.randint(0, 6 if depth < 6 else 3)
        if kind > 3:
            return {rng.choice(["cwd", "a", "n", "dir", "Zé", "b"]): value(depth + 1) for _ in range(rng.randint(0, 4))} if kind > 4 else [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return [rng.choice(["", "x", "y z"]), rng.randint(-3, 9), rng.choice([1.5, True, None]), "t"][kind]

    docs = [value(0) for _ in range(150)] + [{"a": {"cwd": "", "dir": "late"}, "b": {"cwd": "found"}}]
    rows = [(i, json.dumps(d, ensure_ascii=bool(i % 2))) for i, d in enumerate(docs)] + [(900, "{broken"), (901, None)]
    df = spark.createDataFrame(rows, "key long, j string")
    assert {r.key: r.text for r in deepfind.deep_string(df, "key", "j", ["cwd", "dir"]).collect()} == {i: find(d, ["cwd", "dir"]) for i, d in enumerate(docs)} | {900: "", 901: ""}
    assert {r.key: r.number for r in deepfind.deep_number(df, "key", "j", ["n", "a"]).collect()} == {i: max(0, int(total(d, ["n", "a"]) + 0.5)) for i, d in enumerate(docs)} | {900: 0, 901: 0}


def test_pinned_folders_stay_and_old_ones_go(spark):
    at = lambda d: datetime(2026, 1, d)
    state = spark.createDataFrame([], attribution.STATE)
    found = lambda **x: spark.createDataFrame([(k, "s", v) for k, v in x.items()], "key string, session_id string, workdir string")
    for day, now in ((1, {"a": "/1", "b": ""}), (2, {"a": "/2", "b": "/2", "c": "/2"}), (3, {"a": "/3", "d": "/3"}), (4, {"e": "/4"})):
        answer, state = attribution.pinned(state, found(**now), at(day), most=4, keep=2)
        state = state.checkpoint()
        got = {r.key: r.workdir for r in answer.collect()}
        assert got == {1: {"a": "/1", "b": ""}, 2: {"a": "/1", "b": "/2", "c": "/2"}, 3: {"a": "/1", "d": "/3"}, 4: {"e": "/4"}}[day]
    # the fifth entry crosses the upper mark: the two used last stay
    assert sorted((r.key, r.last_seen) for r in state.collect()) == [("a", at(3)), ("e", at(4))]


def test_only_touched_partitions_are_priced_anew(spark, tmp_path):
    rows = [(d, m, 100, 10, 0, 0, 1.0, "old") for d in (1, 2, 3) for m in (("x", "y") if d == 2 else ("y",))] + [(3, "openai/x", 100, 10, 0, 0, 1.0, "old")]
    facts = spark.createDataFrame(rows, "day int, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, cost double, cost_quality string")
    path = str(tmp_path / "f")
    facts.write.partitionBy("day").parquet(path)
    files = lambda: {str(f) for f in Path(path).rglob("*.parquet")}
    before = files()
    prices = spark.createDataFrame([("x", 2.0, 4.0, None, None)], "model string, input_rate double, output_rate double, cache_read_rate double, cache_write_rate double")
    reached = repricing.affected_models(facts, spark.createDataFrame([("X ",)], "model string"), spark.createDataFrame([], "source string, target string"))
    assert sorted(r.model for r in reached.collect()) == ["openai/x", "x"]
    assert repricing.reprice_stored(path, reached, prices) == 2
    assert {f for f in files() & before} == {f for f in before if "day=1" in f}
    assert sorted((r.day, r.model, r.cost, r.cost_quality) for r in spark.read.parquet(path).collect()) == [(1, "y", 1.0, "old"), (2, "x", 0.00024, "exact_price"), (2, "y", 1.0, "old"), (3, "openai/x", 0.00024, "estimated_price"), (3, "y", 1.0, "old")]


def test_prices_and_aliases_are_put_and_dropped(spark):
    rates = "input_rate double, output_rate double, cache_read_rate double, cache_write_rate double"
    row = lambda m, r: (m, r, r, None, None)
    custom = spark.createDataFrame([row("a", 1.0), row("b", 2.0)], f"model string, {rates}")
    custom = repricing.put_price(custom, spark.createDataFrame([row(" A", 5.0), row("c", 3.0), row(" ", 9.0)], custom.schema))
    assert sorted((r.model, r.input_rate) for r in custom.collect()) == [("a", 5.0), ("b", 2.0), ("c", 3.0)]
    aliases = spark.createDataFrame([("x", "a"), ("y", "remote")], "source string, target string")
    aliases, refused = repricing.put_alias(aliases, spark.createDataFrame([("X", "b"), ("z", "c"), ("a", "A"), ("q", "none"), ("", "a"), ("w", None)], aliases.schema), custom)
    assert sorted(map(tuple, aliases.collect())) == [("x", "b"), ("y", "remote"), ("z", "c")]
    assert sorted((r.source, r.reason) for r in refused.collect()) == [("", "no_source"), ("a", "same"), ("q", "no_price"), ("w", "no_target")]
    left, named = repricing.drop_price(custom, aliases, spark.createDataFrame([("B",), ("remote",)], "model string"))
    assert sorted(r.model for r in left.collect()) == ["a", "c"] and sorted(map(tuple, named.collect())) == [("y", "remote"), ("z", "c")]


def test_writes_make_windows_stale(spark):
    day, now = lambda d: date(2026, 1, d) if d else None, datetime(2026, 1, 20, 12)
    rows = [("all", None, None, 0), ("from", 15, None, 0), ("to", None, 15, 0), ("hit", 10, 20, 0), ("gap", 17, 19, 0), ("late", 21, 25, 0), ("open late", 21, None, 0), ("patient", 1, 31, 60_000)]
    windows = spark.createDataFrame([(k, day(a), day(b), t, None) for k, a, b, t in rows], "key string, first_day date, last_day date, tolerance_ms long, expires_at timestamp")
    state = lambda *days: {r.key: r.state for r in repricing.stale_windows(windows, spark.createDataFrame([(day(d),) for d in days], "day date"), day(20), now).collect()}
    kept = dict.fromkeys((k for k, *_ in rows), "kept")
    assert state(16, 20) == kept | dict.fromkeys(("all", "from", "hit", "patient"), "stale")
    assert state(20) == kept | dict.fromkeys(("all", "from", "hit"), "stale") | {"patient": "expires"}
    assert state(None) == kept
    soon = repricing.stale_windows(windows, spark.createDataFrame([(day(20),)], "day date"), day(20), now).where("key = 'patient'").first()
    assert soon.expires_at == now + timedelta(seconds=60)


def test_key_ledgers_as_a_stream_and_as_a_table(spark, tmp_path):
    rng, rounds, seq = random.Random(3), [], {}
    for minute in range(0, 600, 5):
        for key in ("a", "b", "c", "d"):  # d is silent after a while, so a timer ends its window
            if rng.random() < 0.6 and (key != "d" or minute < 60):
                seq[key] = seq.get(key, 0) + 1
                hour = minute // 120
                buckets = [{"key_id": key, "at": (datetime(2026, 1, 1) + timedelta(minutes=minute)).isoformat(), "seq": seq[key], "window": hour - rng.choice([0, 0, 1]), "current_window": hour, "window_end_ms": 1767225600000 + (hour + 1) * 7_200_000, "raw_tokens": rng.randint(1, 9), "charged_tokens": rng.randint(1, 9), "requests": 1, "failed": rng.randint(0, 1)} for _ in range(rng.randint(1, 3))]
                rounds.append(buckets)
                if rng.random() < 0.3:  # the answer was lost: the round is sent again a minute later
                    later = (datetime(2026, 1, 1) + timedelta(minutes=minute + 1)).isoformat()
                    rounds.append([b | {"at": later} for b in buckets])
    rounds.sort(key=lambda r: r[0]["at"])
    source = tmp_path / "in"
    source.mkdir()
    for i in range(0, len(rounds), 25):
        (source / f"{i:05}.json").write_text("\n".join(json.dumps(b) for r in rounds[i : i + 25] for b in r))
        os.utime(source / f"{i:05}.json", (1767225600 + i, 1767225600 + i))  # files are taken by their time
    schema = "key_id string, at timestamp, " + ", ".join(f"{c} long" for c in share_ledger.NUMBERS)
    last, ended = {}, []

    def keep(batch, number):
        for r in batch.collect():
            last[r.key_id] = r
            ended.append(r.event)

    old = spark.conf.get(share_ledger.PROVIDER[0])
    spark.conf.set(*share_ledger.PROVIDER)
    try:
        for part in range(2):  # stopped in between: the state is found again
            stream = share_ledger.key_ledgers(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.set(share_ledger.PROVIDER[0], old)
    table = {r.key_id: r for r in share_ledger.settled(spark.read.schema(schema).json(str(source))).collect()}
    names = ["last_seq", "used_tokens", "requests", "failed", "window", "skipped"]
    assert {k: [r[c] for c in names] for k, r in last.items()} == {k: [r[c] for c in names] for k, r in table.items()}
    assert all(r.window_tokens in (0, table[k].window_tokens) for k, r in last.items()) and sum(r.skipped for r in table.values()) > 5
    want, done = {k: [0, 0] for k in "abcd"}, {}
    for r in rounds:  # a plain ledger
        key = r[0]["key_id"]
        if r[0]["seq"] > done.get(key, 0):
            done[key] = r[0]["seq"]
            for b in r:
                want[key][0] += b["raw_tokens"]
    assert {k: r.used_tokens for k, r in table.items()} == {k: v[0] for k, v in want.items()} and "window_end" in ended and last["d"].window_tokens == 0 < table["d"].window_tokens


def test_csv_files_as_pythons(spark, tmp_path):
    texts = ["plain", "a,b", 'say "hi"', "two\nlines", "=1+1", "-x", None, "ü", ""]
    rows = [(date(2026, 1, 1 + i % 3), t, "m", i, 100 - i, 0.5 * i if i % 2 else None) for i, t in enumerate(texts)]
    usage = spark.createDataFrame(rows, "day date, nickname string, model string, input_tokens long, total_tokens long, cost double").withColumn("other", F.lit(1))
    usage_csv.export(usage, str(tmp_path / "out"), files=3)
    usage_csv.export(usage, str(tmp_path / "out"), (date(2026, 1, 1), date(2026, 1, 3)), files=3)  # in place of the first
    read = []
    for f in sorted((tmp_path / "out").iterdir()):
        data = f.read_bytes()
        assert f.name.startswith("part-") and data.startswith(b"\xef\xbb\xbfDate,User,Model,Input Tokens,Total Tokens,Estimated Cost USD\n")
        lines = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
        read += lines[1:]
        again = io.StringIO()
        for row in lines[1:]:
            again.write(",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') or c[:1] in "=+-@" and c else c for c in row) + "\n")
        assert data.decode("utf-8-sig").split("\n", 1)[1] == again.getvalue()
    want = sorted(rows, key=lambda r: (-r[0].toordinal(), -r[4]))
    assert read == [[str(d), n or "", m, str(i), str(t), "" if c is None else str(c)] for d, n, m, i, t, c in want]
    with pytest.raises(ValueError):
        usage_csv.export(usage, str(tmp_path / "no"), (date(2026, 1, 1), date(2026, 4, 2)))
    usage_csv.export(usage.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").glob("part-*"))
