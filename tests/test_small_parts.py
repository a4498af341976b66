"""Parts that no registered query shows: numbers, keys, digests, expiry, readers by index, CSV of gateways and bursts of streams."""

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterlake.operators import ledger as K
from meterlake.operators import lifecycle as L
from meterlake.operators import quota as Q
from meterlake.sources import logs
from meterlake.streaming import usage_stream


def test_numbers_and_keys(spark):
    given = ["5", "5.5", "-3", "x", None, "NaN", "Infinity", "1e3", ""]
    got = [r.n for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").orderBy("i").select(L.token_number(F.col("g")).alias("n")).collect()]
    assert got == [5, 6, 0, 0, 0, 0, 0, 1000, 0]
    one = spark.createDataFrame([("2026-01-01", None, 7, " M ")], "day string, hour int, participant long, model string")
    assert one.select(L.usage_key("day", "hour", "participant")).first()[0] == "2026-01-01|0|7" and one.select(L.model_name(F.col("model"))).first()[0] == "m"


def test_folders_of_addresses(spark):
    from meterlake.operators.rules import folder_of_uri

    given = ["file:///home/a%20b/c+d", "file://localhost/x", "file:///C:/w%C3%BC", "/plain%20x", "file:///bad%zz", None]
    got = [r.f for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").orderBy("i").select(folder_of_uri(F.col("g")).alias("f")).collect()]
    assert got == ["/home/a b/c+d", "/x", "C:/wü", "/plain%20x", "/bad%zz", None]


def test_scope_digests(spark):
    daily = spark.createDataFrame([(1, "a", "d1"), (2, "a", "d2")], "day int, provider_id string, fingerprint string")
    hourly = spark.createDataFrame([(1, "a", "h2"), (1, "a", "h1"), (3, "a", "h3")], daily.schema)
    got = {r.day: r.digest for r in K.scope_digests(daily, hourly, ["day", "provider_id"]).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    both = lambda d, h: sha(json.dumps({"daily": d, "hourly": h}, separators=(",", ":")))
    assert got == {1: both("d1", sha("h1,h2")), 2: both("d2", ""), 3: both("", sha("h3"))}


def test_claims_that_have_not_run_out(spark):
    now = datetime(2026, 1, 1)
    claims = spark.createDataFrame([(1, None), (2, now), (3, now + timedelta(seconds=1))], "id int, expires_at timestamp")
    assert sorted(r.id for r in Q.unexpired(claims, now).collect()) == [1, 3]


def test_wire_logs_find_their_folder(spark, tmp_path):
    where = tmp_path / "sessions" / "g" / "s1" / "wire.jsonl"
    where.parent.mkdir(parents=True)
    where.write_text(json.dumps({"type": "usage.record", "model": "K", "usage": {"inputOther": 5, "output": 2}, "time": 1767225600000}))
    index = spark.createDataFrame([("s1", "/old", 1), ("s1", "/new", 2), ("s2", "/x", 3)], "sessionId string, workDir string, line int")
    got = logs.record_sessions(spark, str(tmp_path), index).first()
    assert (got.session_id, got.workdir, got.total_tokens, got.model) == ("s1", "/new", 7, "k")


def test_gateway_exports(spark, tmp_path):
    head = "time,agent,provider,model,input_tokens,output_tokens,cache_read_tokens,cache_write_tokens,cost_usd,status,source,rejected\n"
    (tmp_path / "g.csv").write_text(head + '2026-01-01T00:00:00Z,"a ""b""",p," M,\nx ",5,x,-1,2,0.5,200,cli,false\n2026-01-01T00:00:01Z,a,p,m,9,9,9,9,1,200,cli,TRUE\n')
    got = logs.gateway_csv(spark, str(tmp_path)).collect()
    assert [(r.agent, r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens, r.cache_write_tokens, r.cost, r.status) for r in got] == [('a "b"', "m,\nx", 5, 0, 0, 2, 0.5, 200)]


def test_bursts_of_a_stream(spark, tmp_path):
    at = lambda s: (datetime(2026, 1, 1) + timedelta(seconds=s)).isoformat()
    (tmp_path / "in").mkdir()
    for i, seconds in enumerate(([0, 0.5, 1.2, 5], [5.4, 600])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"key": "k", "ts": at(s), "total_tokens": 1}) for s in seconds))
    events = usage_stream.read_events(spark, str(tmp_path / "in"), "key string, ts timestamp, total_tokens long")
    found = []
    query = usage_stream.bursts(events, "key").writeStream.foreachBatch(lambda b, n: found.extend((r.events, r.total_tokens) for r in b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(found) == [(2, 2), (3, 3)]
