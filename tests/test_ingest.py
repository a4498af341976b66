"""The composed ingest as a stream, against a plain-Python model of the stored tables."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.streaming import ingest as I

COUNTS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
CLOUD = I.CLOUD[0]


def item(day, hour, provider, model="m", n=1, workdir="w", fp="f", tool="t"):
    return {"day": day, "hour": hour, "provider_id": provider, "tool_code": tool, "workdir": workdir, "model": model, **{c: n * (i + 1) for i, c in enumerate(COUNTS)}, "source_fingerprint": fp}


def snapshot(i, minute, items, platform="desktop", participant=1, device=1, day="2026-01-01", hour=3, provider="p", **over):
    at = (datetime(2026, 1, 2) + timedelta(minutes=minute)).isoformat()
    return {"snapshot_id": f"s{i}", "sent_at": at, "platform": platform, "participant_id": participant, "device_id": device, "day": day, "hour": hour, "provider_id": provider, "row_count": len(items), "total_tokens": 0, "fingerprint": "x", "items": items} | over


class Model:
    """Hours, buckets and derived days as dictionaries; batches apply one after the other."""

    def __init__(self, days):
        self.hours, self.buckets, self.days, self.told = {}, {}, dict(days), {}

    def valid(self, s):
        return s["fingerprint"] and s["row_count"] == len(s["items"]) != 0 and 0 <= s["hour"] <= 23 and all((x["day"], x["hour"], x["provider_id"]) == (s["day"], s["hour"], s["provider_id"]) for x in s["items"])

    def batch(self, snapshots):
        by_id = {}
        for s in snapshots:
            if s["snapshot_id"] not in by_id or s["sent_at"] > by_id[s["snapshot_id"]]["sent_at"]:
                by_id[s["snapshot_id"]] = s
        best, new = {}, []
        for s in by_id.values():
            scope = (s["participant_id"], s["device_id"], s["day"], s["hour"], s["provider_id"])
            rank = (s["platform"] != I.PLUGIN, s["sent_at"], s["snapshot_id"])
            if not self.valid(s):
                self.told[s["snapshot_id"]] = "bad"
            elif scope not in best or rank > best[scope][0]:
                if scope in best:
                    self.told[best[scope][1]["snapshot_id"]] = "superseded"
                best[scope] = (rank, s)
            else:
                self.told[s["snapshot_id"]] = "superseded"
        claimed = {(k[0], k[1], k[2], k[3]) for k, v in self.days.items() if not v[1]}
        for scope, (rank, s) in best.items():
            rows = {}
            for x in s["items"]:
                key = (x["tool_code"].strip().lower(), x["workdir"], x["model"].strip().lower())
                total = sum(x[c] for c in COUNTS[:4])
                old = rows.get(key)
                value = [x[c] + (old[0][i] if old else 0) for i, c in enumerate(COUNTS)]
                lead = min((-total, x["source_fingerprint"]), old[1]) if old else (-total, x["source_fingerprint"])
                rows[key] = (value, lead)
            rows = {k: (*v[0], v[1][1]) for k, v in rows.items()}
            was = self.buckets.get(scope)
            client = rank[0]
            if not client and (was and was["client"] or (*scope[:3], scope[4]) in claimed):
                self.told[s["snapshot_id"]] = "outranked"
            elif was and was["client"] == client and s["sent_at"] < was["sent_at"]:
                self.told[s["snapshot_id"]] = "stale"
            elif was and was["rows"] == rows and (self.hours.get(scope) or rows) == rows:
                self.told[s["snapshot_id"]] = "noop"
            else:
                self.told[s["snapshot_id"]] = "applied"
                new.append((s["sent_at"], scope, rows, client))
        changed, newest = set(), {}
        for sent, scope, rows, client in new:
            self.hours.pop(scope, None)
            self.buckets[scope] = {"client": client, "sent_at": sent, "rows": rows}
            changed.add((*scope[:3], scope[4]))
            if scope[4] == CLOUD:
                for k in rows:
                    natural = (scope[0], *scope[2:], *k)
                    newest[natural] = max(newest.get(natural, ("", 0)), (sent, scope[1]))
        for _, scope, rows, _ in new:
            self.hours[scope] = {k: v for k, v in rows.items() if scope[4] != CLOUD or newest[(scope[0], *scope[2:], *k)][1] == scope[1]}
        for scope in list(self.hours):
            for k in list(self.hours[scope]):
                natural = (scope[0], *scope[2:], *k)
                if natural in newest and newest[natural][1] != scope[1]:
                    del self.hours[scope][k]
                    changed.add((*scope[:3], scope[4]))
        self.days = {k: v for k, v in self.days.items() if k[:4] not in changed or not v[1]}
        fresh = {}
        for scope, rows in self.hours.items():
            if (*scope[:3], scope[4]) in changed:
                for k, v in rows.items():
                    key = (*scope[:3], scope[4], *k)
                    fresh[key] = [a + b for a, b in zip(fresh.get(key, [0] * 5), v[:5], strict=True)]
        self.days |= {k: (v, True) for k, v in fresh.items()}


@pytest.mark.parametrize("seed", range(1))
def test_tables_stay_as_the_model_says(spark, tmp_path, seed):
    rng, target, source = random.Random(seed), str(tmp_path / "t"), tmp_path / "in"
    source.mkdir()
    legacy = (1, 2, "2026-01-01", "p", "t", "w", "m")
    made = []
    for i in range(60):
        provider = rng.choice(["p", CLOUD])
        day, hour = f"2026-01-0{rng.randint(1, 2)}", rng.choice([3, 4])
        items = [item(day, hour, provider, rng.choice(["m", " M", "n"]), rng.randint(1, 3), fp=rng.choice("ab")) for _ in range(rng.randint(1, 3))]
        made.append(snapshot(i, rng.randint(0, 300), items, rng.choice(["desktop", I.PLUGIN, ""]), device=rng.randint(1, 2), day=day, hour=hour, provider=provider))
    made += [snapshot(100, 1, []), snapshot(101, 1, [item("2026-01-01", 5, "p")], hour=3), snapshot(102, 1, [item("2026-01-01", 3, "p")], row_count=2), snapshot(103, 1, [item("2026-01-01", 3, "p")], fingerprint="")]
    batches = [made[i : i + 16] for i in range(0, len(made), 16)]
    batches += [batches[1], batches[0] + batches[2]]  # the same and older ones come again
    I.prepare(spark, target)
    spark.createDataFrame([(1, 2, date(2026, 1, 1), "p", "t", "w", "m", 5, 5, 5, 5, 5, 20, False)], "participant_id long, device_id long, day date, provider_id string, tool_code string, workdir string, model string, " + ", ".join(f"{c} long" for c in [*COUNTS, "total_tokens"]) + ", hourly_derived boolean").write.mode("append").partitionBy("day").parquet(f"{target}/daily")
    model = Model({legacy: ([5] * 5, False)})
    for n, batch in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, batch)))
        stream = spark.readStream.schema(I.SNAPSHOT).option("maxFilesPerTrigger", 1).json(str(source))
        I.ingest(stream, target, str(tmp_path / "cp")).awaitTermination(300)
        model.batch(batch)
        told = {r.snapshot_id: "bad" if r.status in ("empty", "bad_items", "bad_count", "no_fingerprint") else r.status for r in spark.read.parquet(f"{target}/outcomes").where(F.col("batch") == n).collect()}
        assert told == {s["snapshot_id"]: model.told[s["snapshot_id"]] for s in batch}
    hours = {(r.participant_id, r.device_id, str(r.day), r.hour, r.provider_id, r.tool_code, r.workdir, r.model): (*(r[c] for c in COUNTS), r.source_fingerprint) for r in I.stored(spark, target, "hourly").collect()}
    assert hours == {(*s, *k): v for s, rows in model.hours.items() for k, v in rows.items()}
    days = {(r.participant_id, r.device_id, str(r.day), r.provider_id, r.tool_code, r.workdir, r.model): ([r[c] for c in COUNTS], r.hourly_derived) for r in I.stored(spark, target, "daily").collect()}
    assert days == model.days
    assert {(r.participant_id, r.device_id, str(r.day), r.hour, r.provider_id): r.row_count for r in I.stored(spark, target, "buckets").collect()}.keys() == model.buckets.keys()
    assert {"applied", "noop", "stale", "outranked", "superseded", "bad"} >= set(model.told.values()) >= {"applied", "outranked", "superseded", "bad"}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    target = str(tmp_path)
    I.prepare(spark, target)
    batch = spark.createDataFrame([], I.SNAPSHOT)
    rows = [json.dumps(snapshot(i, i, [item("2026-01-01", 3, "p", n=i + 1)], device=i % 2)) for i in range(4)]
    batch = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", I.SNAPSHOT).alias("s")).select("s.*")
    I.step(batch, 0, target)
    first = [sorted(map(str, I.stored(spark, target, t).collect())) for t in I.TABLES]
    I.step(batch, 0, target)
    assert first == [sorted(map(str, I.stored(spark, target, t).collect())) for t in I.TABLES] and first[0]
    assert {r.status for r in spark.read.parquet(f"{target}/outcomes").collect()} == {"noop", "superseded"}
