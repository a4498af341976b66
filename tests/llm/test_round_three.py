"""Centroid clustering, conversation repair and pattern packing against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlake.llm import centroids, conversation_repair, pattern_packing, queries

# --- clustering


def lloyd(vectors: list[list[int]], first: list[list[int]], rounds: int):
    c = [list(x) for x in first]

    def near():
        return [min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True)), j)) for v in vectors]

    for _ in range(rounds):
        own = near()
        for j in range(len(c)):
            mine = [v for v, o in zip(vectors, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = near()
    return own, [sum((a - b) ** 2 for a, b in zip(v, c[o], strict=True)) for v, o in zip(vectors, own, strict=True)], c


def test_clusters_as_plain_rounds(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.5, 0.0, 2.25, 0.1)) + rng.gauss(0, 0.3) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)]  # equal vectors: ties between equal centroids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, c = centroids.cluster(df, k=6, rounds=9, dim=4, scale=16)
    whole = {i: [math.floor(16 * x) for x in v] for i, v in rows}
    order = sorted(whole, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    own, far, want = lloyd([whole[i] for i, _ in rows], [whole[i] for i in order[:6]], 9)
    assert c.tolist() == want
    assert {r.vec_id: (r.cluster, r.distance) for r in got.collect()} == {i: (o, d) for (i, _), o, d in zip(rows, own, far, strict=True)}
    report = centroids.report(got, c).collect()
    assert {r.inertia for r in report} == {sum(far)} and {r.cluster: r.cluster_inertia for r in report} == {j: sum(d for d, o in zip(far, own, strict=True) if o == j) for j in set(own)}


def test_bounds_are_never_wrong_and_spare_scans():
    rng = np.random.default_rng(3)
    base = rng.integers(-900, 900, (6, 8))
    v = (base[rng.integers(0, 6, 2000)] + rng.integers(-90, 90, (2000, 8))).astype(np.int64)
    c = v[:6].copy()
    own, upper, lower, scan = centroids.nearest(v, c, np.full(2000, -1), np.full(2000, np.inf), np.full(2000, -np.inf))
    scanned = [int(scan.sum())]
    for _ in range(6):
        after = np.array([v[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(6)])
        drift = np.sqrt(((after - c) ** 2).sum(axis=1)) * (1 + 1e-12)
        c = after
        own, upper, lower, scan = centroids.nearest(v, c, own, *centroids.loosened(own, upper, lower, drift))
        far = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (own == far.argmin(axis=1)).all() and (upper >= np.sqrt(far.min(axis=1))).all() and (lower <= np.sqrt(np.sort(far, axis=1)[:, 1])).all()
        scanned.append(int(scan.sum()))
    assert scanned[0] == 2000 and scanned[-1] < 500


def test_vectors_that_do_not_count(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 3.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [3e38, -3e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))
    got, c = centroids.cluster(df, k=8, dim=2)
    assert sorted((str(r.vec_id), r.distance) for r in got.collect()) == [("1", 0), ("1", 0), ("7", 0), ("None", 0)] and len(c) == 4
    assert centroids.report(*centroids.cluster(df.limit(0), dim=2)).count() == 0


# --- repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def brute(turns: list[tuple[str, str]]):
    """All edit sequences with up to two inserts at each place, in plain Python."""
    seen, faults = set(), []
    for role, text in turns:
        kind = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "" if text.strip(SPACE)[-1] in ".!?" else "truncated"
        faults.append(kind)
        seen.add((role, text))
    options = []
    for (role, _), kind in zip(turns, faults, strict=True):
        stay = 5 if kind == "truncated" else 0
        own = [("D", 2, "")]
        if kind not in ("blank", "duplicate"):
            own += [("K", stay, role[:1] or "?"), ("R", 1 + stay, "u"), ("R", 1 + stay, "a")]
        options.append(own)
    inserts = [("", 0, ""), *[("I" * len(x), 5 * len(x), x) for x in ("u", "a", "ua", "au")]]
    best = None
    for pick in itertools.product(*[p for o in options for p in (inserts, o)], inserts):
        out = "".join(p[2] for p in pick)
        if GRAMMAR.fullmatch(out):
            found = (sum(p[1] for p in pick), "".join(p[0] for p in pick), out)
            best = found if best is None or found[:2] < best[:2] else best
    cost, audit, out = best
    lines, at, named = [], 0, {"u": "user", "a": "assistant", "s": "system"}
    place = 0
    for e in audit:
        role, text = turns[at] if e != "I" else ("", "")
        at += e != "I"
        if e != "D":
            lines.append((role if e == "K" else named[out[place]]) + ":" + text)
            place += 1
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:], strict=False)]
    return [faults.count(k) for k in ("blank", "duplicate", "truncated")] + [sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]


def repaired_of(spark, rows, partitions=3, **columns):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    report, turns = conversation_repair.repair(df.withColumns({k: F.lit(v) for k, v in columns.items()}))
    sha = {r.conv: r.repaired_sha256 for r in conversation_repair.digests(turns).collect()}
    return {r.conv_id: [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv_id, hashlib.sha256(b"").hexdigest())] for r in report.collect()}


def test_repairs_as_brute_force(spark):
    rng, rows, want = random.Random(8), [], {}
    for conv in range(120):
        turns = [(rng.choice(["user", "assistant", "assistant", "system", "tool", ""]), rng.choice(["a.", "b!", "c", "d ?\n", " \t", "é…"])) for _ in range(rng.randint(1, 4))]
        at = sorted(rng.sample(range(9), len(turns)))
        rows += [(conv, t, *x) for t, x in zip(at, turns, strict=True)]
        want[conv] = [at[-1] - at[0] + 1 - len(at), *brute(turns)]
    assert repaired_of(spark, rows, n="x", kind="y", edits="z") == want


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 7)
    rng = random.Random(2)
    turns = [(rng.choice(["user", "assistant", "tool"]), f"{i % 30} said" + "." * (i % 3)) for i in range(500)]
    long = repaired_of(spark, [(1, i, *t) for i, t in enumerate(turns)] + [(None, 0, "user", "x.")])
    monkeypatch.setattr(conversation_repair, "BLOCK", 4096)
    assert long == repaired_of(spark, [(1, i, *t) for i, t in enumerate(turns)] + [(None, 0, "user", "x.")])
    assert long[None][6] == "D" and len(long[1][6].replace("I", "")) == 500


def test_null_turns_ties_and_repeated_rows(spark):
    got = repaired_of(spark, [(1, None, "assistant", "b."), (1, None, "user", "a."), (1, 4, "user", "c."), (1, 4, "assistant", "c."), (2, None, None, None), (3, 1, "user", "a."), (3, 1, "user", "a."), (3, 9, "assistant", "b.")])
    assert got[1][:5] == [0, 0, 0, 0, 0] and got[1][6] == "DKKD"  # by role within a turn: assistant, user, assistant, user
    assert got[2][:5] == [0, 1, 0, 0, 0] and got[2][6] == "D"
    assert got[3][:5] == [7, 0, 1, 0, 1] and got[3][5:7] == [2, "KDK"]


def test_damage(spark):
    rows = [(c, t, "assistant", f"Say {t}. Yes!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = sorted(map(tuple, queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id is not null").collect()))
    want = []
    for c, t, role, text in rows[:-1]:
        f = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)
        want += [row] * (0 if f == 0 else 2 if f == 3 else 1)
    assert got == sorted(want) and {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows[:-1]} == set(range(20))


# --- packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_every_pack(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 40 + 4000 * (n == 9)) for n in rng.sample(range(1, 64), 30)}
    runs = pattern_packing.plan(counts, 64)
    packs, seen = {}, {}
    for rest, low, high, start, length, first, at in runs:
        for r in range(low, high):
            packs.setdefault(first + r - low, []).append((at, length))
            seen.setdefault((rest, r), []).append((start, length))
    for parts in (*packs.values(), *seen.values()):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    sizes = [sum(n for _, n in parts) for parts in packs.values()]
    assert all(s == 64 or s & (s - 1) == 0 for s in sizes) and sum(s < 64 for s in sizes) <= 6
    assert {k: sum(n for _, n in v) for k, v in seen.items()} == {(n, r): n for n, c in counts.items() for r in range(c)}


def test_pieces_as_the_tokenizer_says(spark, monkeypatch):
    monkeypatch.setattr(pattern_packing, "RANKED", 5)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta,", "日本", "x", "Zürich"]) for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, "", "a <|endoftext|> b", "word " * 900, "same text"] + ["same text"] * 30
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, "no id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string, id int").repartition(4)
    got = pattern_packing.pack(df, capacity=128).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t, *_ in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(n for _, n, *_ in by_doc[i]) == len(ids) * (2 if i == 3 else 1)
        for start, length, crc, n in by_doc[i]:
            assert n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
    for parts in by_sequence.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == 128 or at & (at - 1) == 0 and at < 128
    assert pattern_packing.pack(df.limit(0)).count() == 0
