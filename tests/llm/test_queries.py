"""The registered opN_ queries on a small set of tables: contract columns, held-out rows, and plain-Python results."""

import collections
import hashlib
import math
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlake.llm import chat_format, decontaminate, queries, toxicity, url_filter
from meterlake.llm.oracle import ORACLE_SQL
from meterlake.llm.shared import fraction

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ra", "lo", "ti", "mu")]


def prose(seed: int, n: int) -> str:
    x, out = seed * 2654435761 % 2**32 + 1, []
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(VOCABULARY[(x >> 12) ** 2 // len(VOCABULARY) % len(VOCABULARY)])
    return " ".join(out)


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    texts = {i: prose(i, 20 + i * 7 % 90) + (" scum filth" if i % 3 == 0 else "") for i in range(1, 61)}
    texts |= {61: texts[5], 62: None, 63: "", 64: "Só 😀 <|endoftext|> x", 65: prose(90, 2600), 66: prose(70, 30) + "\n" + texts[40], 67: " \t", 68: texts[7] + " more"}
    lang = lambda i: None if i % 7 == 0 else ("en", "de")[i % 2]
    docs = [(k, t, lang(k), "hot", None if t is None else len(t)) for k, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, None if i == 9 else i % 2, None if i == 10 else int(i % 3 == 0)) for i in range(1, 61)] + [(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    hosts = ["bad.spam.net", "Good.example.net", "a.org", "example.org", "x.com", "b.c.com"]
    pages = [(i, f"http://{hosts[i % 3 * (i > 40)]}/p{i}?q") for i in range(1, 61)] + [(70, None), (71, "none"), (72, "s://example.org/en/12#a"), (73, "s://www.example.org/es/"), (74, "s://x.com/de/?"), (75, "s://x.com/fr/"), (76, "s://com"), (77, "s://EXAMPLE.org")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{base}/pages.parquet")
    spark.createDataFrame([(1, prose(500, 30)), (2, " ".join(texts[12].split()[:16])), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    turns = [(1, 0, "system", "be \\ kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "<s>yes</s>"), (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", "again"), (None, 0, "assistant", "b")]
    turns += [(3, i, ("user", "assistant")[i % 2], prose(i, 150)) for i in range(60)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{base}/conversations.parquet")
    vectors = [(i, [math.sin(i * j) * (1 + i % 3) for j in range(64)] if i % 17 else None, i % 5) for i in range(90)] + [(3, [0.25] * 64, 0), (200, [0.5] * 63, 1)]
    spark.createDataFrame(vectors, SCHEMAS["embeddings"]).write.parquet(f"{base}/embeddings.parquet")
    return {"dir": str(base), "texts": texts, "turns": turns, "pages": pages}


def rows(spark, tables, name):
    return queries.QUERIES[name](spark, tables["dir"]).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, tables, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings", "conversations"):
        db.execute(f"create view {t} as select * from '{tables['dir']}/{t}.parquet/*.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, tables["dir"]).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_op2_held_out_and_threshold(spark, tables):
    got = {r.doc_id: r for r in rows(spark, tables, "op2_toxicity")}
    assert set(got) == set(tables["texts"])
    assert all(r.held_out == (crc(k) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for k, r in got.items())


def test_op2_as_a_plain_loop(spark, tables):
    docs = spark.read.parquet(f"{tables['dir']}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{tables['dir']}/labels.parquet")
    model = toxicity.fit(docs, labels, epochs=3)
    order = {r.doc_id: r.h for r in docs.select("doc_id", fraction(F.col("doc_id")).alias("h")).collect()}
    marks = {i: int(i % 3 == 0) for i in range(1, 61) if i != 10}
    marks[1] = 0
    ids = sorted(marks, key=lambda k: (order[k], k))
    ids = [k for k in ids if not marks[k]] + [k for k in ids if marks[k]]
    alpha, beta, l1, l2, bias = 0.08, 1.0, 2.5, 0.5, 1 << toxicity.BITS
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        edge = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= edge else -(z[i] - math.copysign(edge, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    shuffled = np.random.default_rng(11)
    for _ in range(3):
        for i in shuffled.permutation(len(ids)):
            text, y = tables["texts"][ids[i]], marks[ids[i]]
            at = [*{int(x) for x in toxicity.features(text)}, bias]
            w = {j: weight(j) for j in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for j in at:
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * w[j]
                n[j] += g * g
    want = {i: weight(i) for i in z if weight(i) or i == bias}
    found = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True))
    assert set(found) == set(want) and len(want) > 1 and all(abs(found[i] - want[i]) < 1e-9 for i in want)


def test_op3_contract(spark, tables):
    got = {r.doc_id: r for r in rows(spark, tables, "op3_fingerprint")}
    order = sorted(tables["texts"])
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        x, y = tables["texts"][a] or "", tables["texts"][b] or ""
        edited = x[: len(x) - len(x) // 4] + y[: len(x) // 4]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
    assert got[5].fingerprint == got[61].fingerprint and got[62].fingerprint == got[63].fingerprint == got[67].fingerprint


def test_op4_contract(spark, tables):
    got = {r.conv_id: r for r in rows(spark, tables, "op4_chat_format")}
    said = "</s>[INST] ok [/INST]"
    by = collections.defaultdict(list)
    for c, turn, role, text in [*tables["turns"], (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        by[c].append((turn, role, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        plain, lost = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256, got[c].loss_chars) == (len(turns), hashlib.sha256(plain.encode()).hexdigest(), hashlib.sha256(lost.encode()).hexdigest(), len(lost))


@pytest.mark.parametrize(("budget", "history"), [(60, 20), (300, 80), (2048, 256)])
def test_op4_windows_keep_the_budget(spark, tables, budget, history):
    conversations = spark.read.parquet(f"{tables['dir']}/conversations.parquet")
    turn_ends = F.size(F.split("formatted", chat_format.END)) - 1
    for r in chat_format.windows(conversations, budget, history).select("conv", "window", F.length("formatted").alias("chars"), turn_ends.alias("turns"), "repeated").collect():
        # rounding up is by turn, and the beginning sign is not counted
        assert r.chars <= 4 * budget + len(chat_format.START) or r.turns - r.repeated == 1


def test_op5_ids_cuts_and_places(spark, tables):
    bpe = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {k: [*bpe.encode(t or "", add_special_tokens=False).ids, 0] for k, t in tables["texts"].items()}
    by, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows(spark, tables, "op5_pack"):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(piece) <= 2048 and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        by[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.piece, r.start, r.length))
    for k, x in ids.items():
        found = sorted(parts[k])
        assert [p for p, _, _ in found] == list(range(len(found))) and sum(n for _, _, n in found) == len(x) and all(n == 2048 for p, _, n in found if p)
    for x in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(x)]).tolist()]
        assert [a for a, _ in sorted(x)] == ends[:-1] and ends[-1] <= 2048
    assert len(by) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_op6_posteriors_as_plain_python(spark):
    trials = {"a.x.net": (40, 39), "b.x.net": (3, 3), "c.y.net": (50, 2), "d.z.org": (0, 0), "e.z.org": (9, 1), "f.w.org": (20, 10), "": (0, 0)}

    def shrink(level, parent_of, means):
        out = {}
        for p in set(map(parent_of, level)):
            own = {k: v for k, v in level.items() if parent_of(k) == p}
            n, b = sum(x for x, _ in own.values()), sum(y for _, y in own.values())
            s = url_filter.STRONGEST
            if n:
                rate, spread = b / n, n - sum(x * x for x, _ in own.values()) / n
                between = sum(y * y / x for x, y in own.values() if x) - n * rate * rate - (len(own) - 1) * rate * (1 - rate)
                if spread and between / spread > 0:
                    s = rate * (1 - rate) / (between / spread) - 1
            s = max(url_filter.WEAKEST, min(url_filter.STRONGEST, s))
            for k, (x, y) in own.items():
                a, c = y + s * means[p], x - y + s * (1 - means[p])
                out[k] = (a / (a + c), math.sqrt(a * c / ((a + c) ** 2 * (a + c + 1))))
        return out

    def summed(level, up):
        out = collections.Counter(), collections.Counter()
        for k, (x, y) in level.items():
            out[0][up(k)] += x
            out[1][up(k)] += y
        return {k: (out[0][k], out[1][k]) for k in out[0]}

    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    domains = summed(trials, domain)
    suffixes = summed(domains, suffix)
    n, b = sum(x for x, _ in suffixes.values()), sum(y for _, y in suffixes.values())
    means = {k: m for k, (m, _) in shrink(suffixes, lambda _: 0, {0: (b + 0.5) / (n + 1)}).items()}
    means = {k: m for k, (m, _) in shrink(domains, suffix, means).items()}
    want = shrink(trials, domain, means)
    got = url_filter.reputation(spark.createDataFrame([(h, x, y) for h, (x, y) in trials.items()], "host string, n long, bad long")).collect()
    assert {r.host for r in got} == set(want)
    assert all(abs(r.m - want[r.host][0]) < 1e-9 and abs(r.sd - want[r.host][1]) < 1e-9 for r in got)


def test_op6_blocks_by_reputation(spark, tmp_path):
    pages = [(i, f"http://spam.bad.net/{i}") for i in range(60)] + [(100 + i, f"http://fine.good.net/{i}") for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 0, 1) for i in range(0, 60, 2)] + [(100 + i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in queries.op6_url_filter(spark, str(tmp_path)).collect()}
    assert {got[i].verdict for i in range(60)} == {"block"} and {got[100 + i].verdict for i in range(60)} == {"allow"} and all(r.rule is None for r in got.values())


def test_op7_contract(spark, tables):
    got = {r.doc_id: r for r in rows(spark, tables, "op7_language_id")}
    assert set(got) == set(tables["texts"])
    assert all(r.held_out == (crc(k) % 3 == 1) and 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for k, r in got.items())
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {62, 63, 67}


def test_op8_base_and_counts(spark, tables):
    words = {k: [*(t or "").encode().lower().split(), b"\n"] for k, t in tables["texts"].items()}
    counts = collections.Counter()
    for k, w in words.items():
        if crc(k) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in rows(spark, tables, "op8_lm_score")}
    assert set(got) == set(words)
    for k, w in words.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(k) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 and r.score < 0
    # a text that training has elsewhere too is told apart
    assert got[61].score / got[61].n_tokens > 2 * got[9].score / got[9].n_tokens / 3


def test_op9_as_brute_force(spark, tables):
    items = {1: prose(500, 30).split(), 2: tables["texts"][12].split()[:16]}
    want = set()
    for k, t in tables["texts"].items():
        w = (t or "").lower().split()
        for i, x in items.items():
            need, seen = max(math.ceil(len(x) / 2), min(8, len(x))), set()
            for shift in range(1 - len(x), len(w)):
                agree = {j for j in range(len(x)) if 0 <= j + shift < len(w) and w[j + shift] == x[j]}
                seen |= agree if len(agree) >= min(7, len(x)) else set()
            if len(seen) >= need:
                want.add((k, i, len(x), len(seen)))
    assert {tuple(r) for r in rows(spark, tables, "op9_decontaminate")} == want and (12, 2, 16, 16) in want


def test_op9_ends_on_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "wo rd " * 3000), (2, "wo rd " * 20), (3, "rd x " * 500)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "wo rd " * 100)], "item_id long, text string")
    assert sorted((r.doc_id, r.matched) for r in decontaminate.find(docs, bench).collect()) == [(1, 200), (2, 200), (3, 100)]


def test_op9_tells_clashing_and_null_ids_apart(spark, monkeypatch):
    items = [(1, prose(500, 30)), (1, prose(501, 40)), (None, prose(502, 20)), (1, prose(500, 30)), (2, None)]
    docs = [(7, prose(1, 50) + " " + prose(500, 30)), (7, prose(501, 40)), (None, prose(502, 20)), (None, prose(500, 30) + " more"), (8, prose(9, 60)), (8, None), (None, None), (7, prose(501, 40))]
    want = [("7", "1", 30), ("7", "1", 40), ("None", "1", 30), ("None", "None", 20)]
    for rows, size in ((500_000, 16_000_000), (2, 3)):  # the second: nothing is broadcast
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(decontaminate, "BROADCAST_SIZE", size)
        documents, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
        assert sorted((str(r.doc_id), str(r.item_id), r.matched) for r in decontaminate.find(documents, bench).collect()) == want
        assert sorted((str(r.doc_id), r.text is None) for r in decontaminate.remove(documents, bench).collect()) == [("8", False), ("8", True), ("None", True)]


def test_pipeline_keeps_columns_of_any_type(spark):
    import corpus_pipeline

    rows = [(1, prose(1, 40), {"a": 1}), (1, prose(1, 40), {"a": 0}), (2, prose(2, 40), None), (3, prose(2, 40) + " end", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>")
    got = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert sorted((r.doc_id, r.tags) for r in got.collect()) == [(1, {"a": 0}), (2, None)] and got.columns == docs.columns


def test_op8_sample_is_of_different_texts(spark, monkeypatch):
    from meterlake.llm import lm_score

    monkeypatch.setattr(lm_score, "SAMPLE_ROWS", 5)
    texts = [prose(i, 5) for i in range(12)]
    df = spark.createDataFrame([(t,) for i, t in enumerate(texts) for _ in range(1 + 200 * (i < 2))], "text string")
    want = {r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text")).limit(5).collect()}
    got = [r.text for r in lm_score._sample(df.repartition(4)).collect()]
    assert len(got) == 5 and set(got) == want
    assert lm_score._sample(df.limit(0)).count() == 0


SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string", "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int"}


def test_empty_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {name: query(spark, str(tmp_path)).count() for name, query in queries.QUERIES.items()} == {name: int(name == "op4_chat_format") for name in queries.QUERIES}


def test_repeated_rows_nulls_and_clashing_names(spark, tmp_path):
    texts = [(1, prose(1, 60)), (1, prose(1, 60)), (None, prose(2, 50)), (None, None), (2, ""), (3, prose(3, 3000)), (3, prose(4, 40))]
    clashing = ["id", "key", "words", "lang_pred", "score", "w", "k", "t", "row", "train", "range", "at", "n_words", "kept_text", "n_removed", "h", "y", "found", "text_", "label"]
    wide = [(i, t, "en", "hot", 1, *["x"] * len(clashing)) for i, t in texts]
    spark.createDataFrame(wide, SCHEMAS["documents"] + "".join(f", {c} string" for c in clashing)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, None, None), (3, None, 0)], SCHEMAS["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a://b.c/", "x"), (1, "a://b.c/", "x"), (None, "a://b.c/", "x"), (None, None, None)], "page_id long, url string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(None, "a"), (1, None), (1, prose(2, 50))], SCHEMAS["benchmark"]).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "assistant", "a", "x"), (1, 0, "assistant", "a", "x"), (None, None, None, None, None)], SCHEMAS["conversations"] + ", window string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, [0.5] * 64, 1, "x"), (1, [0.5] * 64, 1, "x"), (None, [1.5] * 64, None, "x"), (None, None, None, None)], SCHEMAS["embeddings"] + ", cluster string").write.parquet(f"{tmp_path}/embeddings.parquet")
    counts = {name: query(spark, str(tmp_path)).count() for name, query in queries.QUERIES.items() if name != "pipeline"}
    assert counts == {"op1_near_dedup": 4, "op2_toxicity": 7, "op3_fingerprint": 7, "op4_chat_format": 3, "op5_pack": counts["op5_pack"], "op6_url_filter": 4, "op7_language_id": 7, "op8_lm_score": 7, "op9_decontaminate": 1, "op10_substring_dedup": 7, "op11_centroids": 3, "op12_conversation_repair": 2, "op13_pattern_pack": counts["op13_pattern_pack"]}
    # the null id's text is a benchmark item, the repeats and empty texts go; the other columns stay
    assert queries.QUERIES["pipeline"](spark, str(tmp_path)).select("doc_id").distinct().orderBy("doc_id").collect() == [(1,), (3,)]
