"""Corpus operators on small fixtures: brute force, round trips, edge cases."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from meterlake.llm import chat_format, decontaminate, fingerprint, language_id, lm_score, near_dedup, packing, substring_dedup, toxicity, url_filter

WORDS = [f"w{i}" for i in range(400)]


def passage(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared, base = passage(99, 70), passage(5, 200)
    near = base.replace("w1 ", "W1 ").split(" ")
    near[50] = "changed"
    rows = [(1, base), (2, " ".join(near)), (3, base), (4, passage(8, 120) + "\n" + shared), (5, shared + " " + passage(9, 90)), (6, None), (7, ""), (8, "one"), (9, "a " * 300), (10, "a " * 120 + "b"), (11, "!!! 123"), (None, passage(3, 60)), (12, passage(5, 199)), (13, base), (13, base)]
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, id int, words string")


def empty(docs):
    return docs.limit(0)


def test_near_duplicates_as_brute_force(docs):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, width=2, percent=80).collect()}
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} - {()}
    root = {k: k for k in sets}
    low = lambda k: -1 if k is None else k
    for _ in sets:
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b], key=low)
    assert {k: (len(sets[k]), root[k]) for k in sets} == {k: (r.n_shingles, r.component_id) for k, r in got.items()}
    assert near_dedup.near_duplicates(empty(docs)).count() == 0


def test_repeated_rows_in_other_partitions_make_one_set(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j"), (1, "a b c d e f")]
    texts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "id long, text string")
    sketched = texts.mapInPandas(near_dedup._sketch(2), "id long, n long, digest binary, sig binary")
    search = near_dedup._Search(texts, sketched.dropDuplicates(["id"]), 2, 80)
    got = {r.id: len(r.items) for r in search.sets(texts.select("id").distinct()).collect()}
    assert got == {1: 5, 2: 3} and search.sets(texts.select("id").distinct()).count() == 2


def test_keys_meet_within_the_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (200, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)] ^= 1
    assert (near_dedup.keys(a) == near_dedup.keys(b)).any(axis=1).all()


def test_substring_dedup_as_brute_force(docs):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    low = lambda k: -(1 << 63) if k is None else k
    first = {}
    for k, w in rows:
        for i in range(len(w) - 49):
            t = tuple(w[i : i + 50])
            first[t] = min(first.get(t, 1 << 62), low(k))
    want = []
    for k, w in rows:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < low(k):
                gone |= set(range(i, i + 50))
        want.append((low(k), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    got = [(low(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substring_dedup.dedup(empty(docs)).count() == 0


def test_chat_format_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "<", "</s", "<s>\\</s>", None, "", "x" * 9000]
    rows = [(1, i, ["system", "user", "assistant"][min(i, 1 + i % 2) if i else 0], t) for i, t in enumerate(tricky)] + [(2, 0, None, "a"), (None, 0, "assistant", "b")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.windows(df, budget=60, history=20)
    assert windows.where("conv = 1").count() > 1
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role or "", text or ""))
    for c, turns in by.items():
        plain, lost = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256, got[c].loss_chars) == (len(turns), hashlib.sha256(plain.encode()).hexdigest(), hashlib.sha256(lost.encode()).hexdigest(), len(lost))


def test_packing_is_gapless(docs):
    rows = packing.pack(packing.pieces(docs, capacity=64), capacity=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(empty(docs))).count() == 0


def test_fingerprints(docs):
    rows = fingerprint.with_next(docs).collect()
    assert len(rows) == docs.count()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    assert [r.next_text for r in order] == [r.text for r in order[1:] + order[:1]]
    pair = fingerprint.with_next(docs.where("doc_id in (1, 3)")).select(fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("x"))
    assert [r.x for r in pair.collect()] == [1.0, 1.0]
    assert fingerprint.with_next(empty(docs)).count() == 0


def test_decontamination_tolerates_substitutions(spark, docs):
    item = passage(77, 30).split()
    worn = list(item)
    worn[4] = worn[17] = "other"
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, passage(1, 40) + " " + " ".join(worn) + " end"), (51, passage(2, 300))], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.matched) for r in decontaminate.find(more, bench).collect()] == [(50, 1, 28)]
    assert decontaminate.find(empty(docs), bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_all_above_the_share(spark):
    rows, items = [], []
    for i, (n, every, phase) in enumerate([(n, every, phase) for n in (15, 16, 20, 30, 59) for every, phase in ((4, 0), (4, 3), (3, 1), (2, 1))]):
        item = [f"i{i}x{j}" for j in range(n)]
        worn = [f"z{j}" if j % every == phase else w for j, w in enumerate(item)]
        items.append((i, " ".join(item)))
        rows.append((i, passage(i, 30) + " " + " ".join(worn) + " " + passage(i + 1, 300)))
    fewer = [w if j % 2 else f"z{j}" for j, w in enumerate(items[4][1].split())]
    rows.append((99, " ".join([*fewer[:15], "z"])))
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(len(items))]


def test_decontamination_finds_short_items_in_long_texts(spark):
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(1, 11)]
    rows = [(n, passage(n, 40) + " " + t + " " + passage(n + 1, 200)) for n, t in items]
    rows += [(100 + n, passage(n, 40) + " " + t.rsplit(" ", 1)[0] + " z " + passage(n + 1, 200)) for n, t in items if 1 < n < 9]
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.matched) for r in found) == [(n, n, n) for n in range(1, 11)]


def test_url_rules_and_reputation(spark):
    pages = spark.createDataFrame([(i, f"http://bad.example.net/{i}") for i in range(40)] + [(100 + i, f"http://Good.example.net/{i}") for i in range(40)] + [(200, None), (201, "no scheme"), (202, "x://a.org/q"), (203, "x://example.org/en/12?a"), (204, "x://b.com/de/")], "page_id long, url string")
    seen = pages.where("page_id < 140").selectExpr("page_id", "if(page_id < 100, 1, 0) as bad")
    got = {r.page_id: r for r in url_filter.judge(pages, seen).collect()}
    assert {got[i].verdict for i in range(40)} == {"block"} and {got[100 + i].verdict for i in range(40)} == {"allow"}
    assert [(got[i].rule, got[i].verdict) for i in (202, 203, 204)] == [("org/", "allow"), ("example.org/en/1", "block"), ("com/de/", "block")]
    assert (got[200].host, got[200].path, got[201].host) == ("", "", "") and got[101].host == "good.example.net"


def test_languages(spark):
    text = {"en": "the cat and the dog with them ", "de": "der hund und die katze mit ihnen ", "fr": "le chat et le chien avec eux ", "es": "el gato y el perro con ellos "}
    rows = [(i * 4 + j, t * (1 + i % 5), lang) for i in range(12) for j, (lang, t) in enumerate(text.items())] + [(900, None, None), (901, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df, language_id.fit(df), keep=("lang",)).collect()
    assert all(r.lang_pred == (r.lang or "und") and 0 <= r.score <= 1 for r in got)
    assert language_id.fit(df.limit(0))["langs"] == []


def test_toxicity(spark):
    rows = [(i, passage(i, 40) + (" scum" if i % 4 == 0 else "")) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.where("doc_id < 100").selectExpr("doc_id", "if(doc_id % 4 = 0, 1, 0) as toxic")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert min(got[i] for i in range(100, 200, 4)) > max(got[i] for i in range(101, 200, 2)) and 0 <= got[900] <= 1


def test_lm_score_base_and_gain(docs):
    got = lm_score.score(docs, F.col("doc_id") <= 9).collect()
    assert len(got) == docs.count()
    counts = collections.Counter()
    for r in docs.where("doc_id <= 9").collect():
        counts.update([*(r.text or "").lower().split(), None])
    assert {r.train_tokens for r in got} == {sum(counts.values())}
    by = {r.doc_id: r for r in got}
    assert by[6].n_tokens == by[7].n_tokens == 1 and by[3].score > by[3].base_score
    assert lm_score.score(empty(docs), F.lit(True)).count() == 0


def test_fingerprints_order_any_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 8)
    ids = [-(1 << 62) - 5, (1 << 62) + 9, -(1 << 63), (1 << 63) - 1, None, None, *range(100), *[7] * 60]
    rows = [(k, passage(i, 12) if i % 5 else "") for i, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.with_next(df).select("doc_id", "text", "next_text").collect()
    dealt = fingerprint.in_ranges(df.withColumnRenamed("doc_id", "id")).groupBy("range").count().collect()
    assert len(dealt) > 10 and max(r["count"] for r in dealt) < 40
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in got) == sorted((k is not None, k or 0, t) for k, t in rows)
    single = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 7}
    order = sorted(single)
    for a, b in zip(order, order[1:], strict=False):
        if {a, b} & {6, 8} == set() and single[b].doc_id == b:
            assert single[a].next_text == single[b].text
    assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)


def test_fingerprint_columns_as_plain_python(spark):
    base = passage(5, 90)
    texts = {3: base, 9: base + " end", 20: "é" * 37 + " 😀 x", 21: "", 30: None, 44: passage(8, 400), 50: "ab"}
    spark_rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = fingerprint.with_next(spark_rows).withColumn("edited", fingerprint.edited_text(F.col("text"), F.col("next_text")))
    got = {r.doc_id: r for r in rows.select("doc_id", "edited", fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("like")).collect()}
    order = sorted(texts)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        x, y = texts[a] or "", texts[b] or ""
        cut = len(x) // 4
        assert got[a].edited == x[: len(x) - cut] + y[:cut]
    assert got[3].like > 0.8 and got[9].like == 0.0 and got[21].like == 1.0


def test_hot_keys_and_tables_too_large_to_broadcast_change_nothing(spark, docs, monkeypatch):
    shared = passage(40, 60)
    more = spark.createDataFrame([(100 + i, f"{passage(200 + i, 10)} {shared} {passage(300 + i, 12)}", i, "y") for i in range(25)] + [(200 + i, passage(7, 80) + f" tail{i % 3}", i, "z") for i in range(25)], docs.schema)
    both = docs.unionByName(more)
    rows = lambda df: sorted(map(repr, df.collect()))
    near, cut = rows(near_dedup.near_duplicates(both, width=2, percent=80)), rows(substring_dedup.dedup(both))
    for module, name, value in ((near_dedup, "BROADCAST_ROWS", 1), (substring_dedup, "HOT", 2), (substring_dedup, "SALTS", 4), (substring_dedup, "BROADCAST_ROWS", 1)):
        monkeypatch.setattr(module, name, value)
    assert rows(near_dedup.near_duplicates(both, width=2, percent=80)) == near and rows(substring_dedup.dedup(both)) == cut
