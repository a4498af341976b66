"""The whole pipeline on a small fixture against plain Python."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ra", "lo", "ti", "mu")]


def passage(seed: int, n: int) -> list[str]:
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[(x >> 12) % len(WORDS)])
    return out


def fixture():
    shared, item = passage(70, 80), passage(90, 40)
    base = passage(1, 300)
    near = [*base[:150], "other", *base[151:]]
    docs = {
        1: base, 2: near, 3: base, 4: [*passage(4, 60), *shared, *passage(5, 30)], 5: [*passage(6, 45), *shared, *passage(7, 99)],
        6: [], 7: ["12", "!"], 8: [*passage(8, 50), *item, *passage(9, 50)], 9: passage(10, 2500), 10: passage(11, 3), 11: passage(11, 3),
        12: [*passage(12, 5), *shared, *passage(13, 300)], 13: shared,
    }
    return docs, item


def alike(x: list[str], y: list[str]) -> bool:
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x, y))
    return 100 * len(a & b) >= 80 * len(a | b)


def expected(docs: dict, item: list[str]) -> dict:
    docs = {k: w for k, w in docs.items() if any(c.isalpha() for x in w for c in x)}
    root = {k: k for k in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if alike(docs[a], docs[b]):
                    root[a] = root[b] = min(root[a], root[b])
    docs = {k: w for k, w in docs.items() if root[k] == k}
    first = {}
    for k in sorted(docs):
        for i in range(len(docs[k]) - 49):
            first.setdefault(tuple(docs[k][i : i + 50]), k)
    cut = {}
    for k, w in docs.items():
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < k for j in range(i, i + 50)}
        if len(gone) < len(w):
            cut[k] = [x for i, x in enumerate(w) if i not in gone]
    return {k: w for k, w in cut.items() if " ".join(item) not in " ".join(w)}


def test_pipeline_as_plain_python(spark, tmp_path):
    docs, item = fixture()
    rows = [(k, " ".join(w), ("en", "de")[k % 2], None, len(" ".join(w))) for k, w in docs.items()] + [(14, None, None, "web", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    sizes = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    bpe = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = expected(docs, item)
    assert set(want) == {1, 4, 5, 9, 10, 12}
    assert sizes == {k: len(bpe.encode(" ".join(w), add_special_tokens=False).ids) + 1 for k, w in want.items()}
    by = {}
    for r in got.collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_null_and_clashing_ids_lose_no_clean_document(spark, tmp_path):
    item = passage(90, 40)
    clean = [(None, passage(20, 60)), (None, passage(21, 70)), (5, passage(22, 80)), (5, passage(23, 90)), (6, passage(26, 60))]
    leaks = [(None, [*passage(24, 50), *item]), (6, [*passage(25, 50), *item])]
    rows = [(k, " ".join(w)) for k, w in [*clean, *leaks, (7, clean[2][1]), (None, clean[0][1])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
    left = corpus_pipeline.drop_leaks(spark, kept, str(tmp_path))
    low = lambda r: (r[0] or 0, r[1])
    assert sorted([tuple(r) for r in kept.collect()], key=low) == sorted([(k, " ".join(w)) for k, w in [*clean, *leaks]], key=low)
    assert sorted([tuple(r) for r in left.collect()], key=low) == sorted([(k, " ".join(w)) for k, w in clean], key=low)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
