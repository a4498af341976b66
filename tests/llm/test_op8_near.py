"""op8's tasks know the counts of the tokens after the head; only rarer ones meet theirs in a join."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meterlake.llm import lm_score


def test_frequent_tokens_are_not_joined(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j * j + j) % (3 + i)}" for j in range(30 + i)) + f" once{i}" for i in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, joined, write = [], [], lm_score.materialize

    def spy(table, *args):
        out = write(table, *args)
        if "times" in out.columns:
            joined.append(out.select(F.explode(F.arrays_zip("w", "cost")).alias("x")).where("isnan(x.cost)").count())
        return out

    monkeypatch.setattr(lm_score, "materialize", spy)
    for most in (0, 5, 1 << 19):
        monkeypatch.setattr(lm_score, "NEXT", most, raising=False)
        found.append({r.doc_id: r for r in lm_score.score(df, F.col("doc_id") < 20, head=4).collect()})
    assert joined[0] > joined[1] > joined[2] and joined[2] <= 4 * 8  # texts that training does not have may still ask
    for rows in found[1:]:
        for k, r in rows.items():
            assert r[:4] == found[0][k][:4] and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(r[4:], found[0][k][4:], strict=True))


def test_listed_hashes_are_found():
    h = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 500).astype(np.uint64))  # many share their first 4 bits
    order = np.random.default_rng(2).permutation(len(h))
    listed = lm_score.Listed(h[order], 4)
    assert listed.find(h[order]).tolist() == list(range(len(h))) and set(listed.find(h + np.uint64(1)).tolist()) <= {len(h)}
    assert lm_score.Listed(h[:0], 4).find(h).max() == 0


def test_counts_do_not_overflow():
    sums = lm_score.Sums(3)
    sums.add(np.array([1, 2, 2]))
    sums.counts[1], sums.size = (1 << 31) - 2, (1 << 31) - 2  # as after so many additions
    sums.add(np.array([1, 1, 0]))
    assert sums.total().tolist() == [1, 1 << 31, 2]


def test_words_split_in_small_pieces(monkeypatch):
    column = pa.array(["a bc", None, "d" * 50 + " e", "", "f g h", " i"])
    want = [(h.tolist(), starts.tolist()) for _, h, starts in lm_score.together(column)]
    for size in (0, 6, 20):
        monkeypatch.setattr(lm_score, "SPLIT", size)
        assert [(h.tolist(), starts.tolist()) for _, h, starts in lm_score.together(column)] == want
