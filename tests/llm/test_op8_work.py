"""op8 reads texts side by side: as it would read each alone, and without work for texts that have ended."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meterlake.llm import lm_score
from meterlake.llm.shared import word_hashes


def model_of(h):
    hashes, seen = np.unique(h, return_counts=True)
    coder, rng = lm_score.Coder(hashes[:-5], lm_score.huffman(np.append(seen[:-5], 9)), 10), np.random.default_rng(3)
    n0, n1 = ([rng.integers(0, 50, 1 << 10) for _ in range(3)] for _ in range(2))
    return lm_score.Model(coder, n0, n1)


def put_together(sizes):
    rng = np.random.default_rng(7)
    h = (rng.integers(1, 60, sum(sizes)) ** 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h, np.append(0, np.cumsum(sizes)[:-1])


def test_texts_that_ended_are_not_worked_on(monkeypatch):
    h, starts = put_together([20] * 150 + [20_000] + [20] * 150)
    model, bins, count = model_of(h), [], np.bincount

    def spy(x, weights=None, minlength=0):
        bins.append(minlength)
        return count(x, weights, minlength)

    monkeypatch.setattr(np, "bincount", spy)
    model.log10(h, model.coder.symbols(h), starts)
    # two passes over the weights and tables of all texts are more than enough: all but one end in the second segment
    assert sum(bins) < 2 * len(starts) * (5 * 16 + 2 * 16 * len(lm_score._GRID))


def test_side_by_side_as_alone():
    sizes = [1, 700, 16, 17, 1, 48, 49, 496, 497, 3000, 15, 1008, 1009, 2]
    h, starts = put_together(sizes)
    model = model_of(h)
    got = model.log10(h, model.coder.symbols(h), starts)
    for a, n in zip(starts, sizes, strict=True):
        own = h[a : a + n]
        assert np.allclose(got[a : a + n], model.log10(own, model.coder.symbols(own), np.array([0])), rtol=1e-5, atol=1e-6)


def test_tokens_do_not_cross_texts(monkeypatch):
    texts = ["ab", "cd ef", None, "", " x ", "\t\n", "É Ab\x0bC\x00d\x1fe", "ab", "", "long " * 300, "Z", None, ""]
    for column in (pa.array(texts), pa.array(["no", *texts])[1:], pa.array(texts, pa.large_string())):
        for size, most in ((1 << 18, 1000), (7, 1000), (1 << 18, 2), (0, 1)):
            monkeypatch.setattr(lm_score, "TOGETHER", size)
            monkeypatch.setattr(lm_score, "MOST_TEXTS", most)
            got = [None] * len(texts)
            for places, h, starts in lm_score.together(column):
                got[places] = np.split(h, starts[1:])
            for t, h in zip(texts, got, strict=True):
                assert h.tolist() == [*word_hashes((t or "").encode().lower()).tolist(), int(lm_score.END)]
    assert not list(lm_score.together(pa.array([], pa.string()))) and [len(h) for _, h, _ in lm_score.together(pa.array([None, ""], pa.string()))] == [1, 1]


def test_sums_as_counted_at_once():
    sums, rng = lm_score.Sums(10), np.random.default_rng(5)
    parts = [rng.integers(0, 10, n) for n in (0, 3, 45, 20, 1, 7)]
    for x in parts:
        sums.add(x)
    assert sums.total().tolist() == np.bincount(np.concatenate(parts), minlength=10).tolist()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in lm_score.score(df, F.lit(False)).collect()} == {1: (3, 0, 0), 2: (1, 0, 0)}
