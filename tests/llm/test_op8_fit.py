"""op8's weights and tables come from all training texts."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meterlake.llm import lm_score


def test_every_training_text_counts(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j * j + j) % (3 + i % 9)}" for j in range(30 + i)) for i in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = lambda n: {r.doc_id: r.score for r in lm_score.score(df.repartition(n), F.col("doc_id") < 20).collect()}
    want = scores(5)
    monkeypatch.setattr(lm_score, "SAMPLE_ROWS", 1)
    got = scores(2)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def test_a_gate_is_fitted_to_its_counts():
    a, b, c = (n.ravel() for n in np.meshgrid(np.arange(-16, 17), np.arange(-6, 7), np.arange(-6, 7), indexing="ij"))
    x = np.stack([a / 4, b / 2, c / 2])
    p = 1 / (1 + np.exp(-(np.array([0.8, 0.5, -0.3]) @ x + 0.2)))
    _, second, third = lm_score._LEVELS
    cell = ((((a + 32) * second + b + 16) * third + c + 16) * 16 + 7) * 2
    both = pd.DataFrame({"cell": np.concatenate([cell, cell + 1]), "c": np.rint(np.concatenate([1 - p, p]) * 1e6).astype(int)})
    r = lm_score._fit_gate(both.sample(frac=1, random_state=1)).iloc[0]
    assert r.gate == 7 and np.allclose(r.w, [0.8, 0.5, -0.3, 0.2], atol=0.01)
    # the mixed log-odds are right already: the table leaves them, where they occur
    assert np.abs(np.array(r.table) - lm_score._GRID)[8:25].max() < 0.05
