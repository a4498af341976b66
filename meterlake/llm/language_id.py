"""Language identification by hierarchical discrimination.

A text is first put into a language family (one-versus-rest linear SVMs); inside the family,
one-versus-one linear SVMs tell its close relatives apart and vote by margin.

Features are hashed byte trigrams of the whole text (A-Z lower-cased), square-rooted and
scaled to unit length. The SVMs are fitted on ``SAMPLE_ROWS`` labelled rows at most (20 a language, if
there are more than 300), dealt evenly over the languages; rows are chosen by a hash of id and text below
their language's share, without a sort. Each classifier is fitted in its own
task. Only its weights (``DIMS + 1`` numbers) reach the driver and are broadcast. Every language in the labels can be predicted.

Edge cases: null, empty and letterless texts are ``und`` with score 0; texts of every length
are read whole; rows that repeat are answered each; with no labelled row everything is ``und``;
an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import fraction, release, tidy

#: Families of closely related languages; a language not listed is its own family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "sinitic": ["yue", "zh"],
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: Bound of the labelled sample.
SAMPLE_ROWS = 6000
DIMS = 4096
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def features(text: str | None) -> np.ndarray:
    a = np.frombuffer((text or "").encode().lower(), np.uint8).astype(np.uint32)
    x = np.zeros(DIMS, np.float32)
    if len(a) >= 3:
        code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        x = np.sqrt(np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)).astype(np.float32)
        x /= np.linalg.norm(x)
    return x


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 12) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; y is +1 or -1, the last column of x is 1."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diag = 1 / (2 * cost)
    q = np.einsum("ij,ij->i", x, x) + diag
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (x[i] @ w) - 1 + diag * alpha[i]) / q[i], 0) - alpha[i]
            if step:
                alpha[i] += step
                w += (step * y[i]) * x[i]
    return w


def fit(docs: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fit the classifiers on labelled rows of ``docs``; returns {"langs": [...], "weights": {name: array}}."""
    rows = docs.where(trainable) if trainable is not None else docs
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and lang <> 'und'")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "weights": {}}
    each = max(20, sample_rows // len(langs))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(1.0 if counts[lang] <= each else 1.1 * each / counts[lang]))])
    sample = rows.where(fraction(F.col("id"), F.col("text")) < share[F.col("lang")]).dropDuplicates(["id", "text", "lang"])

    jobs = {"family": langs} | {f"{a}|{b}": [a, b] for a, b in combinations(langs, 2) if family_of(a) == family_of(b)}
    names = {lang: sorted(k for k, v in jobs.items() if lang in v) for lang in langs}
    pairs = F.create_map(*[x for lang, v in names.items() for x in (F.lit(lang), F.array(*map(F.lit, v)))])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        release()
        job = group["job"].iloc[0]
        group = group.sort_values(["h", "id", "text"]).groupby("lang").head(each)
        x = np.ones((len(group), DIMS + 1), np.float32)
        for row, t in zip(x, group["text"], strict=True):
            row[:DIMS] = features(t)
        if job == "family":
            own = group["lang"].map(family_of).to_numpy()
            kinds = sorted(set(own))
            out = [(f"family:{k}", fit_svm(x, np.where(own == k, 1.0, -1.0)) if len(kinds) > 1 else np.append(np.zeros(DIMS), 1.0)) for k in kinds]
        else:
            out = [(job, fit_svm(x, np.where(group["lang"].to_numpy() == job.split("|")[0], 1.0, -1.0)))]
        return pd.DataFrame({"name": [n for n, _ in out], "w": [w.astype(np.float32).tolist() for _, w in out]})

    fitted = sample.withColumn("h", fraction(F.col("id"), F.col("text"))).withColumn("job", F.explode(pairs[F.col("lang")])).groupBy("job").applyInPandas(train, "name string, w array<float>")
    return {"langs": langs, "weights": {r.name: np.array(r.w, np.float32) for r in fitted.collect()}}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Per row: id, the columns named in ``keep``, and the language and score under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *[c for c in keep if c != id_col]]

    def one(text, families, weights, langs):
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = np.append(features(text), np.float32(1))
        margins = {f: float(x @ weights[f"family:{f}"]) for f in families}
        best = max(families, key=lambda f: (margins[f], f))
        rivals = [m for f, m in margins.items() if f != best]
        gap = (margins[best] - max(rivals)) / 2 if rivals else 1.0
        own = [lang for lang in langs if family_of(lang) == best]
        votes = dict.fromkeys(own, float("inf"))
        for a, b in combinations(own, 2):
            m = float(x @ weights[f"{a}|{b}"])
            votes[a], votes[b] = min(votes[a], m), min(votes[b], -m)
        pick = max(own, key=lambda k: (votes[k], k))
        return pick, float(1 / (1 + np.exp(-4 * min(gap, votes[pick]))))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with tidy():
            m = shared.value
            families = sorted({family_of(x) for x in m["langs"]})
            for texts in batches:
                yield pd.DataFrame([one(t, families, m["weights"], m["langs"]) if families else (UNKNOWN, 0.0) for t in texts], columns=["lang", "score"])

    found = F.pandas_udf(run, "lang string, score double").asNondeterministic()  # asked once a row, wherever it is used
    return docs.select(*columns, found(F.col(text_col)).alias("__found")).select(*columns, F.col("__found.lang").alias(names[0]), F.col("__found.score").alias(names[1]))
