"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document is the set of its distinct word shingles. Documents with equal sets are put together first.
A signature has ``SYMBOLS`` MinHash values of 16 bits; all documents of which at most
``DISTANCE`` differ are candidates. By pigeonhole, cut into ``CHUNKS`` > DISTANCE / 2 chunks, such a pair has
a chunk with one error at most; each chunk is filed once for each place the error may be in, so every pair
within the distance meets under a key. At a similarity of 0.8 more than DISTANCE symbols differ in
about 2.8 of a million pairs (binomial tail).

Keys are shared by whole groups of copies, whose pairs are never all written. In each round the members of a
key meet only a pivot, candidates are confirmed on the full sets, and links become components. From then
on only keys whose members are still in different components go on, with a new pivot in each of ``ROUNDS`` rounds.
What is left is compared exhaustively, but under rare shingles instead of keys: the shingles of every open
document are put in one order, rarest first, and a pair that is similar enough has its first common shingle
so early in both sets that enough shingles follow for the overlap it needs. Pairs across components that meet
there are compared; this loses no pair that shares a key.
Nothing is capped.

Edge cases: null, empty and wordless texts have an empty set and no link; fewer words than a shingle are one
shingle; a null id counts as the least; rows repeated under one id are one document with the
first text (in order); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import connected_components, materialize, mix, rolling, tidy, word_hashes

SYMBOLS, DISTANCE = 120, 45
CHUNKS = DISTANCE // 2 + 1
ROUNDS = 1
#: So many candidate documents at most (an id and 16 bytes each) are broadcast to pick their texts.
BROADCAST_ROWS = 200_000
_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_BOUNDS = np.linspace(0, SYMBOLS, CHUNKS + 1).astype(int)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles (A-Z lower-cased)."""
    h = word_hashes((text or "").encode().lower())
    if 0 < len(h) < width:
        return mix(rolling(h, len(h)) + np.uint64(len(h)))
    return np.unique(rolling(h, width))


def signature(s: np.ndarray) -> bytes:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        least = np.minimum(least, (s[i : i + 4096] * _FACTORS[:, None]).min(axis=1))
    return (mix(least) >> np.uint64(48)).astype(np.uint16).tobytes()


def keys(signatures: np.ndarray) -> np.ndarray:
    """For each row of symbols, its SYMBOLS keys: every chunk without one of its symbols."""
    wide = signatures.astype(np.uint64)
    out = []
    for c, (a, z) in enumerate(zip(_BOUNDS, _BOUNDS[1:], strict=False)):
        for drop in range(a, z):
            key = np.full(len(wide), (c << 8) | (drop - a), np.uint64)
            for i in range(a, z):
                if i != drop:
                    key = mix(key * np.uint64(31) + wide[:, i])
            out.append(key)
    return np.stack(out, axis=1)


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tidy():
            for b in batches:
                sets = [shingles(t, width) for t in b["text"]]
                yield pd.DataFrame({"id": b["id"], "n": [len(s) for s in sets], "digest": [hashlib.md5(s.tobytes()).digest() for s in sets], "sig": [signature(s) if len(s) else b"" for s in sets]})

    return run


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with tidy():
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                k = keys(np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(-1, SYMBOLS)).view(np.int64)
                yield pd.DataFrame({"key": k.ravel(), "id": np.repeat(part["id"].to_numpy(), SYMBOLS), "n": np.repeat(part["n"].to_numpy(), SYMBOLS)})


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tidy():
            for b in batches:
                sets = [shingles(t, width) for t in b["text"]]
                own = [hashlib.md5(s.tobytes()).digest() == d for s, d in zip(sets, b["digest"], strict=True)]
                yield pd.DataFrame({"id": b["id"], "items": [s.view(np.int64) for s in sets]})[own]

    return run


class _Search:
    def __init__(self, texts: DataFrame, reps: DataFrame, width: int, percent: int):
        self.texts, self.reps, self.width, self.percent = texts, reps, width, percent

    def sets(self, wanted: DataFrame) -> DataFrame:
        """id, items: the shingle sets of the ids in ``wanted``, one row each, however often and wherever an id's row repeats."""
        wanted = materialize(self.reps.select("id", "digest").join(wanted, "id", "left_semi"))
        few = wanted.count() <= BROADCAST_ROWS
        texts = self.texts.join(F.broadcast(wanted) if few else wanted, "id").select("id", "text", "digest")
        return materialize(texts.mapInPandas(_sets(self.width), "id long, items array<long>").dropDuplicates(["id"]))

    def links(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Of distinct pairs (a, b, na, nb) those whose sets (made here if not given) are alike."""
        p = self.percent
        sized = pairs.where(f"100 * least(na, nb) >= {p} * greatest(na, nb)").select("a", "b", "na", "nb")
        if sets is None:
            sets = self.sets(sized.selectExpr("a as id").union(sized.selectExpr("b as id")).distinct())
        both = sized.join(sets.selectExpr("id as a", "items as xa"), "a").join(sets.selectExpr("id as b", "items as xb"), "b")
        common = F.size(F.array_intersect("xa", "xb"))
        return materialize(both.withColumn("c", common).where(f"100 * c >= {p} * (na + nb - c)").select("a", "b"))


def _rooted(filed: DataFrame, roots: DataFrame) -> DataFrame:
    return filed.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))


def _several(rooted: DataFrame) -> DataFrame:
    """Keys whose members are in several components, and their smallest set."""
    return rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("n").alias("least_n")).where("x < y").select("key", "least_n")


def _meeting(documents: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, na, nb) of different components (root) that can be ``percent`` alike.

    ``documents`` has id, n, root and least_n, the size of the smallest set to compare with; ``sets`` their shingles.
    A common shingle with ``after`` shingles from it on, in the common order, allows an overlap of ``after`` if it is
    the first one; alike sets of ``x`` and ``y`` need percent * (x + y) / (100 + percent).
    """

    def enough(after: str, size: str, other: str) -> str:
        return f"{100 + percent} * {after} >= {percent} * ({size} + {other})"

    each = sets.select("id", F.explode("items").alias("s"))
    ordered = each.join(each.groupBy("s").agg(F.count("*").alias("c")), "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("x"))
    spread = ordered.join(documents, "id").select("id", "n", "root", "least_n", F.posexplode("x").alias("at", "y"))
    first = spread.selectExpr("*", "n - at as after").where(f"y.c > 1 and {enough('after', 'n', 'least_n')}")
    first = materialize(first.select("id", "n", "root", "after", "y.s"))
    # of each shingle's holders those outside its largest component meet all others: no pair of one component is formed twice
    sizes = first.groupBy("s", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("several")).where("several > 1").select("s", "most")
    held = first.join(largest, "s")
    few = held.where("root <> most").select("s", F.struct("id", "n", "root", "after").alias("p"))
    pairs = held.join(few, "s").where(f"root <> p.root and (root = most or id < p.id) and {enough('least(after, p.after)', 'n', 'p.n')}")
    return pairs.selectExpr("least(id, p.id) as a", "greatest(id, p.id) as b", "if(id < p.id, n, p.n) as na", "if(id < p.id, p.n, n) as nb").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id of ``docs``: id, n_shingles, component_id (least id it is linked to, over any number of links)."""
    low = -(1 << 63)
    texts = docs.select(F.coalesce(F.col(id_col), F.lit(low)).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = texts.mapInPandas(_sketch(width), "id long, n long, digest binary, sig binary")
    sketched = materialize(sketched.groupBy("id").agg(F.min(F.struct("digest", "n", "sig")).alias("x")).select("id", "x.*"))
    classes = sketched.where("n > 0").groupBy("digest", "n").agg(F.min("id").alias("rep"))
    members = materialize(sketched.where("n > 0").select("id", "digest", "n").join(classes, ["digest", "n"]).select("id", "rep"))
    reps = materialize(sketched.join(members.where("id = rep").select("id"), "id", "left_semi").select("id", "n", "sig", "digest"))
    search = _Search(texts, reps, width, percent)

    filed = reps.select("id", "n", "sig").mapInPandas(_keyed, "key long, id long, n long")
    pivots = filed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("key", "p")
    tested = materialize(filed.join(pivots, "key").where("id <> p.id").selectExpr("p.id as a", "id as b", "p.n as na", "n as nb").distinct())
    links = search.links(tested)

    roots = connected_components(links)
    open_keys = filed.join(pivots.select("key"), "key", "left_semi")
    for step in range(ROUNDS):
        rooted = _rooted(open_keys, roots)
        open_keys = materialize(rooted.join(_several(rooted).select("key"), "key"))
        pivot = open_keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key", F.lit(step)), F.struct("id", "n", "root").alias("p"))).alias("x")).select("key", "x.p")
        pairs = open_keys.join(pivot, "key").where("root <> p.root")
        pairs = pairs.selectExpr("least(id, p.id) as a", "greatest(id, p.id) as b", "if(id < p.id, n, p.n) as na", "if(id < p.id, p.n, n) as nb")
        pairs = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        links = links.unionByName(search.links(pairs))
        tested = tested.select("a", "b").unionByName(pairs.select("a", "b"))
        roots = connected_components(links)
        open_keys = open_keys.drop("root")
    rooted = _rooted(open_keys, roots)
    left = rooted.join(_several(rooted), "key").groupBy("id", "n", "root").agg(F.min("least_n").alias("least_n"))
    left = materialize(left)
    sets = search.sets(left)
    pairs = _meeting(left, sets, percent)
    pairs = materialize(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    roots = connected_components(links.unionByName(search.links(pairs, sets)))
    known = members.join(roots, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("root", "rep").alias("component"))
    out = sketched.select("id", "n").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    real = lambda c: F.when(F.col(c) != low, F.col(c))
    return out.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
