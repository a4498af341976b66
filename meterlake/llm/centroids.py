"""Clustering around centroids: Lloyd's rounds with Hamerly's bounds, exact in whole numbers.

Vectors become whole numbers, so distances are exact. Beside each vector two bounds are kept: an upper one on
the distance to its own centroid and a lower one on the distance to the second nearest. When centroids move,
the upper bound grows by the drift of the own centroid, the lower one shrinks by the largest drift of the
others. A vector whose upper bound is below its lower one, or below half the way from its centroid to the
next centroid, keeps its centroid unseen. Of the others the upper bound is made exact first; those that are
still ambiguous are compared with every centroid. Bounds are doubles that are rounded outwards, so that a tie
is never decided by them.

Each round is one pass that writes vectors, centroids' numbers and bounds to the shared folder (the table
before it is deleted), without a shuffle; then vectors that changed their centroid are summed by the pair of old and new
one, map-side first. The driver holds the centroids and these sums, k * k * dim numbers at most. The rounds
end early where no vector moves, since nothing would change after that.

Edge cases: vectors that are null, have another length, or a null or non-finite component are left out;
components beyond +-2^27 count as that (a squared distance then fits a long), and sums of distances beyond a
long as its largest value; repeated rows and ids are rows of their own; a null id has no hash and is taken as a
first centroid last; equal vectors may be two centroids, of which the smaller number gets all; with fewer
vectors than k there are as many centroids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import discard, materialize, new_path, tidy

DIM = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"
#: Components are held within this, so that a squared distance of up to 64 of them fits a long.
REACH = 1 << 27
_HAIR = 2.0**-48
_LONG = (1 << 63) - 1
_STATE = "id {id}, v array<int>, cluster int, was int, upper double, lower double, scanned boolean"


def _up(x):
    return x + np.abs(x) * _HAIR


def _down(x):
    return x - np.abs(x) * _HAIR


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Columns id and v: the vectors that count, as whole numbers floor(scale * x)."""
    x = F.col(vector_col)
    good = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c: Column) -> Column:
        return F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.floor(c.cast("double") * float(scale)))).cast("int")

    return vectors.where(good).select(F.col(id_col).alias("id"), F.transform(x, whole).alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k vectors whose ids' hashes are least, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in first], np.int64)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    away = v - c
    return np.einsum("ij,ij->i", away, away)


def nearest(v: np.ndarray, centroids: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's centroid, its two bounds, and whether all centroids were compared; ``own`` is -1 where nothing is known."""
    k, own, upper, lower = len(centroids), own.copy(), upper.copy(), lower.copy()
    between = np.array([[_down(np.sqrt(float(((a - b) ** 2).sum()))) / 2 if i != j else np.inf for j, b in enumerate(centroids)] for i, a in enumerate(centroids)])
    half = between.min(axis=1)
    known = own >= 0
    sure = np.where(known, np.maximum(lower, half[own]), -np.inf)
    loose = np.flatnonzero(known & (upper >= sure))
    upper[loose] = _up(np.sqrt(_squares(v[loose], centroids[own[loose]]).astype(np.float64)))
    scan = ~known | (upper >= sure)
    at = np.flatnonzero(scan)
    if len(at):
        far = np.stack([_squares(v[at], c) for c in centroids], axis=1)
        own[at] = far.argmin(axis=1)  # of equal ones the first
        two = np.sort(far, axis=1)[:, :2].astype(np.float64)
        upper[at] = _up(np.sqrt(two[:, 0]))
        lower[at] = _down(np.sqrt(two[:, 1])) if k > 1 else np.inf
    return own, upper, lower, scan


def loosened(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after the centroids moved by ``drift`` (rounded up)."""
    most = int(drift.argmax())
    others = np.delete(drift, most)
    rest = np.where(own == most, others.max() if len(others) else 0.0, drift[most])
    return _up(upper + drift[own]), _down(lower - rest)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def assign(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None = None) -> DataFrame:
    """One round: ``state`` is what the round before gave, or id and v alone."""
    dim = centroids.shape[1]
    names = ["id", "v", "cluster", "was", "upper", "lower", "scanned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            for b in batches:
                v, n = _matrix(b.column("v"), dim), b.num_rows
                if drift is None:
                    was, upper, lower = np.full(n, -1), np.full(n, np.inf), np.full(n, -np.inf)
                else:
                    was, upper, lower = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                    upper, lower = loosened(was, upper, lower, drift)
                own, upper, lower, scan = nearest(v, centroids, was, upper, lower)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(own, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scan)], names)

    return state.mapInArrow(run, _STATE.format(id=state.schema["id"].dataType.simpleString()))


def distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Columns id, cluster and the exact squared distance to its centroid."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            for b in batches:
                own = b.column("cluster").to_numpy(zero_copy_only=False)
                far = _squares(_matrix(b.column("v"), dim), centroids[own])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cluster"), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    return state.mapInArrow(run, f"id {state.schema['id'].dataType.simpleString()}, cluster int, distance long")


def moves(state: DataFrame, dim: int) -> list:
    """For each pair of an old and a new centroid the number and the sum of the vectors that changed: k * (k + 1) rows at most."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dim)]
    return state.where("cluster <> was").groupBy("was", "cluster").agg(F.count("*").alias("n"), *sums).collect()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance) and the final centroids."""
    spark, rows = vectors.sparkSession, whole_vectors(vectors, id_col, vector_col, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    sums, counts = np.zeros(centroids.shape, object), [0] * len(centroids)
    state, drift, path = rows, None, None
    for _ in range(rounds + 1):
        before, path = path, new_path(spark)
        state = materialize(assign(state, centroids, drift), path)
        if before:
            discard(spark, before)
        if _ == rounds:
            break
        moved = moves(state, dim)
        for r in moved:
            shift = np.array([r[f"s{i}"] for i in range(dim)], object)
            sums[r.cluster] += shift
            counts[r.cluster] += r.n
            if r.was >= 0:
                sums[r.was] -= shift
                counts[r.was] -= r.n
        after = np.array([[int(s) // n for s in total] if n else list(c) for total, n, c in zip(sums, counts, centroids, strict=True)], np.int64)
        if not moved or (after == centroids).all():
            break
        drift = _up(np.sqrt(((after - centroids).astype(object) ** 2).sum(axis=1).astype(np.float64)))
        centroids = after
    found = materialize(distances(state, centroids))
    discard(spark, path)
    return found.select(F.col("id").alias(id_col), "cluster", "distance"), centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the sums of distances of the cluster and of all, and a digest of the centroid."""
    spark = found.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(total.alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centroids]
    rows = [(i, min(s, _LONG), min(sum(by.values()), _LONG), digest[i]) for i, s in sorted(by.items())]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster")
