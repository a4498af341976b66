"""Helpers that several corpus operators use.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. ``bytes.split()`` and
``bytes.lower()`` follow exactly these rules (lower() touches A-Z only), and so does the
vectorised form below, which hashes every word of a text with a handful of numpy passes.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base


def release() -> None:
    """Give memory that earlier work left in this Python worker back: workers live on from stage to stage."""
    import pyarrow as pa

    _powers.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


@contextmanager
def tidy() -> Iterator[None]:
    """Around a task's work in Python: releases memory before and after."""
    release()
    try:
        yield
    finally:
        release()


def fraction(*columns: Column) -> Column:
    """A hash of ``columns`` as a number from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(1 << 53)


def new_path(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/meterlake-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """Array of words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit hash of a row's id and text, so that rows with null or clashing ids are told apart."""
    return F.xxhash64(doc_id.isNull(), doc_id, text)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply), elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words of ``data``."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edges = np.concatenate(([0], edges))
    if not gap[-1]:
        edges = np.concatenate((edges, [len(data)]))
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of ``data`` (prefix sums of a polynomial modulo 2^64, then mixed)."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every ``width`` consecutive elements of ``h``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width <= 8:
        out = h[:n].copy()
        for i in range(1, width):
            out = mix(out * np.uint64(3) + h[i : n + i])
        return out
    up, down = _powers_up_to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Label every node of ``edges`` (a, b: long) with the least node it reaches: columns node, root.

    Alternates large-star and small-star steps; each round is one written table, so no
    link and no component passes through the driver. A node without edges has no row.
    """
    current = materialize(edges.selectExpr("greatest(a, b) as hi", "least(a, b) as lo").where("hi <> lo").distinct())
    for _ in range(max_rounds):
        both = current.selectExpr("hi as n", "lo as m").unionByName(current.selectExpr("lo as n", "hi as m"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
        large = both.where("m > n").join(least, "n").selectExpr("m as hi", "r as lo")
        down = large.where("hi <> lo").distinct()
        low = down.groupBy("hi").agg(F.min("lo").alias("r"))
        small = down.join(low, "hi").selectExpr("lo as hi", "r as lo").unionByName(low.selectExpr("hi", "r as lo"))
        after = materialize(small.where("hi <> lo").distinct())
        # done when no node is both somebody's root and somebody's child, and each child has one root
        stats = after.groupBy("hi").agg(F.count("*").alias("c"))
        several = stats.where("c > 1").limit(1).count()
        chained = after.select("lo").distinct().join(after.selectExpr("hi as lo").distinct(), "lo", "left_semi").limit(1).count()
        current = after
        if not several and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return current.selectExpr("hi as node", "lo as root").unionByName(roots)
