"""Substring deduplication by recompression of word sequences.

Rounds give globally consistent names to runs and pairs of symbols: a symbol that its right neighbour
repeats takes a run name, then each symbol falls left or right by its name, and a left one followed by a
right one becomes their pair. Names are 64-bit hashes of what they stand for, so equal substrings get
equal interior symbols wherever they occur and no dictionary is exchanged. After ``ROUNDS`` rounds a
symbol stands for eight words at most, and only symbols within seven words of a repeat's beginning or
fourteen of its end depend on what surrounds it.

Every window of ``window`` words is filed under one of its inner symbols: the longest, the least hash
among equals. Equal windows are filed alike. Spark counts under which symbols several documents file
windows; only windows under these are named themselves (96 bits) and compared: a word is removed if a
window over it also starts in a document with a smaller id. Symbols that very many documents share are
compared in two steps, first within salted parts, so that no task gets all of a common passage.

Edge cases: null, empty and short texts lose nothing; repeats inside one document (and rows repeated
under one id) stay; a null id counts as smaller than all others; texts are read whole; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.shared import materialize, mix, rolling, tidy, word_hashes

WINDOW = 50
ROUNDS = 3
#: Words at a window's two ends whose symbols may depend on its surroundings.
LEFT, RIGHT = 2**ROUNDS - 1, 2 * (2**ROUNDS - 1)
#: A symbol in more documents than this is compared in salted parts.
HOT, SALTS = 1_000, 64
#: Ranges to remove are broadcast up to so many documents and numbers (about 10 MB), and joined by a shuffle beyond.
BROADCAST_ROWS, BROADCAST_NUMBERS = 200_000, 2_000_000


def symbols(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start (in words) and name of each symbol after all rounds over word hashes ``h``."""
    at = np.arange(len(h))
    for k in range(ROUNDS):
        if len(h) < 2:
            break
        h = h.copy()
        again = np.append(h[:-1] == h[1:], False)
        h[again] = mix(h[again] + np.uint64(0xA0761D6478BD642F))
        left = mix(h ^ np.uint64(k + 1)) >> np.uint64(63) == 0
        pair = np.append(left[:-1] & ~left[1:], False)
        second = np.concatenate(([False], pair[:-1]))
        h[pair] = mix(h[pair] * np.uint64(3) + h[np.flatnonzero(pair) + 1])
        h, at = h[~second], at[~second]
    return at, h


def filed_under(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of words, the symbol that it is filed under."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, names = symbols(h)
    ends = np.append(at[1:], len(h))
    rank = (((np.uint64(8) - (ends - at).astype(np.uint64)) << np.uint64(60)) | (mix(names) >> np.uint64(4))).astype(np.int64)
    first = np.searchsorted(at, np.arange(n) + LEFT)
    past = np.searchsorted(ends, np.arange(n) + window - RIGHT, "right")
    out, width = np.empty(n, np.int64), past - first
    table, size = rank, 1
    while size <= width.max():
        fits = (width >= size) & (width < 2 * size)
        out[fits] = np.minimum(table[first[fits]], table[past[fits] - size])
        table = np.minimum(table[:-size], table[size:]) if len(table) > size else table
        size *= 2
    return out


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with tidy():
        for b in batches:
            each = [np.unique(filed_under(word_hashes((text or "").encode())) & -2) for text in b["text"]]
            yield pd.DataFrame({"k": np.repeat(b["k"].to_numpy(), [len(x) for x in each]), "m": np.concatenate([*each, np.zeros(0, np.int64)])})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with tidy():
        for b in batches:
            for i in range(0, len(b), 200):
                parts = []
                for k, t, text, shared in b.iloc[i : i + 200][["k", "t", "text", "shared"]].itertuples(index=False):
                    h = word_hashes((text or "").encode())
                    under, shared = filed_under(h), np.sort(np.asarray(shared, np.int64))
                    # the lowest bit of a shared symbol says whether it is hot
                    place = np.minimum(np.searchsorted(shared >> 1, under >> 1), len(shared) - 1)
                    s = np.flatnonzero(shared[place] >> 1 == under >> 1)
                    salt = np.where(shared[place[s]] & 1, 1 + k % SALTS, 0)
                    check = rolling(mix(h + np.uint64(77)), WINDOW)[s] >> np.uint64(32)
                    parts.append(pd.DataFrame({"w": rolling(h, WINDOW)[s].view(np.int64), "c": check.astype(np.int64), "salt": salt, "k": k, "t": t, "s": s}))
                if parts:
                    yield pd.concat(parts)


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted starts as ranges: first and last start of each run, flat."""
    with tidy():
        for b in batches:
            out = []
            for starts in b["starts"]:
                s = np.unique(starts)
                edge = np.flatnonzero(np.diff(s) > 1)
                out.append(np.stack([s[np.append(0, edge + 1)], s[np.append(edge, len(s) - 1)]], axis=1).ravel())
            yield b[["k", "t"]].assign(ranges=out)


def repeats(keyed: DataFrame) -> DataFrame:
    """From rows k, t, text the rows k, t, ranges: first and last starts of windows that a smaller k has too."""
    long_enough = keyed.where(F.length("text") >= 2 * WINDOW - 1)
    anchors = materialize(long_enough.select("k", "text").mapInPandas(_anchors, "k long, m long"))
    common = anchors.groupBy("m").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("m", (F.col("n") > HOT).cast("long").alias("hot"))
    shared = anchors.join(common, "m").groupBy("k").agg(F.collect_set(F.col("m") + F.col("hot")).alias("shared"))
    rows = long_enough.join(shared, "k").select("k", "t", "text", "shared").mapInPandas(_windows, "w long, c long, salt long, k long, t long, s int")
    rows = rows.withColumn("lo", F.min("k").over(Window.partitionBy("w", "c", "salt")))
    # what is least in its salted part has still to meet the other parts' least; the others are settled
    meet = F.col("lo") == F.col("k")
    found = materialize(rows.where((F.col("lo") < F.col("k")) | (F.col("salt") > 0)).select("k", "t", "s", F.when(meet, F.col("w")).alias("w"), F.when(meet, F.col("c")).alias("c")))
    rest = found.where("w is not null").withColumn("lo", F.min("k").over(Window.partitionBy("w", "c"))).where("lo < k")
    hits = found.where("w is null").select("k", "t", "s").unionByName(rest.select("k", "t", "s"))
    return materialize(hits.groupBy("k", "t").agg(F.collect_list("s").alias("starts")).mapInPandas(_ranges, "k long, t long, ranges array<int>"))


def _keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    with tidy():
        for texts, removals in batches:
            out = []
            for text, ranges in zip(texts, removals, strict=True):
                parts = (text or "").encode().split()
                n, removed = len(parts), 0
                if ranges is not None and len(ranges):
                    first, last = np.asarray(ranges).reshape(-1, 2).T
                    edge = np.bincount(first, minlength=n + 1) - np.bincount(last + WINDOW, minlength=n + 1)
                    stays = np.cumsum(edge[:n]) == 0
                    removed = n - int(stays.sum())
                    parts = [parts[i] for i in np.flatnonzero(stays)]
                out.append((b" ".join(parts).decode(), n, removed))
            yield pd.DataFrame(out, columns=["kept", "words", "removed"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str, str] = ("kept_text", "n_words", "n_removed")) -> DataFrame:
    """Per row of ``docs``: id, the columns named in ``keep``, and under ``names`` the kept text (words joined by one space), its words before and those removed."""
    columns = [id_col, *[c for c in keep if c != id_col]]
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63)))
    rows, ids = docs.agg(F.count("*"), F.count_distinct(key)).first()
    # texts are told apart under one id only if ids repeat
    base = docs.select(*columns, F.col(text_col).alias("__text"), key.alias("__k"), (F.lit(0).cast("long") if rows == ids else F.xxhash64(text_col)).alias("__t"))
    ranges = repeats(base.select(F.col("__k").alias("k"), F.col("__t").alias("t"), F.col("__text").alias("text"))).select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("ranges").alias("__ranges"))
    documents, numbers = ranges.agg(F.count("*"), F.coalesce(F.sum(F.size("__ranges")), F.lit(0))).first()
    small = documents <= BROADCAST_ROWS and numbers <= BROADCAST_NUMBERS
    joined = base.join(F.broadcast(ranges) if small else ranges, ["__k", "__t"], "left")
    cut = F.pandas_udf(_keep, "kept string, words long, removed long").asNondeterministic()  # asked once a row, wherever it is used
    found = joined.select(*columns, cut("__text", "__ranges").alias("__cut"))
    return found.select(*columns, *[F.col(f"__cut.{c}").alias(n) for c, n in zip(("kept", "words", "removed"), names, strict=True)])
