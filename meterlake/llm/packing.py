"""Best-fit packing of token sequences with large-item matching.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens (only documents that
are longer are cut; their first piece takes the remainder). Pieces of one length are alike, so the
packing is decided on the histogram of lengths, which has at most ``capacity`` rows whatever the
corpus: pieces above a third of the capacity meet at most in pairs and are matched greedily, the
longest first, each with the longest that still fits; shorter pieces then go, longest first, to
the smallest gap that holds them. The outcome is a list of runs (length, first and last rank,
first bin, pieces a bin, offset); a piece finds its bin by its rank among the pieces of its
length. Ranks come from windows over (length, salt) and running counts of the salts, so that a
length that a third of all pieces have is still spread over many tasks.

Edge cases: null and empty texts are one piece (the closing id alone); repeated rows are packed
each; an empty table packs to an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from meterlake.llm.shared import materialize, tidy

CAPACITY = 2048
#: Salts that a length's pieces are dealt over before they are ranked.
SALTS = 128
_ODD_CUT = re.compile(r"\s |^ ")
_SPECIAL = "<|endoftext|>"


class CachedBpe:
    """Byte-level BPE ids as little-endian 32-bit bytes, remembered by word.

    The tokenizer never joins a non-space with a space after it, so a text may be cut before each
    single space that follows a non-space and its parts may be looked up one by one. Texts with
    other white space before a space go to the tokenizer whole. ``limit`` bounds the memory.
    """

    def __init__(self, name: str = "byte_bpe_50k", limit: int = 300_000):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file, self.exact, self.limit = public_tokenizers.path(f"{name}.json"), None, limit

        fast, pack = self.fast, self.pack

        class Cache(dict):  # holds no reference to its owner, so that both go when the task ends
            def __missing__(cache, part: str) -> bytes:
                found = cache[part] = pack(fast.encode_ordinary(" " + part))
                return found

        self.cache = Cache()

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.file)
            return self.pack(self.exact.encode(text, add_special_tokens=False).ids)
        if _ODD_CUT.search(text):
            return self.pack(self.fast.encode_ordinary(text))
        if len(self.cache) > self.limit:
            self.cache.clear()
        first, *rest = text.split(" ")
        return b"".join(chain((self.pack(self.fast.encode_ordinary(first)),), map(self.cache.__getitem__, rest)))


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length and crc32 of its ids."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    close = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tidy():
            bpe = CachedBpe(tokenizer)
            for b in batches:
                out = []
                for key, text in zip(b[id_col], b["__text"], strict=True):
                    ids = bpe.encode(text or "") + close
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    out += [(key, i, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pd.DataFrame(out, columns=[id_col, "piece", "start", "length", "ids_crc32"])
            del bpe

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInPandas(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, low rank, high rank, first bin, pieces a bin, offset in the bin) for a histogram."""
    left, done, runs, bins = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first bin, bins)]
    order: list[int] = []  # gaps in use, ascending

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, done[length], done[length] + n, first, each, offset))
        done[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in left if 3 * x > capacity)
    for x in reversed(large):
        while left[x]:
            k = bisect_left(large, capacity - x + 1) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == x else 1):
                k -= 1
            if k < 0:
                leave(capacity - x, bins, n := left[x])
                place(x, n, bins, 1, 0)
            else:
                y = large[k]
                n = left[x] // 2 if y == x else min(left[x], left[y])
                place(x, n, bins, 1, 0)
                place(y, n, bins, 1, x)
                leave(capacity - x - y, bins, n)
            bins += n
    for x in sorted((x for x in left if 0 < 3 * x <= capacity), reverse=True):
        while left[x]:
            k = bisect_left(order, x)
            if k == len(order):  # nothing holds it: open bins for all that is left
                each = capacity // x
                first, n, gap = bins, -(-left[x] // each), capacity
                bins += n
            else:
                gap = order[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
                each = gap // x
            full = min(n, left[x] // each)
            if full:
                place(x, full * each, first, each, capacity - gap)
                leave(gap - each * x, first, full)
            if full < n:
                rest = left[x]
                if rest:
                    place(x, rest, first + full, rest, capacity - gap)
                    leave(gap - rest * x, first + full, 1)
                    full += 1
                leave(gap, first + full, n - full)
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to the rows of :func:`pieces`."""
    spark = cut.sparkSession
    dealt = materialize(cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(SALTS))))
    by_salt = dealt.groupBy("length", "salt").count()
    counts = {r.length: r.n for r in by_salt.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    before = by_salt.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).select("length", "salt", "before")
    runs = spark.createDataFrame(plan(counts, capacity), StructType([StructField(n, LongType()) for n in ("length", "low", "high", "first_bin", "each", "at")]))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.col(id_col), "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("r", rank).join(before, ["length", "salt"]).withColumn("r", F.col("r") + F.col("before"))
    step = F.col("r") - F.col("low")
    placed = ranked.join(F.broadcast(runs), ["length"]).where("r >= low and r < high")
    return placed.select(*cut.columns, (F.col("first_bin") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("at") + (step % F.col("each")) * F.col("length")).alias("offset"))
