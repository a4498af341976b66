"""Shortest-pack-first packing over the length histogram, with free cuts.

Documents are tokenized. What fills whole sequences leaves at once as sequences of its own; the rest of each document,
shorter than ``capacity``, is counted in a histogram of lengths, on which the packing is decided whatever the corpus' size: lengths
are placed longest first, each into the shortest packs (those with most room), and a pattern (a run of packs
that are alike) is split and counted anew as lengths join it. Since cuts are free, the packs are known beforehand: as
many of ``capacity`` as the tokens fill, and one for each power of two in what is left, which needs no padding. A length
that the shortest packs cannot hold is cut: its beginning fills them, its end goes back into the histogram as a shorter
length. So every pack ends full, and nothing is padded. An exact fit is preferred, so that fewer documents are cut.

The outcome is a list of runs: of the documents of one length those of some ranks have their tokens from
``start`` on, ``length`` of them, in the packs from ``first`` on, one each, at ``at``. Documents meet their
runs by rank. Ranks come from windows over (length, salt) and running counts of the salts; there are
more salts the more documents there are, so no window grows with the corpus.

Tokens of rests wait in a written table (two bytes each where the vocabulary allows), so that a text is tokenized once.

Edge cases: null and empty texts are the closing id alone; repeated rows are packed each; an empty
table packs to an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from meterlake.llm.packing import CachedBpe
from meterlake.llm.shared import materialize, tidy

CAPACITY = 1024
#: Rows that are ranked in one window, about.
RANKED = 100_000
_RUN = ["rest", "low", "high", "start", "length", "first", "at"]
_OUT = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_KINDS = ", ".join(f"{c} long" for c in _OUT)


def tokens(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """Whole sequences as they come out (negative numbers), and a row with ``rest`` ids for what is left of each document."""
    names = ["id", *_OUT, "rest", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            bpe, close = CachedBpe(tokenizer), end_id.to_bytes(4, "little")
            number = -1 - (TaskContext.get().partitionId() << 33)
            for b in batches:
                at, cols = [], [[] for _ in names[1:]]
                for i, text in enumerate(b.column("text")):
                    ids = bpe.encode(text.as_py() or "") + close
                    n = len(ids) // 4
                    for a in range(0, n - capacity + 1, capacity):
                        at.append(i)
                        for c, x in zip(cols, (a, capacity, zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n, number, 0, None, None), strict=True):
                            c.append(x)
                        number -= 1
                    if rest := n % capacity:
                        at.append(i)
                        left = np.frombuffer(ids, "<u4", offset=4 * (n - rest))
                        small = left.astype("<u2") if left.max() < 1 << 16 else left
                        for c, x in zip(cols, (n - rest, None, None, n, None, None, rest, small.tobytes()), strict=True):
                            c.append(x)
                kinds = [pa.int64()] * (len(names) - 2) + [pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names)
            del bpe

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_KINDS}, rest long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Runs (rest, low rank, high rank, start, length, first pack, offset) for a histogram of lengths below ``capacity``."""
    total = sum(n * length for length, n in counts.items())
    packs: dict[int, deque[tuple[int, int, int]]] = defaultdict(deque)  # room -> runs (first pack, packs, filled)
    rooms: list[int] = []
    left: dict[int, deque[tuple[int, int, int, int]]] = defaultdict(deque)  # length -> parts (rest, low, high, start)
    runs, pack = [], 0

    def leave(room: int, first: int, n: int, filled: int) -> None:
        if room and n:
            if not packs[room]:
                insort(rooms, room)
            packs[room].append((first, n, filled))

    for size, n in [(capacity, total // capacity), *((1 << b, total % capacity >> b & 1) for b in reversed(range(capacity.bit_length())))]:
        leave(size, pack, n, 0)
        pack += n
    for length, n in counts.items():
        left[length].append((length, 0, n, 0))
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            rest, low, high, start = left[length].popleft()
            k = bisect_left(rooms, length)
            room = length if k < len(rooms) and rooms[k] == length else rooms[-1]  # an exact fit, else the shortest packs
            first, n, filled = packs[room].popleft()
            if not packs[room]:
                rooms.pop(bisect_right(rooms, room) - 1)
            take, piece = min(n, high - low), min(length, room)
            runs.append((rest, low, low + take, start, piece, first, filled))
            leave(room - piece, first, take, filled + piece)
            leave(room, first + take, n - take, filled)
            if piece < length:
                left[length - piece].append((rest, low, low + take, start + piece))
            if low + take < high:
                left[length].appendleft((rest, low + take, high, start))
    return runs


def ranked(rests: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``rank`` among the rows of one length, and gives the histogram."""
    rows = rests.count()
    salts = max(16, -(-rows // RANKED))
    dealt = rests.withColumn("salt", F.pmod(F.xxhash64("id", "doc_tokens", "ids"), F.lit(salts)))
    by_salt = dealt.groupBy("rest", "salt").count()
    counts = {r.rest: r.n for r in by_salt.groupBy("rest").agg(F.sum("count").alias("n")).collect()}  # less than ``capacity`` rows
    before = by_salt.select("rest", "salt", (F.sum("count").over(Window.partitionBy("rest").orderBy("salt")) - F.col("count")).alias("before"))
    here = F.row_number().over(Window.partitionBy("rest", "salt").orderBy("id", "doc_tokens", "ids")) - 1
    return dealt.withColumn("rank", here).join(before, ["rest", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before"), counts


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    made = materialize(tokens(docs, capacity, id_col, text_col, tokenizer, end_id))
    rows, counts = ranked(made.where("rest is not null").select("id", "doc_tokens", F.col("start").alias("from"), "rest", "ids"))
    runs = spark.createDataFrame(plan(counts, capacity), StructType([StructField(n, LongType()) for n in _RUN]))
    placed = rows.join(F.broadcast(runs), "rest").where("rank >= low and rank < high")  # runs: bounded by the capacity
    wide = F.length("ids") > 2 * F.col("rest")
    width = F.when(wide, 4).otherwise(2)
    part = F.substring("ids", (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    # an id of two bytes is four with two zeros behind
    plain = F.when(wide, part).otherwise(F.unhex(F.regexp_replace(F.hex(part), "(.{4})", "$1" + "0000")))
    pieces = placed.select("id", (F.col("from") + F.col("start")).alias("start"), "length", F.crc32(plain).alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))
    return made.where("rest is null").select("id", *_OUT).unionByName(pieces).withColumnRenamed("id", id_col)
