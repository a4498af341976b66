"""Threshold-scaled document sketches, with DataFrame functions only.

A sketch keeps every 64-bit hash of a text's distinct five-word shingles that lies below a fixed
fraction of the hash range, so sketches of parts merge by union and a short text's containment in a
much longer one can be told. A text with few hashes there also keeps its ``LEAST`` smallest ones
(all, if it has fewer); two sketches are compared below the lower of the limits up to which each is
complete. A text of one to four words is one shingle; a text without words has an empty sketch.

:func:`with_next` gives each document the one after it in ascending order without a global sort in
one task: rows are dealt into at most ``MOST_RANGES`` ranges of about equal size, whose bounds are approximate
quantiles of the ids (the only thing that is collected), so neither an outlying id nor a skewed order matters.
An id that fills several ranges (and so equals several bounds), and null ids, are split by a hash of the text. A window inside a range finds
the next row, and the first rows of the ranges, one row each, serve the ranges before them.

Edge cases: null texts count as empty; two empty sketches have likeness 1, an empty and a filled one 0;
rows are ordered by id, then a hash of the text, then text, so a repeated row follows itself; null ids come first; the only
row of a table follows itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.shared import fraction, lower_ascii, words_of

WIDTH = 5
#: One hash in FRACTION is kept.
FRACTION = 8
LEAST = 16
#: Rows of a range, unless that makes too many ranges.
RANGE_ROWS, MOST_RANGES = 1024, 4096
_LIMIT = -(1 << 63) + (1 << 64) // FRACTION
_TOP = (1 << 63) - 1


def with_sketch(df: DataFrame, text_col: str, out: str, width: int = WIDTH) -> DataFrame:
    """Adds ``out``: the ascending array of kept hashes of ``text_col``."""
    words, hashes = f"__w_{out}", f"__h_{out}"
    n = F.size(words)
    shingles = F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)))).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.expr("cast(array() as array<bigint>)"))
    low = F.array_distinct(F.filter(hashes, lambda h: h < _LIMIT))
    few = F.slice(F.array_sort(F.array_distinct(hashes)), 1, LEAST)
    df = df.withColumn(words, words_of(lower_ascii(F.col(text_col)))).withColumn(hashes, shingles).withColumn(out, low)
    return df.withColumn(out, F.when(F.size(out) >= LEAST, F.array_sort(out)).otherwise(few)).drop(words, hashes)


def _complete_to(sketch: Column) -> Column:
    return F.when(F.size(sketch) < LEAST, F.lit(_TOP)).otherwise(F.greatest(F.lit(_LIMIT - 1), F.element_at(sketch, -1)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    upto = F.least(_complete_to(a), _complete_to(b))
    x, y = F.filter(a, lambda h: h <= upto), F.filter(b, lambda h: h <= upto)
    both = F.size(F.filter(F.array_intersect(a, b), lambda h: h <= upto))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both.cast("double"), union), F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    upto = F.least(_complete_to(a), _complete_to(b))
    mine = F.size(F.filter(a, lambda h: h <= upto))
    both = F.size(F.filter(F.array_intersect(a, b), lambda h: h <= upto))
    return F.when(mine == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both.cast("double"), mine), F.lit(0.0)))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the union of two shingle sets."""
    both = F.array_sort(F.array_union(a, b))
    return F.filter(both, lambda h, i: (h < _LIMIT) | (i < LEAST))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _constant(longs: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")


def in_ranges(df: DataFrame) -> DataFrame:
    """Adds ``at`` (a hash of text from 0 to 1) and ``range`` to rows id, text: ranges ascend with (id, at), nulls first."""
    rows, nulls = df.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    n = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    found = df.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10 * max(n, 100))).first()[0] or [0]
    bounds = sorted(found)  # fewer than MOST_RANGES
    times, many = _constant([bounds.count(b) for b in bounds]), _constant(bounds)
    # the number of bounds below the id, by bisection
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda b, step: b + F.when((b + step <= len(bounds)) & (F.get(many, b + step - 1) < F.col("id")), step).otherwise(0))
    df = df.withColumn("at", fraction(F.col("text"))).withColumn("below", below)
    here = F.when(F.get(many, "below") == F.col("id"), F.get(times, "below")).otherwise(1)
    parts = -(-nulls * n // max(1, rows))
    return df.withColumn("range", F.when(F.col("id").isNull(), F.floor(F.col("at") * parts) - parts).otherwise(F.col("below") + F.floor(F.col("at") * here))).drop("below")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, text, sketch, next_text, next_sketch; the last row is followed by the first."""
    base = in_ranges(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    in_order = Window.partitionBy("range").orderBy(F.asc_nulls_first("id"), "at", "text")
    ahead = F.lead(F.struct("text", "sketch")).over(in_order)
    rows = with_sketch(base, "text", "sketch").withColumn("ahead", ahead)

    # the first row of each range is the least by (id, at, text), nulls being least
    firsts = base.groupBy("range").agg(F.min(F.struct("id", "at", "text")).alias("x")).select("range", "x.text")
    # at most MOST_RANGES numbers, twice that with nulls: each range that has rows, and the one after it
    ranges = base.select("range").distinct().withColumn("one", F.lit(0))
    ring = Window.partitionBy("one").orderBy("range")
    follow = ranges.select("range", F.coalesce(F.lead("range").over(ring), F.min("range").over(ring)).alias("after"))
    edges = with_sketch(firsts, "text", "sketch").select(F.col("range").alias("after"), F.struct("text", "sketch").alias("edge")).join(follow, "after").select("range", "edge")

    whole = rows.join(edges, "range", "left").withColumn("ahead", F.coalesce("ahead", "edge"))
    return whole.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "sketch", F.col("ahead.text").alias("next_text"), F.col("ahead.sketch").alias("next_sketch"))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` whose last quarter of code points is replaced by as many from the start of ``following``."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))
