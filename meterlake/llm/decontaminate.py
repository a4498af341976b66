"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed is three words of which the last is at most ``SPAN`` - 1 after the first, in each of the ten
layouts. Seeds of benchmark items are joined with seeds of documents; a hit names a document, an
item and the shift between their word positions, and hits are counted by shift. Of k words that agree among n at
one shift, at least (3k - n - 5) / 2 triples of neighbours lie within the span (their gaps add up to n - 1
at most), so shifts with fewer hits than the rule needs are left out and no other: a pair whose share is reached at
one shift is always found, whichever words were replaced. Each shift left is verified on the whole item, whose
words are compared with the document's there.

A document is contaminated by an item if at least ``SHARE`` of the item's words agree, and ``LEAST`` at
least (all, in a shorter item). Item positions are counted once over all of the pair's shifts at which
``PART`` words agree (so an inserted or dropped word loses no more than itself); such a part of
the item is found if seven of ten words in a row agree there.

Words are split at white space and lower-cased. Items of one or two words have one seed of
all their words, which documents make at every position if there are such items. A table of ``FILTER_LONGS`` * 64 bits,
whatever the benchmark's size, tells which words are surely in no item; these take part in no seed. The benchmark's
seeds are counted first and broadcast only up to ``BROADCAST_ROWS`` (three numbers a row); more are joined by a shuffle on the
seed, in which Spark splits hot seeds. The documents of the shifts left are picked in the same way, and only they are
read again. Words, positions and seeds are rows and array elements, not lambdas: all of it is compiled code.

Items and documents are told apart by id and text (items by a number each, documents by 128 bits), so ids may be null or
clash, as in merged benchmarks: every text is searched for, and every row that has one is found.

Edge cases: null and empty texts and items match nothing; an item or document row that is repeated, id and text, counts once; null ids
are reported as null; an empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import materialize

SPAN = 6
#: Places of a seed's second and third word.
LAYOUTS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
SHARE, LEAST, PART = 0.5, 8, 7
BROADCAST_ROWS = 500_000
#: Most numbers or characters in all of a broadcast table's arrays and texts together.
BROADCAST_SIZE = 16_000_000
#: Size of the table of words that items have.
FILTER_LONGS = 4096


def _words(text: Column) -> Column:
    """Array of the lower-cased words of a text; a single empty string if it has none."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")


def _place(h: Column) -> tuple[Column, Column]:
    """Element and bit of a hash in the word table."""
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_LONGS)).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def word_table(items: DataFrame) -> Column:
    """The table of the words in ``items`` (words: array), as a constant array of ``FILTER_LONGS`` longs."""
    element, bit = _place(F.col("h"))
    hashes = items.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("h")).select(element.alias("e"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    longs = {r.e: r.b for r in hashes.groupBy("e").agg(F.bit_or("b").alias("b")).collect()}  # FILTER_LONGS rows at most
    return F.split(F.lit(",".join(str(longs.get(i, 0)) for i in range(FILTER_LONGS))), ",").cast("array<bigint>")


def seeds(df: DataFrame, short: Sequence[int] = (), whole: bool = False, table: Column | None = None) -> DataFrame:
    """From rows (key, words: array of words): key, pos, seed.

    For each length in ``short`` also seeds of so many words; of texts of that length only, if ``whole``.
    Words that ``table`` does not have take part in no seed.
    """

    def known(h: str) -> Column:
        if table is None:
            return F.col(h).isNotNull()
        element, bit = _place(F.col(h))
        return F.getbit(F.get(table, element), bit) == 1

    each = df.select("key", "words", F.size("words").alias("n"), F.explode_outer(F.sequence(F.lit(0), F.size("words") - 1)).alias("pos"))
    each = each.withColumn("w0", F.xxhash64(F.get("words", "pos"))).where(known("w0"))
    ahead = [F.when(F.col("pos") + i < F.col("n"), F.xxhash64(F.get("words", F.col("pos") + i))).alias(f"h{i}") for i in range(1, SPAN)]
    each = each.select("key", "pos", "n", "w0", *ahead).select("key", "pos", "n", "w0", *[F.when(known(f"h{i}"), F.col(f"h{i}")).alias(f"w{i}") for i in range(1, SPAN)])

    def seed(*places: int, mark: int) -> Column:
        there = F.lit(True)
        for i in places:
            there &= F.col(f"w{i}").isNotNull()
        return F.when(there, F.xxhash64(*[f"w{i}" for i in places], F.lit(mark)))

    every = [seed(0, i, j, mark=i * SPAN + j) for i, j in LAYOUTS]
    every += [F.when((F.col("n") == k) if whole else F.lit(True), seed(*range(k), mark=-k)) for k in short]
    return each.select("key", "pos", F.explode_outer(F.array(*every)).alias("seed")).where("seed is not null")


def document_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text."""
    return F.struct(F.xxhash64(doc_id.isNull(), doc_id, text).alias("k1"), F.xxhash64(text, F.lit("document"), doc_id).alias("k2"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, share: float, least: int) -> DataFrame:
    """Rows key (see :func:`document_key`), id, item, item_words, matched."""
    given = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).where("t is not null").distinct()
    items = given.select("item", "t", _words(F.col("t")).alias("words")).where("words[0] <> ''").withColumn("n", F.size("words"))
    need = F.greatest(F.ceil(share * F.col("n")), F.least(F.lit(least), "n"))
    hits = F.greatest(F.least(F.ceil((3 * need - F.col("n") - 5) / 2), F.lit(3)), F.lit(1))
    # numbered once, when written
    items = materialize(items.select(F.monotonically_increasing_id().alias("nr"), "item", "words", "n", need.alias("need"), hits.cast("int").alias("hits"), F.length("t").cast("long").alias("size")))
    size = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    short = sorted(r.n for r in items.select("n").where("n < 3").distinct().collect())  # 1 and 2 at most
    item_seeds = materialize(seeds(items.select(F.struct("nr", "hits").alias("key"), "words"), short, whole=True).select("key.*", F.col("pos").alias("item_pos"), "seed"))
    small = item_seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(document_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    met = seeds(texts, short, table=word_table(items)).join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    met = met.groupBy("key", "nr", "hits", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count("*").alias("c")).where("c >= hits")

    shifts = materialize(met.groupBy("key", "nr").agg(F.collect_list("shift").alias("shifts")))
    rows, numbers = shifts.agg(F.count("*"), F.coalesce(F.sum(F.size("shifts")), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS and numbers <= BROADCAST_SIZE
    plain = items.select("nr", "item", "n", "need", F.col("words").alias("item_words"))
    found = texts.join(F.broadcast(shifts) if few else shifts, "key").join(F.broadcast(plain) if small and size <= BROADCAST_SIZE else plain, "nr")
    each = found.select("key", "id", "nr", "item", "n", "need", "words", "item_words", F.explode_outer("shifts").alias("shift")).select("*", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    at = F.col("j") + F.col("shift")
    agree = each.where((at >= 0) & (F.get("words", at) == F.get("item_words", "j")))
    of = ["key", "id", "nr", "item", "n", "need"]
    parts = agree.groupBy(*of, "shift").agg(F.collect_set("j").alias("js")).where(F.size("js") >= F.least(F.lit(PART), "n"))
    kept = parts.select(*of, F.explode("js").alias("j")).groupBy(*of).agg(F.count_distinct("j").cast("int").alias("matched")).where("matched >= need")
    return kept.select("key", "id", "item", F.col("n").alias("item_words"), "matched")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Rows id, item, item_words, matched: one for each document and item that it contains."""
    found = matches(docs, benchmark, id_col, text_col, item_col, item_text_col, share, least)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "item_words", "matched")


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` whose text no benchmark item contaminates, by id and text: ids may be null or clash."""
    found = matches(docs, benchmark, id_col, text_col, item_col, item_text_col, share, least)
    keyed = docs.withColumn("__key", document_key(F.col(id_col), F.col(text_col)))
    return keyed.join(found.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)
