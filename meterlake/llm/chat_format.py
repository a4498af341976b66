"""Chat formatting into budgeted windows, with DataFrame functions only.

A turn is written ``[INST]role[/INST]text</s>``; a window begins with ``<s>``. Inside roles and
texts a backslash is doubled and each control string gets a backslash after its first character, so
no control string is left in them and dropping each escaping backslash gives the text back.

A turn's tokens are counted as a quarter of its formatted characters, rounded up. A window has room for
``budget`` tokens less the system turn's and the history's allowance. Prefix sums of the tokens choose turn-aligned spans:
a turn of more than half the room is a span of its own; between such turns, a turn belongs to the span, half the room
wide, that its first token falls in. A window thus never exceeds its budget, but for a single turn that does not fit in
the room: it is never cut, and gets no history. Each
window repeats the system turn (a first turn whose role is ``system``) and the last turns of the window before it
that fit in ``history`` tokens; repeated turns are masked: only texts of assistant turns that are new
in a window are in its loss spans (offset and length in code points).

All windows and sums are keyed by the conversation: one shuffle. A conversation is one output group by
contract; its turns are sorted by Spark, not gathered to be sorted.

Edge cases: null texts and roles are empty; turns that repeat are kept, ordered by turn, role and text;
a null conversation id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template's control strings.
START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
BUDGET, HISTORY = 2048, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"(<)(/?s>)|(\[)(/?INST\])", r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(formatted: Column) -> Column:
    return F.ceil(F.length(formatted) / 4)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows conv, window, formatted, repeated (count of leading repeated turns), loss (array of at, length)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    turns = turns.withColumn("body", escape(F.col("text"))).withColumn("head", head).withColumn("cost", tokens(F.concat("head", "body", F.lit(END))))
    in_order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    so_far, whole = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = turns.withColumn("i", F.row_number().over(in_order)).withColumn("upto", F.sum("cost").over(so_far))
    system = F.when((F.col("i") == 1) & (F.col("role") == "system"), F.struct("head", "body", "cost"))
    turns = turns.withColumn("system", F.first(system, ignorenulls=True).over(whole))
    room = F.greatest(F.lit(2), budget - history - F.coalesce(F.col("system.cost"), F.lit(0)))
    # the system turn is counted apart, so it does not make its window's span larger
    new = F.when((F.col("i") == 1) & F.col("system").isNotNull(), 0).otherwise(F.col("cost"))
    turns = turns.withColumn("room", room).withColumn("new", new).withColumn("large", (2 * F.col("new") > F.col("room")).cast("int"))
    turns = turns.withColumn("part", 2 * F.sum("large").over(so_far) - F.col("large"))
    before = F.sum("new").over(Window.partitionBy("conv", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("new")
    turns = turns.withColumn("span", F.when(F.col("large") == 1, F.lit(0)).otherwise(F.floor(2 * before / F.col("room"))))
    turns = turns.withColumn("window", F.dense_rank().over(Window.partitionBy("conv").orderBy("part", "span")))
    # a turn recurs in the next window if all from it to the end of its own window fit in the history, and that window has room for it
    own = Window.partitionBy("conv", "window")
    turns = turns.withColumn("last", F.max("upto").over(own)).withColumn("filled", F.sum("new").over(own))
    following = F.max("filled").over(Window.partitionBy("conv").orderBy("window").rangeBetween(1, 1))
    recurs = (F.col("last") - F.col("upto") + F.col("cost") <= history) & (following <= F.col("room")) & ~((F.col("i") == 1) & F.col("system").isNotNull())
    turns = turns.withColumn("into", F.when(recurs, F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("again")), F.struct((F.col("window") + 1).alias("w"), F.lit(True).alias("again")))).otherwise(F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("again")))))
    rows = turns.select("conv", "i", "head", "body", "role", "system", F.explode("into").alias("x")).select("conv", F.col("x.w").alias("window"), "i", F.col("x.again").alias("again"), "head", "body", "role", "system")
    grouped = rows.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("i", "again", "head", "body", "role"))).alias("items"), F.first("system").alias("system"))
    lead = F.when(F.col("system").isNotNull() & (F.col("window") > 1), F.array(F.struct(F.lit(0).alias("i"), F.lit(True).alias("again"), F.col("system.head").alias("head"), F.col("system.body").alias("body"), F.lit("system").alias("role"))))
    grouped = grouped.withColumn("items", F.concat(F.coalesce(lead, F.expr("slice(items, 1, 0)")), "items"))
    formatted = F.concat(F.lit(START), F.array_join(F.transform("items", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""))
    # one pass over the items: the position so far, and the spans of new assistant texts
    fold = F.aggregate(
        "items",
        F.struct(F.lit(len(START)).alias("at"), F.expr("cast(array() as array<struct<at:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when((t["role"] == "assistant") & ~t["again"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("at"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return grouped.select("conv", "window", formatted.alias("formatted"), F.size(F.filter("items", lambda t: t["again"])).alias("repeated"), fold.alias("loss"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digest of the output of :func:`windows`, parsed from the formatted text and its loss spans alone."""
    turns = F.slice(F.split(F.substring("formatted", len(START) + 1, 2**31 - 1), END), 1, F.size(F.split("formatted", END)) - 1)
    turns = F.slice(turns, F.col("repeated") + 1, F.greatest(F.size(turns) - F.col("repeated"), F.lit(0)))

    def plain(t: Column) -> Column:
        cut = F.instr(t, CLOSE)
        role, text = F.substring(t, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1), F.substring(t, cut + len(CLOSE), F.length(t))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    parsed = formatted.select(
        "conv", "window", F.length("formatted").cast("long").alias("chars"), F.size(turns).cast("long").alias("turns"), F.array_join(F.transform(turns, plain), "").alias("plain"), F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["at"] + 1, s["length"]))), "").alias("lost")
    )
    whole = parsed.groupBy("conv").agg(F.sum("turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "plain", "lost"))).alias("parts"))
    lost = F.array_join(F.col("parts.lost"), "")
    return whole.select(F.col("conv").alias(id_col), "n_turns", F.sha2(F.array_join(F.col("parts.plain"), ""), 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")
