"""Conversation structure repair by weighted finite-state composition.

A conversation is an acceptor over its turns. An edit transducer keeps, reroles, deletes or inserts turns, at a
cost each; a grammar acceptor takes the initials of roles, ``(s?(ua)+)?``. Their composition is built lazily, one
turn's symbol at a time (at most three inserts-in-a-row states times four grammar states a turn; as many inserts
as never return to a grammar state), so it is acyclic in the order of turns and inserts. The shortest
path over weights (cost, label string), compared in that order, is found from the last turn to the first: arcs that leave
one state have different labels, so comparing costs, then labels, compares whole strings. Costs count
relative to the least of a turn, so turns with one symbol before one rest have one outcome, which is remembered.

Faults of a turn, of which the first counts: ``blank`` (no character outside 0x20 and 0x09-0x0D), ``duplicate``
(role and text seen earlier in the conversation), ``truncated`` (its last such character is none of ``.!?``).
Keep (K) costs 0, Rerole to user or assistant (R) 1, Delete (D) 2, Insert an empty user or assistant turn (I) 5;
blank and duplicate turns are deleted; truncated ones add 5 where they stay.

A conversation's turns are numbered by a window and hashed over the cluster by conversation. The path is found
from some 20 bytes a turn (no text), and its labels leave in blocks of ``BLOCK`` turns, which meet the turns again in one sorted
stream, so no task holds a conversation's texts. The label string of a conversation is one cell by definition;
a conversation with a third of all turns is numbered, searched and read by one task each, the latter as a stream.

Edge cases: nulls in role or text count as one space; null turns come first; turns that share a number are taken
by role, then text; repeated rows are duplicates; a null conversation id is a conversation; a role is told by its
first character, whatever follows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.shared import materialize, tidy

#: Grammar: state -> role initial -> state; 0 and 3 accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPT = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
MOST_INSERTS = 2
BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
_NEVER = 1 << 40
_LONG = (1 << 63) - 1
_SYMBOLS = "sua"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def numbered(conversations: DataFrame) -> DataFrame:
    """Columns conv, n (from 1), turn, role, text: the turns of each conversation in order."""
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.withColumn("n", F.row_number().over(order))


def coded(turns: DataFrame) -> DataFrame:
    """What the search needs of each turn: number, symbol of the role, faults that a turn has by itself, a 128-bit digest."""
    initial, last = F.substring("role", 1, 1), F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    symbol = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return turns.select("conv", "n", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("numbered"), symbol.cast("byte").alias("symbol"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("open"), F.xxhash64("role", "text").alias("d1"), F.xxhash64("text", F.lit("again"), "role").alias("d2"))


def edit_arcs(symbol: int, must: bool, cut: bool, inserted: int) -> list[tuple[str, int, str | None, int]]:
    """Arcs of the edit transducer for a turn: label, cost, initial that comes out (None: none), inserts in a row after it.

    An insert reads nothing; ``symbol`` -1 is the end, which can only be preceded by inserts.
    """
    arcs = [("I", INSERT, x, inserted + 1) for x in NAMES] if inserted < MOST_INSERTS else []
    if symbol < 0:
        return arcs
    stay = TRUNCATED if cut else 0
    if not must:
        arcs += [("K", KEEP + stay, _SYMBOLS[symbol : symbol + 1] or "?", 0), *[("R", REROLE + stay, x, 0) for x in NAMES]]
    return [*arcs, ("D", DELETE, None, 0)]


@lru_cache(maxsize=200_000)
def step(rest: tuple[int, ...], symbol: int, must: bool, cut: bool) -> tuple[tuple[int, ...], tuple[str, ...], int]:
    """The composition before one turn, given the least costs after it by grammar state.

    Least costs without inserts yet (relative to their least one), the label that each of the states (inserts, grammar) leaves by, and that least one.
    """
    cost, label = {}, {}
    for inserted in range(MOST_INSERTS, -1, -1):
        for g, arcs in enumerate(GRAMMAR):
            ways = [(0, "")] if symbol < 0 and g in ACCEPT else []
            for name, price, out, after in edit_arcs(symbol, must, cut, inserted):
                to = g if out is None else arcs.get(out)
                if to is not None:
                    ways.append((price + (cost[after, to] if name == "I" else rest[to]), name))
            cost[inserted, g], label[inserted, g] = min(ways, default=(_NEVER, ""))
    start = [cost[0, g] for g in range(len(GRAMMAR))]
    low = min(start)
    return tuple(min(c - low, _NEVER) for c in start), tuple(label[i, g] for i in range(MOST_INSERTS + 1) for g in range(len(GRAMMAR))), low


def follow(g: int, label: str, symbol: int) -> int:
    """The grammar's state after a label; of a rerole or an insert only one initial fits."""
    if label == "D":
        return g
    fit = GRAMMAR[g]
    return fit[_SYMBOLS[symbol]] if label == "K" else next(fit[x] for x in NAMES if x in fit)


def cheapest(symbols: np.ndarray, must: np.ndarray, cut: np.ndarray) -> tuple[int, list[str], list[int]]:
    """Cost, the labels at each turn (inserts before it included; those after the last in a last element), the grammar's state before each."""
    rest, levels, total = (0,) * len(GRAMMAR), [], 0
    for s, m, c in [(-1, False, False), *zip(symbols[::-1].tolist(), must[::-1].tolist(), cut[::-1].tolist(), strict=True)]:
        rest, label, low = step(rest, s, m, c)
        levels.append(label)
        total += low
    total += rest[0]
    out, states, g = [], [], 0
    for s, label in zip([*symbols.tolist(), -1], reversed(levels), strict=True):
        states.append(g)
        here, inserted = "", 0
        while (x := label[inserted * len(GRAMMAR) + g]) == "I":
            here, g, inserted = here + x, follow(g, x, s), inserted + 1
        out.append(here + x)
        g = follow(g, x, s) if x else g
    return total, out, states


def _repeated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))  # stable: of equal ones the first comes first
    a, b = a[order], b[order]
    out = np.zeros(len(a), bool)
    out[order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]] = True
    return out


def _searched(conv, col: dict[str, np.ndarray]) -> list[tuple]:
    """One conversation: a row for each block of turns, the first with the counts and the whole label string."""
    blank, turns = col["blank"], col["turn"][col["numbered"]]  # ascending
    again = _repeated(col["d1"], col["d2"]) & ~blank
    cut = col["open"] & ~blank & ~again
    pairs = [_SYMBOLS[x : x + 1] + _SYMBOLS[y : y + 1] for x, y in zip(col["symbol"][:-1].tolist(), col["symbol"][1:].tolist(), strict=True)]
    gaps = min(int(turns[-1]) - int(turns[0]) - int((turns[1:] != turns[:-1]).sum()), _LONG) if len(turns) else 0
    cost, labels, states = cheapest(col["symbol"], blank | again, cut)
    counts = [gaps, int(blank.sum()), int(again.sum()), int(cut.sum()), sum(p not in LEGAL for p in pairs), cost]
    n, out = len(blank), []
    for i in range(0, n, BLOCK):
        own = "".join(labels[i : i + BLOCK if i + BLOCK < n else None])
        out.append((conv, i + 1, states[i], own, *(counts if i == 0 else [None] * len(counts)), "".join(labels) if i == 0 else None))
    return out


def search(codes: DataFrame) -> DataFrame:
    """Blocks of edits; the first block of a conversation has its counts, cost and audit (all labels)."""
    kind = codes.schema["conv"].dataType.simpleString()
    names = ["conv", "n", "state", "edits", *_COUNTS, "audit"]
    fields = ["turn", "numbered", "symbol", "blank", "open", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            held, conv, id_type, found = [], None, None, []

            def flush() -> None:
                if held:
                    found.extend(_searched(conv, {f: np.concatenate([h[f] for h in held]) for f in fields}))
                    held.clear()

            def rows() -> pa.RecordBatch:
                cols = list(zip(*found, strict=True)) or [()] * len(names)
                kinds = [id_type, pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * len(_COUNTS), pa.string()]
                found.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

            for b in batches:
                id_type, ids = b.schema.field("conv").type, b.column("conv").to_pylist()
                data = {f: b.column(f).to_numpy(zero_copy_only=False) for f in fields}
                edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
                for a, z in zip(edges, edges[1:], strict=False):
                    if z > a:
                        if held and ids[a] != conv:
                            flush()
                        conv = ids[a]
                        held.append({f: x[a:z] for f, x in data.items()})
                if found:
                    yield rows()
            flush()
            if found:
                yield rows()

    sorted_codes = codes.repartition("conv").sortWithinPartitions("conv", "n")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return sorted_codes.mapInArrow(run, f"conv {kind}, n int, state int, edits string, {counts}, audit string")


def repaired(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv, place (from 1), role, text; each conversation lies in one partition, in order."""
    kind = turns.schema["conv"].dataType.simpleString()
    names = ["conv", "place", "role", "text"]
    edits = blocks.select("conv", "n", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "state", "edits")
    rows = turns.select("conv", "n", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            out, labels, at, g, place, conv = [], "", 0, 0, 0, None

            def put(role: str, text: str) -> None:
                nonlocal place
                place += 1
                out.append((conv, place, role, text))

            def inserts() -> None:
                nonlocal at, g
                while at < len(labels) and labels[at] == "I":
                    put(NAMES[next(x for x in NAMES if x in GRAMMAR[g])], "")
                    g, at = follow(g, "I", -1), at + 1

            def rows_of(kind_of_id: pa.DataType) -> pa.RecordBatch:
                cols = list(zip(*out, strict=True)) or [()] * 4
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind_of_id, pa.int64(), pa.string(), pa.string()), strict=True)], names)

            id_type = None
            for b in batches:
                id_type = b.schema.field("conv").type
                for own, n, is_turn, role, text, state, edits in zip(*[b.column(c).to_pylist() for c in ("conv", "n", "kind", "role", "text", "state", "edits")], strict=True):
                    if not is_turn:
                        inserts()  # what follows the last turn of the conversation before
                        if n == 1:
                            place, conv = 0, own
                        labels, at, g = edits, 0, state
                        continue
                    inserts()
                    x, at = labels[at], at + 1
                    symbol = _SYMBOLS.find(role[:1]) if role[:1] else -1
                    if x == "K":
                        put(role, text)
                    elif x == "R":
                        put(NAMES[next(i for i in NAMES if i in GRAMMAR[g])], text)
                    g = follow(g, x, symbol)
                if out:
                    yield rows_of(id_type)
            inserts()
            if out:
                yield rows_of(id_type)

    both = rows.unionByName(edits).repartition("conv").sortWithinPartitions("conv", "n", "kind")
    return both.mapInArrow(run, f"conv {kind}, place long, role string, text string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report (conv_id, counts, cost, audit) and the repaired turns (conv, place, role, text), ordered within partitions."""
    turns = materialize(numbered(conversations))
    blocks = materialize(search(coded(turns)))
    report = blocks.where("n = 1").select(F.col("conv").alias("conv_id"), *_COUNTS, "audit")
    return report, repaired(turns, blocks)


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines; reads what :func:`repaired` gives as it comes, a turn at a time."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, conv, id_type = None, None, None
        for b in batches:
            done, id_type = [], b.schema.field("conv").type
            for own, place, role, text in zip(*[b.column(c).to_pylist() for c in ("conv", "place", "role", "text")], strict=True):
                if place == 1:
                    if h:
                        done.append((conv, h.hexdigest()))
                    h, conv = hashlib.sha256(), own
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], id_type), pa.array([d[1] for d in done])], ["conv", "repaired_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([conv], id_type), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv {turns.schema['conv'].dataType.simpleString()}, repaired_sha256 string")
