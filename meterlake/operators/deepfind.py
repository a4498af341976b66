"""Values at any depth of JSON texts, found level by level inside each row.

A row carries what is open at its level: nested values with the way that led to them (positions, keys in byte order). One step opens
them all; as many steps are made as the text has brackets, those after its depth with nothing open. Rows are neither
exploded nor shuffled nor written: a text is parsed once, and what nests deeper or is wider costs its own row alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators.lifecycle import token_number

_NODES = "array<struct<path: array<int>, name: string, value: variant>>"


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT and so on; a JSON null is VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.transform(F.array(value), f)[0]


def _children(names: list[str], node: Column, ends_at_empty: bool) -> Column:
    """The entries of an object in the order of their keys, or an array's (name null), with their paths; nothing of other values. With ``ends_at_empty`` an object's entries before the first named empty text."""
    order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    entries = F.array_sort(F.map_entries(F.try_variant_get(node["value"], "$", "map<string, variant>")), order)
    if ends_at_empty:
        empty = lambda e: e["key"].isin(names) & (F.try_variant_get(e["value"], "$", "string") == "") & (_kind(e["value"]) == "STRING")
        at = lambda es: F.array_position(F.transform(es, lambda e: F.coalesce(empty(e), F.lit(False))), True).cast("int")
        entries = _let(entries, lambda es: _let(at(es), lambda n: F.when(n > 0, F.slice(es, F.lit(1), n - 1)).otherwise(es)))
    nodes = lambda found, name, value: F.transform(found, lambda e, i: F.struct(F.concat(node["path"], F.array(i)).alias("path"), name(e).alias("name"), value(e).alias("value")))
    items = nodes(F.try_variant_get(node["value"], "$", "array<variant>"), lambda e: F.lit(None).cast("string"), lambda e: e)
    return F.coalesce(nodes(entries, lambda e: e["key"], lambda e: e["value"]), items, F.array().cast(_NODES))


def _walk(json: str, names: list[str], ends_at_empty: bool, first: Column, add: Callable[[Column, Column], Column], goes_on: Callable[[Column, Column], Column]) -> Column:
    """The last of the values that begin with ``first`` and that ``add`` makes of it and each level's nodes; nodes for which ``goes_on``, given the value, are opened further."""
    root = F.try_parse_json(json)
    start = F.when(root.isNotNull(), F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"), root.alias("value"))).cast(_NODES)).otherwise(F.array().cast(_NODES))
    brackets = F.length(json) - F.length(F.translate(F.col(json), "{[", ""))

    def step(state: Column, _: Column) -> Column:
        level = F.flatten(F.transform(state["open"], lambda n: _children(names, n, ends_at_empty)))
        found = lambda nodes: _let(add(state["found"], nodes), lambda f: F.struct(F.filter(nodes, lambda n: goes_on(f, n)).alias("open"), f.alias("found")))
        return F.when(F.size(state["open"]) > 0, _let(level, found)).otherwise(state)

    steps = F.when(F.coalesce(brackets, F.lit(0)) > 0, F.sequence(F.lit(1), brackets)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(start.alias("open"), first.alias("found")), step)["found"]


def _is(node: Column, names: list[str], kinds: list[str]) -> Column:
    return F.when(F.coalesce(node["name"].isin(names), F.lit(False)), _kind(node["value"]).isin(kinds)).otherwise(False)


def deep_string(rows: DataFrame, key: str, json: str, names: list[str]) -> DataFrame:
    """``key`` and the first text (by the order of keys, entries of an object before what follows it) under one of the names; "" without any.

    An empty text under a name ends the search in its own object. Texts that are no JSON have nothing.
    """

    def add(best: Column, nodes: Column) -> Column:
        texts = F.transform(F.filter(nodes, lambda n: _is(n, names, ["STRING"])), lambda n: F.struct(n["path"].alias("path"), F.try_variant_get(n["value"], "$", "string").alias("text")))
        return F.least(best, F.array_min(texts))

    first = F.lit(None).cast("struct<path: array<int>, text: string>")
    found = _walk(json, names, True, first, add, lambda best, n: best.isNull() | (n["path"] < best["path"]))
    return rows.select(key, F.coalesce(found["text"], F.lit("")).alias("text"))


def deep_number(rows: DataFrame, key: str, json: str, names: list[str]) -> DataFrame:
    """``key`` and the sum of the numbers under the names, as a whole number of 0 or more; what lies below a named entry does not count."""
    kinds = ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"]
    numbers = lambda nodes: F.transform(F.filter(nodes, lambda n: _is(n, names, kinds)), lambda n: F.try_variant_get(n["value"], "$", "double"))
    add = lambda total, nodes: F.aggregate(numbers(nodes), total, lambda a, b: a + b)
    found = _walk(json, names, False, F.lit(0.0), add, lambda total, n: ~F.coalesce(n["name"].isin(names), F.lit(False)))
    return rows.select(key, token_number(found).alias("number"))
