"""Usage events told of by several logs: events that share any identity are one event.

Events and identities make a graph whose connected parts are found by contraction: in each round every node goes to
that neighbour, or itself, whose hash is least in this round, and links between merged nodes become links of
the next, smaller graph. The hashes change from round to round, so a chain of any length and order shrinks by
a constant share each time. Each round is a written table; no part passes through the driver, and a key that
very many events share is first reduced to a star by a map-side minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """node and root for every node of ``links`` (a, b: long); two nodes have one root if a path joins them. Nulls link nothing."""
    edges = links.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a <> b").distinct().checkpoint()
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        if len(steps) == MOST_ROUNDS:
            raise RuntimeError("the links did not contract")

        def rank(node: str, turn: int = len(steps)):
            return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("h"), F.col(node).cast("long").alias("n"))

        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("parent")).checkpoint()
        at_a, at_b = step.selectExpr("node as a", "parent as pa"), step.selectExpr("node as b", "parent as pb")
        edges = edges.join(at_a, "a").join(at_b, "b").where("pa <> pb").selectExpr("least(pa, pb) as a", "greatest(pa, pb) as b").distinct().checkpoint()
        steps.append(step)
    if not steps:
        return edges.selectExpr("a as node", "b as root")
    roots = steps.pop().withColumnRenamed("parent", "root")
    for step in reversed(steps):  # from the smallest graph back to the first
        above = roots.selectExpr("node as parent", "root")
        roots = step.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots


def same_events(events: DataFrame, identities: str = "identities", order: str = "event_id") -> DataFrame:
    """``order`` (unique, long) and ``part``: the same for events that share an identity, directly or through others. Empty and null identities join nothing."""
    keyed = events.select(order, F.explode(F.array_distinct(identities)).alias("key")).where("key <> ''")
    first = keyed.groupBy("key").agg(F.min(order).alias("a"))
    found = components(keyed.join(first, "key").select("a", F.col(order).alias("b")))
    return events.select(order).join(found.withColumnRenamed("node", order), order, "left").select(order, F.coalesce("root", order).alias("part"))


def merged_events(events: DataFrame, first: list[str], most: list[str], identities: str = "identities", order: str = "event_id", output: str = "output_tokens", reasoning: str = "reasoning_tokens", total: str = "total_output_tokens") -> DataFrame:
    """One row for each set of equal events: columns ``first`` of its first event, the largest value of each of ``most``.

    The total output of several events is at least their largest output and reasoning together.
    """
    labelled = events.join(same_events(events, identities, order), order)
    merged = labelled.groupBy("part").agg(F.min(order).alias(f"__{order}"), F.count("*").alias("events"), *[F.min_by(c, order).alias(c) for c in first], *[F.max(c).alias(f"__{c}") for c in most])
    values = {c: F.col(f"__{c}") for c in most}
    if total in most:
        whole = F.coalesce(values[output], F.lit(0)) + F.coalesce(values[reasoning], F.lit(0))
        values[total] = F.when(F.col("events") > 1, F.greatest(values[total], whole)).otherwise(values[total])
    return merged.select(F.col(f"__{order}").alias(order), "events", *first, *[v.alias(c) for c, v in values.items()])
