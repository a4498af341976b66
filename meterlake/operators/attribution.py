"""Attributions that stay: the first folder found for a source counts, whatever is found later.

The state is a table of key, session_id, workdir and last_seen; it is kept between two marks by last use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond the first number of entries only the most recently used ones, as many as the second, stay.
MOST, KEEP = 20_000, 10_000
STATE = "key string, session_id string, workdir string, last_seen timestamp"


def pinned(state: DataFrame, found: DataFrame, now, most: int | None = MOST, keep: int = KEEP) -> tuple[DataFrame, DataFrame]:
    """Attributions of the sources of ``found`` (key, session_id, workdir: what is found now), and the state after it.

    A pinned entry with a folder counts and is used now; a source without one counts as it is found, and is pinned if it has a folder.
    Of several rows of a key the least is taken. Over the upper mark the most recently used entries stay (of equals the lesser key); with ``most`` None all stay.
    """
    one = found.groupBy("key").agg(F.min(F.struct("session_id", "workdir")).alias("f"))
    both = one.join(state.select("key", F.struct("session_id", "workdir").alias("s"), "last_seen"), "key", "full")
    has = F.coalesce(F.col("s.workdir"), F.lit("")) != ""
    seen = F.col("f").isNotNull()
    both = both.select("key", seen.alias("seen"), F.when(has, F.col("s")).otherwise(F.coalesce("f", "s")).alias("a"), F.when(seen, F.lit(now).cast("timestamp")).otherwise(F.col("last_seen")).alias("last_seen"), F.col("s").isNotNull().alias("known"))
    both = both.checkpoint()  # the state may be read from the table that it is written to
    entries = both.where("known or coalesce(a.workdir, '') <> ''").select("key", "a.session_id", "a.workdir", "last_seen")
    if most is not None and entries.limit(most + 1).count() > most:
        entries = entries.orderBy(F.desc("last_seen"), "key").limit(keep)
    return both.where("seen").select("key", "a.session_id", "a.workdir"), entries
