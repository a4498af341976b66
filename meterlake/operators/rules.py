"""Validation, predicates and orders of usage rows.

Nothing is collected; a bad row is marked, split off or filtered by a column expression.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators.lifecycle import COUNTS, token_number

#: Kinds of requests that are no usage.
NOT_USAGE = ("model_list", "provider_test", "probe")
QUALITIES = ("exact", "partial", "estimated")


#: Trace texts of an item, and what an item without a value has.
TRACES = ("raw_source_ref", "provider_version", "parser_version", "source_fingerprint")
DEFAULTS = {"hour": 0, "source_quality": "unknown"}


def public_item(events: DataFrame, columns: list[str], longest: int = 160) -> DataFrame:
    """Only the named columns: tokens as whole numbers and their total made anew, traces trimmed and cut to ``longest``, defaults where nothing is.

    A parser without a version has the provider's.
    """
    present = [c for c in columns if c in events.columns]
    out = {c: token_number(F.col(c)) for c in COUNTS if c in present}
    total = sum((out[c] for c in COUNTS if c in out and c != "reasoning_tokens"), F.lit(0).cast("long"))
    for c in TRACES:
        if c in present:
            value = F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("provider_version")) if c == "parser_version" and "provider_version" in events.columns else F.col(c)
            out[c] = F.substring(F.trim(F.coalesce(value, F.lit(""))), 1, longest)
    out |= {c: F.coalesce(F.nullif(F.col(c), F.lit("")) if isinstance(x, str) else F.col(c), F.lit(x)) for c, x in DEFAULTS.items() if c in present}
    out["total_tokens"] = total
    return events.select(*[out.get(c, F.col(c)).alias(c) for c in [*present, *(["total_tokens"] if "total_tokens" not in present else [])]])


def problems(required: list[str]) -> Column:
    """What is wrong with an item, as an array of short names; empty if nothing is."""
    missing = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"no_{c}")) for c in required]
    rules = [
        F.when(~F.coalesce(F.col("day").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "bad_day"),
        F.when(~F.col("source_quality").isin(*QUALITIES), "bad_quality"),
        F.when(F.coalesce("total_tokens", F.lit(-1)) < 0, "bad_total"),
    ]
    return F.filter(F.array(*missing, *rules), lambda x: x.isNotNull())


def split_valid(items: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted items, and rejected ones with their problems."""
    marked = items.withColumn("problems", problems(required))
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def forbidden_fields(schema: T.StructType, names: set[str], path: str = "") -> list[str]:
    """Paths of fields at any depth whose name is forbidden, whatever its case."""
    found = []
    for f in schema.fields:
        here = f"{path}{f.name}"
        found += [here] if f.name.lower() in {n.lower() for n in names} else []
        kind = f.dataType
        while isinstance(kind, T.ArrayType | T.MapType):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            found += forbidden_fields(kind, names, f"{here}.")
    return found


def snapshot_status(snapshots: DataFrame, items: DataFrame, scope: list[str], key: str | None = None) -> DataFrame:
    """Whether each snapshot may be taken: ok, or the first of bad_day, bad_hour, no_provider, no_fingerprint, empty, bad_count, bad_total, bad_items.

    Items belong to a snapshot by ``key``, or by the scope itself; an item of another scope makes a snapshot bad_items. A total only has to be
    a number of 0 or more, as the items say what counts.
    """
    on = [key] if key else scope
    said = snapshots.select(*on, *[F.col(c).alias(f"__{c}") for c in scope if c not in on], *[c for c in ("row_count", "total_tokens", "fingerprint") if c in snapshots.columns])
    own = F.lit(True)
    for c in scope:
        if c not in on:
            own = own & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = said.join(items.select(*dict.fromkeys([*on, *scope]), F.lit(1).alias("__item")), on, "left")
    counted = joined.groupBy(*said.columns).agg(F.count("__item").alias("__items"), F.count_if(F.col("__item").isNotNull() & ~own).alias("__others"))
    at = {c: F.col(c if c in on else f"__{c}") for c in scope}
    status = F.when(~F.coalesce(at["day"].cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "bad_day")
    if "hour" in scope:
        status = status.when(~F.coalesce(at["hour"].between(0, 23), F.lit(False)), "bad_hour")
    if "provider_id" in scope:
        status = status.when(F.coalesce(at["provider_id"], F.lit("")) == "", "no_provider")
    if "fingerprint" in snapshots.columns:
        status = status.when(F.coalesce("fingerprint", F.lit("")) == "", "no_fingerprint")
    status = status.when(F.col("row_count") == 0, "empty").when(F.coalesce("row_count", F.lit(-1)) != F.col("__items"), "bad_count")
    status = status.when(F.coalesce("total_tokens", F.lit(-1)) < 0, "bad_total").when(F.col("__others") > 0, "bad_items").otherwise("ok")
    return counted.select(*([key] if key else []), *[c.alias(n) for n, c in at.items()], status.alias("status"))


def workdir_identity(candidate: Column, participant: Column) -> tuple[Column, Column]:
    """Digest of a work folder and its participant, and the folder's name.

    A path has forward slashes, none at its end and lower case in the digest; its name is its last part, or ``root``. Of ``virtual:a:b`` the
    name is ``b`` and the digest takes it as it is. Without a folder both are those of ``unknown``: there is no folder to stand in for it.
    """
    given = F.coalesce(candidate, F.lit(""))
    virtual = given.startswith("virtual:")
    path = F.regexp_replace(F.translate(given, "\\", "/"), r"/+$", "")
    last = F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))
    name = F.when(given == "", "unknown").when(virtual, F.element_at(F.split(given, ":"), -1)).otherwise(F.coalesce(last, F.lit("root")))
    hashed = F.when(given == "", "unknown").when(virtual, given).otherwise(F.lower(path))
    return F.sha2(F.concat(hashed, F.lit(":"), participant.cast("string")), 256), name


def folder_of_uri(uri: Column) -> Column:
    """The folder of a ``file://`` address, its percent signs decoded (a plus is a plus); any other text as it is."""
    path = F.regexp_replace(F.regexp_replace(uri, "^file://(localhost)?", ""), r"^/([A-Za-z]:)", "$1")
    return F.when(uri.startswith("file://"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(uri)


def with_alias(rows: DataFrame, aliases: DataFrame, key: str, name: str) -> DataFrame:
    """``name`` replaced by its alias where one is given for ``key``."""
    return rows.join(aliases.select(key, F.col("alias").alias("__alias")), key, "left").withColumn(name, F.coalesce("__alias", name)).drop("__alias")


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def local_hour(ts: Column, zone: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def in_scope(usage: DataFrame, days: tuple[date, date] | None = None, **equal) -> DataFrame:
    """Rows of some days and of given values of columns; None restricts nothing, a list allows several."""
    out = usage if days is None else usage.where(F.col("day").between(F.lit(days[0]), F.lit(days[1])))
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name).isin(*value) if isinstance(value, list | tuple) else F.col(name) == F.lit(value))
    return out


def containing(usage: DataFrame, **parts: str) -> DataFrame:
    """Rows whose columns contain the given text, whatever its case; % and _ stand for themselves."""
    for name, part in parts.items():
        if part:
            usage = usage.where(F.contains(F.lower(F.col(name)), F.lit(part.lower())))
    return usage


def not_ahead(usage: DataFrame, today: date) -> DataFrame:
    """Without days that a wrong clock puts in the future."""
    return usage.where(F.col("day") <= F.lit(today))


def countable(requests: DataFrame, kind: str = "kind") -> DataFrame:
    return requests.where(~F.coalesce(F.col(kind), F.lit("")).isin(*NOT_USAGE) & (F.coalesce("total_tokens", F.lit(0)) > 0))


def newest_days(usage: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` newest days that occur; the days are picked first, so no row is sorted."""
    days = usage.select("day").distinct().orderBy(F.desc("day")).limit(n)
    return usage.join(F.broadcast(days), "day", "left_semi")


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """A limit from outside, within its bounds."""
    return max(low, min(high, default if value is None else int(value)))
