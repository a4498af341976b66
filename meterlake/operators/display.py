"""Strings and labels derived from figures: compositions, formats, identities, versions, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.operators.analytics import ratio

KINDS = [("in", ("input_tokens",)), ("out", ("output_tokens",)), ("cache", ("cache_read_tokens", "cache_write_tokens")), ("reasoning", ("reasoning_tokens",))]


def contribution_text(value: Column, total: Column) -> Column:
    """A share in percent with one decimal; nothing is ``0.0%``, very little ``<0.1%``."""
    share = F.try_divide(value.cast("double"), total.cast("double")) * 100
    shown = F.when(share < 0.1, "<0.1%").otherwise(F.concat(F.round(share, 1).cast("decimal(20,1)").cast("string"), F.lit("%")))
    return F.when((value > 0) & (total > 0), shown).otherwise("0.0%")


def composition_text(total: str = "total_tokens") -> Column:
    """Whole percents of the kinds of tokens that occur."""
    parts = []
    for name, cols in KINDS:
        tokens = sum(F.coalesce(F.col(c), F.lit(0)) for c in cols)
        whole = F.floor(ratio(tokens, F.col(total), 12) * 100 + 0.5).cast("int").cast("string")
        parts.append(F.when(tokens > 0, F.concat(F.lit(f"{name} "), whole, F.lit("%"))))
    return F.when(F.coalesce(F.col(total), F.lit(0)) == 0, "none").otherwise(F.concat_ws(" · ", *parts))


def compact(tokens: Column) -> Column:
    """1234 as 1.2K, with M and B beyond; a whole number has no decimal."""

    def short(size: float, sign: str) -> Column:
        return F.concat(F.regexp_replace(F.round(tokens / size, 1).cast("decimal(20,1)").cast("string"), r"\.0$", ""), F.lit(sign))

    return F.when(tokens >= 1_000_000_000, short(1e9, "B")).when(tokens >= 1_000_000, short(1e6, "M")).when(tokens >= 1000, short(1e3, "K")).otherwise(tokens.cast("string"))


def price_per_100m(cost: Column, tokens: Column) -> Column:
    return F.round(F.try_divide(cost, tokens) * 1e8, 4)


def hash_number(c: Column, modulus: int, digits: int = 4) -> Column:
    """Number below ``modulus`` from the first hexadecimal digits of a SHA-256."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, digits), 16, 10).cast("long") % modulus).cast("int")


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC by two nested hashes over padded keys of up to 64 bytes."""
    padded = key.encode().ljust(64, b"\0")
    if len(padded) > 64:
        raise ValueError("a key has 64 bytes at most")

    def pad(x: int) -> Column:
        return F.unhex(F.lit(bytes(b ^ x for b in padded).hex()))

    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def daily_identity(people: DataFrame, day: str, salt: str, names: list[str], key: str = "participant_id") -> DataFrame:
    """An id and a name for each person that last one day; people who share a name get a number from the second on."""
    public = F.substring(hmac_sha256(salt, F.concat_ws("|", F.col(key).cast("string"), F.lit(day))), 1, 16)
    named = people.select(key, public.alias("public_id")).withColumn("base", F.element_at(F.array(*map(F.lit, names)), hash_number(F.col("public_id"), len(names)) + 1))
    n = F.row_number().over(Window.partitionBy("base").orderBy(key))
    return named.withColumn("n", n).select(key, "public_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" "), F.col("n").cast("string"))).alias("name"))


def redacted_workdirs(rows: DataFrame, owner: str = "participant_id", workdir: str = "workdir_id", measure: str = "total_tokens") -> DataFrame:
    """Work folders of each owner renamed by rank, so that no name is told."""
    n = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(measure), workdir))
    return rows.withColumn("label", F.concat(F.lit("Workdir "), n.cast("string"))).drop(workdir)


def segment_widths(rows: DataFrame, owner: str = "participant_id", measure: str = "total_tokens", least: float = 2.0) -> DataFrame:
    """Percent of each segment of a bar, at least so wide that it can be seen."""
    return rows.where(F.col(measure) > 0).withColumn("width", F.greatest(F.lit(least), F.round(F.try_divide(F.col(measure) * 100.0, F.sum(measure).over(Window.partitionBy(owner))), 4)))


def version_numbers(version: Column) -> Column:
    """The three numbers of a version as an array, which compares as versions do; missing ones are 0."""
    parts = F.split(F.regexp_replace(F.regexp_replace(version, "^v", ""), "[-+].*$", ""), r"\.")
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0)))


def usd(value: Column, little: str = "< $0.01") -> Column:
    """Dollars with two decimals and commas; a dash for what is unknown."""
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    shown = F.format_number(F.round(F.abs(value.cast("decimal(28,10)")), 2), 2)
    return F.when(~known, "-").when((value > 0) & (value < 0.01), little).when(value < 0, F.concat(F.lit("-$"), shown)).otherwise(F.concat(F.lit("$"), shown))


def compatibility(protocol: Column, version: Column, low: int, high: int, newest: str, enforce: bool = False) -> Column:
    """Whether a client's protocol (as text) and version go with the server: a struct of status, reason and compatible."""
    n = protocol.try_cast("double")
    bad = n.isNull() | F.isnan(n) | (n != F.floor(n)) | (n < 0)
    whole = lambda v: F.when(v.rlike(r"^\d+\.\d+\.\d+"), version_numbers(F.regexp_extract(v, r"^(\d+\.\d+\.\d+)", 1))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))
    old = (F.coalesce(F.trim(version), F.lit("")) != "") & (whole(version) < whole(F.lit(newest)))

    def answer(status: str, reason: str, good: bool) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit(good).alias("compatible"))

    out = F.when(protocol.isNull(), answer("upgrade_recommended", "missing_client_protocol", True)).when(bad, answer("unsupported_client", "malformed_client_protocol", False))
    out = out.when(n < low, answer("unsupported_client", "client_protocol_too_old", False)).when(n > high, answer("unsupported_server", "client_protocol_too_new", False))
    late = answer("unsupported_client", "client_app_version_too_old", False) if enforce else answer("upgrade_available", "newer_client_available", True)
    return out.when(old, late).otherwise(answer("compatible", "", True))


def fleet_versions(devices: DataFrame, newest: str, version: str = "version") -> DataFrame:
    """Devices by version, and whether it is older than the newest."""
    by = devices.groupBy(version).agg(F.count("*").alias("devices"))
    return by.withColumn("outdated", version_numbers(F.col(version)) < version_numbers(F.lit(newest)))


def platform(text: Column) -> Column:
    """System and processor of a platform string, what is known of them; the string itself, or a dash, if nothing is."""
    raw = F.coalesce(text, F.lit(""))
    system = F.when(raw.rlike("^win"), "Windows").when(raw.rlike("^(darwin|macos)"), "macOS").when(raw.rlike("^linux"), "Linux")
    processor = F.when(raw.rlike("aarch64|arm64"), "arm64").when(raw.rlike(r"x86_64|\bx64\b"), "x64")
    return F.coalesce(F.nullif(F.concat_ws(" · ", system, processor), F.lit("")), F.nullif(raw, F.lit("")), F.lit("-"))


def primary_address(addresses: Column) -> Column:
    """The first address of a comma list that is not link-local, else the first."""
    each = F.transform(F.split(addresses, ","), lambda a: F.trim(a))
    return F.coalesce(F.get(F.filter(each, lambda a: ~a.startswith("169.254.") & (a != "")), 0), F.nullif(F.get(each, 0), F.lit("")))
