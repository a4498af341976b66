"""URL filtering by empirical-Bayes host reputation.

A page with a label is a trial of its host: bad or not. Rates are shrunk from the top down through
beta-binomial priors: all pages to suffix (last name of the host), suffix to registered domain (last
two names), registered domain to host. At each level the prior's mean is the parent's posterior mean
and its strength follows from the spread of the children's rates (method of moments). A host is blocked
if the lower bound of its posterior (mean less ``Z`` standard deviations) exceeds ``LIMIT``; a host
without labelled pages has its parents' reputation. Rules given by hand come first.

Only DataFrame functions are used. Counts are summed before they are shuffled; the tables of suffixes
and domains are joined, never collected; a host that has a third of all pages is one row of counts.
The pages' own join is with the verdicts of hosts, which Spark can split where a host is hot.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict of
the top level; repeated pages are judged each; outcomes of unknown pages count for nothing; without
outcomes nothing is blocked except by rule; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import lower_ascii

Z = 1.645
LIMIT = 0.5
#: Bounds of a prior's strength, in trials.
WEAKEST, STRONGEST = 2.0, 1000.0
#: (host, path prefix, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None)
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _posterior(level: DataFrame, parent: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Shrink the rates of ``level`` (keys, n, bad) to the mean m of ``parent`` (joined on ``on``).

    The strength comes from moments: with p the pooled rate, the weighted variance v of the
    children's rates beyond binomial noise gives strength p(1-p)/v - 1, within bounds.
    """
    spread = level.groupBy(*on).agg(
        F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").alias("k"), F.sum(F.col("bad") * F.col("bad") / F.when(F.col("n") > 0, F.col("n"))).alias("q"), F.sum(F.col("n") * F.col("n")).alias("n2")
    )
    p = F.try_divide(F.col("B"), F.col("N"))
    between = F.col("q") - F.col("N") * p * p - (F.col("k") - 1) * p * (1 - p)
    weight = F.col("N") - F.try_divide(F.col("n2"), F.col("N"))
    variance = F.try_divide(between, weight)
    strength = F.when(variance > 0, F.try_divide(p * (1 - p), variance) - 1).otherwise(F.lit(STRONGEST))
    fitted = spread.select(*on, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(strength, F.lit(STRONGEST)))).alias("s"))
    a = F.col("bad") + F.col("s") * F.col("m")
    b = F.col("n") - F.col("bad") + F.col("s") * (1 - F.col("m"))
    return level.join(fitted, on).join(parent, on).select(*keys, (a / (a + b)).alias("m"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))


def reputation(trials: DataFrame) -> DataFrame:
    """From rows (host, n, bad) the posterior of every host: host, m, sd."""
    names = F.split("host", r"\.")
    hosts = trials.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select("host", F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(names, -1).alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("top", F.lit(0))
    top = suffixes.groupBy("top").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("m"))
    by_suffix = _posterior(suffixes, top, ["top"], ["suffix"]).select("suffix", "m")
    by_domain = _posterior(domains, by_suffix, ["suffix"], ["domain", "suffix"]).select("domain", "suffix", "m")
    return _posterior(hosts, by_domain, ["domain", "suffix"], ["host"])


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", z: float = Z, limit: float = LIMIT) -> DataFrame:
    """Per page: id, host, path, rule, verdict. ``outcomes`` has the id and ``bad`` (0 or 1) of labelled pages."""
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    seen = outcomes.select(F.col(id_col).alias("__id"), F.col("bad").cast("int").alias("bad")).where("bad is not null").groupBy("__id").agg(F.max("bad").alias("bad"))
    counted = parsed.select("__id", "host").join(seen, "__id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = reputation(counted).where(F.col("m") - z * F.col("sd") > limit).select("host", F.lit(True).alias("blocked"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.join(blocked, "host", "left").select(
        F.col("__id").alias(id_col), "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict")
    )
