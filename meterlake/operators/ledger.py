"""Keeping stored facts right: request ledgers, uploads, reconciliation, removal.

All are joins and aggregates over scopes (day, hour, provider) or keys and give the same rows when run
again. Rows that a step does not name stay as they are.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.operators.lifecycle import COUNTS, SCOPE, keep_first
from meterlake.operators.pricing import with_cost

_MEASURES = [*COUNTS, "total_tokens"]


def _measures(df: DataFrame) -> list[str]:
    return [c for c in _MEASURES if c in df.columns]


def dirty_scopes(scanned: DataFrame, known: DataFrame, fingerprint: str = "source_fingerprint", scope: list[str] = SCOPE) -> DataFrame:
    """Scopes of rows that come from sources not seen before."""
    return scanned.join(known.select(fingerprint).distinct(), fingerprint, "left_anti").select(*scope).distinct()


def preserved_scopes(ledger: DataFrame, scanned: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Per provider what the ledger has in scopes that a scan did not touch."""
    kept = ledger.join(scanned.select(*scope).distinct(), scope, "left_anti").groupBy(*scope).agg(F.count("*").alias("rows"), F.sum("total_tokens").alias("total_tokens"))
    return kept.groupBy("provider_id").agg(F.count("*").alias("scopes"), F.sum("rows").alias("rows"), F.sum("total_tokens").alias("tokens"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).withColumnRenamed("tokens", "total_tokens")


def changed_requests(stored: DataFrame, incoming: DataFrame, key: str = "request_id", digest: str = "digest") -> DataFrame:
    """Incoming requests that are new or whose digest is another one."""
    return incoming.join(stored.select(key, F.col(digest).alias("__was")), key, "left").where(~F.col(digest).eqNullSafe(F.col("__was"))).drop("__was")


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "request_id") -> DataFrame:
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def affected_scopes(stored: DataFrame, changed: DataFrame, facts: DataFrame, key: str = "request_id", scope: list[str] = SCOPE) -> DataFrame:
    """Scopes to count again: those of changed requests, before and after, and those of the ledger that have no facts."""
    before = stored.join(changed.select(key), key, "left_semi").select(*scope)
    missing = stored.select(*scope).subtract(facts.select(*scope))
    return before.union(changed.select(*scope)).union(missing).distinct()


def residual(old: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """What old facts have beyond live ones, by key: the difference where no count would be negative, else nothing."""
    cols = [c for c in _measures(old) if c in live.columns]
    joined = old.join(live.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in cols]), keys, "left")
    left = {c: F.col(c) - F.coalesce(f"__{c}", F.lit(0)) for c in cols}
    whole = F.lit(True)
    for c in cols:
        whole &= left[c] >= 0
    out = joined.select(*keys, *[F.when(whole, left[c]).otherwise(0).cast("long").alias(c) for c in cols])
    return out.where(" or ".join(f"{c} > 0" for c in cols))


def overlap_is_sound(old: DataFrame, live: DataFrame, scope: list[str], keys: list[str], least: int = 10) -> DataFrame:
    """One row: scopes and keys that both have; unsound if many scopes overlap and no key does."""
    scopes = old.select(*scope).intersect(live.select(*scope)).agg(F.count("*").alias("scopes"))
    both = old.select(*keys).intersect(live.select(*keys)).agg(F.count("*").alias("matches"))
    one = F.lit(0).alias("one")
    return scopes.select("*", one).join(both.select("*", one), "one").select("scopes", "matches", (~((F.col("scopes") >= least) & (F.col("matches") == 0))).alias("sound"))


def merged_items(items: DataFrame, keys: list[str], texts: list[str], seq: str) -> DataFrame:
    """Sums, and of each text the last one that is not empty."""
    last = [F.max_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(seq))).alias(c) for c in texts]
    return items.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _measures(items)], *last)


def legacy_upsert(stored: DataFrame, batch: DataFrame, applied: DataFrame, key: str, fingerprint: str = "source_fingerprint", seq: str = "seq", display: list[str] | None = None) -> DataFrame:
    """Apply a batch of daily rows once: batches seen before change nothing, and of rows with one key the last (by ``seq``) counts.

    An incoming row puts out, under other keys: stored rows of its fingerprint (an empty one puts out none), the unnamed twin of a
    named model, and with ``display`` (columns that are all set where it applies) stored rows that agree in them. A stored row of its own key that is derived from hours stays.
    """
    fresh = batch.join(applied.select("batch_hash").distinct(), "batch_hash", "left_anti").drop("batch_hash")
    fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*[c for c in fresh.columns if c != key]), seq).alias("__r")).select(key, "__r.*").drop(seq)

    def put_out(on: list[str], by: DataFrame, rows: DataFrame) -> DataFrame:
        # gone if a row under another key agrees: by the least and the largest key of those that do
        keys = by.groupBy(*on).agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
        return rows.join(keys, on, "left").where(F.col("__low").isNull() | ((F.col("__low") == F.col(key)) & (F.col("__high") == F.col(key)))).drop("__low", "__high")

    kept = put_out([fingerprint], fresh.where(F.coalesce(fingerprint, F.lit("")) != ""), stored)
    named = fresh.where("model <> 'unknown'").select("day", "provider_id", "workdir_id").distinct().withColumn("__named", F.lit(True))
    kept = kept.join(named, ["day", "provider_id", "workdir_id"], "left").where("__named is null or model <> 'unknown'").drop("__named")
    if display:
        kept = put_out(display, fresh.dropna(subset=display), kept)
    derived = kept.where("hourly_derived").select(key)
    incoming = fresh.join(derived, key, "left_anti")
    return kept.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def daily_upsert(stored: DataFrame, snapshot: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """Rows of a day's snapshot go over stored ones; stored rows of its scopes that it does not have go, unless derived from hours."""
    touched = snapshot.select(*scope).distinct().withColumn("__touched", F.lit(True))
    derived = stored.where("hourly_derived")
    incoming = snapshot.join(derived.select(key), key, "left_anti")
    kept = stored.join(touched, scope, "left").where("__touched is null or hourly_derived").drop("__touched")
    return kept.unionByName(incoming, allowMissingColumns=True)


def merged_collisions(rows: DataFrame, keys: list[str], texts: list[str], fingerprint: str = "source_fingerprint") -> DataFrame:
    """Rows whose keys agree but for case and blanks are one: sums, and the texts of the largest row (of equals, the lesser fingerprint)."""
    shaped = rows.select(*[F.lower(F.trim(F.col(k))).alias(k) if dict(rows.dtypes)[k] == "string" else F.col(k) for k in keys], *[c for c in rows.columns if c not in keys])
    best = F.struct(-F.col("total_tokens"), fingerprint)
    return shaped.groupBy(*keys).agg(*[F.min_by(c, best).alias(c) for c in texts], *[F.sum(c).alias(f"__{c}") for c in _measures(rows)]).withColumnsRenamed({f"__{c}": c for c in _measures(rows)})


def newest_upload(rows: DataFrame, natural_key: list[str], uploaded: str = "uploaded_at", device: str = "device_id") -> DataFrame:
    """Of rows that several devices sent for one natural key the newest one counts."""
    return keep_first(rows, natural_key, F.desc(uploaded), device)


def batch_results(validity: DataFrame) -> DataFrame:
    """One row: accepted and rejected buckets of a batch; a bad one does not touch the others."""
    return validity.agg(F.count("*").alias("buckets"), F.count_if(F.col("status") == "ok").alias("accepted"), F.count_if(F.col("status") != "ok").alias("rejected"))


def scope_digests(daily: DataFrame, hourly: DataFrame, scope: list[str]) -> DataFrame:
    """One digest for what a scope has by the day and by the hour; inputs have the scope and ``fingerprint``."""
    d = daily.groupBy(*scope).agg(F.max("fingerprint").alias("d"))
    h = hourly.groupBy(*scope).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fingerprint")), ","), 256).alias("h"))
    text = F.concat(F.lit('{"daily":"'), F.coalesce("d", F.lit("")), F.lit('","hourly":"'), F.coalesce("h", F.lit("")), F.lit('"}'))
    return d.join(h, scope, "full").select(*scope, F.sha2(text, 256).alias("digest"))


def reconcile(actions: DataFrame, state: DataFrame, scope: list[str]) -> DataFrame:
    """Outcome of each action (prune or rebuild, with the digest it expects): absent, conflict, pruned, rebuilt or invalid."""
    joined = actions.join(state.select(*scope, F.col("digest").alias("__now")), scope, "left")
    status = F.when(~F.coalesce(F.col("action").isin("prune", "rebuild"), F.lit(False)), "invalid").when(F.col("__now").isNull(), "absent").when(~F.col("expected").eqNullSafe(F.col("__now")), "conflict").when(F.col("action") == "prune", "pruned").otherwise("rebuilt")
    return joined.withColumn("status", status).drop("__now")


def pruned(rows: DataFrame, outcomes: DataFrame, scope: list[str]) -> DataFrame:
    """What is left after the prunings that were carried out."""
    return rows.join(outcomes.where("status = 'pruned'").select(*scope).distinct(), scope, "left_anti")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("actions"))


def manifest_kinds(manifest: DataFrame) -> DataFrame:
    """Entries of a client's manifest by kind; a day's entry stands for the hours of that day, which go."""
    kind = F.when(F.col("hour").isNotNull(), "hourly").when(F.col("day").isNotNull(), "daily").otherwise("unknown")
    marked = manifest.withColumn("kind", kind)
    days = marked.where("kind = 'daily'").select("day", "provider_id").distinct().withColumn("__day", F.lit(True))
    return marked.join(days, ["day", "provider_id"], "left").where("kind <> 'hourly' or __day is null").drop("__day")


def prunable(scopes: DataFrame, today: date, failed: list[str], days: int = 2) -> DataFrame:
    """Scopes that may be pruned: not of the last days, and of no provider that failed to read."""
    return scopes.where((F.col("day") <= F.lit(today - timedelta(days=days))) & ~F.col("provider_id").isin(failed))


def recent_states(states: DataFrame, today: date, days: int = 35, most: int = 250, *ties: str) -> DataFrame:
    """The newest states within some days; a report of ``most`` rows."""
    return states.where(F.col("day") > F.lit(today - timedelta(days=days))).orderBy(F.desc("day"), *ties).limit(most)


def dirty_buckets(buckets: DataFrame, manifest: DataFrame, scope: list[str]) -> DataFrame:
    """Buckets whose fingerprint the manifest does not have."""
    return changed_requests(manifest.withColumn("__scope", F.struct(*scope)), buckets.withColumn("__scope", F.struct(*scope)), "__scope", "fingerprint").drop("__scope")


def without_device(rows: DataFrame, participant: int, device: int, cloud: Column, scope: list[str]) -> DataFrame:
    """Without a device's rows, and without its person's cloud rows in the scopes it had, whichever device sent them."""
    gone = rows.where((F.col("participant_id") == participant) & (F.col("device_id") == device))
    left = rows.where(~((F.col("participant_id") == participant) & (F.col("device_id") == device)))
    cloudy = gone.where(cloud).select("participant_id", *scope).distinct().withColumn("__gone", F.lit(True))
    return left.join(cloudy, ["participant_id", *scope], "left").where(F.col("__gone").isNull() | ~cloud).drop("__gone")


def removed_counts(rows: DataFrame, participant: int) -> DataFrame:
    """How many rows of each provider go with a person."""
    return rows.where(F.col("participant_id") == participant).groupBy("provider_id").agg(F.count("*").alias("rows"))


def missing_providers(previous: DataFrame, current: DataFrame, enabled: list[str]) -> DataFrame:
    """Enabled providers with history and no row now: their history is kept and marked partial."""
    absent = previous.where(F.col("provider_id").isin(enabled)).join(current.select("provider_id").distinct(), "provider_id", "left_anti")
    return current.unionByName(absent.withColumn("source_quality", F.lit("partial")), allowMissingColumns=True)


def merged_summaries(history: DataFrame, window: DataFrame, key: str = "day") -> DataFrame:
    """Days of a window go over those of the history."""
    cols = [c for c in history.columns if c != key]
    w = window.select(key, F.lit(True).alias("__in"), *[F.col(c).alias(f"__{c}") for c in cols])
    return history.join(w, key, "full").select(key, *[F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def compared_sync(client: DataFrame, buckets: DataFrame, facts: DataFrame, today: date, scope: list[str], full: bool = False, days: int = 35) -> DataFrame:
    """What a client's buckets (scope, granularity, fingerprint) are to the server: missing, different, matched, or unknown_legacy.

    ``buckets`` is what the server remembers, ``facts`` the fingerprints of its stored rows; both have scope, granularity and fingerprint. Facts count
    before what is remembered. Only a full comparison goes back beyond ``days`` and names buckets without a granularity; else these count as hourly.
    """
    asked = client if full else client.where(F.col("day") >= F.lit(today - timedelta(days=days)))
    asked = asked.withColumn("granularity", F.coalesce(F.nullif("granularity", F.lit("")), F.lit("unknown_legacy" if full else "hourly")))
    keys = [*scope, "granularity"]

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("fingerprint").alias(name))

    out = asked
    for df, name in ((buckets, "__told"), (facts, "__facts")):
        other = named(df, name)
        # a day's bucket has no hour
        out = out.join(other, [out[k].eqNullSafe(other[f"__{k}"]) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    server = F.coalesce(F.nullif("__facts", F.lit("")), F.nullif("__told", F.lit("")), F.lit(""))
    status = F.when(F.col("granularity") == "unknown_legacy", "unknown_legacy").when(F.col("__told").isNull() & (F.coalesce("__facts", F.lit("")) == ""), "missing").when(server == F.coalesce("fingerprint", F.lit("")), "matched").otherwise("different")
    return out.select(*client.columns, status.alias("status"), F.when(status == "different", server).alias("server_fingerprint"))


def scope_page(tables: list[DataFrame], scope: list[str], cursor: tuple | None, limit: int = 250, most: int = 250) -> DataFrame:
    """One page of the scopes that any of the tables has, after ``cursor`` (a scope's values) in their order; ``more`` says whether others follow."""
    limit = max(1, min(limit, most))
    found = tables[0].select(*scope)
    for t in tables[1:]:
        found = found.unionByName(t.select(*scope))
    found = found.dropna(subset=scope)
    if cursor is not None:
        after, equal = F.lit(False), F.lit(True)
        for c, v in zip(scope, cursor, strict=True):
            after, equal = after | (equal & (F.col(c) > F.lit(v))), equal & (F.col(c) == F.lit(v))
        found = found.where(after)
    page = found.distinct().orderBy(*scope).limit(limit + 1)  # a page of ``most`` rows
    numbered = page.withColumn("__n", F.row_number().over(Window.orderBy(*scope)))
    return numbered.withColumn("more", F.max("__n").over(Window.partitionBy()) > limit).where(F.col("__n") <= limit).drop("__n")


def migrated(rows: DataFrame, key: str, prices: DataFrame) -> DataFrame:
    """Old rows as they would be written now: a digest of their key where they have none, their total made anew, and costs where these are missing or the total was another."""
    old = F.coalesce("source_fingerprint", F.lit("")) == ""
    legacy = lambda c: F.when(old, F.coalesce(F.nullif(c, F.lit("")), F.lit("legacy"))).otherwise(F.col(c))
    total = sum((F.coalesce(c, F.lit(0)) for c in COUNTS if c in rows.columns and c != "reasoning_tokens"), F.lit(0).cast("long"))
    again = F.col("cost_quality").isNull() | (F.col("cost_quality") == "") | ~F.col("total_tokens").eqNullSafe(total)
    marked = rows.withColumns({**{c: legacy(c) for c in ("raw_source_ref", "provider_version", "parser_version") if c in rows.columns}, "source_fingerprint": F.when(old, F.sha2(F.concat(F.lit("legacy|"), F.col(key).cast("string")), 256)).otherwise(F.col("source_fingerprint")), "__again": again, "total_tokens": total})
    priced = with_cost(marked.withColumnsRenamed({"cost": "__cost", "cost_quality": "__quality"}), prices)
    both = priced.withColumns({"cost": F.when(F.col("__again"), F.col("cost")).otherwise(F.col("__cost")), "cost_quality": F.when(F.col("__again"), F.col("cost_quality")).otherwise(F.col("__quality"))})
    return both.select(*rows.columns)


def request_buckets(requests: DataFrame) -> DataFrame:
    """Hour buckets of gateway requests: a row a model, with calls and errors."""
    return requests.groupBy(*SCOPE, "model").agg(*[F.sum(c).alias(c) for c in _measures(requests)], F.count("*").alias("calls"), F.count_if(F.col("status") >= 400).alias("errors"))


def bucket_snapshots(items: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    return items.groupBy(*scope).agg(F.count("*").alias("row_count"), F.sum("total_tokens").alias("tokens")).withColumnRenamed("tokens", "total_tokens")


def completed_attempts(attempts: DataFrame, sessions: DataFrame) -> DataFrame:
    """The last completed attempt of each request, with its session's folder if there is one; input is counted without the cache."""
    done = attempts.where("status = 'completed'")
    last = done.withColumn("__n", F.row_number().over(Window.partitionBy("logical_request_id").orderBy(F.desc("attempt_index")))).where("__n = 1").drop("__n")
    joined = last.join(sessions.select(F.col("id").alias("session_id"), "directory"), "session_id", "left")
    return joined.withColumn("input_tokens", F.greatest(F.col("input_tokens") - F.col("cache_read_tokens") - F.col("cache_write_tokens"), F.lit(0)))


def not_imported(messages: DataFrame, imports: DataFrame, key: str = "session_id") -> DataFrame:
    """Messages of sessions that were not imported from elsewhere; a message without a session stays."""
    return messages.join(imports.select(key).where(f"{key} is not null").distinct(), key, "left_anti")


def within_sessions(traces: DataFrame, sessions: DataFrame, slack_seconds: int = 5) -> DataFrame:
    """Each trace with the newest created session of its root that was open when it began; deleted sessions are left out.

    Traces and sessions meet by root and by the days that the session spans, so that the interval is a filter on an equi-join.
    """
    ends = F.coalesce("last_activity_at", "updated_at")
    live = sessions.where(F.col("deleted_at").isNull()) if "deleted_at" in sessions.columns else sessions
    spans = live.select(F.col("id").alias("session_id"), "root", "cwd", "created_at", ends.alias("ended_at"), F.explode(F.sequence(F.to_date(F.col("created_at") - F.make_dt_interval(secs=F.lit(slack_seconds))), F.to_date(F.greatest("created_at", ends)))).alias("__day"))
    joined = traces.withColumn("__day", F.to_date("started_at")).join(spans, ["root", "__day"], "left")
    open_then = (F.col("created_at") - F.make_dt_interval(secs=F.lit(slack_seconds)) <= F.col("started_at")) & (F.col("started_at") <= F.col("ended_at"))
    best = joined.groupBy("trace_id").agg(F.max_by(F.struct("session_id", "cwd"), F.when(open_then, F.struct("created_at", "session_id"))).alias("s"))
    return traces.join(best, "trace_id").select(*traces.columns, "s.session_id", "s.cwd")


def without_replay(events: DataFrame, fields: list[str], gap_ms: int = 1000) -> DataFrame:
    """Usage events without what forked sessions repeat of their parents.

    ``events`` has file, line (ascending), session_id, ts, parent_id (null: not forked), forked_at, burst_at and ``fields``. A parent is the
    first file of its session. A fork drops its longest common beginning with the parent's events up to the first one after
    forked_at (events without a time and forks without one set no end). If not even the first event agrees and burst_at is
    set, it drops the burst instead: events from burst_at on, each within the gap of the one before; an event without a time ends it.
    """
    order = Window.partitionBy("file").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("__n", F.row_number().over(order))
    forks = numbered.where("parent_id is not null")
    parents = numbered.join(numbered.groupBy("session_id").agg(F.min("file").alias("file")), ["session_id", "file"], "left_semi")
    theirs = parents.select(F.col("session_id").alias("parent_id"), "__n", F.col("ts").alias("__at"), F.struct(*fields).alias("__theirs"))
    at = forks.join(theirs, ["parent_id", "__n"], "left")
    # before the fork: no event so far is later than it; a fork's own order serves, since both are numbered alike
    late = F.coalesce(F.col("__at") > F.col("forked_at"), F.lit(False))
    differs = late | ~F.coalesce(F.col("__theirs").eqNullSafe(F.struct(*fields)), F.lit(False)) | F.col("__theirs").isNull()
    marked = at.withColumn("__own", F.max(differs.cast("int")).over(upto)).withColumn("__none", F.first(differs).over(upto))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    since = ms - F.coalesce(F.lag(ms).over(order), F.when(F.col("__n") == 1, F.unix_millis(F.col("burst_at").cast("timestamp"))))
    pause = ~F.coalesce((since >= 0) & (since <= gap_ms), F.lit(False))
    marked = marked.withColumn("__after", F.max(pause.cast("int")).over(upto))
    kept = marked.where(F.when(F.col("__none") & F.col("burst_at").isNotNull(), F.col("__after") == 1).otherwise(F.col("__own") == 1))
    return numbered.where("parent_id is null").unionByName(kept.select(*numbered.columns)).drop("__n")


def one_copy(files: DataFrame) -> DataFrame:
    """Of copies of a log (home, name) the active one, then the plain one, then the first path."""
    return keep_first(files, ["home", "name"], F.col("archived").cast("int"), F.col("compressed").cast("int"), "path")
