"""Readers of tool logs. Each returns the same usage events; lines that are not JSON are skipped.

Columns: provider_id, session_id, ts, workdir, model, input_tokens, output_tokens, cache_read_tokens,
cache_write_tokens, reasoning_tokens, total_tokens, source_quality, dedup_key, source_file.
Lines carry their place in the file, so forward fills and deltas are windows over one file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.operators.ledger import without_replay
from meterlake.sources.files import source_files
from meterlake.sources.packed import packed_lines

EVENT = ["provider_id", "session_id", "ts", "workdir", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "total_tokens", "source_quality", "dedup_key", "source_file"]


def json_lines(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl", packed: str | None = None, whole_frames: bool = False) -> DataFrame:
    """Rows file, line (ascending in the file), r (the parsed record) of all files below ``path``; ``packed`` names compressed ones."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    # a split of a file is read in order by one task, so its lines are told apart by its offset and the task's row number
    placed = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))
    lines = placed.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("block", "place")) - 1).select("file", F.col("line").cast("long").alias("line"), "raw")
    if packed:
        lines = lines.unionByName(packed_lines(spark, path, packed, whole_frames))
    # a record in a column that cannot hold it is null there; a line that is no JSON object is left out
    parsed = lines.where(F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")).select("file", "line", F.from_json("raw", schema).alias("r"))
    return parsed.where("r is not null")


def timestamp(c: Column) -> Column:
    """RFC 3339, ``yyyy-MM-dd HH:mm:ss`` and its relatives, or epoch seconds or milliseconds as text."""
    number = c.try_cast("double")
    epoch = F.when(number > 1e12, F.timestamp_millis(number.cast("long"))).when(number > 0, F.timestamp_seconds(number))
    return F.coalesce(epoch, F.try_to_timestamp(c))


def number(*names: Column) -> Column:
    """The first that is present, as a non-negative whole number."""
    c = F.coalesce(*names, F.lit(0))
    return F.greatest(c.cast("long"), F.lit(0).cast("long"))


def fill_down(value: Column, *keys: str) -> Column:
    """Last value so far in the file."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("file", *keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))


def finished(df: DataFrame, provider: str) -> DataFrame:
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    df = df.withColumn("total_tokens", total).where("total_tokens > 0")
    quality = F.when((F.col("input_tokens") > 0) | (F.col("output_tokens") > 0), "exact").otherwise("partial")
    return df.select(*[{"provider_id": F.lit(provider), "source_quality": quality, "source_file": F.col("file")}.get(c, F.col(c)).alias(c) for c in EVENT])


_USAGE = "input_tokens bigint, output_tokens bigint, cached_input_tokens bigint, cache_creation_input_tokens bigint, reasoning_output_tokens bigint, reasoning_tokens bigint, total_tokens bigint"


#: What is compared when a forked session repeats its parent's usage.
REPLAYED = ["raw_input", "cache_read_tokens", "cache_write_tokens", "raw_output", "reasoning_tokens", "raw_total"]


def session_counts(spark: SparkSession, path: str) -> DataFrame:
    """Usage events of cumulative session logs, plain or compressed, replays included, with what finds these: parent_id and forked_at of the
    session (from a session_meta on the file's first line), burst_at (the time of its first token count if the second came within a second), and the counts as logged."""
    counts = f"struct<{_USAGE.replace(' bigint', ':bigint').replace(', ', ',')}>"
    schema = f"""timestamp string, session_id string, cwd string, model string, token_count {counts}, type string,
     payload struct<id:string,session_id:string,timestamp:string,forked_from_id:string,source:string,cwd:string,model:string,type:string,info:struct<last_token_usage:{counts},total_token_usage:{counts}>>"""
    r = json_lines(spark, path, schema, packed="*.jsonl.zst")
    r = r.select("file", "line", "r.*").withColumn("model", fill_down(F.coalesce(F.col("model"), F.col("payload.model")))).withColumn("workdir", fill_down(F.coalesce(F.col("cwd"), F.col("payload.cwd"))))
    meta = F.col("type") == "session_meta"
    r = r.withColumn("session_id", fill_down(F.coalesce(F.col("session_id"), F.when(meta, F.coalesce("payload.id", "payload.session_id")))))
    spawned = F.get_json_object("payload.source", "$.subagent.thread_spawn.parent_thread_id")
    parent = F.coalesce(F.col("payload.forked_from_id"), spawned)
    r = r.withColumn("ts", timestamp(F.col("timestamp")))
    head = F.struct(F.nullif(parent, F.lit("")).alias("parent_id"), F.coalesce("ts", timestamp(F.col("payload.timestamp"))).alias("forked_at"))
    r = r.withColumn("head", fill_down(F.when(meta & (F.col("line") == 0), head)))
    timed = F.when((F.col("type") == "event_msg") & (F.col("payload.type") == "token_count"), F.col("ts"))
    whole = Window.partitionBy("file").orderBy("line")
    nth = F.sum(timed.isNotNull().cast("int")).over(whole)
    r = r.withColumn("timed", timed).withColumn("nth", nth)
    first, second = (F.max(F.when((F.col("nth") == k) & F.col("timed").isNotNull(), F.unix_millis("timed"))).over(Window.partitionBy("file")) for k in (1, 2))
    r = r.withColumn("burst_at", F.when((second >= first) & (second - first <= 1000), F.timestamp_millis(first)))
    total, last = F.col("payload.info.total_token_usage"), F.col("payload.info.last_token_usage")
    r = r.withColumn("last", last).withColumn("now", F.coalesce(total, F.when(last.isNull(), F.col("token_count"))))
    before = F.last("now", ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("before", before).where("now is not null or last is not null")
    own = F.col("last").isNotNull() & ~(F.col("now").isNotNull() & F.col("now").eqNullSafe(F.col("before")))

    def delta(name: str) -> Column:
        now, then = F.coalesce(F.col(f"now.{name}"), F.lit(0)), F.coalesce(F.col(f"before.{name}"), F.lit(0))
        again = F.coalesce(F.col("now.total_tokens"), F.lit(0)) < F.coalesce(F.col("before.total_tokens"), F.lit(0))
        return F.when(own, number(F.col(f"last.{name}"))).when(again, now).otherwise(F.greatest(now - then, F.lit(0)))

    read, write = delta("cached_input_tokens"), delta("cache_creation_input_tokens")
    said = delta("total_tokens")
    return r.select(
        "file", "line", "session_id", "ts", "workdir", F.lower(F.trim("model")).alias("model"), F.greatest(delta("input_tokens") - read - write, F.lit(0)).alias("input_tokens"), delta("output_tokens").alias("output_tokens"),
        read.alias("cache_read_tokens"), write.alias("cache_write_tokens"), F.greatest(delta("reasoning_output_tokens"), delta("reasoning_tokens")).alias("reasoning_tokens"), F.concat_ws(":", "session_id", "line").alias("dedup_key"),
        "head.parent_id", "head.forked_at", "burst_at", delta("input_tokens").alias("raw_input"), delta("output_tokens").alias("raw_output"), F.when(said > 0, said).otherwise(delta("input_tokens") + delta("output_tokens")).alias("raw_total"),
    ).where("input_tokens + output_tokens + cache_read_tokens + cache_write_tokens > 0")


def cumulative_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session logs whose token counts run on: usage is the difference to the line before, never negative.

    Handles rollout records (session_meta, turn_context, event_msg of type token_count) and the plain
    form with token_count on each line, also in ``.jsonl.zst`` files. A total that shrinks has begun anew. A record's last_token_usage
    counts instead of the difference if the total differs from the one before or is missing. What a forked session repeats of its parent does not count.
    """
    return finished(without_replay(session_counts(spark, path), REPLAYED), "codex_local")


def compacted_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage records that a compaction would swallow, as usage events with their response_id.

    A record waits until a ``compacted`` row names its response, before or after it. It does not count if a cumulative count that comes
    before that, while it is the latest record, has just its usage. Of several records of one response the first counts.
    """
    counts = _USAGE.replace(" bigint", ":bigint").replace(", ", ",")
    schema = f"timestamp string, type string, cwd string, model string, payload struct<id:string,cwd:string,model:string,type:string,response_id:string,compaction_response_id:string,usage:struct<{counts}>>"
    r = json_lines(spark, path, schema, packed="*.jsonl.zst").select("file", "line", "r.*")
    r = r.withColumn("session_id", fill_down(F.when(F.col("type") == "session_meta", F.col("payload.id")))).withColumn("model", fill_down(F.coalesce("model", "payload.model"))).withColumn("workdir", fill_down(F.coalesce("cwd", "payload.cwd")))
    u = "payload.usage"
    read, write = number(F.col(f"{u}.cached_input_tokens")), number(F.col(f"{u}.cache_creation_input_tokens"))
    name = lambda c: F.nullif(F.trim(c), F.lit(""))
    records = r.where((F.col("type") == "token_usage_record") & name("payload.response_id").isNotNull() & F.col(u).isNotNull()).select(
        "file", "line", name("payload.response_id").alias("response_id"), "session_id", timestamp(F.col("timestamp")).alias("ts"), "workdir", F.lower(F.trim("model")).alias("model"), number(F.col(f"{u}.input_tokens")).alias("raw_input"), read.alias("cache_read_tokens"), write.alias("cache_write_tokens"),
        number(F.col(f"{u}.output_tokens")).alias("output_tokens"), F.greatest(number(F.col(f"{u}.reasoning_output_tokens")), number(F.col(f"{u}.reasoning_tokens"))).alias("reasoning_tokens"),
    )
    first = records.groupBy("file", "response_id").agg(F.min_by(F.struct(*[c for c in records.columns if c not in ("file", "response_id")]), "line").alias("x")).select("file", "response_id", "x.*")
    named = r.where("type = 'compacted'").select("file", "line", name("payload.compaction_response_id").alias("response_id")).where("response_id is not null").groupBy("file", "response_id").agg(F.min("line").alias("named"))
    usage = ["raw_input", "cache_read_tokens", "cache_write_tokens", "output_tokens"]
    counted = session_counts(spark, path).select("file", "line", F.struct(F.col("raw_input"), "cache_read_tokens", "cache_write_tokens", F.col("raw_output").alias("output_tokens")).alias("counted"))
    # each count with the latest record before it
    both = records.select("file", "line", "response_id").unionByName(counted, allowMissingColumns=True)
    latest = both.withColumn("response_id", fill_down(F.col("response_id"))).where("counted is not null and response_id is not null")
    told = latest.join(first.select("file", "response_id", F.struct(*usage).alias("mine")), ["file", "response_id"]).where(F.col("mine").eqNullSafe(F.col("counted")))
    told = told.groupBy("file", "response_id").agg(F.collect_list("line").alias("told"))  # lines of equal counts that follow one record
    due = first.join(named, ["file", "response_id"]).join(told, ["file", "response_id"], "left").withColumn("at", F.greatest("line", "named"))
    kept = due.where(~F.coalesce(F.exists("told", lambda x: (x > F.col("line")) & (x < F.col("at"))), F.lit(False)))
    events = kept.withColumn("input_tokens", F.greatest(F.col("raw_input") - F.col("cache_read_tokens") - F.col("cache_write_tokens"), F.lit(0))).withColumn("dedup_key", F.concat_ws("|", F.lit("record"), "session_id", "response_id"))
    return finished(events, "codex_local").join(events.select(F.col("file").alias("source_file"), "dedup_key", "response_id"), ["source_file", "dedup_key"]).select(*EVENT, "response_id")


def all_session_usage(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative session logs whole: their counts, without replays, and the records that compactions swallowed."""
    return cumulative_sessions(spark, path).unionByName(compacted_usage(spark, path).drop("response_id"))


def message_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session logs of messages: the last row of a message id counts, advisor iterations are events of their own."""
    usage = "input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint"
    schema = f"timestamp string, session_id string, sessionId string, cwd string, model string, uuid string, message struct<id:string,model:string,usage:struct<{usage},iterations:array<struct<type:string,model:string,{usage}>>>>"
    r = json_lines(spark, path, schema).select("file", "line", "r.*")
    r = r.withColumn("model", fill_down(F.coalesce("message.model", "model"))).withColumn("workdir", fill_down(F.col("cwd"))).withColumn("key", F.coalesce("message.id", "uuid", F.concat_ws(":", "file", "line")))
    r = r.where("message.usage is not null").withColumn("n", F.row_number().over(Window.partitionBy("file", "key").orderBy(F.desc("line")))).where("n = 1")

    def shaped(df: DataFrame, u: str, model: str, key: Column) -> DataFrame:
        return df.select(
            "file", F.coalesce("session_id", "sessionId").alias("session_id"), timestamp(F.col("timestamp")).alias("ts"), "workdir", F.lower(F.trim(F.col(model))).alias("model"), number(F.col(f"{u}.input_tokens")).alias("input_tokens"), number(F.col(f"{u}.output_tokens")).alias("output_tokens"),
            number(F.col(f"{u}.cache_read_input_tokens")).alias("cache_read_tokens"), number(F.col(f"{u}.cache_creation_input_tokens")).alias("cache_write_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"), key.alias("dedup_key"),
        )

    own = shaped(r, "message.usage", "model", F.col("key"))
    parts = r.select("*", F.posexplode("message.usage.iterations").alias("at", "it")).where("it.type = 'advisor_message' and it.model is not null")
    return finished(own.unionByName(shaped(parts, "it", "it.model", F.concat_ws(":", "key", F.lit("advisor"), "at"))), "claude_code_local")


def record_sessions(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """Wire logs of usage records; sessions find their folder in an index whose last row wins. A time that is not in milliseconds is that of the file."""
    schema = "type string, model string, usage struct<inputOther:bigint,output:bigint,inputCacheRead:bigint,inputCacheCreation:bigint>, time double"
    changed = source_files(spark, path, "wire.jsonl").select(F.col("path").alias("file"), "changed")
    r = json_lines(spark, path, schema, "wire.jsonl").select("file", "line", "r.*").where("type = 'usage.record'").join(changed, "file", "left")
    r = r.withColumn("session_id", F.regexp_extract("file", r"/sessions/[^/]+/([^/]+)/", 1))
    if index is not None:
        last = index.groupBy("sessionId").agg(F.max_by("workDir", "line").alias("workdir"))
        r = r.join(last, r.session_id == last.sessionId, "left")
    else:
        r = r.withColumn("workdir", F.lit(None).cast("string"))
    u = "usage"
    shaped = r.select(
        "file", "session_id", F.coalesce(F.timestamp_millis(F.when(F.col("time") > 1e12, F.col("time")).cast("long")), "changed").alias("ts"), "workdir", F.lower(F.trim("model")).alias("model"), number(F.col(f"{u}.inputOther")).alias("input_tokens"), number(F.col(f"{u}.output")).alias("output_tokens"),
        number(F.col(f"{u}.inputCacheRead")).alias("cache_read_tokens"), number(F.col(f"{u}.inputCacheCreation")).alias("cache_write_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"), F.concat_ws(":", "file", "line").alias("dedup_key"),
    )
    return finished(shaped, "kimi_local")


def seeded_sessions(spark: SparkSession, path: str, exact_names: bool = False) -> DataFrame:
    """Logs with a versioned header (only version 0 is read); rows up to the last end-seed belong to a parent.

    With ``exact_names`` the files are ``session.jsonl`` and, of whole frames, ``session.jsonl.zstd``; else every ``*.jsonl``."""
    usage = "inputTokens:bigint,outputTokens:bigint,cacheReadTokens:bigint,cacheWriteTokens:bigint,reasoningTokens:bigint"
    schema = f"type string, version int, id string, cwd string, seq bigint, time string, data struct<message:struct<source:struct<model:string>>,usage:struct<{usage}>>"
    r = json_lines(spark, path, schema, "session.jsonl", "session.jsonl.zstd", whole_frames=True).select("file", "line", "r.*") if exact_names else json_lines(spark, path, schema).select("file", "line", "r.*")
    whole = Window.partitionBy("file")
    r = r.withColumn("edition", F.max(F.when(F.col("type") == "session", F.col("version"))).over(whole)).withColumn("seed", F.max(F.when(F.col("type") == "session/end-seed", F.col("seq"))).over(whole))
    r = r.withColumn("session_id", F.max(F.when(F.col("type") == "session", F.col("id"))).over(whole)).withColumn("workdir", F.max("cwd").over(whole)).where("edition = 0 and data.usage is not null and seq > coalesce(seed, -1)")
    u = "data.usage"
    shaped = r.select(
        "file", "session_id", timestamp(F.col("time")).alias("ts"), "workdir", F.lower(F.trim("data.message.source.model")).alias("model"), number(F.col(f"{u}.inputTokens")).alias("input_tokens"), number(F.col(f"{u}.outputTokens")).alias("output_tokens"),
        number(F.col(f"{u}.cacheReadTokens")).alias("cache_read_tokens"), number(F.col(f"{u}.cacheWriteTokens")).alias("cache_write_tokens"), number(F.col(f"{u}.reasoningTokens")).alias("reasoning_tokens"), F.concat_ws(":", "session_id", "seq").alias("dedup_key"),
    )
    return finished(shaped, "dsh_local")


def gateway_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gateway exports: columns by header, quoted line breaks, rejected rows left out."""
    r = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).where("lower(coalesce(rejected, 'false')) <> 'true'")
    whole = lambda c: number(F.col(c).try_cast("double"))
    return r.select(timestamp(F.col("time")).alias("ts"), "agent", "provider", F.lower(F.trim("model")).alias("model"), whole("input_tokens").alias("input_tokens"), whole("output_tokens").alias("output_tokens"), whole("cache_read_tokens").alias("cache_read_tokens"), whole("cache_write_tokens").alias("cache_write_tokens"), F.col("cost_usd").try_cast("double").alias("cost"), F.col("status").try_cast("int").alias("status"), "source")
