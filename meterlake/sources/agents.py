"""Readers of agents' own logs: role logs, traces, transcripts, event rows and rows of local stores.

All give the usage events of :mod:`meterlake.sources.logs`. Traces and transcripts share one usage shape;
a session that has a transcript counts by it alone. Stores are read as rows (session_id, data), data being JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.logs import fill_down, finished, json_lines, number, timestamp

#: Names under which tools write one count, the first that is present being taken.
ALIASES = {
    "input_tokens": ("input_tokens", "inputTokens", "prompt_tokens"),
    "output_tokens": ("output_tokens", "outputTokens", "completion_tokens"),
    "cache_read_tokens": ("cache_read_tokens", "cacheReadTokens", "cached_input_tokens"),
    "cache_write_tokens": ("cache_write_tokens", "cacheWriteTokens", "cache_creation_input_tokens"),
    "reasoning_tokens": ("reasoning_tokens", "reasoningTokens", "reasoning_output_tokens"),
}
#: Usage as prompt and completion counts with details.
_USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,prompt_tokens_details:struct<cached_tokens:bigint>,completion_tokens_details:struct<reasoning_tokens:bigint>>"


def by_alias(usage: str, name: str) -> Column:
    """A count under any of its names, as a whole number."""
    return number(*[F.col(f"{usage}.{a}") for a in ALIASES[name]])


def role_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Logs of roles: assistant rows with usage; rows that name a model set it for those after them. Rotated files count too."""
    counts = ",".join(f"{a}:bigint" for names in ALIASES.values() for a in names)
    schema = f"role string, type string, model string, timestamp string, cwd string, workdir string, working_directory string, project_path string, usage struct<{counts}>"
    r = json_lines(spark, path, schema, "*.jsonl*").where(F.col("file").rlike(r"\.jsonl(\.(deleted|reset)\..*)?$")).select("file", "line", "r.*").where("role = 'assistant'")
    sets = F.col("type").isin("model_change", "model-snapshot", "custom")
    r = r.withColumn("set", fill_down(F.when(sets, F.col("model")))).where(~F.coalesce(sets, F.lit(False)) & F.col("usage").isNotNull())
    session = F.regexp_extract("file", r"([^/]+?)\.jsonl", 1)
    return finished(r.select("file", session.alias("session_id"), timestamp(F.col("timestamp")).alias("ts"), F.coalesce("cwd", "workdir", "working_directory", "project_path").alias("workdir"), F.lower(F.trim(F.coalesce("set", "model", F.lit("unknown")))).alias("model"), *[by_alias("usage", c).alias(c) for c in ALIASES], F.concat_ws(":", "file", "line").alias("dedup_key")), "openclaw_local")


def _split(df: DataFrame, usage: str, model: Column, *rest: Column | str) -> DataFrame:
    """Prompt and completion counts as usage events: input without what was cached."""
    cached = number(F.col(f"{usage}.prompt_tokens_details.cached_tokens"))
    return df.select(
        "file", *rest, F.lower(F.trim(F.coalesce(F.nullif(F.trim(model), F.lit("")), F.lit("unknown")))).alias("model"), F.greatest(number(F.col(f"{usage}.prompt_tokens")) - cached, F.lit(0)).alias("input_tokens"), number(F.col(f"{usage}.completion_tokens")).alias("output_tokens"),
        cached.alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), number(F.col(f"{usage}.completion_tokens_details.reasoning_tokens")).alias("reasoning_tokens"),
    )


_SPAN = "struct<type:string,startedAt:string,toolOutput:string>"


def _generations(df: DataFrame) -> DataFrame:
    """The answer of each generation span (column span): JSON in a string, an object or an array whose first element counts."""
    answer = f"struct<model:string,usage:{_USAGE}>"
    text = F.col("span.toolOutput")
    first = F.get(F.from_json(F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{answer}>"), 0)
    return df.where("span.type = 'generation'").withColumn("answer", first).where("answer.usage is not null")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Whole-document traces: trace_id, worker, started_at and usage events of their generation spans.

    A trace that did not end well has none; one without usable spans falls back to the counts that it sums up for its models.
    """
    schema = f"trace struct<traceId:string,workerPid:bigint,sessionId:string,startedAt:string,status:string,modelInfo:array<struct<model:string,usage:{_USAGE}>>>, spans array<{_SPAN}>"
    docs = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "trace_*.json").json(path).select(F.col("_metadata.file_path").alias("file"), "trace", "spans").where("trace.status = 'ok'")
    spans = _generations(docs.select("file", "trace", F.posexplode("spans").alias("at", "span")))
    summed = docs.join(spans.select("file").distinct(), "file", "left_anti").select("file", "trace", F.posexplode("trace.modelInfo").alias("at", "answer"))
    both = spans.select("file", "trace", "at", "answer").unionByName(summed.select("file", "trace", "at", "answer"))
    return _traced(both)


def _traced(both: DataFrame) -> DataFrame:
    t = "trace"
    ids = [F.col(f"{t}.traceId").alias("trace_id"), F.col(f"{t}.workerPid").alias("worker"), F.col(f"{t}.sessionId").alias("session_id"), timestamp(F.col(f"{t}.startedAt")).alias("ts"), F.concat_ws(":", F.col(f"{t}.traceId"), "at").alias("dedup_key")]
    return _split(both, "answer.usage", F.col("answer.model"), *ids)


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """Traces written line by line: only those whose end says ok, and of these the ended generation spans."""
    schema = f"type string, trace struct<traceId:string,workerPid:bigint,sessionId:string,startedAt:string,status:string>, span {_SPAN}"
    r = json_lines(spark, path, schema, "trace_*.jsonl").select("file", "line", "r.*")
    done = r.where("type = 'trace_end' and trace.status = 'ok'").select("file").distinct()
    head = r.where("type in ('trace_start', 'trace_end')").groupBy("file").agg(F.min_by("trace", "line").alias("trace"))
    return _traced(_generations(r.where("type = 'span_end'").drop("trace").join(done, "file", "left_semi")).join(head, "file").withColumnRenamed("line", "at"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Project transcripts: messages and calls with raw usage and a time."""
    schema = f"type string, messageId string, sessionId string, cwd string, timestamp string, providerData struct<model:string,requestModelId:string,rawUsage:{_USAGE}>"
    r = json_lines(spark, path, schema).select("file", "line", "r.*").withColumn("workdir", fill_down(F.col("cwd"))).where("type in ('message', 'function_call') and providerData.rawUsage is not null and timestamp is not null")
    model = F.coalesce(F.nullif(F.trim("providerData.model"), F.lit("")), F.col("providerData.requestModelId"))
    return _split(r, "providerData.rawUsage", model, F.col("sessionId").alias("session_id"), timestamp(F.col("timestamp")).alias("ts"), "workdir", F.concat_ws(":", "sessionId", F.coalesce("messageId", F.col("line").cast("string"))).alias("dedup_key"))


def traced_usage(traces: DataFrame, transcripts: DataFrame, provider: str = "workbuddy_local") -> DataFrame:
    """Transcripts, and the traces of sessions that have none; ``traces`` may have got sessions by their interval."""
    own = traces.join(transcripts.select("session_id").where("session_id is not null").distinct(), "session_id", "left_anti")
    both = transcripts.unionByName(own.drop("trace_id", "worker"), allowMissingColumns=True)
    return finished(both, provider)


def dashboard_events(events: DataFrame, account: str) -> DataFrame:
    """Rows of a dashboard's events (timestamp, model, tokenUsage): those with tokens and a time; unnamed models are ``auto``."""
    name = F.lower(F.trim("model"))
    u = "tokenUsage"
    shaped = events.where("tokenUsage is not null").select(
        F.lit("api").alias("file"), F.lit(None).cast("string").alias("session_id"), timestamp(F.col("timestamp")).alias("ts"), F.lit(f"virtual:{account}").alias("workdir"), F.when(name.isNull() | name.isin("", "default", "auto"), "auto").otherwise(name).alias("model"),
        *[number(F.col(f"{u}.{a}")).alias(c) for c, a in (("input_tokens", "inputTokens"), ("output_tokens", "outputTokens"), ("cache_read_tokens", "cacheReadTokens"), ("cache_write_tokens", "cacheWriteTokens"))], F.lit(0).cast("long").alias("reasoning_tokens"), F.sha2(F.to_json(F.struct("timestamp", "model", "tokenUsage")), 256).alias("dedup_key"),
    )
    return finished(shaped.where("ts is not null"), "cursor_dashboard")


def stored_messages(rows: DataFrame, provider: str = "opencode_local") -> DataFrame:
    """Rows of a message store: assistant messages with tokens by kind."""
    schema = "role string, modelID string, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>, time struct<created:string,completed:string>, path struct<cwd:string>"
    r = rows.select("session_id", F.from_json("data", schema).alias("d")).select("session_id", "d.*").where("role = 'assistant' and tokens is not null")
    shaped = r.select(
        F.lit("store").alias("file"), "session_id", timestamp(F.coalesce("time.completed", "time.created")).alias("ts"), F.col("path.cwd").alias("workdir"), F.lower(F.trim(F.coalesce("modelID", F.lit("unknown")))).alias("model"), number(F.col("tokens.input")).alias("input_tokens"), number(F.col("tokens.output")).alias("output_tokens"),
        number(F.col("tokens.cache.read")).alias("cache_read_tokens"), number(F.col("tokens.cache.write")).alias("cache_write_tokens"), number(F.col("tokens.reasoning")).alias("reasoning_tokens"), F.sha2(F.to_json(F.struct("*")), 256).alias("dedup_key"),
    )
    return finished(shaped, provider)


def stored_usage(rows: DataFrame, provider: str = "hermes_local") -> DataFrame:
    """Rows of a store of flat usage records; rows without a readable time are left out."""
    schema = "session_id string, timestamp string, cwd string, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint"
    r = rows.select(F.from_json("data", schema).alias("d")).select("d.*").withColumn("ts", timestamp(F.col("timestamp"))).where("ts is not null")
    shaped = r.select(F.lit("store").alias("file"), "session_id", "ts", F.col("cwd").alias("workdir"), F.lower(F.trim(F.coalesce("model", F.lit("unknown")))).alias("model"), *[number(F.col(c)).alias(c) for c in ALIASES], F.sha2(F.to_json(F.struct("*")), 256).alias("dedup_key"))
    return finished(shaped, provider)


def quota_windows(answers: DataFrame) -> DataFrame:
    """Limits of a plan's quota answer (column data: level, limits): the window of five hours and that of a week.

    A limit of unit 3 is the first, of unit 6 the second; others fill what is left, those without a reset time first, then by it.
    Usage by model (usageDetails), where the answers have it, is the map ``details``.
    """
    each = answers.select(F.col("data.level").alias("level"), F.posexplode("data.limits").alias("at", "x")).where(F.upper("x.type").isin("TOKENS_LIMIT", "CREDIT_LIMIT"))
    order = F.struct(F.col("x.nextResetTime").isNotNull().alias("known"), F.coalesce("x.nextResetTime", F.lit(0)).alias("reset"), "at", "x")
    kind = F.when(F.col("x.unit") == 3, "five").when(F.col("x.unit") == 6, "week").otherwise("rest")
    whole = each.groupBy("level").agg(F.array_sort(F.collect_list(F.struct(kind.alias("kind"), order.alias("o")))).alias("all"))  # a handful of limits a plan

    def of(name: str) -> Column:
        return F.filter("all", lambda y: y["kind"] == name)

    # a second limit of a unit is one of the rest, after those without a unit of their own only by its place in time
    rest = F.array_sort(F.transform(F.concat(of("rest"), F.slice(of("five"), 2, 1000), F.slice(of("week"), 2, 1000)), lambda y: y["o"]))
    five = F.coalesce(F.get(of("five"), 0)["o"], F.get(rest, 0))
    week = F.coalesce(F.get(of("week"), 0)["o"], F.get(rest, F.when(F.size(of("five")) > 0, 0).otherwise(1)))
    windows = whole.select("level", F.explode(F.array(F.struct(F.lit("five_hour").alias("window"), five["x"].alias("x")), F.struct(F.lit("weekly").alias("window"), week["x"].alias("x")))).alias("w")).where("w.x is not null")
    details = []
    if "usageDetails" in windows.select("w.x.*").columns:
        given = F.filter("w.x.usageDetails", lambda d: d["modelCode"].isNotNull())
        codes = F.array_distinct(F.transform(given, lambda d: d["modelCode"]))
        # of a model named twice the last counts
        details = [F.map_from_arrays(codes, F.transform(codes, lambda c: F.element_at(F.filter(given, lambda d: d["modelCode"] == c), -1)["usage"])).alias("details")]
    return windows.select("level", "w.window", F.col("w.x.percentage").alias("percentage"), F.timestamp_millis("w.x.nextResetTime").alias("resets_at"), *details)
