"""Queries on what only larger tables have, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlake.operators import deepfind, gateway_views, reports
from meterlake.plans import surrogate
from meterlake.plans.all_queries import ORACLE_SQL, QUERIES
from tests.test_usage_sql import DATA, rows


def events(path, sql: str) -> tuple[str, duckdb.DuckDBPyConnection]:
    """A folder of tables whose events are as given (``e``: the small ones), and the same in DuckDB."""
    con = duckdb.connect()
    con.execute(f"create view e as select * from '{DATA}/events.parquet'")
    con.execute(f"copy ({sql}) to '{path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    for name in ("lineitem", "part", "supplier"):
        (path / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["gateway_days", "chart_tokens_by_model_and_day", "chart_calls_by_source_and_hour", "chart_cost_by_source_and_day"])
def test_requests_answered_without_tokens(spark, tmp_path, name):
    data, db = events(tmp_path, """select * replace (CASE WHEN event_id%4=1 THEN 0 ELSE value END AS value, CASE WHEN event_id%4=1 THEN '{"k": 0}' ELSE props END AS props) from e""")
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(db.execute(ORACLE_SQL[name]).df())


def test_tokens_decide_if_nothing_else_does(spark):
    sums = "0 input_tokens, 0 output_tokens, 0 cache_read_tokens, 0 cache_write_tokens, 0.0D cost"
    asked = spark.sql(f"select date'2024-01-01' day, 1 hour, 's' source, 'm' model, total_tokens, {sums}, status, 'chat' kind from values (5, 200), (0, 200), (0, 500) as (total_tokens, status)")
    assert [(r.total_tokens, r.calls, r.errors) for r in gateway_views.judged(asked).orderBy("errors").collect()] == [(5, 1, 0), (0, 1, 1)]


def test_more_people_than_a_state_with_marks_holds(spark, tmp_path):
    data, db = events(tmp_path, "select e.* replace (event_id + 1000*i AS event_id, event_id + 1000*i AS user_id) from e, range(60) r(i)")
    assert rows(QUERIES["pinned_folders"](spark, data).toPandas()) == rows(db.execute(ORACLE_SQL["pinned_folders"]).df())


def test_deep_values_are_found_within_rows(spark):
    texts = ['{"a": {"cwd": "x", "n": 2}, "cwd": "y"}', '{"cwd": "b", "n": [[{"n": 5}]]}', '[[{"n": 1.5}, {"n": 2}]]']
    df = spark.createDataFrame([(1, t) for t in texts], "key long, j string")
    found, numbers = deepfind.deep_string(df, "key", "j", ["cwd"]), deepfind.deep_number(df, "key", "j", ["n"])
    assert sorted(r.text for r in found.collect()) == ["", "b", "x"] and sorted(r.number for r in numbers.collect()) == [0, 2, 4]
    assert not any("Exchange" in d._jdf.queryExecution().executedPlan().toString() for d in (found, numbers))


def test_no_task_has_the_whole_board(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        u, p = surrogate.daily_facts(spark, DATA).withColumn("participant_id", F.col("workdir_id")), spark.range(40).select(F.col("id").alias("participant_id"), F.lit("same").alias("nickname"))
        board = reports.full_board(u, p).select("participant_id", "total_tokens", "rank", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.participant_id for r in sorted(board, key=lambda r: r.rank)] == [r.participant_id for r in sorted(board, key=lambda r: (-r.total_tokens, r.participant_id))]
    assert len(board) == 40 and len({r.task for r in board}) > 3
