"""The ledger of claimed keys as a stream with state of its own: at most once by sequence number, windows that roll, late buckets.

A round is what arrives for a key at one time (column ``at``). Of a round the rows beyond the last sequence number of earlier rounds
apply, all of them, and then the largest number is the last: a round that is sent again changes nothing, and several
buckets of one round may share a number. Raw tokens count for the lifetime; charged ones count where the bucket's
window is the one that is current at its arrival, and a later window begins at 0. A timer ends a window that nothing follows.

``settled`` gives the same state from a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

#: What a round's rows have besides key_id and at.
NUMBERS = ["seq", "window", "current_window", "window_end_ms", "raw_tokens", "charged_tokens", "requests", "failed"]
STATE = ["last_seq", "used_tokens", "requests", "failed", "window", "window_tokens", "skipped"]
#: State providers that can hold several states and timers for a key.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class KeyLedger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [*STATE, "window_end_ms"]
        self.ledger = handle.getValueState("ledger", ", ".join(f"{c} bigint" for c in self.names))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.ledger.get() if self.ledger.exists() else None
        s = dict(zip(self.names, held, strict=True)) if held else dict.fromkeys(self.names, 0) | {"last_seq": -1, "window": -1}
        most, at = s["last_seq"], None
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):  # the rounds of one batch of one key
            if r["at"] != at:
                s["last_seq"], at = most, r["at"]
            most = max(most, r["seq"])
            if r["seq"] <= s["last_seq"]:
                s["skipped"] += 1
                continue
            s["used_tokens"] += r["raw_tokens"]
            s["requests"] += r["requests"]
            s["failed"] += r["failed"]
            if r["window"] == r["current_window"]:
                if s["window"] != r["window"]:
                    s["window"], s["window_tokens"] = r["window"], 0
                s["window_tokens"] += r["charged_tokens"]
                s["window_end_ms"] = r["window_end_ms"]
        s["last_seq"] = most
        self.ledger.update(tuple(s[c] for c in self.names))
        if s["window_end_ms"] > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(s["window_end_ms"])
        yield Row(key_id=key[0], event="round", **{c: s[c] for c in STATE})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = dict(zip(self.names, self.ledger.get(), strict=True))
        if s["window_tokens"] and s["window_end_ms"] <= expiredTimerInfo.getExpiryTimeInMs():  # else a later window has begun
            s["window_tokens"] = 0
            self.ledger.update(tuple(s[c] for c in self.names))
            yield Row(key_id=key[0], event="window_end", **{c: s[c] for c in STATE})

    def close(self) -> None:
        pass


def key_ledgers(deltas: DataFrame, late_by: str = "10 minutes") -> DataFrame:
    """Updates of each key's ledger (columns of STATE) as a stream; needs the state provider in ``PROVIDER``."""
    out = StructType([StructField("key_id", StringType()), StructField("event", StringType()), *[StructField(c, LongType()) for c in STATE]])
    rows = deltas.select(F.col("key_id").cast("string").alias("key_id"), F.col("at").cast("timestamp").alias("at"), *[F.col(c).cast("long").alias(c) for c in NUMBERS])
    return rows.withWatermark("at", late_by).groupBy("key_id").transformWithState(statefulProcessor=KeyLedger(), outputStructType=out, outputMode="Update", timeMode="EventTime")


def settled(deltas: DataFrame) -> DataFrame:
    """The ledgers after all rounds of a table; windows are numbers that grow with time."""
    order = Window.partitionBy("key_id").orderBy(F.unix_micros(F.col("at").cast("timestamp")))
    before = F.coalesce(F.max("seq").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    rows = deltas.withColumn("__applies", F.col("seq") > before)
    current = F.col("__applies") & (F.col("window") == F.col("current_window"))
    by = rows.groupBy("key_id", F.when(current, F.col("window")).alias("__w")).agg(
        F.max("seq").alias("last_seq"), *[F.coalesce(F.sum(F.when(F.col("__applies"), F.col(c))), F.lit(0)).alias(a) for a, c in (("used_tokens", "raw_tokens"), ("requests", "requests"), ("failed", "failed"))], F.sum("charged_tokens").alias("__charged"), F.count_if(~F.col("__applies")).alias("skipped")
    )
    return by.groupBy("key_id").agg(
        F.max("last_seq").alias("last_seq"), *[F.sum(c).alias(c) for c in ("used_tokens", "requests", "failed")], F.coalesce(F.max("__w"), F.lit(-1)).alias("window"),
        F.coalesce(F.max_by("__charged", "__w"), F.lit(0)).alias("window_tokens"), F.sum("skipped").alias("skipped"),
    )
