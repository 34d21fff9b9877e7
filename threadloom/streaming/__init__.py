"""Structured Streaming: sessions, keyed state, deduplication and incremental sync."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import joins

HISTORY_OUT = "user_id long, turns int, last_question string"


def sessions(events: DataFrame, key: str, ts: str, gap: str = "48 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream by pauses; an event exactly at the gap stays in the session."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w).agg(F.count("*").alias("events"), F.min(ts).alias("begin_ts"), F.max(ts).alias("end_ts")).drop("session_window")


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, ts: str, length: str, step: str | None, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, step), *keys).agg(F.count("*").alias("n"))


class History(StatefulProcessor):
    """A user's last turns with answers cut, forgotten after a pause; a question '/reset' clears them."""

    def __init__(self, most: int = 10, chars: int = 600, ttl_ms: int = 3_600_000):
        self.most, self.chars, self.ttl_ms = most, chars, ttl_ms

    def init(self, handle) -> None:
        self.turns = handle.getListState("turns", "question string, answer string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        held = list(self.turns.get()) if self.turns.exists() else []
        for pdf in rows:
            for r in pdf.sort_values("ts").itertuples():
                if r.question == "/reset":
                    held = []
                    continue
                answer = r.answer or ""
                held.append((r.question, answer if len(answer) <= self.chars else answer[: self.chars] + "…"))
        held = [tuple(x) for x in held[-self.most :]]
        if held:
            self.turns.put(held)
        elif self.turns.exists():
            self.turns.clear()
        yield pd.DataFrame({"user_id": [key[0]], "turns": [len(held)], "last_question": [held[-1][0] if held else None]})

    def close(self) -> None:
        pass


class RatingGate(StatefulProcessor):
    """Lets a user's question pass unless the last answer still waits for its rating from 1 to 10."""

    def init(self, handle) -> None:
        self.open = handle.getValueState("waiting", "waiting boolean")

    def handleInputRows(self, key, rows, timer_values):
        waiting = bool(self.open.get()[0]) if self.open.exists() else False
        passed = blocked = rated = 0
        for pdf in rows:
            for r in pdf.sort_values("ts").itertuples():
                if r.kind == "rate":
                    rated += waiting
                    waiting = False
                elif waiting:
                    blocked += 1
                else:
                    passed, waiting = passed + 1, True
        self.open.update((waiting,))
        yield pd.DataFrame({"user_id": [key[0]], "passed": [passed], "blocked": [blocked], "rated": [rated]})

    def close(self) -> None:
        pass


def history(turns: DataFrame, most: int = 10, chars: int = 600, ttl_ms: int = 3_600_000) -> DataFrame:
    """(user_id, turns, last_question) after each batch of (user_id, question, answer, ts). Needs the RocksDB state store."""
    return turns.groupBy("user_id").transformWithStateInPandas(History(most, chars, ttl_ms), HISTORY_OUT, "Update", "ProcessingTime")


def rating_gate(actions: DataFrame) -> DataFrame:
    return actions.groupBy("user_id").transformWithStateInPandas(RatingGate(), "user_id long, passed int, blocked int, rated int", "Update", "ProcessingTime")


def clamped(value, low: int = 1, high: int = 20):
    """A preference kept in its range."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append", timeout_s: int = 120) -> DataFrame:
    """Runs a stream over what is there and returns the result table; for tests and backfills."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination(timeout_s)
    finally:
        q.stop()
    return spark.table(name)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sync_batches(manifests: DataFrame, read_points: Callable[[], DataFrame], write_points: Callable[[DataFrame], None], embed: Callable[[DataFrame], DataFrame], key: str = "chunk_id"):
    """A foreachBatch writer: each batch is a whole snapshot; only added and changed rows are embedded, removed ones go."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        old = read_points()
        diff = joins.snapshot_diff(old, batch, key, "content_sha256")
        changed = embed(batch.join(joins.to_upsert(diff).select(key), key, "left_semi"))
        kept = joins.delete_keys(old, diff.where("op = 'removed'"), key)
        write_points(joins.upsert(kept, changed, key))

    return manifests.writeStream.foreachBatch(apply)
