"""Continuous forms of the log and extraction operators.

Each is stateless, a built-in stateful aggregation, or a keyed state machine with event-time timers: state lives in
Spark's state store, is dropped when the watermark passes it, and survives executor loss.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from hiresift import vocab as V
from hiresift.operators import extract as ex
from hiresift.operators import funnel
from hiresift.session import checkpoint_dir, materialize, ship


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as they arrive; by default all that are there make one batch."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (source if files_per_batch is None else source.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def stream_extract_terms(postings: DataFrame, *, vocab: V.Vocabulary = V.DEFAULT, top_n: int = 40) -> DataFrame:
    """Keywords of arriving postings; extraction is per row, so there is no state at all."""
    return ex.jd_keywords(postings, top_n=top_n, alternatives=False, vocab=vocab)


def stream_dedup_postings(postings: DataFrame, *, ts: str = "ts", text: str = "jd_text", delay: str = "30 days") -> DataFrame:
    """First arrival of each posting text; a hash is remembered until the watermark passes it."""
    hashed = postings.withColumn("content_hash", F.sha2(F.col(text), 256))
    return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])


def stream_latest_outcome(events: DataFrame, key: str = "app_id", *, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events as versions for an upsert sink: the last outcome and the last note each bring the order they hold at.

    Stateless: which version is newest is settled where versions are stored (`run_upsert`), so no state grows with keys.
    """
    order = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    return funnel.valid_events(events).select(
        key, "outcome", order.alias("outcome_at"), "notes", F.when(F.col("notes").isNotNull(), order).alias("notes_at"))


def newest_outcome(versions: DataFrame, key: str = "app_id") -> DataFrame:
    """One version per key out of several, in any order of arrival: max-style aggregates that combine before the shuffle."""
    return versions.groupBy(key).agg(
        F.max_by("outcome", "outcome_at").alias("outcome"), F.max("outcome_at").alias("outcome_at"),
        F.max_by("notes", "notes_at").alias("notes"), F.max("notes_at").alias("notes_at"))


class GhostTimer(StatefulProcessor):
    """Per application its last outcome and when; a timer in event time fires `days` after it.

    A key that speaks again after its silence has begun a new run: the old one is closed first, whether its timer has
    fired or not.  What is remembered goes when a run closes, so state holds open runs only.
    """

    def __init__(self, days: int):
        self.silence = days * 86_400_000_000  # times are whole microseconds: no clock's zone takes part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "outcome string, us long, tie long")

    def _closed(self, key: tuple, outcome: str, us: int) -> Row:
        return Row(key=key[0], us=us, outcome="ghosted" if outcome == "pending" else outcome)

    def _timer(self, us: int) -> int:
        return -(-(us + self.silence) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - the API's names
        known = tuple(self.last.get()) if self.last.exists() else None
        before = known[1] if known else None
        for row in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
            if known and row["us"] - known[1] > self.silence:
                yield self._closed(key, known[0], known[1])
                known = None
            if known is None or (row["us"], row["event_id"]) > known[1:]:
                known = (row["outcome"], row["us"], row["event_id"])
        if before != known[1]:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(known[1]))
        self.last.update(known)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        outcome, us, _ = self.last.get()
        self.last.clear()
        yield self._closed(key, outcome, us)

    def close(self) -> None:
        pass


def stream_ghost_timeout(events: DataFrame, *, key: str = "app_id", ts: str = "ts", days: int = 45, delay: str = "1 day") -> DataFrame:
    """Append-mode stream of runs of events that fell silent: `days` after its last event a run closes, as ghosted when
    that was still pending.  Timers fire by the watermark, between batches as well as with them."""
    ship(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), "event_id", "outcome").withWatermark("ts", delay)
    closed = rows.groupBy("key").transformWithState(GhostTimer(days), f"key {dict(events.dtypes)[key]}, us long, outcome string", "append", "eventTime")
    last = F.timestamp_micros("us")
    return closed.select(F.col("key").alias(key), last.alias("last_ts"), (last + F.make_dt_interval(F.lit(days))).alias("closed_at"), "outcome")


def stream_funnel_tumbling(events: DataFrame, *, ts: str = "ts", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Append-mode daily conversion counts with Wilson bounds; rows later than the watermark are dropped."""
    daily = funnel.counts(funnel.resolved(events).withWatermark(ts, delay), F.window(ts, width).alias("w"))
    return funnel.with_rate(daily).select(F.col("w.start").alias("day"), "n", "reached_human", "conversion_pct", "ci_low", "ci_high")


def stream_candidate_counts(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Complete-mode running counts of terms outside a static vocabulary."""
    return terms.join(known.select("term").distinct(), "term", "left_anti").groupBy("term").agg(F.count("*").alias("count"))


# ------------------------------------------------------------------ runs

#: keyed state of any size is kept on disk by this store; transformWithState needs it
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class Place:
    """Where a run keeps its output and its progress; runs of the same place go on where the last one stopped."""

    out: str
    state: str


def place(spark: SparkSession, name: str) -> Place:
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return Place(f"{base}/out", f"{base}/state")


def _drain(writer) -> StreamingQuery:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_append(stream: DataFrame, name: str, at: Place | None = None) -> DataFrame:
    """Drain what has arrived into a parquet folder and return it."""
    spark = stream.sparkSession
    at = at or place(spark, name)
    _drain(stream.writeStream.format("parquet").option("path", at.out).option("checkpointLocation", at.state))
    return spark.read.schema(stream.schema).parquet(at.out)


def run_stateful(stream: DataFrame, name: str, at: Place | None = None) -> DataFrame:
    """run_append with the state store on disk."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return run_append(stream, name, at)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_keyed(stream: DataFrame, name: str, key: str, mode: str = "update") -> DataFrame:
    """Drain an update- or complete-mode stream; each batch is written under its id, so a replayed batch
    overwrites itself, and the newest row per key is returned."""
    at = place(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{at.out}/batch={batch_id}")

    _drain(stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", at.state))
    written = stream.sparkSession.read.parquet(at.out).drop("batch")
    fields = [F.col(c) for c in stream.columns if c != key]
    return written.groupBy(key).agg(F.max_by(F.struct(*fields), "batch_id").alias("s")).select(key, "s.*")


class UpsertTable:
    """A keyed table in hash buckets, each in versions: a batch rewrites only the buckets that it touches.

    Version `v` holds the buckets that batch `v` touched, written from the newest versions before it, so a batch that
    runs again writes the same files again.  Rows of a key are merged by `newest`, which must not mind their order.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType, newest: Callable[[DataFrame], DataFrame], buckets: int):
        self.spark, self.folder, self.key, self.schema, self.newest, self.buckets = spark, folder, key, schema, newest, buckets

    def _found(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        return [x.getPath().toString() for x in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []]

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> its newest committed version, of those before a batch."""
        whole = {int(re.search(r"version=(\d+)/", p)[1]) for p in self._found("version=*/_SUCCESS")}
        out: dict[int, int] = {}
        for path in self._found("version=*/bucket=*"):
            version, bucket = map(int, re.search(r"version=(\d+)/bucket=(\d+)", path).groups())
            if version in whole and (before is None or version < before) and version > out.get(bucket, -1):
                out[bucket] = version
        return out

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = materialize(self.newest(batch), "upsert")
        touched = {r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()}  # no more than there are buckets
        held = {b: v for b, v in self.versions(batch_id).items() if b in touched}
        merged = self.newest(rows.unionByName(self._read(held))).select(*self.schema.names, bucket.alias("bucket"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/version={batch_id}")

    def read(self) -> DataFrame:
        return self._read(self.versions())


def run_upsert(stream: DataFrame, name: str, key: str, newest: Callable[[DataFrame], DataFrame], *, buckets: int = 16, at: Place | None = None) -> DataFrame:
    """Drain a stream of versions into an upsert table and return the table."""
    at = at or place(stream.sparkSession, name)
    table = UpsertTable(stream.sparkSession, at.out, key, stream.schema, newest, buckets)
    _drain(stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", at.state))
    return table.read()
