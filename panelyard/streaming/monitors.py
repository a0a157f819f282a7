"""Structured Streaming operators: finalisation after a stable interval, snapshot ingest, late guard, de-duplication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STABLE_MINUTES = 15


def finalized(observations: pd.DataFrame, first: tuple | None, minutes: int = STABLE_MINUTES) -> tuple[tuple | None, tuple | None]:
    """One key's observations in time order after the state first (time, digest): the new state, and what became final.

    A ready observation starts or keeps a wait; a changed digest or an unready observation starts over; an
    observation older than the one kept replaces it.
    """
    for at, ready, digest in zip(observations["observed_at"], observations["ready"], observations["digest"], strict=True):
        if not ready:
            first = None
        elif first is None or first[1] != digest or first[0] > at:
            first = (at, digest)
        elif at >= first[0] + pd.Timedelta(minutes=minutes):
            return first, (first[0], at, digest)
    return first, None


#: What transformWithState keeps its state in.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Finalizer(StatefulProcessor):
    """One key's wait for a digest that stays ready; the key's state is gone once the watermark is retention past its last observation."""

    def __init__(self, key: str, minutes: int, retention: pd.Timedelta) -> None:
        self.key, self.minutes, self.retention = key, minutes, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", "first_at bigint, digest string, done boolean, last_at bigint")  # microseconds

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, done, last = None, False, 0
        if self.wait.exists():
            at, digest, done, last = self.wait.get()
            first = (pd.Timestamp(at, unit="us"), digest) if digest is not None else None
        own = pd.DataFrame([(r.at_us, r.ready, r.digest) for r in rows], columns=["at_us", "ready", "digest"])
        own["observed_at"] = pd.to_datetime(own["at_us"], unit="us")
        final = None
        if not done:
            first, final = finalized(own.sort_values(["observed_at", "digest"], kind="stable"), first, self.minutes)
        last = max(last, int(own["at_us"].max()))
        micros = lambda t: t.value // 1000
        self.wait.update((micros(first[0]) if first else None, first[1] if first else None, done or final is not None, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.retention // pd.Timedelta("1ms"))
        if final:
            yield Row(**{self.key: key[0], "first_us": micros(final[0]), "final_us": micros(final[1]), "digest": final[2]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.wait.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_finalization(stream: DataFrame, key: str = "target", minutes: int = STABLE_MINUTES, retention: str = "60 days", delay: str = "1 hour") -> DataFrame:
    """key, first_seen, final_at, digest: emitted once per key when the same digest has stayed ready for minutes.

    stream: key (string), observed_at (timestamp), ready, digest; rows without a time are left out. A key's observations come in order of time from batch to batch;
    inside a batch they are put in the order of batch_finalization, since files have none. Observations more than delay older than
    the newest one of earlier batches are late and dropped. retention has to be longer than any two observations of a
    key lie apart: that long after its last one a key leaves the state, finished or not, so the state holds
    recent keys only. The session needs the state store ROCKSDB.
    """
    ready = stream.where("observed_at is not null").withColumn("at_us", F.unix_micros("observed_at")).withWatermark("observed_at", delay)
    processor = Finalizer(key, minutes, pd.Timedelta(retention))
    found = ready.groupBy(key).transformWithState(processor, f"{key} string, first_us bigint, final_us bigint, digest string", "Append", "EventTime")
    return found.select(key, F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("final_us").alias("final_at"), "digest")


def batch_finalization(df: DataFrame, key: str = "target", minutes: int = STABLE_MINUTES) -> DataFrame:
    """The batch twin: runs of equal ready digests in time order, the first run that lasts long enough."""
    w = Window.partitionBy(key).orderBy("observed_at", "digest")
    same = F.col("ready") & F.coalesce(F.lag("ready").over(w), F.lit(False)) & F.col("digest").eqNullSafe(F.lag("digest").over(w))
    runs = df.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w)).where("ready")
    start = F.min("observed_at").over(Window.partitionBy(key, "_run"))
    late = runs.withColumn("first_seen", start).where(F.col("observed_at") >= F.col("first_seen") + F.expr(f"interval {minutes} minutes"))
    return late.groupBy(key).agg(F.min(F.struct("observed_at", "first_seen", "digest")).alias("_f")).select(key, "_f.first_seen", F.col("_f.observed_at").alias("final_at"), "_f.digest")


def stream_snapshot_ingest(spark: SparkSession, path: str, schema: StructType | str, required: Sequence[str], clean: str, quarantine: str, checkpoint: str):
    """A query that appends new JSON files' good rows to clean and the others to quarantine; the checkpoint resumes it."""
    rows = spark.readStream.schema(schema).json(path)
    good = F.lit(True)
    for c in required:
        good = good & F.col(c).isNotNull()

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        df.where(good).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{clean}/batch={batch}")
        df.where(~good).write.mode("overwrite").parquet(f"{quarantine}/batch={batch}")
        df.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_late_guard(df: DataFrame, time: str, deadline: str) -> DataFrame:
    """usable says whether a record's time lies before its target's deadline; works on streams and tables."""
    return df.withColumn("usable", F.coalesce(F.col(time) < F.col(deadline), F.lit(False)))


def stream_dedup(stream: DataFrame, keys: Sequence[str], digest: str, time: str, delay: str) -> DataFrame:
    """Exact repeats inside the watermark dropped; rows of one key with another digest stay, for a conflict check."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, digest])


def key_conflicts(df: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Keys that came with more than one digest."""
    return df.groupBy(*keys).agg(F.count_distinct(digest).alias("variants")).where("variants > 1")
