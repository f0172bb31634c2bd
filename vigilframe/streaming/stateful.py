"""Streams with state of their own: a ledger of receipts that refuses what it can't hold, and the correlation of processes.

Both give the same rows as the batch operators whatever the order of arrival within the allowed lateness. State of processes
needs the RocksDB state store (``use_rocksdb``), where waiting times lie on disk and are appended without being read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


class CapacityError(RuntimeError):
    """The ledger of receipts is full: the batch isn't committed and arrives again after retention or with more room."""


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


# --- receipts


def receive(stream: DataFrame, path: str, checkpoint: str, ledger: str, key: list[str], capacity: int, ttl_hours: float = 48, received: str = "collected_at"):
    """Rows whose key wasn't received in the last ``ttl_hours``, as Parquet, one of each key (the earliest by ``ts``).

    The age of a receipt is that of its reception (the collection clock that comes with the rows), not of the event. The
    ledger is a folder of receipts (key, received) by micro-batch; a batch that is replayed overwrites its own. Receipts past
    their time don't count; if those that do and the batch's rows are more than ``capacity``, CapacityError stops the
    stream before anything of the batch is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        size, clock = batch.agg(F.count(F.lit(1)), F.max(received)).first()
        if not size:
            return
        known = _receipts(spark, ledger, number, batch.select(*key, F.col(received).cast("double").alias("received")).schema)
        known = known.where(F.col("received") >= clock - ttl_hours * 3600)
        if known.count() + size > capacity:
            raise CapacityError(f"{size} rows don't fit into a ledger of {capacity} receipts; run retention or raise the capacity")
        first = Window.partitionBy(*key).orderBy("ts", *[c for c in ("event_id",) if c in batch.columns])
        fresh = batch.join(known.select(*key).distinct(), key, "left_anti").withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
        written = spark.read.schema(fresh.schema).parquet(f"{path}/batch={number}")
        written.select(*key, F.lit(float(clock)).alias("received")).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _receipts(spark: SparkSession, ledger: str, number: int, schema: StructType) -> DataFrame:
    """What batches before ``number`` have left in the ledger."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch", "long")).option("basePath", ledger).parquet(ledger).where(F.col("batch") < number).drop("batch")


def forget(spark: SparkSession, ledger: str, clock: float, ttl_hours: float = 48) -> int:
    """Deletes the batches of a ledger whose receipts are all past their time; returns how many."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    ages = spark.read.option("basePath", ledger).parquet(ledger).groupBy("batch").agg(F.max("received").alias("last")).where(F.col("last") < clock - ttl_hours * 3600)
    old = [r.batch for r in ages.collect()]  # numbers of batches
    for number in old:
        folder = path(f"{ledger}/batch={number}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(old)


# --- processes

_FOUND = "host string, guid string, created double, network_ts double"


class _Process(StatefulProcessor):
    """State of one process: (created, best, last, timer) and the times of network events that may still become the first."""

    def __init__(self, keep_days: int):
        self.keep = keep_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "created double, best double, done boolean, last long, timer long")
        self.waiting = handle.getListState("waiting", "ts double")

    def _set(self, created: float | None, best: float | None, done: bool, last: int, timer: int, now: int) -> None:
        """Keeps the facts; one timer is set: at the result's own time, or where the process is forgotten."""
        forget = last + self.keep
        wanted = max(now + 1, forget if done or best is None else min(forget, int(best * 1000) + 1))
        if wanted != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.facts.update((created, best, done, last, wanted))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        created, best, done, last, timer = self.facts.get() if self.facts.exists() else (None, None, False, 0, 0)
        starts, times = [], []
        for batch in rows:
            start = batch["kind"].isna()
            starts += batch.loc[start, "ts"].tolist()
            times += batch.loc[~start, "ts"].tolist()
            last = max(last, int(1000 * batch["ts"].max()))
        if not done:
            times = sorted(set(times))
            lowered = bool(starts) and (created is None or min(starts) < created)
            created = min(starts) if lowered else created
            if created is None:
                if times:
                    self.waiting.appendList([(t,) for t in times])
            else:
                kept = [t for (t,) in self.waiting.get()] if lowered else []
                after = [t for t in [*times, *kept] if t >= created]
                best = min([*after, *([] if best is None else [best])], default=None)
                # times before the start matter only if an earlier start arrives; times after the best never do
                before = [(t,) for t in sorted({t for t in [*times, *kept] if t < created})]
                if lowered:
                    self.waiting.clear()
                if before:
                    self.waiting.appendList(before)
        self._set(created, best, done, last, timer, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, best, done, last, timer = self.facts.get()
        now = timerValues.getCurrentWatermarkInMs()
        if best is not None and not done:
            yield pd.DataFrame({"host": [key[0]], "guid": [key[1]], "created": [created], "network_ts": [best]})
            done = True
            self.waiting.clear()
        if now >= last + self.keep:
            self.facts.clear()
            self.waiting.clear()
        else:
            self._set(created, best, done, last, 0, now)

    def close(self) -> None:
        pass


def correlate(stream: DataFrame, lateness: str = "1 day", keep_days: int = 7, at: str = "at") -> DataFrame:
    """Process starts (kind null) with the first network event of the same process at or after them: (host, guid, created,
    network_ts), each process once.

    A pair is emitted once the watermark has passed it, so that nothing earlier can still arrive; starts and network events may
    come in any order within ``lateness``. A process is forgotten ``keep_days`` after its last event.
    """
    keyed = stream.select("host", "guid", "kind", "ts", at).withWatermark(at, lateness).groupBy("host", "guid")
    return keyed.transformWithStateInPandas(_Process(keep_days), _FOUND, "append", "EventTime")
