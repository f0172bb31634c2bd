"""Structured Streaming jobs over observations: landing, deduplication and windows. Process correlation is in ``stateful``.

Streaming frames have the columns of an observation with ``at`` (timestamp of the event). The collection clock comes with
the data (``collected_at``); nothing reads the wall clock, so a replay gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import summaries
from ..operators.correlation import admission

SHARDS = 4
#: Files of a lane and shard in one batch, at most.
SPREAD = 64


def shard(host: str = "host", shards: int = SHARDS):
    """The shard of a host: stable, so that a host's records keep their order within it."""
    return F.pmod(F.conv(F.substring(F.sha2(F.col(host), 256), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def deduplicate(stream: DataFrame, key: list[str], ttl: str = "48 hours", at: str = "at") -> DataFrame:
    """One row of each key; keys are forgotten when the watermark has passed them by ``ttl``."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(key)


def tumbling_windows(stream: DataFrame, lateness: str = "2 hours", at: str = "at", keys: tuple[str, ...] = ("host", "app", "location", "kind")) -> DataFrame:
    """Events per key and half hour, and the estimate of distinct values, emitted when the watermark closes the window.

    The estimate is the batch's: the first aggregation keeps the largest rank of each register (state of at most 256 rows a
    window and key, merged on the map side), the second one turns the registers of a closed window into the estimate.
    """
    rows = stream.where(F.col("kind").isNotNull()).withColumn("bucket", F.coalesce(summaries.bucket(F.col("value")), F.lit(-1))).withWatermark(at, lateness)
    parts = rows.groupBy(F.window(at, "30 minutes").alias("w"), *keys, "bucket").agg(F.max(summaries.rank(F.col("value"))).alias("rank"), F.count(F.lit(1)).alias("n"))
    full = F.col("bucket") >= 0
    sums = parts.groupBy("w", *keys).agg(F.sum("n").alias("n"), F.count_if(full).alias("used"), F.coalesce(F.sum(F.when(full, F.pow(F.lit(2.0), -F.col("rank")))), F.lit(0.0)).alias("s"))
    zero = summaries.REGISTERS - F.col("used")
    return sums.select(F.col("w.start").alias("start"), *keys, "n", F.when(F.col("used") > 0, summaries.estimate(F.col("s") + zero, zero)).alias("distinct_estimate"))


def land(stream: DataFrame, path: str, checkpoint: str, ledger: str, baseline_days: int = 28):
    """Lands micro-batches as Parquet by lane and shard: ``live`` within a day of the collection clock, else ``backfill``.

    A batch's number is part of its folder, so a batch that is replayed after a failure overwrites itself; ``ledger``
    gets the counts of what was admitted.
    """

    def write(batch: DataFrame, number: int) -> None:
        clock = batch.agg(F.max("collected_at")).first()[0]
        if clock is None:
            return
        labelled = admission(batch, float(clock), baseline_days).withColumn("shard", shard())
        kept = labelled.where(F.col("admission").isin("live", "historical")).withColumn("lane", F.when(F.col("admission") == "live", "live").otherwise("backfill"))
        spread = F.pmod(F.xxhash64("host"), F.lit(SPREAD))  # a host's records stay together, a shard's go to several files
        kept.drop("admission").repartition("lane", "shard", spread).sortWithinPartitions("lane", "shard", "ts", F.col("kind").isNotNull()).write.mode("overwrite").partitionBy("lane", "shard").parquet(f"{path}/batch={number}")
        labelled.groupBy("admission").agg(F.count(F.lit(1)).alias("n")).withColumn("clock", F.lit(float(clock))).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(result: DataFrame, path: str, checkpoint: str):
    """Everything that has arrived, as Parquet files with exactly-once commits."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
