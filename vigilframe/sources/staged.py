"""Batches of observations that are kept for analysis with what proves them whole, and their decoding.

A batch is a row: (batch, lane, shard, payload, sha256, size, event_count, processed). The payload is a JSON array; its digest,
its size in bytes and its number of records are taken when it is staged. A batch that isn't what it was is refused as a
whole; ``processed`` records of it are committed already and aren't read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a payload, and records of a batch, at most.
MAXIMUM_BYTES, MAXIMUM_RECORDS = 64 << 20, 5000
#: Fixed value: what a failure says instead of its content.
HINT = "Staged payload validation failed. Check integrity and local worker logs before retry."


def stage(rows: DataFrame, keys: list[str], order: list[str], most: int = MAXIMUM_RECORDS) -> DataFrame:
    """Batches of at most ``most`` rows of one key (lane, shard), in order.

    Rows are numbered within (key, part), where a part is a stable sixty-fourth of a key's hosts, so a hot shard is spread;
    a host's rows keep their order."""
    part = F.pmod(F.xxhash64("host"), F.lit(64)).cast("int")
    numbered = rows.withColumn("__part", part).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1)
    cut = numbered.withColumn("__cut", F.floor(F.col("__n") / most))
    record = F.struct(*[c for c in rows.columns if c not in keys])
    grouped = cut.groupBy(*keys, "__part", "__cut").agg(F.sort_array(F.collect_list(F.struct(F.col("__n").alias("n"), record.alias("r")))).alias("rs"))  # ``most`` rows at most
    payload = F.to_json(F.transform("rs", lambda x: x["r"]))
    batch = F.concat_ws("-", *keys, "__part", "__cut")
    return sealed(grouped.select(batch.alias("batch"), *keys, payload.alias("payload"), F.size("rs").cast("long").alias("event_count")))


def sealed(batches: DataFrame) -> DataFrame:
    """Batches (batch, ..., payload, event_count) with digest, size and a committed offset of 0."""
    return batches.withColumns({"sha256": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long"), "processed": F.lit(0).cast("long")})


def verdict() -> Column:
    """Why a batch is refused; null for one that is whole. Counted without a schema: what the records hold is not looked at."""
    count = F.json_array_length("payload")
    return (
        F.when(F.col("payload").isNull(), "missing_payload")
        .when(F.octet_length("payload") > MAXIMUM_BYTES, "too_large")
        .when(~F.col("sha256").eqNullSafe(F.sha2("payload", 256)), "wrong_digest")
        .when(~F.col("size").eqNullSafe(F.octet_length("payload").cast("long")), "wrong_size")
        .when(count.isNull(), "no_array")
        .when(~F.col("event_count").eqNullSafe(count.cast("long")), "wrong_count")
        .when((F.col("processed") < 0) | (F.col("processed") > F.col("event_count")), "wrong_offset")
    )


def decode(batches: DataFrame, schema: str) -> DataFrame:
    """The records of whole batches from the committed offset on: (batch, offset, columns of ``schema``)."""
    whole = batches.where(verdict().isNull())
    records = whole.select("batch", "processed", F.posexplode(F.from_json("payload", f"array<struct<{schema}>>")).alias("offset", "record"))
    return records.where(F.col("offset") >= F.col("processed")).select("batch", "offset", "record.*")


def failures(batches: DataFrame, clock: float) -> DataFrame:
    """What is told of refused batches: where and why, nothing of their content."""
    bad = batches.withColumn("reason", verdict()).where("reason IS NOT NULL")
    return bad.select("batch", "lane", "shard", "reason", F.lit("decode").alias("stage"), F.col("processed").alias("cursor_before_failure"), F.lit(HINT).alias("hint"), F.lit(True).alias("message_redacted"), F.lit(clock).alias("occurred_at"))


def committed(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches with the offset that a ledger (batch, upto) has for them, those that are done left out."""
    last = ledger.groupBy("batch").agg(F.max("upto").alias("upto"))
    return batches.join(last, "batch", "left").withColumn("processed", F.greatest("processed", F.coalesce("upto", F.lit(0)))).drop("upto").where((F.col("processed") < F.col("event_count")) | verdict().isNotNull())


def land(batches: DataFrame, path: str, ledger: str, schema: str, run: int) -> None:
    """Writes what is left of whole batches and then commits it. A run that failed between the two is repeated under its number
    and overwrites itself, so each record lands once."""
    spark: SparkSession = batches.sparkSession
    decode(batches, schema).write.mode("overwrite").parquet(f"{path}/run={run}")
    done = batches.where(verdict().isNull()).select("batch", F.col("event_count").alias("upto"))
    done.write.mode("overwrite").parquet(f"{ledger}/run={run}")
    spark.catalog.refreshByPath(path)
