"""Two-pass external shuffle into shards (operator 8).

Pass 1 scatters the records into memory-sized buckets by a seeded hash of (id, text); pass 2 shuffles each bucket
in memory by Fisher-Yates with a generator seeded by (seed, bucket). The buckets in order are one random
permutation of the records; position p goes to shard ``p % shards`` as slot ``p // shards``, so shard sizes differ by
one row at most (the ``rows`` law) and slots have no gaps. The same seed and rows give the same shards.

Groups of equal texts scatter like any other rows, since the id is part of the hash. The number of shuffle partitions
doesn't grow with that of the buckets: a partition takes many of them, Spark's sort (which spills) puts its rows in the order
of their buckets, and a task holds one bucket at a time. Rows and the first positions of buckets are dealt alike, so the rows
are shuffled once. ``keep`` names what travels with a row where the whole record isn't asked for.

Rows that repeat id and text share a hash. Where a bucket is more than twice as large as it should be, the hashes in it that
alone fill a bucket are found, their rows are stored with a number each, and scatter by hash and number. Such hashes are at
most as many as buckets; which of the repeated rows gets which of their places follows from how they were stored.

Defined results: null ids and texts hash as such; whole repeated rows are interchangeable; an empty table gives no rows;
extra columns pass through, but for those called size, shard or slot, in whose place the results come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions, table

BUCKET_BYTES = 16 << 20
#: Bytes of texts in a shuffle partition, about: 50,000 partitions at 100 TB.
PARTITION_BYTES = 2 << 30
SHARDS = 8
SEED = 20240229
#: Buckets that share one partial sum of offsets, so that no task sums more than this many or one row per such run.
RUN = 4096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n): numpy's ``shuffle`` is the Fisher-Yates exchange."""
    order = np.arange(n)
    np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, bucket]))).shuffle(order)
    return order


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, n) to (bucket, first position of the bucket), by sums within runs of buckets and over the runs."""
    from pyspark.sql import Window

    run = (F.col("__bucket") / RUN).cast("long")
    within = counts.withColumn("__run", run).withColumn("__in", F.sum("n").over(Window.partitionBy("__run").orderBy("__bucket")) - F.col("n"))
    runs = counts.groupBy(run.alias("__run")).agg(F.sum("n").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__run")) - F.col("n"))
    return within.join(runs.select("__run", "__before"), "__run").select("__bucket", (F.col("__before") + F.col("__in")).alias("__first"))


def _counts(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("__bytes")), "bucket-counts")


def _spread(rows: DataFrame, counts: DataFrame, buckets: int, seed: int, bucket_bytes: int) -> DataFrame | None:
    """``rows`` with those of hashes that alone fill a bucket dealt one by one; None if there are no such hashes."""
    heavy = counts.where((F.col("__bytes") > 2 * bucket_bytes) & (F.col("n") > 1)).select("__bucket")
    if not heavy.limit(1).count():
        return None
    keys = rows.join(heavy, "__bucket", "left_semi").groupBy("__key").agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("n"))
    keys = materialize(keys.where((F.col("__bytes") > bucket_bytes) & (F.col("n") > 1)).select("__key"), "repeated")
    if not keys.limit(1).count():
        return None
    few = F.broadcast(keys)  # each alone fills a bucket: at most as many as buckets, 8 bytes each
    numbered = materialize(rows.join(few, "__key", "left_semi").withColumn("__number", F.monotonically_increasing_id()), "numbered")
    key = F.xxhash64(F.lit(seed), "__key", "__number")
    dealt = numbered.withColumn("__key", key).withColumn("__bucket", F.pmod("__key", F.lit(buckets))).drop("__number")
    return rows.join(few, "__key", "left_anti").unionByName(dealt)


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """All rows of ``docs``, with all columns or those of ``keep``, and size (UTF-8 bytes of the text plus 1), shard int
    and slot long."""
    spark, docs = docs.sparkSession, docs.drop("size", "shard", "slot")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(-(-total // bucket_bytes), 4 * partitions(spark))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))
    carried = docs.select(*(keep or ["*"]))
    rows = docs.select(*(keep or ["*"]), size.alias("__size"), key.alias("__key")).withColumn("__bucket", F.pmod("__key", F.lit(buckets)))
    counts = _counts(rows)
    spread = _spread(rows, counts, buckets, seed, bucket_bytes)
    if spread is not None:
        rows, counts = spread, _counts(spread)
    tasks = max(partitions(spark), -(-total // PARTITION_BYTES))
    # both sides dealt alike, merged where they stand: no second shuffle of the rows for their groups
    placed = rows.repartition(tasks, "__bucket").join(_offsets(counts).repartition(tasks, "__bucket").hint("merge"), "__bucket")
    fields = [*carried.schema.fields, T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    names = carried.columns

    def shuffled(bucket: pa.Table) -> pa.Table:
        bucket = bucket.take(pc.sort_indices(bucket, [("__key", "ascending")]))
        bucket = bucket.take(pa.array(fisher_yates(bucket.num_rows, seed, bucket["__bucket"][0].as_py())))
        position = bucket["__first"][0].as_py() + np.arange(bucket.num_rows, dtype=np.int64)
        columns = [bucket[c] for c in names] + [bucket["__size"], pa.array((position % shards).astype(np.int32)), pa.array(position // shards)]
        return pa.table(columns, names=[f.name for f in fields])

    return placed.groupBy("__bucket").applyInArrow(shuffled, T.StructType(fields))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder a shard, its files in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row of ``documents`` in 8 shards; the texts stay where they are."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    placed = shuffle_shards(table(spark, sf_dir, "documents"), keep=[F.col("doc_id"), crc])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
