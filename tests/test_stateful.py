"""Ledger of receipts and process state: same rows as the batch, whatever the order; capacity refuses and recovers."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vigilframe.operators import correlation
from vigilframe.streaming import ingest, stateful

ROWS = "host string, guid string, kind string, ts double"
DAY = 86400.0


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def files(spark, tmp_path, parts, schema=ROWS):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"file:{tmp_path}/in/{k}")
    return spark.readStream.schema(schema + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file:{tmp_path}/in/*")


def correlated(spark, tmp_path, stream, **more):
    ingest.run_once(stateful.correlate(stream, **more), f"file:{tmp_path}/out", f"file:{tmp_path}/check").awaitTermination()
    return sorted((r.host, r.guid, r.created, r.network_ts) for r in spark.read.parquet(f"file:{tmp_path}/out").collect())


@pytest.mark.parametrize("seed", range(3))
def test_any_order_gives_the_batch(spark, tmp_path, seed):
    """Rows of one day in any order over three files, then a late row that closes the day."""
    rng = random.Random(seed)
    rows = [(f"h{rng.randrange(2)}", f"g{rng.randrange(8)}", rng.choice([None, "ip", "domain"]), float(rng.randrange(2000))) for _ in range(150)]
    parts = [rows[k::3] for k in range(3)] + [[("end", "end", None, 3 * DAY)]]
    got = correlated(spark, tmp_path, files(spark, tmp_path, parts))
    frame = spark.createDataFrame(rows, ROWS)
    creates = frame.where("kind IS NULL").groupBy("host", "guid").agg(F.min("ts").alias("created"))
    want = correlation.attribute_network(creates, frame.where("kind IS NOT NULL"), ["host", "guid"])
    assert got == sorted((r.host, r.guid, r.created, r.network_ts) for r in want.collect()) and got


def test_many_waiting_events_of_one_process(spark, tmp_path):
    """100,000 network events wait for their start; once it is there only those before it stay."""
    waiting = spark.range(100_000).select(F.lit("h").alias("host"), F.lit("g").alias("guid"), F.lit("ip").alias("kind"), (F.col("id") / 2).alias("ts"))
    last = [[("h", "g", None, 30_000.25)], [("end", "end", None, 3 * DAY)]]
    for k, part in enumerate([waiting, *[spark.createDataFrame(p, ROWS) for p in last]]):
        part.withColumn("at", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"file:{tmp_path}/in/{k}")
    stream = spark.readStream.schema(ROWS + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file:{tmp_path}/in/*")
    assert correlated(spark, tmp_path, stream) == [("h", "g", 30_000.25, 30_000.5)]
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"file:{tmp_path}/check")
    assert state.where("key.guid = 'g'").count() == 0


def test_processes_are_forgotten(spark, tmp_path):
    parts = [[("h", "g", "ip", 10.0)], [("end", "end", None, 9 * DAY)], [("end", "end", None, 10 * DAY)], [("h", "g", None, 10 * DAY), ("h", "g", "ip", 10 * DAY + 1)], [("end", "end", None, 15 * DAY)]]
    assert correlated(spark, tmp_path, files(spark, tmp_path, parts)) == [("h", "g", 10 * DAY, 10 * DAY + 1)]
    state = spark.read.format("statestore").option("stateVarName", "facts").load(f"file:{tmp_path}/check")
    assert {r.key.guid for r in state.collect()} == {"g", "end"}


RECEIVED = "event_id long, ts double, collected_at double"


def received(spark, tmp_path, capacity):
    stream = spark.readStream.schema(RECEIVED + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file:{tmp_path}/in/*")
    stateful.receive(stream, f"file:{tmp_path}/out", f"file:{tmp_path}/check", f"file:{tmp_path}/ledger", ["event_id"], capacity).awaitTermination()
    return sorted((r.event_id, r.ts) for r in spark.read.parquet(f"file:{tmp_path}/out").collect())


def test_each_receipt_once_by_the_time_of_reception(spark, tmp_path):
    hour = 3600.0
    files(spark, tmp_path, [[(1, 5.0, hour), (1, 4.0, hour), (2, 1.0, hour)], [(2, 9.0, 2 * hour), (3, 0.0, 2 * hour)], [(1, 7.0, 60 * hour), (3, 8.0, 50 * hour)]], RECEIVED)
    # after 58 hours the first receipts are past their time, those of the second hour too
    assert received(spark, tmp_path, 100) == [(1, 4.0), (1, 7.0), (2, 1.0), (3, 0.0), (3, 8.0)]
    assert stateful.forget(spark, f"file:{tmp_path}/ledger", 60 * hour) == 2


def test_a_full_ledger_refuses(spark, tmp_path):
    """Nothing of the batch is written; with more room it arrives whole."""
    files(spark, tmp_path, [[(k, 1.0, 10.0) for k in range(6)], [(k, 2.0, 20.0) for k in range(4, 9)]], RECEIVED)
    with pytest.raises(StreamingQueryException, match="don't fit"):
        received(spark, tmp_path, 10)
    assert spark.read.parquet(f"file:{tmp_path}/out").count() == 6
    assert [r[0] for r in received(spark, tmp_path, 11)] == list(range(9))
