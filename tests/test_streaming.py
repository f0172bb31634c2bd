"""Streams give what the same rows give in a batch."""

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import summaries
from vigilframe.sources.observations import novelty_view
from vigilframe.streaming import ingest

SCHEMA = "event_id long, host string, guid string, app string, location string, kind string, value double, ts double, collected_at double, at timestamp"


@pytest.fixture(scope="module")
def source(spark, sf_dir, tmp_path_factory):
    """Events in order of time, three files, each event twice."""
    folder = f"file:{tmp_path_factory.mktemp('source')}/rows"
    rows = novelty_view(spark, sf_dir).select("event_id", "host", F.col("k").cast("string").alias("guid"), "app", "location", F.when(F.col("event_type") == "purchase", "ip").alias("kind"), "value", "ts", F.lit(1706659200.0).alias("collected_at"), F.timestamp_seconds("ts").alias("at"))
    for k, part in enumerate(((0, 19733), (19733, 19743), (19743, 99999))):
        day = rows.where((F.floor(F.col("ts") / 86400) >= part[0]) & (F.floor(F.col("ts") / 86400) < part[1]))
        day.union(day).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{k}")
    return f"{folder}/*"


def stream(spark, source):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)


def run(spark, tmp_path, frame):
    ingest.run_once(frame, f"file:{tmp_path}/out", f"file:{tmp_path}/check").awaitTermination()
    return spark.read.parquet(f"file:{tmp_path}/out")


def test_each_event_once(spark, source, tmp_path):
    got = run(spark, tmp_path, ingest.deduplicate(stream(spark, source), ["event_id"], "60 days"))
    assert got.count() == got.select("event_id").distinct().count() == spark.read.schema(SCHEMA).parquet(source).select("event_id").distinct().count()


def test_windows_equal_the_batch(spark, source, tmp_path):
    """Counts and distinct estimates of all windows that the watermark has closed."""
    keys = ["host", "app", "location", "kind", "start"]
    got = {tuple(r[k] for k in keys): (r.n, r.distinct_estimate) for r in run(spark, tmp_path, ingest.tumbling_windows(stream(spark, source), "1 hour")).withColumn("start", F.unix_seconds("start")).collect()}
    rows = spark.read.schema(SCHEMA).parquet(source).where("kind IS NOT NULL").withColumn("start", summaries.window_start(F.col("ts")))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(summaries.estimates(summaries.registers(rows, keys, "value"), keys), keys)
    want = {tuple(r[k] for k in keys): (r.n, r.distinct_estimate) for r in counted.collect()}
    closed = {k: v for k, v in want.items() if k[-1] < max(k[-1] for k in want) - 7200}
    assert got.items() <= want.items() and closed.items() <= got.items() and len(closed) > 50


def test_landing_by_lane_and_shard(spark, source, tmp_path):
    ingest.land(stream(spark, source), f"file:{tmp_path}/land", f"file:{tmp_path}/check", f"file:{tmp_path}/ledger").awaitTermination()
    landed = spark.read.option("basePath", f"file:{tmp_path}/land").parquet(f"file:{tmp_path}/land/*")
    ledger = {r.admission: r.n for r in spark.read.parquet(f"file:{tmp_path}/ledger/*").groupBy("admission").agg(F.sum("n").alias("n")).collect()}
    assert landed.where("lane = 'live'").count() == ledger["live"] and landed.where("lane = 'backfill'").count() == ledger["historical"]
    assert len(landed.inputFiles()) > 8
    assert landed.groupBy("host", F.input_file_name().alias("f"), "lane", "batch").count().groupBy("host", "lane", "batch").count().where("count > 1").count() == 0
    assert landed.groupBy("host").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
