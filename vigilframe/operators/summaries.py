"""Summaries of observations per host and UTC day, and 30-minute network windows with distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS = 1800
REGISTERS = 256
#: Fixed value: bias correction of the estimate for 256 registers.
ALPHA = 0.7213 / (1 + 1.079 / REGISTERS)


def hosts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("host").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def coverage(obs: DataFrame, kind: str = "event_type") -> DataFrame:
    """Observations per host, day and kind."""
    return obs.groupBy("host", "day", kind).agg(F.count(F.lit(1)).alias("n"))


def behavior_days(obs: DataFrame, cap: int) -> DataFrame:
    """Per host, day and context (app, parent, location): count, first and last time and the first event.

    Of each host's day the ``cap`` contexts that start first are kept, as the store's size bound asks for.
    """
    days = obs.groupBy("host", "day", "app", "parent", "location").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min(F.struct("ts", "event_id")).getField("event_id").alias("sample")
    )
    order = Window.partitionBy("host", "day").orderBy("first_seen", "app", "parent", "location")
    return days.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("rank")


def overflow(obs: DataFrame, cap: int) -> DataFrame:
    """(host, day, contexts, events) that ``behavior_days`` leaves out of the days that have more contexts than the cap."""
    days = obs.groupBy("host", "day", "app", "parent", "location").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"))
    order = Window.partitionBy("host", "day").orderBy("first_seen", "app", "parent", "location")
    over = days.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > cap)
    return over.groupBy("host", "day").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("events"))


def sustained(windows: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Windows (keys, start, value) over the threshold that directly follow one that is, too; a gap breaks the row."""
    order = Window.partitionBy(*keys).orderBy("start")
    over = windows.where(F.col(value) > threshold).withColumn("before", F.lag("start").over(order))
    return over.where(F.col("before") == F.col("start") - WINDOW_SECONDS).drop("before")


def thresholds(windows: DataFrame, keys: list[str], value: str, baseline_days: int = 28, floor: float = 30.0, factor: float = 4.0, least_days: int = 7, least_windows: int = 8) -> DataFrame:
    """(keys, day, days, windows, threshold): for each day with windows (keys, start, value), what counts as unusual by the
    95th percentile of the days before it; only where these are enough."""
    rows = windows.withColumn("day", F.floor(F.col("start") / 86400).cast("int"))
    wanted = rows.select(*keys, "day").distinct()
    # a day's histogram goes to the days that look back on it, so a key's days are summed apart, and on the map side first
    daily = rows.groupBy(*keys, F.col("day").alias("d"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ahead = daily.withColumn("day", F.explode(F.sequence(F.col("d") + 1, F.col("d") + baseline_days))).join(wanted, [*keys, "day"], "left_semi")
    found = ahead.groupBy(*keys, "day").agg(F.size(F.collect_set("d")).cast("long").alias("days"), F.sum("c").alias("windows"), F.percentile("v", F.lit(0.95), F.col("c")).alias("p95"))
    found = found.where((F.col("days") >= least_days) & (F.col("windows") >= least_windows))
    return found.select(*keys, "day", "days", "windows", F.greatest(F.lit(floor), F.col("p95") * factor, F.col("p95") + floor / 2).alias("threshold"))


def bursts(windows: DataFrame, keys: list[str], value: str, **limits: float) -> DataFrame:
    """(keys, start, value, threshold, before): windows over the threshold of their day that directly follow one that is over
    its own, whose start is ``before``. Days without enough history have no threshold and so no bursts."""
    placed = windows.withColumn("day", F.floor(F.col("start") / 86400).cast("int"))
    limit = thresholds(windows, keys, value, **limits).select(*keys, "day", "threshold")
    over = placed.join(limit, [*keys, "day"]).where(F.col(value) > F.col("threshold")).withColumn("before", F.lag("start").over(Window.partitionBy(*keys).orderBy("start")))
    return over.where(F.col("before") == F.col("start") - WINDOW_SECONDS).select(*keys, "start", value, "threshold", "before")


def bucket(value: Column) -> Column:
    """The register of a value's sketch, from the first byte of its digest; null for null."""
    return F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, 2), 16, 10).cast("int")


def rank(value: Column) -> Column:
    """The place of the first set bit in the next 56 bits of the digest."""
    rest = F.conv(F.substring(F.sha2(value.cast("string"), 256), 3, 14), 16, 10).cast("long")
    return F.when(rest == 0, 57).otherwise(57 - F.length(F.bin(rest)))


def estimate(z: Column, zero: Column) -> Column:
    """Distinct values by the sum of 2**-rank of all registers (1 for empty ones) and the number of empty ones: linear
    counting for small sets, no correction for large ones."""
    raw = F.lit(ALPHA * REGISTERS * REGISTERS) / z
    small = REGISTERS * F.log(F.lit(float(REGISTERS)) / F.nullif(zero, F.lit(0)))
    return F.bround(F.when((zero > 0) & (raw <= 640), small).otherwise(raw)).cast("long")


def registers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sketch of each key's distinct values: (keys, bucket, rank); sketches merge by the largest rank of a bucket."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, bucket(F.col(value)).alias("bucket")).agg(F.max(rank(F.col(value))).cast("int").alias("rank"))


def estimates(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values from sketches."""
    n = F.count(F.lit(1))
    sums = sketch.groupBy(*keys).agg((F.sum(F.pow(F.lit(2.0), -F.col("rank"))) + (REGISTERS - n)).alias("z"), (REGISTERS - n).alias("zero"))
    return sums.select(*keys, estimate(F.col("z"), F.col("zero")).alias("distinct_estimate"))


def window_start(ts: Column) -> Column:
    return (F.floor(ts / WINDOW_SECONDS) * WINDOW_SECONDS).cast("long")


def network_windows(obs: DataFrame, value: str, samples: int = 5) -> DataFrame:
    """Per host, app, kind and half hour: events, the distinct estimate of ``value`` and its first distinct samples."""
    keys = ["host", "app", "kind", "start"]
    rows = obs.where(F.col("kind").isNotNull()).withColumn("start", window_start(F.col("ts")))
    firsts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ts", "event_id")).alias("at"))
    order = Window.partitionBy(*keys).orderBy("at", value)
    ranked = firsts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples)  # ranked before they are collected
    few = ranked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda s: s.getField("v")).alias("samples"))
    seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(few, keys, "left").withColumn("samples", F.coalesce("samples", F.array()))
    return seen.join(estimates(registers(rows, keys, value), keys), keys)
