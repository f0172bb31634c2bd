"""Process and network observations as the operators read them, and two views of ``events`` in that shape.

Columns: event_id long, host, app, parent, location, kind (null for a process start), ts double (epoch seconds), day int.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select("event_id", F.col("user_id").cast("string").alias("host"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), seconds.alias("ts"))
        .withColumn("day", F.floor(F.col("ts") / 86400).cast("int"))
    )


def novelty_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fleet in which new and rare launches occur."""
    k = F.col("k")
    return _events(spark, sf_dir).select(
        "event_id",
        "host",
        F.concat("event_type", F.lit("-v"), F.floor(F.col("value") / 5).cast("string")).alias("app"),
        F.concat(F.lit("p"), (k % 10).cast("string")).alias("parent"),
        F.when(k < 60, "windows").when(k < 90, "program-files").otherwise("user-profile").alias("location"),
        F.when(F.col("event_type") == "purchase", "ip").when(F.col("event_type") == "click", "domain").alias("kind"),
        "k",
        "event_type",
        "value",
        "ts",
        "day",
    )


def cohort_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fleet of six teams, each with applications of its own."""
    k, team = F.col("k"), F.concat(F.lit("team"), (F.col("user_id") % 6).cast("string"))
    return _events(spark, sf_dir).select(
        "event_id",
        "host",
        F.when(k % 4 == 0, F.concat(F.lit("shared-app"), (k % 3).cast("string"))).otherwise(F.concat(team, F.lit("-app"), (k % 5).cast("string"))).alias("app"),
        F.concat(team, F.lit("-svc"), (k % 2).cast("string")).alias("parent"),
        F.lit("program-files").alias("location"),
        F.when(F.col("event_type").isin("view", "click"), "domain").when(F.col("event_type") == "purchase", "ip").alias("kind"),
        "ts",
        "day",
    )


def suite_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fleet of six teams in two departments, whose applications come in suites. The hosts of the last team start them in
    ways of their own; every eleventh host is seen on few days."""
    k, team = F.col("k"), F.col("user_id") % 6
    name, last = F.concat(F.lit("team"), team.cast("string")), team == 5
    app = (
        F.when(k % 4 == 0, F.concat(F.lit("shared-app"), (k % 3).cast("string")))
        .when((k % 5).isin(1, 2), F.concat(F.lit("dept"), (team % 2).cast("string"), F.lit("-app")))
        .otherwise(F.concat(name, F.lit("-app"), (k % 2).cast("string")))
    )
    kind = F.when(~last & F.col("event_type").isin("view", "click"), "domain").when(~last & (F.col("event_type") == "purchase"), "ip")
    parent = F.when(last, F.concat(F.lit("own"), F.col("host"))).otherwise(F.concat(name, F.lit("-svc"), (k % 2).cast("string")))
    rows = _events(spark, sf_dir).where("user_id % 11 <> 0 OR day % 5 = 0")
    return rows.select("event_id", "host", app.alias("app"), parent.alias("parent"), F.lit("program-files").alias("location"), kind.alias("kind"), "ts", "day")
