"""How long tables are kept, as filters and as dropped partitions, and the retirement of a detector."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.policy import Policy

DAY = 86400
#: Days that finished jobs and batches, expectations and audit rows are kept; detectors that are retired.
JOB_DAYS, BATCH_DAYS, YEAR = 7, 2, 365
RETIRED, DISABLED = "DS-NET-001", ("DS-EXEC-001", "DS-EXEC-002", "DS-NET-001")


def expired(table: str, clock: float, policy: Policy) -> Column:
    """Whether a row of a table is past its time at the clock. Open findings never are, nor are unfinished jobs and batches."""
    day = int(clock) // DAY - policy.baseline_days
    column = F.col
    rules = {
        "receipts": lambda: column("received") < clock - policy.dedup_hours * 3600,
        "batch_receipts": lambda: column("received") < clock - (policy.baseline_days + 1) * DAY,
        "behavior_days": lambda: column("day") < day,
        "coverage": lambda: column("day") < day,
        "network_windows": lambda: column("start") < day * DAY,
        "processes": lambda: column("last_seen") < clock - policy.process_days * DAY,
        "jobs": lambda: (column("finished") > 0) & (column("finished") < clock - JOB_DAYS * DAY),
        "sessions": lambda: column("expires") < clock,
        "findings": lambda: column("closed").isNotNull() & (column("closed") < clock - policy.closed_finding_days * DAY),
        "expectations": lambda: column("expires") < clock - YEAR * DAY,
        "audit": lambda: column("created") < clock - YEAR * DAY,
        "staged_batches": lambda: (column("status") == "done") & (column("finished") < clock - BATCH_DAYS * DAY),
    }
    if table not in rules:
        raise ValueError(f"no retention for {table}; there is one for {', '.join(rules)}")
    return F.coalesce(rules[table](), F.lit(False))


def keep(rows: DataFrame, table: str, clock: float, policy: Policy) -> DataFrame:
    """The rows that stay. For tables by day the filter prunes partitions."""
    return rows.where(~expired(table, clock, policy))


def counted(rows: DataFrame, table: str, clock: float, policy: Policy) -> DataFrame:
    """(name, kept, deleted) of one table, in one pass."""
    gone = expired(table, clock, policy)
    return rows.agg(F.lit(table).alias("name"), F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted"))


def store_days(rows: DataFrame, path: str) -> None:
    """Writes rows (with ``day``) to a table by day; days that it holds already are replaced, others stay."""
    rows.repartition("day", F.pmod(F.xxhash64("host"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def drop_days(spark: SparkSession, path: str, clock: float, policy: Policy) -> list[int]:
    """Deletes the partitions of a table by day that are past the baseline, without reading them; returns their days."""
    first = int(clock) // DAY - policy.baseline_days
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(int(m[1]) for s in store.listStatus(folder) if (m := re.fullmatch(r"day=(-?\d+)", s.getPath().getName())) and int(m[1]) < first)
    for day in days:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}"), True)
    return days


def retirement(findings: DataFrame, expectations: DataFrame, detector: str = RETIRED) -> DataFrame:
    """(name, retired, kept): what the retirement of a detector would take out of findings and expectations."""
    counts = lambda df, name: df.agg(F.lit(name).alias("name"), F.count_if(F.col("detector") == detector).alias("retired"), F.count_if(F.coalesce(F.col("detector") != detector, F.lit(True))).alias("kept"))
    return counts(findings, "findings").unionByName(counts(expectations, "expectations"))


def retire(findings: DataFrame, expectations: DataFrame, policy: Policy, detector: str = RETIRED) -> tuple[DataFrame, DataFrame, Policy]:
    """(findings, expectations, policy) without a detector; the detectors that come with it stay off from now on, what they
    have found stays."""
    left = [df.where(F.coalesce(F.col("detector") != detector, F.lit(True))) for df in (findings, expectations)]
    return left[0], left[1], replace(policy, execution_enabled=False, contextual_enabled=False)
