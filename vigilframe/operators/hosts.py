"""The dimension of hosts and what is asked about it: namespaces, cohorts, coverage, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_hosts(facts: DataFrame, hosts: DataFrame, namespace: str | None = None) -> DataFrame:
    """Facts by host with the host's namespace, name and cohort; of one namespace, if named."""
    chosen = hosts.select("host", "namespace", "host_name", "cohort")
    return facts.join(chosen.where(F.col("namespace") == namespace) if namespace is not None else chosen, "host")


def by_cohort(hosts: DataFrame, approved: list[str]) -> DataFrame:
    """(cohort, hosts) of approved labels; labels without hosts aren't listed."""
    return hosts.where(F.col("cohort").isin(approved)).groupBy("cohort").agg(F.count(F.lit(1)).alias("hosts"))


def orphans(network: DataFrame, creates: DataFrame, keys: list[str]) -> DataFrame:
    """Processes of which network activity, but no start is known."""
    return network.select(*keys).distinct().join(creates.select(*keys), keys, "left_anti")


def lag(sources: DataFrame, clock: float) -> DataFrame:
    """(lag): how far the source that is furthest behind has been read. ``sources``: (source, checkpoint)."""
    return sources.agg(F.max(F.lit(clock) - F.col("checkpoint")).alias("lag"))


def fresh(workers: DataFrame, clock: float, seconds: float = 600) -> DataFrame:
    """Workers whose last sign of life is recent enough."""
    return workers.where(F.col("heartbeat") > clock - seconds)


def covered(groups: list[DataFrame]) -> DataFrame:
    """Hosts of any of several groupings, each once."""
    every = groups[0].select("host")
    for g in groups[1:]:
        every = every.union(g.select("host"))
    return every.distinct()


def views(process: DataFrame, network: DataFrame) -> DataFrame:
    """(host, both): hosts with a process or a network view, and whether with both."""
    both = process.select("host").intersect(network.select("host")).withColumn("both", F.lit(True))
    return process.select("host").union(network.select("host")).distinct().join(both, "host", "left").fillna(False, ["both"])


def page(hosts: DataFrame, number: int = 0, size: int = 50) -> DataFrame:
    """A page of hosts, the last seen first."""
    return hosts.orderBy(F.col("last_seen").desc(), "host").offset(size * number).limit(size)
