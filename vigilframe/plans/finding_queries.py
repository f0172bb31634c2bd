"""Queries about stored findings, hosts and windows, over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import hosts as H
from ..operators import lifecycle, peers, summaries, triage
from ..sources.observations import novelty_view

LIVE_DAY = 19752
CLOCK = float((LIVE_DAY + 1) * 86400)
#: A key of exports for tests; real ones are drawn for each export.
PRIVACY_KEY = b"only for tests"
WIDE = ["id", "namespace", "host", "detector", "context", "state", "priority", "first_seen", "last_seen", "occurrences", "closed", "category", "app", "parent", "location", "image", "flags"]


def _r(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


def hosts_of(spark: SparkSession, d: str) -> DataFrame:
    """Users as hosts: one in ten of the demo namespace, cohorts by number."""
    n = F.col("host").cast("int")
    rows = summaries.hosts(novelty_view(spark, d))
    cohort = F.when(n % 7 == 0, "unassigned").otherwise(F.concat(F.lit("cohort-"), (n % 5).cast("string")))
    return rows.withColumns({"namespace": F.when(n % 10 == 9, "demo").otherwise("main"), "host_name": F.concat(F.lit("PC-"), "host"), "cohort": cohort})


def store(spark: SparkSession, d: str) -> DataFrame:
    """Events as findings in all states."""
    obs, k, n = novelty_view(spark, d), F.col("k"), F.col("host").cast("int")
    image = F.when(k % 13 != 0, F.concat(F.lit("C:\\Users\\u"), "host", F.lit("\\"), "event_type", F.lit("_updater_9."), (k % 8).cast("string"), F.lit(".0.exe"))).otherwise("")
    state = F.when(k % 8 == 0, "resolved").when(k % 8 == 1, "expected").when((k % 8 == 2) & (F.col("event_type") == "view"), "investigating").when((k == 3) & (F.col("event_type") == "click"), "malicious").otherwise("new")
    opened = state.isin(*lifecycle.OPEN)
    return obs.select(
        F.col("event_id").alias("id"), F.when(n % 10 == 9, "demo").otherwise("main").alias("namespace"), "host", F.when(k % 4 == 0, "DS-EXEC-002").otherwise("DS-BEH-001").alias("detector"),
        F.col("event_id").cast("string").alias("context"), state.alias("state"), F.when((k % 10 == 0) & (F.col("event_type") != "view"), "high").otherwise("review").alias("priority"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"),
        F.lit(1).cast("long").alias("occurrences"), F.when(~opened, F.col("ts") + 60).alias("closed"), F.when(k < 50, "rare_application").when(k < 95, "rare_launch_relationship").alias("category"), "app", "parent", "location", image.alias("image"),
        F.when(k % 6 == 0, F.array(F.lit("shell_chain"), F.lit("encoded_argument"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


def _shown(spark: SparkSession, d: str) -> DataFrame:
    named = H.with_hosts(store(spark, d).drop("namespace"), hosts_of(spark, d))
    return named.withColumns({"app_hosts": F.lit(3), "fleet_hosts": F.lit(150), "pattern_hosts": F.lit(2)})


def family_signatures(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.with_family(store(spark, d)).select("id", "shape", "signature")


def _real(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).where("namespace <> 'demo'")


def family_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.snapshot(_real(spark, d)).select("signature", "detector", "category", "parent", "location", "flags", "pattern", "findings", "hosts", "variants", "high", "malicious", "version_churn", "share", "signals")


def family_members_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the largest family."""
    rows = _real(spark, d)
    largest = lifecycle.snapshot(rows, 1).select("signature").first()
    return lifecycle.family_page(rows, largest[0] if largest else "", 1).select("id", _r("last_seen"))


def _reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All families reviewed, every third for the future too; one unknown, one for too long."""
    rows = _real(spark, d)
    known = peers.kept(lifecycle.families(rows))
    digit = F.conv(F.substring("signature", 1, 2), 16, 10).cast("int")
    asked = known.select("signature", F.when(digit % 3 == 0, 14).when(digit % 17 == 1, 60).otherwise(0).alias("suppress_days"))
    return lifecycle.review(rows, asked.unionByName(spark.createDataFrame([("none", 7)], "signature string, suppress_days int")), CLOCK, known)


def family_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d)[0]


def family_reviewed_states(spark: SparkSession, d: str) -> DataFrame:
    after = _reviewed(spark, d)[1]
    return after.groupBy("state").agg(F.count(F.lit(1)).alias("findings"), F.count_if("changed").alias("changed"))


def family_expected(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d)[2].select("signature", "pattern", "expires")


def _by_context(spark: SparkSession, d: str) -> DataFrame:
    """The store with one finding for each (host, detector, application): of several the open one seen last, or the last."""
    rows = store(spark, d).withColumn("context", F.col("app"))
    best = F.max_by(F.struct(*WIDE), F.struct(lifecycle.is_open(), "last_seen", "id"))
    return rows.groupBy("host", "detector", "context").agg(best.alias("f")).select("f.*")


def findings_merged(spark: SparkSession, d: str) -> DataFrame:
    """The findings before the live day, merged with those of that day; expectations of hosts divisible by 3, families of
    parent p1."""
    rows = _by_context(spark, d)
    old = store(spark, d).withColumn("context", F.col("app")).where(F.col("last_seen") < LIVE_DAY * 86400)
    old = old.groupBy("host", "detector", "context").agg(F.max_by(F.struct(*WIDE), F.struct(lifecycle.is_open(), "last_seen", "id")).alias("f")).select("f.*")
    live = store(spark, d).withColumn("context", F.col("app")).where(F.col("last_seen") >= LIVE_DAY * 86400)
    fresh = live.groupBy("host", "detector", "context").agg(F.min_by(F.struct(*[c for c in WIDE if c not in ("last_seen", "occurrences")]), F.struct("first_seen", "id")).alias("f"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"))
    fresh = fresh.select("f.*", "last_seen", "occurrences").withColumns({"state": F.lit("new"), "closed": F.lit(None).cast("double")})
    expectations = rows.where(F.col("host").cast("int") % 3 == 0).select("host", "detector", "context", F.lit(CLOCK - 9).alias("created"), F.lit(CLOCK + 9).alias("expires"), (F.col("host").cast("int") % 2 == 0).alias("revoked"))
    families = lifecycle.with_family(fresh).where("parent = 'p1'").select("signature", F.lit(CLOCK + 5).alias("expires")).distinct()
    return lifecycle.merge(old, fresh, expectations, families, CLOCK).select("id", "host", "detector", "context", "state", _r("last_seen"), "occurrences")


def findings_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of every fifth finding of a store with one key a host and detector, so that many are refused."""
    rows = store(spark, d).withColumn("context", F.lit("one"))
    to = F.element_at(F.array(*map(F.lit, ["new", "investigating", "resolved", "malicious", "expected"])), (F.col("id") % 25 / 5 + 1).cast("int"))
    changes = rows.where("id % 5 = 0").select("id", to.alias("to"))
    return lifecycle.change_states(rows, changes, CLOCK).select("id", "state", F.col("closed").isNull().alias("is_open"), "outcome")


def findings_expected(spark: SparkSession, d: str) -> DataFrame:
    rows = store(spark, d)
    after, made = lifecycle.expect(rows, rows.where("id % 4 = 0").select("id", (F.col("id") % 120).alias("days")), CLOCK)
    ends = made.select(F.col("context").cast("long").alias("id"), "expires")
    return after.join(ends, "id", "left").groupBy("state").agg(F.count(F.lit(1)).alias("findings"), F.count("expires").alias("expectations"), F.max("expires").alias("last_expiry"))


def expectations_with_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The 200 expectations made last, with the names of their hosts."""
    rows = store(spark, d)
    made = rows.where("state = 'expected'").select("host", "context", F.col("closed").alias("created"))
    return H.with_hosts(made, hosts_of(spark, d)).orderBy(F.col("created").desc(), "context").limit(200).select("context", "host_name", "namespace", _r("created"))


def finding_states(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.state_counts(store(spark, d), "DS-BEH-001", CLOCK)


def findings_table_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The first page of open findings in each of the six orders, both ways."""
    return triage.first_pages(triage.in_state(_shown(spark, d)), 20)


def findings_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Findings under investigation or malicious whose host, parent, path or application holds a text."""
    rows = _shown(spark, d)
    found = [triage.search(triage.in_state(rows, s), text, columns=("host_name", "parent", "image", "app")).select(F.lit(s).alias("status"), "id") for s, text in (("investigating", "PC-1"), ("malicious", "_UPDATER_9.3"), ("resolved", "View-v1"), ("other", "p9"))]
    return reduce(DataFrame.unionByName, found)


def findings_private(spark: SparkSession, d: str) -> DataFrame:
    return triage.table_rows(triage.in_state(_shown(spark, d)), PRIVACY_KEY)


def findings_export(spark: SparkSession, d: str) -> DataFrame:
    return triage.csv_lines(triage.table_rows(triage.in_state(_shown(spark, d), "investigating")))


def findings_json(spark: SparkSession, d: str) -> DataFrame:
    return triage.as_json(triage.in_state(_shown(spark, d), "malicious"), ["id", "host_name", "detector", "state", "parent", "image"])


def endpoint_findings(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.latest_of_each(triage.in_state(store(spark, d), "all"), "host", 10).select("host", "id", "r")


def global_counts(spark: SparkSession, d: str) -> DataFrame:
    obs = novelty_view(spark, d)
    lost = H.orphans(obs.where("event_type = 'purchase'"), obs.where("event_type = 'click'"), ["host", "k"])
    counts = [triage.in_state(store(spark, d)).select(F.lit("open_findings").alias("what")), hosts_of(spark, d).select(F.lit("endpoints").alias("what")), lost.select(F.lit("orphan_processes").alias("what"))]
    return reduce(DataFrame.unionByName, counts).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def hosts_by_cohort(spark: SparkSession, d: str) -> DataFrame:
    return H.by_cohort(hosts_of(spark, d), [f"cohort-{k}" for k in range(6)])


def endpoints_page(spark: SparkSession, d: str) -> DataFrame:
    return H.page(hosts_of(spark, d).where(S.contains_ignoring_case(F.col("host_name"), "pc-_")), 0, 50).select("host", "host_name", _r("last_seen"))


def namespace_support(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that show each application, by namespace."""
    days = summaries.behavior_days(novelty_view(spark, d), 2000)
    return H.with_hosts(days, hosts_of(spark, d)).groupBy("namespace", "app").agg(F.count_distinct("host").alias("app_hosts"))


def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """All namespaces, detectors and cohorts."""
    rows, hosts = store(spark, d), hosts_of(spark, d)
    parts = [hosts.select(F.lit("namespace").alias("kind"), F.col("namespace").alias("label")), rows.select(F.lit("detector").alias("kind"), F.col("detector").alias("label")), hosts.select(F.lit("cohort").alias("kind"), F.col("cohort").alias("label"))]
    return reduce(DataFrame.unionByName, parts).distinct()


def covered_hosts(spark: SparkSession, d: str) -> DataFrame:
    obs = novelty_view(spark, d)
    return H.covered([obs.where("k < 5"), obs.where("k > 97"), obs.where("event_type = 'signup' AND k < 20")])


def host_views(spark: SparkSession, d: str) -> DataFrame:
    obs = novelty_view(spark, d)
    return H.views(obs.where("event_type = 'signup' AND k < 50"), obs.where("kind = 'ip' AND k < 30"))


def collection_lag(spark: SparkSession, d: str) -> DataFrame:
    sources = novelty_view(spark, d).groupBy("event_type").agg(F.max("ts").alias("checkpoint"))
    return H.lag(sources, CLOCK).select(_r("lag"))


def fresh_workers(spark: SparkSession, d: str) -> DataFrame:
    workers = novelty_view(spark, d).groupBy("host").agg(F.max("ts").alias("heartbeat"))
    return H.fresh(workers, CLOCK, 3600).select("host")


def context_overflow(spark: SparkSession, d: str) -> DataFrame:
    return summaries.overflow(novelty_view(spark, d), 2)


def window_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each kind of event, with the hosts of a half hour as their diversity."""
    rows = novelty_view(spark, d).withColumn("start", summaries.window_start(F.col("ts")))
    windows = rows.groupBy("event_type", "start").agg(F.count_distinct("host").alias("v"))
    return summaries.thresholds(windows, ["event_type"], "v").withColumn("threshold", F.round("threshold", 6))


def sustained_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = novelty_view(spark, d).withColumn("start", summaries.window_start(F.col("ts")))
    windows = rows.groupBy("event_type", "start").agg(F.count_distinct("host").alias("v"))
    return summaries.sustained(windows, ["event_type"], "v", 1.0)


def name_filters(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names by globs and searches, a third of them as domain names."""
    rows = spark.read.parquet(f"{d}/supplier.parquet").withColumn("q", F.when(F.col("s_suppkey") % 3 == 0, F.replace("s_name", F.lit("#"), F.lit("."))).otherwise(F.col("s_name")))
    name = F.col("s_name")
    return rows.select(
        "s_suppkey", S.matches_glob(name, "Supplier#*[1-3]?").alias("by_glob"), S.matches_glob(name, "Supplier#*[!0-4]").alias("by_other"), S.matches_glob(name, "supplier*").alias("by_case"),
        S.contains_ignoring_case(name, "supplier#0000000_1").alias("by_search"), S.is_domain_name(F.col("q")).alias("is_domain"), S.shown(F.when(F.col("s_suppkey") % 4 != 0, F.col("q")).otherwise("")).alias("shown"),
    )


def next_spans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.next_span(k % 700, F.lit(600), k % 5003, F.when(k % 11 == 0, 0).otherwise(5000), k % 3).alias("span"))


QUERIES = {
    f.__name__: f
    for f in (
        family_signatures, family_snapshot, family_members_page, family_reviews, family_reviewed_states, family_expected, findings_merged, findings_after_changes, findings_expected, expectations_with_hosts,
        finding_states, findings_table_sorted, findings_filtered, findings_private, findings_export, findings_json, endpoint_findings, global_counts, hosts_by_cohort, endpoints_page, namespace_support, distinct_labels,
        covered_hosts, host_views, collection_lag, fresh_workers, context_overflow, window_thresholds, sustained_windows, name_filters, next_spans,
    )
}
