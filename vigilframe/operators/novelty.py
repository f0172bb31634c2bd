"""Reference windows and the environment-novelty detector, as one set-oriented plan.

Only previous UTC days count: ``day - baseline_days <= d < day``. Everything is aggregated to (host, day, key) before the
window is applied, so the range condition touches summaries and never events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Policy

UNKNOWN = ("", "unknown")
PATTERN = ["app", "parent", "location"]
#: Fixed value: the identifier of the detector.
DETECTOR = "DS-BEH-001"


def prior(days: DataFrame, day: int, policy: Policy) -> DataFrame:
    """The reference window of one day; prunes partitions where the table is partitioned by day."""
    return days.where((F.col("day") >= day - policy.baseline_days) & (F.col("day") < day))


def references(subjects: DataFrame, days: DataFrame, policy: Policy) -> DataFrame:
    """For each (host, day, app, parent, location): observed and familiar days before it, whether it is new, and whether
    the host's history is established. ``days`` is the behaviour table."""
    near = (F.col("d") >= F.col("day") - policy.baseline_days) & (F.col("d") < F.col("day"))
    keys = ["host", "day", *PATTERN]
    wanted = subjects.select(*keys).distinct()
    seen = days.select("host", F.col("day").alias("d")).distinct()
    observed = wanted.select("host", "day").distinct().join(seen, "host").where(near).groupBy("host", "day").agg(F.count("d").alias("observed_days"))
    context = days.select("host", *PATTERN, F.col("day").alias("d")).distinct()
    familiar = wanted.join(context, ["host", *PATTERN]).where(near).groupBy(*keys).agg(F.count("d").alias("familiar_days"))
    found = wanted.join(observed, ["host", "day"], "left").join(familiar, keys, "left").fillna(0, ["observed_days", "familiar_days"])
    return found.withColumn("local_new", F.col("familiar_days") == 0).withColumn("established", F.col("observed_days") >= policy.minimum_days)


def fleet_hosts(window: DataFrame) -> DataFrame:
    return window.agg(F.count_distinct("host").alias("fleet_hosts"))


def support(window: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct hosts that show each key in the window."""
    return window.groupBy(*keys).agg(F.count_distinct("host").alias(name))


def local_app_days(window: DataFrame) -> DataFrame:
    return window.groupBy("host", "app").agg(F.count_distinct("day").alias("local_app_days"))


def qualified_peers(window: DataFrame, policy: Policy) -> DataFrame:
    """Hosts with enough observed days of an application to be compared on it."""
    return local_app_days(window).where(F.col("local_app_days") >= policy.minimum_days)


def peer_evidence(subjects: DataFrame, window: DataFrame, groups: DataFrame, policy: Policy) -> DataFrame:
    """For each (host, app, parent, location): qualified peers of the host's group and how many show the same pattern.
    ``groups``: (host, grp).

    Qualified hosts are counted by group and application, and by group and pattern; a subject that is among them is taken
    off its own counts, so no pairs of hosts are made."""
    qualified = qualified_peers(window, policy).select("host", "app").join(groups, "host")
    eligible = qualified.groupBy("grp", "app").agg(F.count(F.lit(1)).alias("eligible"))
    shows = window.select("host", *PATTERN).distinct().join(qualified, ["host", "app"])
    seen = shows.groupBy("grp", *PATTERN).agg(F.count(F.lit(1)).alias("seen"))
    subject = subjects.select("host", *PATTERN).distinct().join(groups, "host")
    found = subject.join(eligible, ["grp", "app"]).join(seen, ["grp", *PATTERN], "left")
    found = found.join(qualified.withColumn("is_peer", F.lit(1)), ["host", "grp", "app"], "left").join(shows.select("host", "grp", *PATTERN, F.lit(1).alias("is_shown")), ["host", "grp", *PATTERN], "left")
    counts = found.select("host", *PATTERN, (F.col("eligible") - F.coalesce("is_peer", F.lit(0))).alias("peer_eligible"), (F.coalesce("seen", F.lit(0)) - F.coalesce("is_shown", F.lit(0))).alias("peer_seen"))
    return counts.where("peer_eligible > 0")


def reference_evidence(live: DataFrame, days: DataFrame, day: int, cohorts: DataFrame, suppressing: DataFrame, policy: Policy) -> DataFrame:
    """Every live (host, app, parent, location) with all that its reference says: days seen before, peers in the host's cohort that
    are qualified and that show the same, whether they may keep a finding back, and how far the host is known.

    ``cohorts``: (host, cohort), hosts without one left out; ``suppressing``: (label, suppressing)."""
    found = references(live, days, policy)
    grouped = cohorts.select("host", F.col("cohort").alias("grp"))
    peers = peer_evidence(live, prior(days, day, policy), grouped, policy)
    rows = found.join(cohorts.select("host", "cohort"), "host", "left").join(suppressing.select(F.col("label").alias("cohort"), "suppressing"), "cohort", "left")
    rows = rows.join(peers, ["host", *PATTERN], "left").fillna(0, ["peer_eligible", "peer_seen"])
    allowed = F.coalesce("suppressing", F.lit(False))
    return rows.select(
        "host", "day", *PATTERN, "observed_days", "familiar_days", "local_new", "peer_seen", "peer_eligible", (F.col("peer_eligible") > 0).alias("peer_evidence_available"), allowed.alias("peer_group_suppression_allowed"),
        (allowed & (F.col("peer_eligible") >= policy.minimum_peer_hosts)).alias("peer_qualified"), F.coalesce("cohort", F.lit("unassigned")).alias("cohort"), F.when(F.col("established"), "established").otherwise("learning").alias("confidence"),
    )


def _laddered(found: DataFrame, policy: Policy) -> DataFrame:
    """Rows with fleet_hosts, app_hosts and pattern_hosts, and the gate that each stopped at."""
    fleet, app_hosts = F.col("fleet_hosts"), F.col("app_hosts")
    rare_max = F.greatest(F.lit(2), F.floor(fleet * F.lit(policy.rare_app_fraction)))
    common_min = F.greatest(F.lit(policy.min_common_app_hosts), F.ceil(fleet * F.lit(0.03)))
    relation_max = F.greatest(F.lit(2), F.floor(app_hosts * F.lit(policy.rare_relation_fraction)))
    rare_relation = (app_hosts >= common_min) & ~F.col("parent").isin(*UNKNOWN) & (F.col("location") != "unknown") & (F.col("pattern_hosts") <= relation_max)
    ladder = (
        F.when(F.lit(not policy.behavioral_enabled), "detector_disabled")
        .when(~F.col("established"), "insufficient_local_history")
        .when(~F.col("local_new"), "locally_familiar_context")
        .when(F.col("app").isin(*UNKNOWN), "unknown_application")
        .when(fleet < policy.min_fleet_hosts, "insufficient_fleet_coverage")
        .when(app_hosts <= rare_max, "rare_application")
        .when(rare_relation, "rare_launch_relationship")
        .otherwise("not_rare_by_fleet_reference")
    )
    return found.withColumn("gate", ladder)


def gates(live: DataFrame, days: DataFrame, day: int, policy: Policy) -> DataFrame:
    """Every live (host, app, parent, location) with its reference, fleet counts and the gate it stopped at."""
    window = prior(days, day, policy)
    found = references(live, days, policy)
    for keys, name in ((["app"], "app_hosts"), (PATTERN, "pattern_hosts")):
        found = found.join(support(window, keys, name), keys, "left").fillna(0, [name])
    return _laddered(found.crossJoin(F.broadcast(fleet_hosts(window))), policy)  # one row


def gates_by_day(live: DataFrame, days: DataFrame, first: int, last: int, policy: Policy) -> DataFrame:
    """``gates`` of each day from ``first`` to ``last`` against the days before it, in one pass over ``days``: what was seen
    on a day counts for those of the asked days in whose window it stands, once a host."""
    seen = days.where((F.col("day") >= first - policy.baseline_days) & (F.col("day") < last)).select("host", *PATTERN, "day").distinct()
    asked = F.sequence(F.greatest(F.col("day") + 1, F.lit(first)), F.least(F.col("day") + policy.baseline_days, F.lit(last)))
    windows = seen.select("host", *PATTERN, F.explode(asked).alias("day")).distinct()
    found = references(live.where(F.col("day").between(first, last)), days, policy)
    for keys, name in ((["app"], "app_hosts"), (PATTERN, "pattern_hosts"), ([], "fleet_hosts")):
        found = found.join(support(windows, ["day", *keys], name), ["day", *keys], "left").fillna(0, [name])
    return _laddered(found, policy)


#: Days of a bin in which intervals of days meet.
BIN = 7


def incomplete(subjects: DataFrame, backlog: DataFrame, policy: Policy, source: str = "source") -> DataFrame:
    """``subjects`` (source, day, ...) with ``historical_reference_incomplete``: whether days of their reference window are still
    to be loaded. ``backlog``: (source, first_day, last_day) of outstanding batches.

    Intervals meet in bins of days. A bin keeps one row a source, the earliest first day and the latest last day of what
    touches it: a window is never shorter than a bin, so these two tell exactly whether something in the bin overlaps it."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN)))
    low, high = F.col("day") - policy.baseline_days, F.col("day") - 1
    held = backlog.where("first_day <= last_day").select(source, "first_day", "last_day", bins(F.col("first_day"), F.col("last_day")).alias("bin"))
    held = held.groupBy(source, "bin").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    asked = subjects.select(source, "day").distinct().select(source, "day", bins(low, high).alias("bin"))
    hit = asked.join(held, [source, "bin"]).where((F.col("last_day") >= low) & (F.col("first_day") <= high)).select(source, "day").distinct()
    marked = subjects.join(hit.withColumn("hit", F.lit(True)), [source, "day"], "left")
    return marked.withColumn("historical_reference_incomplete", F.coalesce("hit", F.lit(False))).drop("hit")


def candidates(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("gate").isin("rare_application", "rare_launch_relationship")).withColumnRenamed("gate", "category")


def funnel(gated: DataFrame) -> DataFrame:
    """Contexts that stopped at each gate."""
    return gated.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def findings(found: DataFrame, live: DataFrame) -> DataFrame:
    """One finding for each host and identity (the application, or the launch): the evidence of the first event stays,
    later events count as occurrences."""
    events = live.join(found.select("host", *PATTERN, "category", "fleet_hosts", "app_hosts", "pattern_hosts"), ["host", *PATTERN])
    relation = F.col("category") == "rare_launch_relationship"
    identity = F.when(relation, F.concat_ws("|", F.lit("launch"), *PATTERN)).otherwise(F.concat_ws("|", F.lit("application"), "app"))
    evidence = F.struct("app", "parent", "location", "fleet_hosts", "app_hosts", "pattern_hosts")
    return (
        events.withColumn("identity", identity)
        .groupBy("host", "category", "identity")
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("ts", "event_id", evidence.alias("e"))).getField("e").alias("evidence"))
        .select("host", F.lit(DETECTOR).alias("detector"), "category", "identity", "first_seen", "last_seen", "occurrences", "evidence")
    )


def suppress(found: DataFrame, expectations: DataFrame, clock: float) -> DataFrame:
    """Findings without an expectation (host, detector, identity, created, expires, revoked) that holds at ``clock``."""
    active = expectations.where((F.col("created") <= clock) & (F.col("expires") > clock) & ~F.col("revoked"))
    return found.join(active.select("host", "detector", "identity"), ["host", "detector", "identity"], "left_anti")
