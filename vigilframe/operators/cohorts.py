"""Analytical strata, similarity cohorts from application pairs, and their validation on later days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Prevalence and size limits of cohorts.
STRATUM_PREVALENCE, APP_PREVALENCE = 0.20, 0.30
COHORT_DAYS, COHORT_HOSTS, LIFT, SEEDS = 7, 40, 1.25, 16
#: Members that have to be seen later, and the share of them that has to show its applications again.
LATER_MEMBERS, PERSISTENCE = 12, 0.50


def eligible(obs: DataFrame, days: int = COHORT_DAYS, hosts: int = COHORT_HOSTS) -> DataFrame:
    """Observations of hosts with enough days to be in a cohort; none of a fleet with fewer such hosts than make cohorts."""
    enough = obs.groupBy("host").agg(F.count_distinct("day").alias("n")).where(F.col("n") >= days).select("host")
    return obs.join(enough, "host", "left_semi") if enough.limit(hosts).count() >= hosts else obs.limit(0)


def breadth(prevalences: DataFrame) -> DataFrame:
    """(host, channel, n): features of each channel that a host shows on a fifth of its days."""
    rows = prevalences.where(F.col("channel").isin("applications", "process", "network", "activity"))
    return rows.groupBy("host", "channel").agg(F.count_if(F.col("prevalence") >= STRATUM_PREVALENCE).alias("n"))


def strata(breadths: DataFrame) -> DataFrame:
    """(channel, host, band): tertiles by order statistics, so that equal values never fall into two bands.

    The cut points are exact percentiles of the counts' frequencies, whose number is bounded by the features a host keeps."""
    counts = breadths.groupBy("channel", "n").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("channel").orderBy("n")
    total = F.sum("c").over(Window.partitionBy("channel"))
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("last", total - 1)
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(k * F.col("last") / 3), F.col("n")))
    cuts = placed.groupBy("channel").agg(at(1).alias("low"), at(2).alias("high"))
    return breadths.join(F.broadcast(cuts), "channel").select("channel", "host", "n", F.when(F.col("n") <= F.col("low"), "low").when(F.col("n") <= F.col("high"), "middle").otherwise("high").alias("band"))


def seeds(prevalences: DataFrame, hosts: int, limit: int = SEEDS, shown: float = APP_PREVALENCE) -> DataFrame:
    """(host, app): a host's applications with the largest prevalence times share of hosts without them."""
    rows = prevalences.where((F.col("channel") == "applications") & (F.col("prevalence") >= shown))
    df = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(df, "feature").withColumn("u", F.col("prevalence") * (1 - F.col("df") / F.lit(hosts)))
    order = Window.partitionBy("host").orderBy(F.col("u").desc(), "feature")
    return ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("host", F.col("feature").alias("app"), "df")


def app_pairs(prevalences: DataFrame, hosts: int, least: int | None = None, limit: int = 480, shown: float = APP_PREVALENCE) -> DataFrame:
    """Pairs of seed applications by members * log2(lift): (first, second, members, lift, utility)."""
    least = max(20, -(-hosts // 100)) if least is None else least
    chosen = seeds(prevalences, hosts, shown=shown).where((F.col("df") >= least) & (F.col("df") <= 0.8 * hosts))
    lists = chosen.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("app", "df"))).alias("apps"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(apps, (x, i) -> transform(slice(apps, i + 2, size(apps)), y -> struct(x, y))))")).alias("p"))
    counted = pairs.groupBy(F.col("p.x.app").alias("first"), F.col("p.y.app").alias("second"), F.col("p.x.df").alias("df1"), F.col("p.y.df").alias("df2")).agg(F.count(F.lit(1)).alias("members"))
    lift = F.col("members") * F.lit(float(hosts)) / (F.col("df1") * F.col("df2"))
    ranked = counted.withColumn("lift", lift).where((F.col("lift") >= LIFT) & (F.col("members") >= least) & (F.col("members") <= 0.65 * hosts))
    return ranked.withColumn("utility", F.col("members") * F.log2("lift")).orderBy(F.col("utility").desc(), "first", "second").limit(limit).select("first", "second", "members", "lift", "utility")


def cohort_members(pairs: DataFrame, prevalences: DataFrame, shown: float = APP_PREVALENCE) -> DataFrame:
    """(first, second, host): hosts that show both applications of a pair often."""
    apps = prevalences.where((F.col("channel") == "applications") & (F.col("prevalence") >= shown)).select("host", "feature")
    one = pairs.select("first", "second").join(apps, F.col("feature") == F.col("first")).drop("feature")
    return one.join(apps.withColumnRenamed("feature", "second"), ["second", "host"]).select("first", "second", "host")


def overlaps(members: DataFrame, key: list[str]) -> DataFrame:
    """(cohorts of a host, hosts): how many cohorts hosts belong to."""
    return members.groupBy("host").agg(F.count_distinct(F.struct(*key)).alias("cohorts")).groupBy("cohorts").agg(F.count(F.lit(1)).alias("hosts"))


def persistence(members: DataFrame, training: DataFrame, later: DataFrame, minimum_days: int = 3) -> DataFrame:
    """Frozen members of each cohort on later days: (first, second, members, observed, persistent, holds).

    A member is observed with enough later days, and persistent if it still shows both applications there. A cohort holds
    if enough members are observed and at least half of them are persistent."""
    days = later.groupBy("host").agg(F.count_distinct("day").alias("days")).where(F.col("days") >= minimum_days).select("host")
    shown = later.select("host", F.concat(F.lit("app:"), "app").alias("app")).distinct()
    seen = members.join(days, "host").withColumn("observed", F.lit(1))
    both = seen.join(shown.withColumnRenamed("app", "first"), ["host", "first"], "left_semi").join(shown.withColumnRenamed("app", "second"), ["host", "second"], "left_semi")
    counts = members.groupBy("first", "second").agg(F.count(F.lit(1)).alias("members"))
    for rows, name in ((seen, "observed"), (both, "persistent")):
        counts = counts.join(rows.groupBy("first", "second").agg(F.count(F.lit(1)).alias(name)), ["first", "second"], "left").fillna(0, [name])
    return counts.withColumn("holds", (F.col("observed") >= LATER_MEMBERS) & (F.col("persistent") >= PERSISTENCE * F.col("observed")))


def pair_overlaps(members: DataFrame, key: str) -> DataFrame:
    """(a, b, overlap): Jaccard similarity of every two cohorts with a common host. A host is in few cohorts, so the
    pairs grow with the hosts."""
    size = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sides = [members.select("host", F.col(key).alias(s)) for s in ("a", "b")]
    both = sides[0].join(sides[1], "host").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = both.join(size.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("overlap"))


def best_groups(rows: DataFrame, delta: float = 0.08, members: int = 11, pairs: int = 24) -> DataFrame:
    """Each host's best group (host, grp, delta, pairs, members): the largest delta, then pairs, then members, then the
    first group, among those with enough of each."""
    order = Window.partitionBy("host").orderBy(F.col("delta").desc(), F.col("pairs").desc(), F.col("members").desc(), "grp")
    fit = rows.where((F.col("delta") >= delta) & (F.col("members") >= members) & (F.col("pairs") >= pairs))
    return fit.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def match_buckets(breadths: DataFrame) -> DataFrame:
    """(host, apps, days) to (host, app_bin, day_bin): doublings of the application count, whole weeks after the first."""
    days = F.floor((F.col("days") - 7) / 7)
    return breadths.select("host", (F.length(F.bin(F.col("apps") + 1)) - 1).cast("int").alias("app_bin"), F.greatest(F.lit(0), days).cast("int").alias("day_bin"))


def control_pools(buckets: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """For each of ``members`` (host, group) the number of hosts outside its group that match it: those of its own bucket
    or, if it has none, those one step away in one direction.

    Hosts are counted by bucket before the join, so pairs of hosts are never made.
    """
    key = ["app_bin", "day_bin"]
    everyone = buckets.groupBy(*key).agg(F.count(F.lit(1)).alias("everyone"))
    placed = buckets.join(members, "host")
    own = placed.groupBy(group, *key).agg(F.count(F.lit(1)).alias("own"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    near = own.select(group, *key, F.explode(steps).alias("step"))
    near = near.select(group, F.col("app_bin").alias("own_app"), F.col("day_bin").alias("own_day"), "step", (F.col("app_bin") + F.col("step.a")).alias("app_bin"), (F.col("day_bin") + F.col("step.b")).alias("day_bin"))
    outside = near.join(everyone, key).join(own, [group, *key], "left").withColumn("outside", F.col("everyone") - F.coalesce("own", F.lit(0)))
    here = (F.col("step.a") == 0) & (F.col("step.b") == 0)
    pools = outside.groupBy(group, F.col("own_app").alias("app_bin"), F.col("own_day").alias("day_bin")).agg(F.sum(F.when(here, F.col("outside")).otherwise(0)).alias("same"), F.sum(F.when(here, 0).otherwise(F.col("outside"))).alias("beside"))
    found = placed.join(pools, [group, *key])
    return found.select("host", group, *key, (F.col("same") > 0).alias("exact"), F.when(F.col("same") > 0, F.col("same")).otherwise(F.col("beside")).alias("controls"))
