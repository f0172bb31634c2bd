"""Peer groups: candidate pairs from shared features, similarity per channel, links, components and group scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profiles import CHANNEL_WEIGHTS

#: Similarity thresholds of peers and technical clusters, and the ring of neighbours in long postings.
OVERALL, APPLICATIONS, TECHNICAL = 0.50, 0.42, 0.72
SUPPORT = {"bundles": 0.28, "process": 0.30, "network": 0.30, "activity": 0.55}
RING_FROM, RING = 24, 8
#: From how many hosts on only the first features of a channel, or of a technical vector, are looked up;
#: share of the fleet beyond which a component is no group; technical clusters inside groups, and how they hold together.
FEW, FEATURES, TECHNICAL_FEATURES = 64, 8, 32
WHOLE, CONTAINED, COHESION = 0.90, 0.80, 0.68


def _met(rows: DataFrame, keys: list[str], hosts: int) -> DataFrame:
    """(a, b) with a < b of hosts that share enough of the keys.

    A key of 2 to RING_FROM hosts pairs them all; a longer posting each with its RING next ones in order of name, so a key
    of n hosts gives at most RING * n pairs. The longest postings, by a bound that grows with the fleet, say too little and
    give none; from 20 hosts on two keys have to be shared.
    """
    maximum = hosts if hosts < 20 else max(16, min(300, int(hosts * 0.45)))
    posting = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") <= maximum))
    placed = rows.select(*keys, "host").join(posting, keys).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("host")) - 1)
    reach = F.when(F.col("n") <= RING_FROM, F.col("n") - 1).otherwise(F.lit(RING))
    asked = placed.withColumn("o", F.explode(F.sequence(F.lit(1), reach.cast("int")))).withColumn("j", F.pmod(F.col("i") + F.col("o"), F.col("n")))
    other = placed.select(*keys, F.col("host").alias("other"), F.col("i").alias("j"))
    met = asked.join(other, [*keys, "j"]).select(*keys, F.least("host", "other").alias("a"), F.greatest("host", "other").alias("b")).distinct()
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= (1 if hosts < 20 else 2)).select("a", "b")


def candidate_pairs(weighted: DataFrame, hosts: int) -> DataFrame:
    """(a, b) with a < b of hosts that meet under applications, bundles, process or network features; of large fleets'
    hosts the heaviest FEATURES of each channel count."""
    rows = weighted.where(F.col("channel").isin("applications", "bundles", "process", "network"))
    return _met(rows.where(F.col("r") <= FEATURES) if hosts >= FEW else rows, ["channel", "feature"], hosts)


def _sides(pairs: DataFrame, vectors: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(a, b, keys, x, y) for all features of either side, absent ones 0."""
    both = [pairs.join(vectors.withColumnRenamed("host", side), side).select("a", "b", *keys, *(F.col(value).alias(n) if n == own else F.lit(0.0).alias(n) for n in ("x", "y"))) for side, own in (("a", "x"), ("b", "y"))]
    return both[0].unionByName(both[1]).groupBy("a", "b", *keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def channel_scores(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """(a, b, channel, score, shared): weighted Jaccard similarity; channels that neither side has are missing (0)."""
    sides = _sides(pairs, weighted.where(F.col("channel").isin(*CHANNEL_WEIGHTS)).select("host", "channel", "feature", "weight"), ["channel", "feature"], "weight")
    return sides.groupBy("a", "b", "channel").agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("score"), F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("shared"))


def pair_scores(pairs: DataFrame, weighted: DataFrame, hosts: int) -> DataFrame:
    """(a, b, one score for each channel, overall, shared_apps, eligible)."""
    scores = channel_scores(pairs, weighted).groupBy("a", "b").agg(
        *[F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("score"))), F.lit(0.0)).alias(c) for c in CHANNEL_WEIGHTS],
        F.coalesce(F.sum(F.when(F.col("channel") == "applications", F.col("shared"))), F.lit(0)).alias("shared_apps"),
    )
    overall = sum((w * F.col(c) for c, w in CHANNEL_WEIGHTS.items()), F.lit(0.0))
    supported = sum(((F.col(c) >= t).cast("int") for c, t in SUPPORT.items()), F.lit(0)) >= 1
    return scores.withColumn("overall", overall).withColumn("eligible", (F.col("overall") >= OVERALL) & (F.col("applications") >= APPLICATIONS) & (F.col("shared_apps") >= (3 if hosts < 20 else 4)) & supported)


def cosine_pairs(vectors: DataFrame, hosts: int, least: float = TECHNICAL) -> DataFrame:
    """(a, b, cosine) of candidates whose unit vectors (host, feature, value, r) are at least so similar."""
    pairs = _met(vectors.where(F.col("r") <= TECHNICAL_FEATURES) if hosts >= FEW else vectors, ["feature"], hosts)
    one = pairs.join(vectors.select(F.col("host").alias("a"), "feature", F.col("value").alias("x")), "a")
    both = one.join(vectors.select(F.col("host").alias("b"), "feature", F.col("value").alias("y")), ["b", "feature"])
    return both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine")).where(F.col("cosine") >= least)


def kept(rows: DataFrame) -> DataFrame:
    """The rows, computed once and written to the folder that the session names for checkpoints (of a local master without
    one, as in tests, to a folder of the machine)."""
    spark = rows.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file:/tmp/vigilframe-checkpoints")
    return rows.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(host, component) of linked hosts (a, b); component is the smallest host reachable.

    The smallest label goes along the links, then over to the label's own label, until nothing changes; every round is
    checkpointed to the folder that the session names, so no lineage grows and a lost executor costs one round.
    """
    one = kept(links.select("a", "b"))
    both = one.union(one.select("b", "a")).distinct()
    labels = both.groupBy(F.col("a").alias("host")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    while True:
        near = both.join(labels.withColumnsRenamed({"host": "b", "component": "c"}), "b").groupBy(F.col("a").alias("host")).agg(F.min("c").alias("c"))
        step = labels.join(near, "host").select("host", "component", F.least("component", "c").alias("c"))
        jump = labels.select(F.col("host").alias("c"), F.col("component").alias("far"))
        step = step.join(jump, "c").select("host", F.col("component").alias("old"), F.least("c", "far").alias("component"))
        step = kept(step)
        labels = step.select("host", "component")
        if not step.where("old <> component").limit(1).count():
            return labels


def sizes(members: DataFrame, hosts: int) -> DataFrame:
    """(component, size) of components that may be a group: three hosts or more, not nearly the whole fleet."""
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 3)
    return size.where(F.col("size") / F.lit(hosts) <= WHOLE) if hosts >= 10 else size


def group_scores(members: DataFrame, weighted: DataFrame) -> DataFrame:
    """(component, one score for each channel, overall): how similar its members are to their centroid, on average.

    A member's features are joined with the centroid; what the centroid has besides is its total less what was joined."""
    own = weighted.where(F.col("channel").isin(*CHANNEL_WEIGHTS)).select("host", "channel", "feature", "weight").join(members, "host")
    middle = centroids(members, weighted.where(F.col("channel").isin(*CHANNEL_WEIGHTS)))
    total = middle.groupBy("component", "channel").agg(F.sum("value").alias("total"))
    met = own.join(middle, ["component", "channel", "feature"]).groupBy("component", "channel", "host")
    met = met.agg(F.sum(F.least("weight", "value")).alias("low"), (F.sum(F.greatest("weight", "value")) - F.sum("value")).alias("high"))
    scores = met.join(total, ["component", "channel"]).groupBy("component", "channel").agg(F.sum(F.col("low") / (F.col("high") + F.col("total"))).alias("s"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    wide = scores.join(size, "component").groupBy("component").agg(*[F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("s") / F.col("size"))), F.lit(0.0)).alias(c) for c in CHANNEL_WEIGHTS])
    return wide.withColumn("overall", sum((w * F.col(c) for c, w in CHANNEL_WEIGHTS.items()), F.lit(0.0)))


def common_apps(members: DataFrame, prevalences: DataFrame) -> DataFrame:
    """(component, apps): applications that half of the members show."""
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    shown = prevalences.where("channel = 'applications'").join(members, "host").groupBy("component", "feature").agg(F.count(F.lit(1)).alias("n"))
    return shown.join(size, "component").where(F.col("n") / F.col("size") >= 0.5).groupBy("component").agg(F.count(F.lit(1)).alias("apps"))


def groups(members: DataFrame, weighted: DataFrame, prevalences: DataFrame, hosts: int) -> DataFrame:
    """(component, size, one score for each channel, overall, apps): components of eligible links whose members are broadly
    alike, and so may stand for each other as peers."""
    size = sizes(members, hosts)
    inside = kept(members.join(size, "component", "left_semi"))
    found = size.join(group_scores(inside, weighted), "component").join(common_apps(inside, prevalences), "component")
    supported = sum(((F.col(c) >= t).cast("int") for c, t in SUPPORT.items()), F.lit(0)) >= 1
    return found.where((F.col("overall") >= OVERALL) & (F.col("applications") >= APPLICATIONS) & (F.col("apps") >= (3 if hosts < 20 else 4)) & supported)


def cohesion(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(component, cohesion): the mean cosine of the members' unit vectors with their centroid."""
    middle = centroids(members, vectors.select("host", F.lit("technical").alias("channel"), "feature", F.col("value").alias("weight")))
    norm = middle.groupBy("component").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    own = vectors.select("host", "feature", F.col("value").alias("x")).join(members, "host").join(middle, ["component", "feature"])
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return own.groupBy("component").agg(F.sum(F.col("x") * F.col("value")).alias("s")).join(norm, "component").join(size, "component").select("component", (F.col("s") / F.col("norm") / F.col("size")).alias("cohesion"))


def technical_clusters(members: DataFrame, vectors: DataFrame, recommended: DataFrame, hosts: int) -> DataFrame:
    """(component, size, cohesion) of components of technical links that hold together and aren't mostly inside one of the
    ``recommended`` groups (host, component)."""
    size = sizes(members, hosts)
    inside = kept(members.join(size, "component", "left_semi"))
    shared = inside.join(recommended.withColumnRenamed("component", "other"), "host").groupBy("component", "other").agg(F.count(F.lit(1)).alias("shared"))
    within = shared.join(size, "component").where(F.col("shared") / F.col("size") >= CONTAINED).select("component").distinct()
    return size.join(within, "component", "left_anti").join(cohesion(inside, vectors), "component").where(F.col("cohesion") >= COHESION)


def centroids(members: DataFrame, weighted: DataFrame) -> DataFrame:
    """(component, channel, feature, value): mean weight over all members, absent features counting 0."""
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sums = weighted.join(members, "host").groupBy("component", "channel", "feature").agg(F.sum("weight").alias("s"))
    return sums.join(size, "component").select("component", "channel", "feature", (F.col("s") / F.col("size")).alias("value"))


def anchor(feature: F.Column) -> F.Column:
    """The application that a feature is about; empty for bundles and hours."""
    return (
        F.when(F.startswith(feature, F.lit("app:")), F.expr("substring(feature, 5)"))
        .when(F.startswith(feature, F.lit("pc:")), F.regexp_extract(feature, r"^pc:(?:[^>]*>)?(.*)$", 1))
        .when(F.startswith(feature, F.lit("net:")), F.regexp_extract(feature, r"^net:([^:]*)", 1))
        .otherwise("")
    )


def label(channel: F.Column, feature: F.Column) -> F.Column:
    """A feature in words."""
    rest = lambda n: F.expr(f"substring(feature, {n})")
    platform = F.when(channel == "platform", F.lit("platform "))
    return (
        F.when(F.startswith(feature, F.lit("app:")), F.concat(F.when(channel == "platform", "platform component ").otherwise("application "), rest(5)))
        .when(F.startswith(feature, F.lit("pc:")), F.concat(F.coalesce(platform, F.lit("")), F.lit("parent-child "), rest(4)))
        .when(F.startswith(feature, F.lit("net:")), F.concat(F.regexp_extract(feature, r"^net:([^:]*)", 1), F.lit(" with "), F.regexp_extract(feature, r"^net:[^:]*:(.*)$", 1), F.lit(" network activity")))
        .when(F.startswith(feature, F.lit("bundle:")), F.concat(F.lit("application bundle "), F.array_join(F.split(rest(8), r"\|"), " + ")))
        .when(F.startswith(feature, F.lit("activity:")), F.replace(F.replace(feature, F.lit("activity:"), F.lit("activity ")), F.lit("utc"), F.lit(" UTC")))
        .otherwise(feature)
    )


def explanations(members: DataFrame, prevalences: DataFrame, hosts: int, limit: int = 10) -> DataFrame:
    """(component, r, channel, feature, label, group_fraction, fleet_fraction, score, launched_by, network_kinds): what sets
    a group apart, an application at a time.

    Features that half of the members show, more than in the fleet, are ranked by (share in the group - share in the fleet)
    * (logarithm of the rarity + 0.15). Two bundles; four applications, with their most telling parent and kinds of
    network; two launches and two kinds of network about applications not named yet; one time of day; the best ten of all.
    """
    fleet = prevalences.groupBy("channel", "feature").agg(F.count(F.lit(1)).alias("df"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    own = prevalences.join(members, "host").groupBy("component", "channel", "feature").agg(F.count(F.lit(1)).alias("n")).join(size, "component").join(fleet, ["channel", "feature"])
    own = own.withColumns({"group_fraction": F.col("n") / F.col("size"), "fleet_fraction": F.col("df") / F.lit(hosts)}).where("group_fraction >= 0.5 AND group_fraction > fleet_fraction")
    score = (F.col("group_fraction") - F.col("fleet_fraction")) * (F.log((hosts + 1) / (F.col("df") + 1)) + 0.15)
    columns = ["component", "channel", "feature", "anchor", "group_fraction", "fleet_fraction", "score"]
    found = kept(own.withColumns({"score": score, "anchor": anchor(F.col("feature"))}).select(*columns))
    best = lambda *keys: Window.partitionBy("component", *keys).orderBy(F.col("score").desc(), "feature")
    first = lambda rows, n: rows.withColumn("k", F.row_number().over(best())).where(F.col("k") <= n).drop("k")
    each = lambda rows: rows.withColumn("k", F.row_number().over(best("anchor"))).where("k = 1 OR anchor = ''").drop("k")
    bundles = first(found.where("channel = 'bundles'"), 2)
    apps = first(each(found.where("anchor <> '' AND startswith(feature, 'app:')")), 4)
    named = apps.select("component", "anchor")
    launches = first(each(found.where("channel = 'process'").join(named, ["component", "anchor"], "left_anti")), 2)
    named = named.unionByName(launches.where("anchor <> ''").select("component", "anchor"))
    kinds = first(each(found.where("channel = 'network'").join(named, ["component", "anchor"], "left_anti")), 2)
    hours = first(found.where("channel = 'activity'"), 1)
    edges = found.where("startswith(feature, 'pc:')").withColumn("side", F.when(F.col("channel") == "platform", "platform").otherwise("applications"))
    edges = edges.withColumn("k", F.row_number().over(best("side", "anchor"))).where("k = 1").select("component", "anchor", F.col("side").alias("channel"), F.regexp_extract("feature", r"^pc:([^>]*)", 1).alias("launched_by"))
    nets = found.where("channel = 'network'").groupBy("component", "anchor").agg(F.array_join(F.sort_array(F.collect_set(F.regexp_extract("feature", r"([^:]*)$", 1))), "/").alias("network_kinds"))
    apps = apps.join(edges, ["component", "channel", "anchor"], "left").join(nets.withColumn("channel", F.lit("applications")), ["component", "channel", "anchor"], "left")
    every = apps
    for rows in (bundles, launches, kinds, hours):
        every = every.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy("component").orderBy(F.col("score").desc(), "channel", "feature")
    named = every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).withColumn("label", label(F.col("channel"), F.col("feature")))
    return named.select("component", "r", "channel", "feature", "label", "group_fraction", "fleet_fraction", "score", "launched_by", "network_kinds")


def catalogue(members: DataFrame, explained: DataFrame, scores: DataFrame, observed: DataFrame, namespace: str, partial: bool) -> DataFrame:
    """(component, id, size, observed_days, maturity, cohesion, confidence, dominant_channel) of recommended
    groups. ``observed``: (host, observed_days); partial: today's unfinished day is among the days.

    The id is made of the namespace and the group's first six explanations, so a group keeps it while these stay."""
    six = explained.where("r <= 6").groupBy("component").agg(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(":", "channel", "feature").alias("f")))).alias("f"))
    mark = six.select("component", F.sha2(F.concat(F.lit(namespace + "\n"), F.array_join("f.f", "\n")), 256).alias("fingerprint"))
    days = members.join(observed, "host").groupBy("component").agg(F.median("observed_days").cast("int").alias("observed_days"), F.count(F.lit(1)).alias("size"))
    provisional = F.lit(partial) | (F.col("observed_days") < 3)
    maturity = F.when(provisional, "provisional").when(F.col("observed_days") < 7, "growing").otherwise("stable")
    confidence = F.least(F.lit(1.0), F.col("overall") * F.least(F.lit(1.0), F.greatest(F.lit(1), F.col("observed_days")) / 7) * F.least(F.lit(1.0), F.col("size") / 15))
    largest = F.greatest(*map(F.col, CHANNEL_WEIGHTS))
    dominant = F.coalesce(*[F.when(F.col(c) == largest, c) for c in CHANNEL_WEIGHTS])
    rows = days.join(scores.drop("size"), "component").join(mark, "component").withColumn("maturity", maturity)
    return rows.select(
        "component", F.substring("fingerprint", 1, 12).alias("id"), "size", "observed_days", "maturity", F.round("overall", 3).alias("cohesion"), F.round(confidence, 3).alias("confidence"), dominant.alias("dominant_channel"),
    )


def may_suppress(registry: DataFrame) -> DataFrame:
    """Registered groups (origin, approved, suitability, maturity, partial) with whether they may suppress findings: those
    made by hand, and approved automatic ones that are recommended, stable and of whole days."""
    auto = F.col("approved") & (F.col("suitability") == "recommended") & (F.col("maturity") == "stable") & ~F.col("partial")
    return registry.withColumn("suppressing", F.coalesce((F.col("origin") == "manual") | ((F.col("origin") == "auto") & auto), F.lit(False)))
