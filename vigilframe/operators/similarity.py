"""Comparison cohorts and the evidence for them: analytical strata, cohorts seeded by application pairs, quality by sampled
pairs of hosts inside and outside, residual quality against matched controls, and the choice of reference pools.

Cohorts overlap and never suppress findings. All evidence comes from at most PAIRS pairs a cohort, and there are at most
EVALUATED cohorts (or a dozen strata), so tables of pairs are small whatever the fleet; they are broadcast, and each
join with the profiles reads these once. Members, buckets and controls are counted and ranked in Spark; only the ranked
proposals (at most PROPOSED) and their close pairs reach the driver, for the choice that depends on its own order.

Profiles come as three tables: prevalence (host, channel, feature, prevalence), weighted (host, channel, feature, weight)
and observed (host, observed_days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cohorts
from .peers import kept

#: Pairs sampled for a cohort, the channels compared, and what evidence has to reach.
PAIRS, CHANNELS = 160, ("applications", "process", "network", "activity")
QUALITY_PAIRS, QUALITY_WITHIN, DELTA = 12, 0.10, 0.08
RESIDUAL_PAIRS, RESIDUAL_WITHIN, APPLICATION_DELTA = 24, 0.12, 0.10
#: Similarity cohorts are proposed, evaluated and shown up to these numbers; how alike two may be.
PROPOSED, EVALUATED, SHOWN, ALIKE = 480, 80, 32, 0.85
DAYS, FLEET, SEEDS, PREVALENCE, LIFT = 7, 40, 16, 0.30, 1.25
#: Later days of a member, later members of a cohort and of a pool, deltas that pools are chosen at.
LATER_DAYS, LATER_MEMBERS, POOL_MEMBERS, POOL_DELTAS, PERSISTENCE = 3, 12, 11, (0.08, 0.12), 0.50
#: Hosts of a bucket are ranked within this many slices.
SLICES = 1024


def maturity(days: Column, partial: bool) -> Column:
    return F.when(F.lit(partial) | (days < 3), "provisional").when(days < 7, "growing").otherwise("stable")


# --- strata


def bands(breadths: DataFrame) -> DataFrame:
    """(dimension, band, host, n): thirds of the fleet by a breadth (host, channel, n). Equal hosts share a band; where both
    cuts are one value there are two bands, where all hosts are equal none."""
    counts = breadths.groupBy("channel", "n").agg(F.count(F.lit(1)).alias("c"))
    total = Window.partitionBy("channel")
    placed = counts.withColumns({"upto": F.sum("c").over(total.orderBy("n")), "last": F.sum("c").over(total) - 1})
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(k * F.col("last") / 3), F.col("n")))
    cuts = placed.groupBy("channel").agg(at(1).alias("low"), at(2).alias("high"), F.count(F.lit(1)).alias("values")).where(F.col("values") >= 2)
    band = F.when(F.col("n") <= F.col("low"), "lower").when((F.col("n") <= F.col("high")), "middle").otherwise("higher")
    return breadths.join(F.broadcast(cuts), "channel").select(F.col("channel").alias("dimension"), band.alias("band"), "host", "n")


def strata(prevalence: DataFrame, observed: DataFrame, hosts: int, partial: bool) -> tuple[DataFrame, DataFrame]:
    """(cohorts, members): bands of breadth that hold 5 % to 95 % of the hosts, three at least.

    Cohorts: (grp, dimension, band, size, fraction, low, high, middle, observed_days, maturity); members: (grp, host)."""
    shown = prevalence.where(F.col("channel").isin(*CHANNELS) & (F.col("prevalence") >= cohorts.STRATUM_PREVALENCE)).groupBy("host", "channel").agg(F.count(F.lit(1)).alias("n"))
    channels = F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel")  # a host without features of a channel counts as 0
    breadths = observed.select("host", "observed_days", channels).join(shown, ["host", "channel"], "left").fillna(0, ["n"])
    placed = kept(bands(breadths.select("host", "channel", "n")).withColumn("grp", F.concat_ws(":", "dimension", "band")))
    with_days = placed.join(observed, "host")
    middle = F.percentile("n", 0.5)
    sized = with_days.groupBy("grp", "dimension", "band").agg(
        F.count(F.lit(1)).alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), middle.alias("middle"), F.percentile("observed_days", 0.5).cast("int").alias("observed_days"),
    )
    least = max(3, -(-hosts * 5 // 100))
    fit = sized.where((F.col("size") >= least) & (F.col("size") <= 0.95 * hosts)) if hosts >= 3 else sized.limit(0)
    fit = fit.withColumns({"fraction": F.col("size") / F.lit(hosts), "maturity": maturity(F.col("observed_days"), partial)})
    return fit, placed.join(F.broadcast(fit.select("grp")), "grp").select("grp", "host")


# --- pairs of hosts


def sample_pairs(members: DataFrame, seed: str) -> DataFrame:
    """(grp, i, a, b), a < b: all pairs of a small group, PAIRS of a larger one, numbered.

    Members are put in order of a hash; only the first PAIRS + 1 of a group stay (ranked within each task before they are
    shuffled), as a ring: each with the next, then with the one after, until there are enough. No pair comes twice."""
    order = Window.partitionBy("grp").orderBy(F.sha2(F.concat_ws(":", "grp", F.lit(seed), "host"), 256), "host")
    ring = members.select("grp", "host", F.row_number().over(order).alias("at")).where(F.col("at") <= PAIRS + 1)
    ring = ring.withColumns({"at": F.col("at") - 1, "m": F.count(F.lit(1)).over(Window.partitionBy("grp"))}).where("m >= 2")
    steps = F.least(F.floor(F.col("m") / 2), F.ceil(F.lit(PAIRS) / F.col("m"))).cast("int")
    asked = ring.withColumn("o", F.explode(F.sequence(F.lit(1), steps))).where("2 * o < m OR at < o")
    asked = asked.withColumns({"i": ((F.col("o") - 1) * F.col("m") + F.col("at")).cast("int"), "to": (F.col("at") + F.col("o")) % F.col("m")}).where(F.col("i") < PAIRS)
    other = ring.select("grp", F.col("at").alias("to"), F.col("host").alias("other"))
    return asked.join(other, ["grp", "to"]).select("grp", "i", F.least("host", "other").alias("a"), F.greatest("host", "other").alias("b"))


def overlaps(pairs: DataFrame, features: DataFrame, keys: list[str], usable: Column | None = None) -> DataFrame:
    """(keys, channel, overlap) of pairs (keys, a, b and what ``usable`` reads): weighted Jaccard similarity of two hosts.

    There is no row where neither host has a feature of the channel (they can't be compared), 0 where one has none. ``pairs`` are few
    (see above): both sides' features come by one broadcast join, and the larger sums follow from the totals."""
    sides = F.array(F.struct(F.col("a").alias("host"), F.lit(True).alias("one")), F.struct(F.col("b").alias("host"), F.lit(False).alias("one")))
    few = F.broadcast(kept(pairs).select("*", F.inline(sides)))
    own = features.join(few, "host").where(F.lit(True) if usable is None else usable)
    value = lambda one: F.max(F.when(F.col("one") == one, F.col("weight")))
    both = own.groupBy(*keys, "channel", "feature").agg(value(True).alias("x"), value(False).alias("y"))
    sums = both.groupBy(*keys, "channel").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.least(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0)))).alias("low"))
    share = F.when(F.col("x").isNull() | F.col("y").isNull(), 0.0).otherwise(F.try_divide(F.col("low"), F.col("x") + F.col("y") - F.col("low")))
    return sums.select(*keys, "channel", share.alias("overlap"))


def quality(members: DataFrame, everyone: DataFrame, weighted: DataFrame) -> DataFrame:
    """(grp, channel, within, within_pairs, fleet, fleet_pairs, delta): mean overlap of sampled pairs of a cohort's members
    against pairs of all hosts, which are the same for every cohort."""
    rows = weighted.where(F.col("channel").isin(*CHANNELS))
    fleet = overlaps(sample_pairs(everyone.select(F.lit("fleet").alias("grp"), "host"), "fleet-quality-v1"), rows, ["grp", "i"])
    inside = overlaps(sample_pairs(members.select("grp", "host"), "quality-v1"), rows, ["grp", "i"])
    mean = lambda df, keys, a, b: df.where("overlap IS NOT NULL").groupBy(*keys).agg(F.avg("overlap").alias(a), F.count(F.lit(1)).alias(b))
    every = members.select("grp").distinct().select("grp", F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"))
    found = every.join(mean(inside, ["grp", "channel"], "within", "within_pairs"), ["grp", "channel"], "left")
    found = found.join(F.broadcast(mean(fleet, ["channel"], "fleet", "fleet_pairs")), "channel", "left").fillna(0, ["within_pairs", "fleet_pairs"])
    return found.select("grp", "channel", "within", "within_pairs", "fleet", "fleet_pairs", (F.col("within") - F.col("fleet")).alias("delta"))


def supports(within: float) -> Column:
    """Whether a row of ``quality`` is evidence for its cohort."""
    enough = (F.col("within_pairs") >= QUALITY_PAIRS) & (F.col("fleet_pairs") >= QUALITY_PAIRS)
    return F.coalesce(enough & (F.col("within") >= within) & (F.col("delta") >= DELTA), F.lit(False))


def independent_support(found: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(grp, independent): channels other than the cohort's own dimension (grp, dimension) that are evidence for it."""
    rows = found.join(F.broadcast(dimensions.select("grp", "dimension")), "grp")
    return rows.groupBy("grp").agg(F.count_if(supports(QUALITY_WITHIN) & (F.col("channel") != F.col("dimension"))).alias("independent"))


# --- similarity cohorts


def established(observed: DataFrame) -> DataFrame:
    """Hosts with enough days to be in a similarity cohort."""
    return observed.where(F.col("observed_days") >= DAYS)


def seeds(prevalence: DataFrame, hosts: DataFrame, n: int) -> DataFrame:
    """(host, app, df): up to SEEDS recurring applications a host, neither rare nor all over the fleet, the most telling
    first."""
    shown = prevalence.where((F.col("channel") == "applications") & (F.col("prevalence") >= PREVALENCE)).join(hosts.select("host"), "host", "left_semi")
    df = shown.groupBy("feature").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= least_members(n)) & (F.col("df") <= n * 80 // 100))
    order = Window.partitionBy("host").orderBy((F.col("prevalence") * (1 - F.col("df") / F.lit(n))).desc(), "feature")
    ranked = shown.join(df, "feature").withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEEDS)
    return ranked.select("host", F.col("feature").alias("app"), "df")


def least_members(n: int) -> int:
    return max(20, -(-n // 100))


def proposals(seeded: DataFrame, n: int) -> DataFrame:
    """(r, first, second, members, lift, utility): the best PROPOSED pairs of seeds, from 0. A host has at most 120 pairs."""
    lists = seeded.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("app", "df"))).alias("apps"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(apps, (x, i) -> transform(slice(apps, i + 2, size(apps)), y -> struct(x, y))))")).alias("p"))
    counted = pairs.groupBy(F.col("p.x.app").alias("first"), F.col("p.y.app").alias("second"), F.col("p.x.df").alias("df1"), F.col("p.y.df").alias("df2")).agg(F.count(F.lit(1)).alias("members"))
    lift = F.col("members") * F.lit(float(n)) / (F.col("df1") * F.col("df2"))
    fit = counted.withColumn("lift", lift).where((F.col("members") >= least_members(n)) & (F.col("members") <= 0.65 * n) & (F.col("lift") >= LIFT))
    best = [F.col("utility").desc(), F.col("members").desc(), F.col("first"), F.col("second")]
    top = fit.withColumn("utility", F.col("members") * F.log2("lift")).orderBy(*best).limit(PROPOSED)
    return top.select((F.row_number().over(Window.orderBy(*best)) - 1).alias("r"), "first", "second", "members", "lift", "utility")


def proposed_members(proposed: DataFrame, seeded: DataFrame) -> DataFrame:
    """(r, host): hosts that have both seeds of a proposal."""
    one = seeded.select("host", F.col("app").alias("first")).join(F.broadcast(proposed.select("r", "first", "second")), "first")
    return one.join(seeded.select("host", F.col("app").alias("second")), ["host", "second"]).select("r", "host")


def alike(members: DataFrame, proposed: DataFrame, at_least: float = ALIKE) -> DataFrame:
    """(r, earlier, jaccard) of proposals that share nearly all their members.

    Hosts in the same proposals are counted together first, and sets whose sizes differ too much can't be alike, so they
    make no pair."""
    size = lambda r, s: F.broadcast(proposed.select(F.col("r").alias(r), F.col("members").alias(s)))
    sets = members.groupBy("host").agg(F.sort_array(F.collect_list("r")).alias("rs")).groupBy("rs").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select("n", F.explode("rs").alias("r"), "rs").select("n", "r", F.explode(F.filter("rs", lambda x: x < F.col("r"))).alias("earlier"))
    pairs = pairs.join(size("r", "s"), "r").join(size("earlier", "t"), "earlier").where(F.least("s", "t") >= at_least * F.greatest("s", "t"))
    shared = pairs.groupBy("r", "earlier", "s", "t").agg(F.sum("n").alias("shared"))
    return shared.withColumn("jaccard", F.col("shared") / (F.col("s") + F.col("t") - F.col("shared"))).where(F.col("jaccard") >= at_least).select("r", "earlier", "jaccard")


def chosen(proposed: DataFrame, members: DataFrame) -> list[int]:
    """Places of the proposals that are evaluated: in order of their rank, those that are alike with none chosen before."""
    near: dict[int, list[int]] = {}
    for row in alike(members, proposed).collect():  # at most PROPOSED squared
        near.setdefault(row.r, []).append(row.earlier)
    taken: list[int] = []
    for (r,) in proposed.select("r").orderBy("r").collect():  # at most PROPOSED
        if len(taken) < EVALUATED and not set(taken) & set(near.get(r, ())):
            taken.append(r)
    return taken


def candidates(prevalence: DataFrame, observed: DataFrame, namespace: str, partial: bool) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of similarity cohorts before they are assessed; both empty for a fleet with few established hosts.

    Groups: (grp, first, second, size, fraction, observed_days, maturity, utility); members: (grp, host)."""
    hosts = kept(established(observed))
    n = hosts.count()
    seeded = kept(seeds(prevalence, hosts, n) if n >= FLEET else seeds(prevalence, hosts, max(n, 1)).limit(0))
    proposed = kept(proposals(seeded, max(n, 1)))
    inside = kept(proposed_members(proposed, seeded))
    taken = proposed.where(F.col("r").isin(chosen(proposed, inside)))
    name = F.concat(F.lit("bs-"), F.substring(F.sha2(F.concat(F.lit(namespace), F.lit("\0"), "first", F.lit("\0"), "second"), 256), 1, 16))
    named = kept(taken.withColumn("grp", name))
    members = kept(inside.join(F.broadcast(named.select("r", "grp")), "r").select("grp", "host"))
    days = members.join(hosts, "host").groupBy("grp").agg(F.percentile("observed_days", 0.5).cast("int").alias("observed_days"))
    groups = named.join(days, "grp").select(
        "grp", F.substring("first", 5, 10_000).alias("first"), F.substring("second", 5, 10_000).alias("second"), F.col("members").alias("size"), (F.col("members") / F.lit(max(n, 1))).alias("fraction"),
        "observed_days", F.lit("provisional" if partial else "stable").alias("maturity"), "utility",
    )
    return kept(groups), members


# --- residual quality


def controls(pairs: DataFrame, members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(grp, i, control) for pairs (grp, i, subject): a host outside the group in the subject's bucket, or where the bucket
    has none, in one of the four beside it. Pairs without such a host are left out.

    ``buckets``: (host, app_bin, day_bin). The control is the k-th of the outside hosts in order of (slice, host), k a hash
    of group and pair modulo their number. Outside hosts are counted by slice, as all hosts less the members, and only the
    slice that holds the k-th is looked at, so neither groups nor buckets are listed. The hash is made once a pair, before
    pairs meet the slices."""
    key = ["app_bin", "day_bin"]
    slice_ = F.conv(F.substring(F.sha2("host", 256), 1, 8), 16, 10).cast("long") % SLICES
    placed = kept(buckets.withColumn("slice", slice_.cast("int")))
    everyone = placed.groupBy(*key, "slice").agg(F.count(F.lit(1)).alias("n"))
    own = placed.join(members, "host").groupBy("grp", *key, "slice").agg(F.count(F.lit(1)).alias("own"))
    hash_ = F.conv(F.substring(F.sha2(F.concat_ws(":", "grp", "i"), 256), 1, 8), 16, 10).cast("long")
    asked = kept(pairs.join(placed.select(F.col("host").alias("subject"), *key), "subject").withColumn("hash", hash_))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    near = asked.select("grp", F.col("app_bin").alias("of_app"), F.col("day_bin").alias("of_day")).distinct().withColumn("step", F.explode(steps))
    near = near.select("grp", "of_app", "of_day", (F.col("of_app") + F.col("step.a")).alias("app_bin"), (F.col("of_day") + F.col("step.b")).alias("day_bin"))
    open_ = near.join(everyone, key).join(own, ["grp", *key, "slice"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0")
    here = (F.col("app_bin") == F.col("of_app")) & (F.col("day_bin") == F.col("of_day"))
    pool = Window.partitionBy("grp", "of_app", "of_day")
    open_ = kept(open_.withColumns({"here": here, "exact": F.max(here).over(pool)}).where("here OR NOT exact"))
    slices = open_.groupBy("grp", "of_app", "of_day", "slice").agg(F.sum("n").alias("n"))
    slices = slices.withColumns({"upto": F.sum("n").over(pool.orderBy("slice")), "total": F.sum("n").over(pool)})
    k = F.pmod("hash", "total")
    at = asked.withColumnsRenamed({"app_bin": "of_app", "day_bin": "of_day"}).join(slices, ["grp", "of_app", "of_day"]).withColumn("k", k)
    at = at.where("k < upto AND k >= upto - n").select("grp", "i", "of_app", "of_day", "slice", (F.col("k") - F.col("upto") + F.col("n")).alias("k"))
    listed = at.join(open_.select("grp", "of_app", "of_day", *key, "slice"), ["grp", "of_app", "of_day", "slice"]).join(placed, [*key, "slice"])
    listed = listed.join(members, ["grp", "host"], "left_anti")
    order = Window.partitionBy("grp", "i").orderBy("host")
    return listed.withColumn("p", F.row_number().over(order) - 1).where("p = k").select("grp", "i", F.col("host").alias("control"))


def unmasked(first: str = "first", second: str = "second") -> Column:
    """Whether a process or network feature says nothing about a group's two seed applications."""
    seeds_ = [F.col(first), F.col(second)]
    launch = F.split(F.substring("feature", 4, 100_000), ">", 2)
    of_launch = launch[0].isin(*seeds_) | F.coalesce(F.try_element_at(launch, F.lit(2)).isin(*seeds_), F.lit(False))
    of_network = F.split("feature", ":")[1].isin(*seeds_)
    return ~F.when(F.startswith("feature", F.lit("pc:")), of_launch).when(F.startswith("feature", F.lit("net:")), of_network).otherwise(False)


def residual(groups: DataFrame, members: DataFrame, prevalence: DataFrame, weighted: DataFrame, observed: DataFrame) -> DataFrame:
    """(grp, channel, within, control, delta, pairs, sampled, matched) for process and network: what members have in common
    beyond the two applications that made the group, against hosts outside with as many applications and days.

    The first host of every other pair (else the second) is compared with its partner and with its control, features of the
    seeds taken out; a pair counts if both comparisons are possible."""
    apps = prevalence.where((F.col("channel") == "applications") & (F.col("prevalence") >= PREVALENCE)).groupBy("host").agg(F.count(F.lit(1)).alias("apps"))
    depth = observed.join(apps, "host", "left").select("host", F.coalesce("apps", F.lit(0)).alias("apps"), F.col("observed_days").alias("days"))
    pairs = sample_pairs(members, "residual-v2")
    turned = pairs.select("grp", "i", F.when(F.col("i") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("subject"), F.when(F.col("i") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("other"))
    turned = kept(turned)
    found = kept(turned.join(controls(turned.select("grp", "i", "subject"), members, cohorts.match_buckets(depth)), ["grp", "i"]).join(F.broadcast(groups.select("grp", "first", "second")), "grp"))
    rows = weighted.where(F.col("channel").isin("process", "network"))
    side = lambda name: overlaps(found.select("grp", "i", "first", "second", F.col("subject").alias("a"), F.col(name).alias("b")), rows, ["grp", "i"], unmasked()).where("overlap IS NOT NULL")
    both = side("other").withColumnRenamed("overlap", "within").join(side("control").withColumnRenamed("overlap", "control"), ["grp", "i", "channel"])
    means = both.groupBy("grp", "channel").agg(F.avg("within").alias("within"), F.avg("control").alias("control"), F.count(F.lit(1)).alias("pairs"))
    counts = turned.groupBy("grp").agg(F.count(F.lit(1)).alias("sampled")).join(found.groupBy("grp").agg(F.count(F.lit(1)).alias("matched")), "grp", "left").fillna(0, ["matched"])
    every = groups.select("grp", F.explode(F.array(F.lit("process"), F.lit("network"))).alias("channel"))
    out = every.join(counts, "grp", "left").join(means, ["grp", "channel"], "left").fillna(0, ["sampled", "matched", "pairs"])
    return out.select("grp", "channel", "within", "control", (F.col("within") - F.col("control")).alias("delta"), "pairs", "sampled", "matched")


def residual_supports(delta: float = DELTA) -> Column:
    return F.coalesce((F.col("pairs") >= RESIDUAL_PAIRS) & (F.col("within") >= RESIDUAL_WITHIN) & (F.col("delta") >= delta), F.lit(False))


def discover(prevalence: DataFrame, weighted: DataFrame, observed: DataFrame, namespace: str = "main", partial: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(groups, members, quality, residual): similarity cohorts with their evidence, the best SHOWN of them.

    Groups: those of ``candidates`` with application_delta, views (channels of residual support), unmasked_views, process_delta,
    network_delta, status (supported or exploratory) and place (from 1). Supported ones come first, then the larger application
    delta, more views, more members, the smaller name."""
    groups, members = candidates(prevalence, observed, namespace, partial)
    hosts = established(observed)  # pairs and controls are drawn from these alone, so the profiles needn't be filtered
    found = kept(quality(members, hosts, weighted))
    rest = kept(residual(groups, members, prevalence, weighted, hosts))
    apps = found.where("channel = 'applications'").select("grp", F.col("delta").alias("application_delta"))
    plain = found.where(F.col("channel").isin("process", "network")).groupBy("grp").agg(F.count_if(supports(RESIDUAL_WITHIN)).alias("unmasked_views"))
    delta = lambda c: F.max(F.when(F.col("channel") == c, F.col("delta"))).alias(f"{c}_delta")
    views = rest.groupBy("grp").agg(F.count_if(residual_supports()).alias("views"), delta("process"), delta("network"))
    every = groups.join(apps, "grp", "left").join(plain, "grp", "left").join(views, "grp", "left")
    supported = (F.col("views") > 0) & F.coalesce(F.col("application_delta") >= APPLICATION_DELTA, F.lit(False))
    every = every.withColumn("status", F.when(supported, "supported").otherwise("exploratory"))
    order = Window.orderBy(F.col("status") != "supported", F.coalesce("application_delta", F.lit(-1.0)).desc(), F.col("views").desc(), F.col("size").desc(), "grp")  # EVALUATED rows at most
    shown = kept(every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SHOWN))
    return shown, kept(members.join(F.broadcast(shown.select("grp")), "grp", "left_semi")), found, rest


def overlap_summary(members: DataFrame) -> DataFrame:
    """(measure, value): how cohorts overlap, in counts alone. Hosts in the same cohorts are counted together, and pairs of
    cohorts come from these sets."""
    sets = kept(members.groupBy("host").agg(F.sort_array(F.collect_list("grp")).alias("gs")).groupBy("gs").agg(F.count(F.lit(1)).alias("n")))
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    pairs = sets.select("n", F.explode("gs").alias("a"), "gs").select("n", "a", F.explode(F.filter("gs", lambda x: x > F.col("a"))).alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    sized = lambda s: F.broadcast(size.select(F.col("grp").alias(s), F.col("size").alias(f"{s}_size")))
    jaccard = shared.join(sized("a"), "a").join(sized("b"), "b").select((F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))).alias("j"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    m = F.size("gs")
    by_host = sets.agg(
        count(m > 1).alias("hosts_with_several"), F.coalesce(F.max(m), F.lit(0)).cast("double").alias("largest_number"), *[count(m == k).alias(f"in_{k}") for k in range(1, 5)], count(m >= 5).alias("in_5_or_more"),
        F.coalesce(F.sum(m * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("mean_number"),
    )
    by_pair = jaccard.agg(F.count_if(F.col("j") >= 0.5).cast("double").alias("pairs_over_half"), F.count_if(F.col("j") >= 0.75).cast("double").alias("pairs_over_three_quarters"), F.coalesce(F.max("j"), F.lit(0.0)).alias("largest_overlap"))
    one = by_host.crossJoin(by_pair)  # one row each
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("measure", "value"))


# --- later days and reference pools


def validate(groups: DataFrame, members: DataFrame, prevalence: DataFrame, weighted: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, later members): groups of earlier days on later ones. Membership is frozen; the other tables are of later days.

    Rows: (grp, place, size, later, persistence, training, holds, and for process and network delta, within and pairs).
    A group's residual quality is measured if LATER_MEMBERS of its members are seen on LATER_DAYS later days."""
    seen = kept(observed.where(F.col("observed_days") >= LATER_DAYS))
    later = kept(members.join(seen.select("host"), "host", "left_semi").join(F.broadcast(groups.select("grp")), "grp", "left_semi"))
    shown = prevalence.where((F.col("channel") == "applications") & (F.col("prevalence") >= PREVALENCE)).select("host", F.substring("feature", 5, 10_000).alias("app"))
    both = later.join(F.broadcast(groups.select("grp", "first", "second")), "grp").join(shown, "host").where("app = first OR app = second")
    both = both.groupBy("grp", "host").agg(F.count(F.lit(1)).alias("n")).where("n = 2").groupBy("grp").agg(F.count(F.lit(1)).alias("persistent"))
    counts = later.groupBy("grp").agg(F.count(F.lit(1)).alias("later")).join(both, "grp", "left")
    enough = kept(groups.join(counts.where(F.col("later") >= LATER_MEMBERS).select("grp"), "grp", "left_semi"))
    rest = kept(residual(enough, later.join(F.broadcast(enough.select("grp")), "grp", "left_semi"), prevalence, weighted, seen))
    wide = rest.groupBy("grp").agg(F.count_if(residual_supports()).alias("views"), *[F.max(F.when(F.col("channel") == c, F.col(m))).alias(f"{c}_{m}") for c in ("process", "network") for m in ("within", "delta", "pairs")])
    rows = groups.select("grp", "place", "size", (F.col("status") == "supported").alias("training")).join(counts, "grp", "left").join(wide, "grp", "left").fillna(0, ["later", "persistent", "views", "process_pairs", "network_pairs"])
    rows = rows.withColumn("persistence", F.when(F.col("later") > 0, F.col("persistent") / F.col("later")))
    return kept(rows.withColumn("holds", (F.col("views") > 0) & F.coalesce(F.col("persistence") >= PERSISTENCE, F.lit(False)))), later


def preferred_pools(rows: DataFrame, later: DataFrame, deltas: tuple[float, ...] = POOL_DELTAS) -> DataFrame:
    """(minimum, channel, host, grp, possible): for each delta asked for, the one group that serves a host as reference in each
    view, and out of how many: the largest later advantage, then more pairs, more members, the earlier place."""
    fit = rows.where(F.col("training") & F.col("holds") & (F.col("later") >= POOL_MEMBERS))
    views = F.array(*[F.struct(F.lit(c).alias("channel"), *[F.col(f"{c}_{m}").alias(m) for m in ("within", "delta", "pairs")]) for c in ("process", "network")])
    each = fit.select("grp", "place", "later", F.inline(views)).withColumn("minimum", F.explode(F.array(*map(F.lit, deltas))))
    each = each.where((F.col("pairs") >= RESIDUAL_PAIRS) & (F.col("within") >= RESIDUAL_WITHIN) & (F.col("delta") >= F.col("minimum")))
    order = Window.partitionBy("minimum", "channel", "host").orderBy(F.col("delta").desc(), F.col("pairs").desc(), F.col("later").desc(), "place")
    possible = F.count(F.lit(1)).over(Window.partitionBy("minimum", "channel", "host"))
    return later.join(F.broadcast(each), "grp").withColumns({"r": F.row_number().over(order), "possible": possible}).where("r = 1").select("minimum", "channel", "host", "grp", "possible")


def pool_summary(pools: DataFrame, deltas: tuple[float, ...] = POOL_DELTAS) -> DataFrame:
    """(minimum, process_hosts, network_hosts, any_hosts, both_hosts, possible, pools, largest) of ``preferred_pools``; zeros
    included."""
    pools = kept(pools)
    by_host = pools.groupBy("minimum", "host").agg(F.count_if(F.col("channel") == "process").alias("p"), F.count_if(F.col("channel") == "network").alias("n"), F.sum("possible").alias("s"))
    hosts = by_host.groupBy("minimum").agg(F.sum("p").alias("process_hosts"), F.sum("n").alias("network_hosts"), F.count(F.lit(1)).alias("any_hosts"), F.count_if((F.col("p") > 0) & (F.col("n") > 0)).alias("both_hosts"), F.sum("s").alias("possible"))
    use = pools.groupBy("minimum", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("minimum").agg(F.count(F.lit(1)).alias("pools"), F.max("n").alias("largest"))
    every = pools.sparkSession.createDataFrame([(d,) for d in deltas], "minimum double")
    return every.join(hosts, "minimum", "left").join(use, "minimum", "left").fillna(0)


def best_supported(groups: DataFrame, members: DataFrame, largest: int = 500) -> DataFrame:
    """(host, grp, size): the supported group of at most ``largest`` hosts that a host is compared with: the largest process
    delta, then network delta, then name."""
    fit = groups.where((F.col("status") == "supported") & (F.col("size") > 1) & (F.col("size") <= largest) & (F.greatest(F.coalesce("process_delta", F.lit(0.0)), F.coalesce("network_delta", F.lit(0.0))) >= DELTA))
    order = Window.partitionBy("host").orderBy(F.coalesce("process_delta", F.lit(0.0)).desc(), F.coalesce("network_delta", F.lit(0.0)).desc(), F.col("grp").desc())
    return members.join(F.broadcast(fit), "grp").withColumn("r", F.row_number().over(order)).where("r = 1").select("host", "grp", "size")


def compared(best: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, host): members of the groups that some host is compared with. There are at most SHOWN of these, of at most as many
    hosts as ``best_supported`` allows, whatever the fleet."""
    return members.join(F.broadcast(best.select("grp").distinct()), "grp", "left_semi").select("grp", "host")


def evidence(subjects: DataFrame, prior: DataFrame, best: DataFrame, members: DataFrame, minimum_days: int) -> DataFrame:
    """(host, app, parent, location, grp, size, qualified, with_same, available): of the other members of a host's best
    supported group, how many have shown the application on enough earlier days, and how many of them in the same context. Hosts
    without such a group get zeros.

    Of ``prior`` only the days of ``compared`` hosts count. Qualified members are counted by (group, application) and by (group,
    context), then the host itself is taken off, so no pairs of hosts are made."""
    context = ["app", "parent", "location"]
    days = prior.groupBy("host", "app").agg(F.count_distinct("day").alias("days")).where(F.col("days") >= minimum_days).select("host", "app")
    qualified = kept(days.join(compared(best, members), "host"))
    shown = prior.select("host", *context).distinct().join(qualified, ["host", "app"])
    by_app = qualified.groupBy("grp", "app").agg(F.count(F.lit(1)).alias("with_app"))
    by_context = shown.groupBy("grp", *context).agg(F.count(F.lit(1)).alias("with_context"))
    own_app = qualified.select("host", "grp", "app", F.lit(1).alias("own_app"))
    own_context = shown.select("host", "grp", *context, F.lit(1).alias("own_context"))
    rows = subjects.select("host", *context).distinct().join(best, "host", "left")
    rows = rows.join(by_app, ["grp", "app"], "left").join(by_context, ["grp", *context], "left").join(own_app, ["host", "grp", "app"], "left").join(own_context, ["host", "grp", *context], "left")
    less = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    return rows.select("host", *context, "grp", F.coalesce("size", F.lit(0)).alias("size"), less("with_app", "own_app").alias("qualified"), less("with_context", "own_context").alias("with_same"), (less("with_app", "own_app") > 0).alias("available"))
