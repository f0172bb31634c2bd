"""Behaviour profiles of hosts in long form: (host, channel, feature, prevalence, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Channels with their votes, how many features of each a host keeps, and the support thresholds.
CHANNEL_WEIGHTS = {"applications": 0.40, "bundles": 0.15, "process": 0.20, "network": 0.15, "activity": 0.10}
CHANNEL_LIMITS = {"applications": 160, "bundles": 96, "process": 96, "network": 64, "activity": 8, "platform": 96}
BUNDLE_APPS, TECHNICAL_FEATURES = 18, 36
UNUSABLE = ("", "unknown", "-")


def _usable(name: str) -> F.Column:
    return F.col(name).isNotNull() & ~F.col(name).isin(*UNUSABLE)


def features(obs: DataFrame) -> DataFrame:
    """(host, channel, feature, day): what each observation says about its host. Windows components go to ``platform``,
    which has no vote."""
    platform = F.col("location") == "windows"
    bin6 = F.floor((F.floor(F.col("ts") / 3600) % 24) / 6).cast("int") * 6
    activity = F.concat(F.lit("activity:"), F.lpad(bin6.cast("string"), 2, "0"), F.lit("-"), F.lpad((bin6 + 6).cast("string"), 2, "0"), F.lit("utc"))
    found = F.array(
        F.when(_usable("app"), F.struct(F.when(platform, "platform").otherwise("applications").alias("channel"), F.concat(F.lit("app:"), "app").alias("feature"))),
        F.when(_usable("app") & _usable("parent"), F.struct(F.when(platform, "platform").otherwise("process").alias("channel"), F.concat(F.lit("pc:"), "parent", F.lit(">"), "app").alias("feature"))),
        F.when(_usable("app") & F.col("kind").isNotNull() & ~platform, F.struct(F.lit("network").alias("channel"), F.concat(F.lit("net:"), "app", F.lit(":"), "kind").alias("feature"))),
        F.struct(F.lit("activity").alias("channel"), activity.alias("feature")),
    )
    return obs.select("host", "day", F.explode(found).alias("f")).where("f IS NOT NULL").select("host", "f.channel", "f.feature", "day")


def shown_days(obs: DataFrame) -> DataFrame:
    """(host, channel, feature, word, bits): the days on which a host shows a feature, 64 days a row, one bit each. Bits merge
    by OR, so observations are reduced before they are shuffled; a word covers days 64 * word to 64 * word + 63."""
    bits = F.bit_or(F.expr("shiftleft(1L, cast(day & 63 AS int))")).alias("bits")
    return features(obs).groupBy("host", "channel", "feature", F.expr("shiftright(day, 6)").alias("word")).agg(bits)


def _days() -> F.Column:
    return F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))


def observed_days(shown: DataFrame) -> DataFrame:
    """(host, observed_days) from ``shown_days``: each observation shows a feature (its activity), so a host's features
    together have all its days."""
    return shown.groupBy("host", "word").agg(F.bit_or("bits").alias("bits")).groupBy("host").agg(_days().alias("observed_days"))


def shares(shown: DataFrame, observed: DataFrame) -> DataFrame:
    """(host, channel, feature, prevalence) from ``shown_days`` and ``observed_days``."""
    per_feature = shown.groupBy("host", "channel", "feature").agg(_days().alias("days"))
    return per_feature.join(observed, "host").select("host", "channel", "feature", (F.col("days") / F.col("observed_days")).alias("prevalence"))


def prevalence(obs: DataFrame) -> DataFrame:
    """Share of a host's own observed days on which it shows a feature."""
    shown = shown_days(obs)
    return shares(shown, observed_days(shown))


def bundles(prevalences: DataFrame, hosts: int) -> DataFrame:
    """Pairs among a host's most prevalent applications that enough, but not nearly all, hosts share."""
    order = Window.partitionBy("host").orderBy(F.col("prevalence").desc(), "feature")
    top = prevalences.where("channel = 'applications'").withColumn("r", F.row_number().over(order)).where((F.col("r") <= BUNDLE_APPS) & (F.col("prevalence") >= 0.2))
    apps = top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.expr("substring(feature, 5)").alias("a"), "prevalence"))).alias("apps"))
    pairs = apps.select("host", F.explode(F.expr("flatten(transform(apps, (x, i) -> transform(slice(apps, i + 2, size(apps)), y -> struct(x, y))))")).alias("p"))
    pairs = pairs.select("host", F.concat(F.lit("bundle:"), "p.x.a", F.lit("|"), "p.y.a").alias("feature"), F.least("p.x.prevalence", "p.y.prevalence").alias("prevalence"))
    least, most = (2, 0.80) if hosts < 20 else (3, 0.65)
    shared = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("n") / hosts <= most))
    return pairs.join(shared.select("feature"), "feature", "left_semi").select("host", F.lit("bundles").alias("channel"), "feature", "prevalence")


def document_frequency(prevalences: DataFrame) -> DataFrame:
    return prevalences.groupBy("channel", "feature").agg(F.count(F.lit(1)).alias("df"))


def weights(prevalences: DataFrame, hosts: int) -> DataFrame:
    """Prevalence times a bounded inverse frequency; each host keeps the heaviest features of a channel.

    Features of a single host, which are most of them in a large fleet, aren't listed: the table that is joined stays small
    enough for a broadcast where hosts share few features, and no task gets all hosts of a common one."""
    idf = F.when(F.col("channel") == "activity", 1.0).otherwise(F.least(F.lit(2.0), 0.25 + F.greatest(F.lit(0.0), F.log((hosts + 1) / (F.col("df") + 1)))))
    shared = document_frequency(prevalences).where("df > 1")
    placed = prevalences.where("channel IS NOT NULL AND feature IS NOT NULL").join(shared, ["channel", "feature"], "left").fillna(1, ["df"])
    weighted = placed.withColumn("weight", F.col("prevalence") * idf)
    order = Window.partitionBy("host", "channel").orderBy(F.col("weight").desc(), "feature")
    limit = F.create_map(*[F.lit(x) for pair in CHANNEL_LIMITS.items() for x in pair])[F.col("channel")]
    return weighted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("host", "channel", "feature", "prevalence", "weight", "r")


def technical(prevalences: DataFrame, hosts: int) -> DataFrame:
    """Unit vectors of distinctive features (host, feature, value, r), for technical clusters."""
    least = 2 if hosts < 20 else 3
    rows = prevalences.where("channel <> 'activity'").join(document_frequency(prevalences), ["channel", "feature"])
    rows = rows.where((F.col("df") >= least) & (F.col("df") / hosts <= 0.55)).select(
        "host", F.concat("channel", F.lit(":"), "feature").alias("feature"), (F.col("prevalence") * (F.log((hosts + 1) / (F.col("df") + 1)) + 0.15)).alias("v")
    )
    order = Window.partitionBy("host").orderBy(F.col("v").desc(), "feature")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TECHNICAL_FEATURES)
    return rows.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("host")))).select("host", "feature", (F.col("v") / F.col("norm")).alias("value"), "r")


def with_bundles(obs: DataFrame) -> tuple[DataFrame, int]:
    """(prevalence of all channels, number of hosts). The one action is the count of hosts."""
    base = prevalence(obs)
    hosts = obs.select("host").distinct().count()
    return base.unionByName(bundles(base, hosts)), hosts


#: Days that profiles look back, and hosts that a namespace needs.
REFERENCE_DAYS, FEWEST_HOSTS = 28, 3


def profile_days(obs: DataFrame, today: int) -> DataFrame:
    """(namespace, first_day, last_day, partial): the days that each namespace's profiles are made of. Completed days if it has
    any among the last REFERENCE_DAYS, else today so far, which is partial."""
    first = today - (REFERENCE_DAYS - 1)
    seen = obs.where((F.col("day") >= first) & (F.col("day") <= today)).groupBy("namespace").agg(F.min("day").alias("earliest"))
    completed = F.col("earliest") < today
    return seen.select("namespace", F.lit(first).alias("first_day"), F.when(completed, today - 1).otherwise(today).alias("last_day"), (~completed).alias("partial"))


def explicit_days(obs: DataFrame, first: int, last: int, today: int) -> DataFrame:
    """As ``profile_days``, of completed days that the caller names."""
    if not today - REFERENCE_DAYS <= first <= last < today:
        raise ValueError(f"Explicit windows must be completed UTC days within the last {REFERENCE_DAYS}")
    return obs.select("namespace").distinct().select("namespace", F.lit(first).alias("first_day"), F.lit(last).alias("last_day"), F.lit(False).alias("partial"))


def namespace_weights(obs: DataFrame, days: DataFrame) -> DataFrame:
    """(namespace, host, channel, feature, prevalence, weight, r): profiles of all namespaces at once, each on its own days and
    against its own hosts. A namespace of fewer than FEWEST_HOSTS has none.

    ``days`` and the sizes have one row a namespace and are broadcast: by namespace, a shuffle would put most observations into
    the task of the largest one."""
    rows = obs.join(F.broadcast(days), "namespace").where("day BETWEEN first_day AND last_day")
    rows = rows.withColumn("host", F.struct("namespace", "host"))  # hosts of two namespaces are never one
    base = prevalence(rows)
    size = base.select("host").distinct().groupBy("host.namespace").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= FEWEST_HOSTS)
    order = Window.partitionBy("host").orderBy(F.col("prevalence").desc(), "feature")
    top = base.where("channel = 'applications'").withColumn("k", F.row_number().over(order)).where((F.col("k") <= BUNDLE_APPS) & (F.col("prevalence") >= 0.2))
    apps = top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.expr("substring(feature, 5)").alias("a"), "prevalence"))).alias("apps"))
    pairs = apps.select("host", F.explode(F.expr("flatten(transform(apps, (x, i) -> transform(slice(apps, i + 2, size(apps)), y -> struct(x, y))))")).alias("p"))
    pairs = pairs.select("host", F.lit("bundles").alias("channel"), F.concat(F.lit("bundle:"), "p.x.a", F.lit("|"), "p.y.a").alias("feature"), F.least("p.x.prevalence", "p.y.prevalence").alias("prevalence"))
    every = base.unionByName(pairs).withColumn("namespace", F.col("host.namespace")).join(F.broadcast(size), "namespace")
    df = every.groupBy("namespace", "channel", "feature").agg(F.count(F.lit(1)).alias("df"))
    small = F.col("hosts") < 20
    shared = (F.col("df") >= F.when(small, 2).otherwise(3)) & (F.col("df") / F.col("hosts") <= F.when(small, 0.80).otherwise(0.65))
    every = every.join(df, ["namespace", "channel", "feature"]).where((F.col("channel") != "bundles") | shared)
    idf = F.when(F.col("channel") == "activity", 1.0).otherwise(F.least(F.lit(2.0), 0.25 + F.greatest(F.lit(0.0), F.log((F.col("hosts") + 1) / (F.col("df") + 1)))))
    best = Window.partitionBy("host", "channel").orderBy(F.col("weight").desc(), "feature")
    limit = F.create_map(*[F.lit(x) for pair in CHANNEL_LIMITS.items() for x in pair])[F.col("channel")]
    ranked = every.withColumn("weight", F.col("prevalence") * idf).withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit)
    return ranked.select("namespace", F.col("host.host").alias("host"), "channel", "feature", "prevalence", "weight", "r")
