"""Queries on profiles by namespace, the catalogue of both kinds of groups and the registry of approved ones, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import peers, profiles, registry
from ..sources.observations import cohort_view, suite_view
from .oracles import _BUNDLES, _CENTROIDS, _CLUSTERS, _EXPLAINED, _FEATURES, _TEAM, _TEAMS, _TECH, _WEIGHTS, LIVE_DAY
from .cohort_queries import _SUITE


def _r(name: str) -> F.Column:
    return F.round(name, 9).alias(name)


# --- profiles by namespace


def _namespaces(spark: SparkSession, d: str) -> DataFrame:
    """Three namespaces; one has been seen on the live day only, and one has two hosts."""
    number = F.col("host").cast("int")
    name = F.when(number < 2, "tiny").when(number % 3 == 0, "young").otherwise("old")
    return suite_view(spark, d).withColumn("namespace", name).where(f"namespace <> 'young' OR day = {LIVE_DAY}")


def profile_days(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile_days(_namespaces(spark, d), LIVE_DAY)


def explicit_days(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and days of each namespace in a window that the caller names."""
    obs = _namespaces(spark, d)
    days = profiles.explicit_days(obs, LIVE_DAY - 20, LIVE_DAY - 10, LIVE_DAY)
    inside = obs.join(F.broadcast(days), "namespace").where("day BETWEEN first_day AND last_day")
    counts = inside.groupBy("namespace").agg(F.count_distinct("host").alias("hosts"), F.count_distinct("day").alias("days"))
    return days.join(counts, "namespace", "left").fillna(0, ["hosts", "days"])


def namespace_weights(spark: SparkSession, d: str) -> DataFrame:
    obs = _namespaces(spark, d)
    return profiles.namespace_weights(obs, profiles.profile_days(obs, LIVE_DAY)).select("namespace", "host", "channel", "feature", _r("prevalence"), _r("weight"))


# --- catalogue


def full_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Teams as groups: four recommended ones and two technical clusters."""
    obs = peers.kept(cohort_view(spark, d).select("host", "day", "app", "parent", "location", "kind", "ts"))
    number = F.col("host").cast("int") % 6
    teams = peers.kept(obs.select("host", number.cast("string").alias("component"), F.when(number < 4, "recommended").otherwise("technical").alias("suitability")).distinct())
    found, hosts = profiles.with_bundles(obs)
    found = peers.kept(found)
    members = teams.select("host", "component")
    held = peers.cohesion(members, peers.kept(profiles.technical(found.where("channel <> 'bundles'"), hosts)))
    observed = obs.groupBy("host").agg(F.count_distinct("day").alias("observed_days"))
    names = members.select("host", F.concat(F.lit("client-"), F.lpad("host", 5, "0")).alias("name"))
    scores = peers.group_scores(members, profiles.weights(found, hosts))
    rows = registry.described(teams.join(held, "component"), peers.explanations(members, found, hosts), scores, observed, names, "main", False)
    return rows.select("component", "id", "suitability", "reason", "size", "observed_days", "maturity", _r("cohesion"), _r("confidence"), "dominant_channel", F.array_join("sample_clients", ",").alias("sample_clients"))


# --- registry


def _run(spark: SparkSession, d: str, later: bool) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of a run: suppliers as hosts, those that deliver a kind of part often, in the first or the second half of
    the lines. In the second some groups have become others."""
    kind = F.col("l_partkey") % 12
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where((F.col("l_linenumber") % 2 == 0) == F.lit(later))
    counts = lines.groupBy(F.col("l_suppkey").cast("string").alias("host"), kind.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    members = counts.where((F.col("q") % 5) < 2).withColumn("mark", F.when(F.lit(later) & (F.col("g") % 4 == 3), F.concat(F.lit("new"), F.col("g").cast("string"))).otherwise(F.col("g").cast("string")))
    members = members.select("host", "g", F.sha2("mark", 256).alias("fingerprint"))
    groups = members.groupBy("g", "fingerprint").agg(F.count(F.lit(1)).alias("size")).select(
        "fingerprint", F.substring("fingerprint", 1, 12).alias("id"), F.when(F.col("g") % 5 == 4, "other").otherwise("main").alias("namespace"),
        F.when(F.col("g") % 2 == 0, "recommended").otherwise("technical").alias("suitability"), F.lit("stable" if later else "growing").alias("maturity"), (F.col("g") == 6).alias("partial"), "size",
    )
    return groups, members.select("host", "fingerprint")


def _twice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, cohorts, suggestions) after two runs: between them most groups are approved, one is turned down, one made by hand."""
    groups, members = map(peers.kept, _run(spark, d, False))
    key = F.col("s_suppkey")
    cohorts = spark.read.parquet(f"{d}/supplier.parquet").select(key.cast("string").alias("host"), F.lit("main").alias("namespace"), F.when(key % 10 == 0, "by-hand").otherwise(registry.NONE).alias("cohort"))
    known = registry.create(spark.createDataFrame([], registry.REGISTRY), "by-hand", "ann", 1.0)
    suggestions, rejected = groups, spark.createDataFrame([], "fingerprint string, at double")
    found = {r.id for r in groups.select("id").collect()}  # twelve kinds of parts
    for g in range(12):
        if _mark(g) in found:
            if g == 5:
                rejected, suggestions = registry.reject(rejected, suggestions, _mark(g), 2.0)
            elif g % 3 != 2:
                known, cohorts, suggestions = map(peers.kept, registry.approve(known, cohorts, suggestions, members, _mark(g), f"team-{g:02d}", "ann", 2.0))
    groups, members = map(peers.kept, _run(spark, d, True))
    return registry.refresh(known, rejected, cohorts, groups, members, 3.0)


def _mark(g: int) -> str:
    return hashlib.sha256(str(g).encode()).hexdigest()[:12]


def registry_refreshed(spark: SparkSession, d: str) -> DataFrame:
    rows = _twice(spark, d)[0]
    return rows.select("label", "kind", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), "suitability", "maturity", "partial", F.coalesce("size", F.lit(0)).alias("size"), "updated_at")


def registry_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """The cohort of every host after both runs."""
    return _twice(spark, d)[1]


def registry_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return _twice(spark, d)[2].select("id", "namespace", "suitability", "size")


def registry_suppressing(spark: SparkSession, d: str) -> DataFrame:
    known, cohorts, _ = _twice(spark, d)
    return registry.suppressing(known, cohorts)


QUERIES = {f.__name__: f for f in (profile_days, explicit_days, namespace_weights, full_catalogue, registry_refreshed, registry_cohorts, registry_suggestions, registry_suppressing)}

_NAMED = f"""WITH {_SUITE}, nobs AS (
  SELECT * FROM (SELECT *, CASE WHEN CAST(host AS INT) < 2 THEN 'tiny' WHEN CAST(host AS INT) % 3 = 0 THEN 'young' ELSE 'old' END AS namespace FROM suite) WHERE namespace <> 'young' OR day = {LIVE_DAY}
),
chosen AS (
  SELECT namespace, {LIVE_DAY - 27} AS first_day, CASE WHEN min(day) < {LIVE_DAY} THEN {LIVE_DAY - 1} ELSE {LIVE_DAY} END AS last_day, min(day) >= {LIVE_DAY} AS partial
  FROM nobs WHERE day BETWEEN {LIVE_DAY - 27} AND {LIVE_DAY} GROUP BY namespace
)"""

_RUNS = """WITH line AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS host, l_partkey % 12 AS g, l_linenumber % 2 = 0 AS later, sum(l_quantity) AS q FROM lineitem GROUP BY ALL
),
mem AS (SELECT host, g, later, sha256(CASE WHEN later AND g % 4 = 3 THEN 'new' || g ELSE CAST(g AS VARCHAR) END) AS fingerprint FROM line WHERE q % 5 < 2),
grp AS (
  SELECT later, g, fingerprint, substr(fingerprint, 1, 12) AS id, CASE WHEN g % 5 = 4 THEN 'other' ELSE 'main' END AS namespace, CASE WHEN g % 2 = 0 THEN 'recommended' ELSE 'technical' END AS suitability, g = 6 AS partial, count(*) AS size
  FROM mem GROUP BY later, g, fingerprint
),
app AS (SELECT *, 'team-' || lpad(CAST(g AS VARCHAR), 2, '0') AS label FROM grp WHERE NOT later AND g % 3 <> 2),
first AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS host, CASE WHEN s_suppkey % 10 = 0 THEN 'by-hand' ELSE coalesce((SELECT max(label) FROM app JOIN mem m ON m.fingerprint = app.fingerprint AND NOT m.later WHERE m.host = CAST(s_suppkey AS VARCHAR) AND app.namespace = 'main'), 'unassigned') END AS cohort FROM supplier
),
met AS (SELECT n.*, app.label FROM grp n JOIN app ON app.fingerprint = n.fingerprint WHERE n.later),
want AS (SELECT m.host, arg_max(label, (suitability <> 'recommended', -size, met.id)) AS label FROM mem m JOIN met ON met.fingerprint = m.fingerprint WHERE m.later AND met.namespace = 'main' GROUP BY m.host),
after AS (
  SELECT first.host, CASE WHEN label IS NOT NULL AND cohort <> 'by-hand' THEN label WHEN label IS NULL AND cohort IN (SELECT label FROM met) THEN 'unassigned' ELSE cohort END AS cohort FROM first LEFT JOIN want ON want.host = first.host
),
reg AS (
  SELECT app.label, 'auto' AS kind, app.fingerprint, app.suitability, CASE WHEN met.label IS NULL THEN 'growing' ELSE 'stable' END AS maturity, app.partial, coalesce(met.size, app.size) AS size, CASE WHEN met.label IS NULL THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS updated_at FROM app LEFT JOIN met ON met.label = app.label
  UNION ALL SELECT 'by-hand', 'manual', '', 'manual', 'manual', false, 0, 1.0::DOUBLE
)"""

SQL = {
    "profile_days": f"{_NAMED} SELECT * FROM chosen",
    "explicit_days": f"""{_NAMED} SELECT a.namespace, {LIVE_DAY - 20} AS first_day, {LIVE_DAY - 10} AS last_day, false AS partial, coalesce(hosts, 0) AS hosts, coalesce(days, 0) AS days
      FROM (SELECT DISTINCT namespace FROM nobs) a LEFT JOIN (SELECT namespace, count(DISTINCT host) AS hosts, count(DISTINCT day) AS days FROM nobs WHERE day BETWEEN {LIVE_DAY - 20} AND {LIVE_DAY - 10} GROUP BY namespace) c ON c.namespace = a.namespace""",
    "namespace_weights": " UNION ALL ".join(
        f"SELECT * FROM ({_NAMED}, obs AS (SELECT nobs.* FROM nobs JOIN chosen ON chosen.namespace = nobs.namespace WHERE nobs.namespace = '{name}' AND day BETWEEN first_day AND last_day){_FEATURES}{_BUNDLES}{_WEIGHTS} SELECT '{name}' AS namespace, w.host, w.channel, w.feature, round(p.prevalence, 9) AS prevalence, round(weight, 9) AS weight FROM w JOIN full_prev p ON p.host = w.host AND p.channel = w.channel AND p.feature = w.feature)"
        for name in ("young", "old")
    ),
    "full_catalogue": f"""WITH {_TEAM}{_FEATURES}{_BUNDLES}{_WEIGHTS}{_TEAMS}, grp AS (SELECT * FROM size), gm AS (SELECT * FROM member){_CENTROIDS}{_EXPLAINED}{_TECH}{_CLUSTERS.split('tcent AS')[0].split(', tlink')[0]},
      tcomp AS (SELECT * FROM member), tsize AS (SELECT * FROM size), tcent AS{_CLUSTERS.split('tcent AS')[1]},
      fp AS (SELECT component, sha256('main' || chr(10) || string_agg(channel || ':' || feature, chr(10) ORDER BY r)) AS f FROM expl WHERE r <= 6 GROUP BY component),
      od AS (SELECT component, CAST(trunc(median(observed_days)) AS INT) AS observed_days FROM hd JOIN member USING (host) GROUP BY component),
      nm AS (SELECT component, string_agg(name, ',' ORDER BY name) AS sample_clients FROM (SELECT component, 'client-' || lpad(host, 5, '0') AS name FROM member QUALIFY row_number() OVER (PARTITION BY component ORDER BY name) <= 8) GROUP BY component),
      al AS (SELECT go.*, f, observed_days, sample_clients, CASE WHEN CAST(go.component AS INT) < 4 THEN 'recommended' ELSE 'technical' END AS suitability, CASE WHEN CAST(go.component AS INT) < 4 THEN overall ELSE tcoh.cohesion END AS held,
        CASE greatest(applications, bundles, process, network, activity) WHEN applications THEN 'applications' WHEN bundles THEN 'bundles' WHEN process THEN 'process' WHEN network THEN 'network' ELSE 'activity' END AS dominant_channel
        FROM go JOIN fp USING (component) JOIN od USING (component) JOIN nm USING (component) JOIN tcoh USING (component))
      SELECT component, substr(f, 1, 12) AS id, suitability, CASE WHEN suitability = 'recommended' THEN '{registry.REASONS['recommended']}' WHEN dominant_channel = 'applications' THEN '{registry.REASONS['applications']}' ELSE '{registry.REASONS['other']}' END AS reason,
        al.size, observed_days, CASE WHEN observed_days < 3 THEN 'provisional' WHEN observed_days < 7 THEN 'growing' ELSE 'stable' END AS maturity, round(held, 9) AS cohesion, round(least(1, held * least(1, greatest(1, observed_days) / 7) * least(1, al.size / 15)), 9) AS confidence, dominant_channel, sample_clients FROM al""",
    "registry_refreshed": f"{_RUNS} SELECT * FROM reg",
    "registry_cohorts": f"{_RUNS} SELECT host, 'main' AS namespace, cohort FROM after",
    "registry_suggestions": f"{_RUNS} SELECT id, namespace, suitability, size FROM grp WHERE later AND fingerprint NOT IN (SELECT fingerprint FROM app) AND NOT (g = 5)",
    "registry_suppressing": f"{_RUNS} SELECT label, kind = 'manual' OR (suitability = 'recommended' AND maturity = 'stable' AND NOT partial) AS suppressing FROM reg",
}
