"""Queries on comparison cohorts and their evidence over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import novelty, peers, profiles, similarity, summaries
from ..sources.observations import suite_view
from .oracles import _BASE, _BUNDLES, _FEATURES, _WEIGHTS, LIVE_DAY
from .policy import DEFAULT

TRAINING, LATER = (LIVE_DAY - 28, LIVE_DAY - 8), (LIVE_DAY - 7, LIVE_DAY - 1)


def _r(name: str) -> F.Column:
    return F.round(name, 9).alias(name)


def _profile(obs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(prevalence, weighted, observed, hosts), stored. Observations are read once and stored as what they show."""
    shown = peers.kept(profiles.shown_days(obs))
    observed = peers.kept(profiles.observed_days(shown))
    base = peers.kept(profiles.shares(shown, observed))
    hosts = observed.count()
    bundles = peers.kept(profiles.bundles(base, hosts))
    return base, peers.kept(profiles.weights(base.unionByName(bundles), max(hosts, 1))), observed, hosts


def _strata(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    base, weighted, observed, hosts = _profile(suite_view(spark, d))
    return *similarity.strata(base, observed, hosts, False), weighted, observed


def analytical_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d)[0].select("grp", "dimension", "band", "size", _r("fraction"), "low", "high", "middle", "observed_days", "maturity")


def analytical_quality(spark: SparkSession, d: str) -> DataFrame:
    """Strata against the whole fleet, by sampled pairs."""
    groups, members, weighted, observed = _strata(spark, d)
    found = similarity.quality(members, observed, weighted).withColumn("supports", similarity.supports(similarity.QUALITY_WITHIN))
    return found.select("grp", "channel", _r("within"), "within_pairs", _r("fleet"), "fleet_pairs", _r("delta"), "supports")


def analytical_support(spark: SparkSession, d: str) -> DataFrame:
    groups, members, weighted, observed = _strata(spark, d)
    return similarity.independent_support(similarity.quality(members, observed, weighted), groups)


def small_group_quality(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at most 18 hosts, of which all pairs are compared."""
    _, weighted, observed, _ = _profile(suite_view(spark, d))
    number = F.col("host").cast("int")
    members = observed.where(number < 72).select(F.concat(F.lit("g"), (number % 6).cast("string")).alias("grp"), "host")
    found = similarity.quality(members, observed, weighted)
    return found.select("grp", "channel", _r("within"), "within_pairs", _r("fleet"), "fleet_pairs", _r("delta"))


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    base, weighted, observed, _ = _profile(suite_view(spark, d))
    return similarity.discover(base, weighted, observed)


def similarity_proposals(spark: SparkSession, d: str) -> DataFrame:
    base, _, observed, _ = _profile(suite_view(spark, d))
    hosts = peers.kept(similarity.established(observed))
    n = hosts.count()
    seeded = similarity.seeds(base, hosts, max(n, 1))
    return similarity.proposals(seeded if n >= similarity.FLEET else seeded.limit(0), max(n, 1)).select("r", "first", "second", "members", _r("lift"), _r("utility"))


def similarity_cohorts(spark: SparkSession, d: str) -> DataFrame:
    groups = _similar(spark, d)[0]
    return groups.select("place", "grp", "first", "second", "size", _r("fraction"), "observed_days", "maturity", _r("application_delta"), "unmasked_views", "views", "status")


def similarity_members(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d)[1]


def residual_quality(spark: SparkSession, d: str) -> DataFrame:
    rest = _similar(spark, d)[3]
    return rest.select("grp", "channel", _r("within"), _r("control"), _r("delta"), "pairs", "sampled", "matched")


def residual_controls(spark: SparkSession, d: str) -> DataFrame:
    """The host outside a group that each sampled pair's subject is compared with."""
    base, _, observed, _ = _profile(suite_view(spark, d))
    hosts = similarity.established(observed)
    _, members = similarity.candidates(base, observed, "main", False)
    pairs = similarity.sample_pairs(members, "residual-v2")
    subjects = peers.kept(pairs.select("grp", "i", F.when(F.col("i") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("subject")))
    apps = base.where((F.col("channel") == "applications") & (F.col("prevalence") >= similarity.PREVALENCE)).groupBy("host").agg(F.count(F.lit(1)).alias("apps"))
    depth = hosts.join(apps, "host", "left").select("host", F.coalesce("apps", F.lit(0)).alias("apps"), F.col("observed_days").alias("days"))
    found = similarity.controls(subjects, members, similarity.cohorts.match_buckets(depth))
    return subjects.join(found, ["grp", "i"], "left")


def similarity_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return similarity.overlap_summary(_similar(spark, d)[1]).select("measure", _r("value"))


def _validated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = suite_view(spark, d)
    base, weighted, observed, _ = _profile(obs.where(F.col("day").between(*TRAINING)))
    groups, members, _, _ = similarity.discover(base, weighted, observed)
    base, weighted, observed, _ = _profile(obs.where(F.col("day").between(*LATER)))
    return similarity.validate(groups, members, base, weighted, observed)


def temporal_validation(spark: SparkSession, d: str) -> DataFrame:
    """Groups of 21 days on the seven days after."""
    rows = _validated(spark, d)[0]
    return rows.select("place", "grp", "size", "later", _r("persistence"), "training", "holds", *[_r(f"{c}_{m}") for c in ("process", "network") for m in ("within", "delta")], "process_pairs", "network_pairs")


def preferred_pools(spark: SparkSession, d: str) -> DataFrame:
    return similarity.preferred_pools(*_validated(spark, d))


def pool_summary(spark: SparkSession, d: str) -> DataFrame:
    return similarity.pool_summary(similarity.preferred_pools(*_validated(spark, d)))


def cohort_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What the best supported group of a host says of the contexts it shows on the live day. Earlier days are read a second
    time, but only those of hosts that others are compared with."""
    obs = suite_view(spark, d)
    base, weighted, observed, _ = _profile(obs.where(F.col("day").between(LIVE_DAY - 28, LIVE_DAY - 1)))
    groups, members, _, _ = similarity.discover(base, weighted, observed)
    best = peers.kept(similarity.best_supported(groups, members))
    others = similarity.compared(best, members).select("host").distinct()
    days = lambda rows: peers.kept(summaries.behavior_days(rows, DEFAULT.maximum_contexts_per_host_day).select("host", "day", "app", "parent", "location"))
    prior = days(novelty.prior(obs, LIVE_DAY, DEFAULT).join(F.broadcast(others), "host", "left_semi"))
    return similarity.evidence(days(obs.where(F.col("day") == LIVE_DAY)), prior, best, members, DEFAULT.minimum_days)


QUERIES = {
    f.__name__: f
    for f in (
        analytical_cohorts, analytical_quality, analytical_support, small_group_quality, similarity_proposals, similarity_cohorts, similarity_members, residual_quality, residual_controls, similarity_overlaps,
        temporal_validation, preferred_pools, pool_summary, cohort_evidence,
    )
}


_SUITE = (
    _BASE
    + """, suite AS (
  SELECT event_id, host, CASE WHEN k % 4 = 0 THEN 'shared-app' || (k % 3) WHEN k % 5 IN (1, 2) THEN 'dept' || (user_id % 6 % 2) || '-app' ELSE 'team' || (user_id % 6) || '-app' || (k % 2) END AS app,
    CASE WHEN user_id % 6 = 5 THEN 'own' || host ELSE 'team' || (user_id % 6) || '-svc' || (k % 2) END AS parent, 'program-files' AS location,
    CASE WHEN user_id % 6 = 5 THEN NULL WHEN event_type IN ('view', 'click') THEN 'domain' WHEN event_type = 'purchase' THEN 'ip' END AS kind, ts, day
  FROM e WHERE user_id % 11 <> 0 OR day % 5 = 0
)"""
)


def _profiled(first: int | None = None, last: int | None = None) -> str:
    where = f" WHERE day BETWEEN {first} AND {last}" if first else ""
    return f", obs AS (SELECT * FROM suite{where})" + _FEATURES + _BUNDLES + _WEIGHTS


_CHANNELS = "(SELECT unnest(['applications', 'process', 'network', 'activity']) AS channel)"

_STRATA = f""", bre AS (
  SELECT hd.host, c.channel, count(prev.feature) AS n FROM hd CROSS JOIN {_CHANNELS} c LEFT JOIN prev ON prev.host = hd.host AND prev.channel = c.channel AND prevalence >= 0.20 GROUP BY hd.host, c.channel
),
ord AS (SELECT channel, n, row_number() OVER (PARTITION BY channel ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY channel) AS c FROM bre),
cut AS (SELECT channel, max(CASE WHEN i = (c - 1) // 3 THEN n END) AS lo, max(CASE WHEN i = 2 * (c - 1) // 3 THEN n END) AS hi FROM ord GROUP BY channel HAVING count(DISTINCT n) >= 2),
band AS (SELECT channel AS dimension, CASE WHEN n <= lo THEN 'lower' WHEN n <= hi THEN 'middle' ELSE 'higher' END AS band, host, n FROM bre JOIN cut USING (channel)),
strat AS (
  SELECT dimension || ':' || band AS grp, dimension, band, count(*) AS size, count(*) / total.n AS fraction, min(band.n) AS low, max(band.n) AS high, median(band.n) AS middle, CAST(trunc(median(observed_days)) AS INTEGER) AS observed_days
  FROM band JOIN hd USING (host), total GROUP BY dimension, band, total.n
  HAVING total.n >= 3 AND count(*) >= greatest(3, ceil(total.n * 0.05)) AND count(*) <= 0.95 * total.n
),
sm AS (SELECT grp, host FROM band JOIN strat USING (dimension, band))"""


def _pairs(name: str, members: str, seed: str) -> str:
    return f""", {name}_ring AS (
  SELECT grp, host, row_number() OVER (PARTITION BY grp ORDER BY sha256(grp || ':{seed}:' || host), host) - 1 AS spot FROM ({members}) QUALIFY spot <= 160
),
{name}_m AS (SELECT *, count(*) OVER (PARTITION BY grp) AS m FROM {name}_ring),
{name}_off AS (SELECT grp, host, spot, m, unnest(range(1, least(m // 2, (159 + m) // m) + 1)) AS o FROM {name}_m),
{name} AS (
  SELECT x.grp, CAST((o - 1) * m + x.spot AS INTEGER) AS i, least(x.host, y.host) AS a, greatest(x.host, y.host) AS b
  FROM {name}_off x JOIN {name}_ring y ON y.grp = x.grp AND y.spot = (x.spot + o) % m WHERE (2 * o < m OR x.spot < o) AND (o - 1) * m + x.spot < 160
)"""


def _overlap(name: str, pairs: str, a: str, b: str, rows: str = "w", usable: str = "true") -> str:
    side = lambda s, v: f"SELECT p.grp, p.i, channel, feature, weight AS {v} FROM ({pairs}) p JOIN {rows} f ON f.host = p.{s} WHERE channel IN ('applications', 'process', 'network', 'activity') AND {usable}"
    return f""", {name} AS (
  SELECT grp, i, channel, CASE WHEN sum(x) IS NULL OR sum(y) IS NULL THEN 0.0::DOUBLE ELSE sum(least(coalesce(x, 0), coalesce(y, 0))) / sum(greatest(coalesce(x, 0), coalesce(y, 0))) END AS overlap
  FROM ({side(a, "x")}) FULL JOIN ({side(b, "y")}) USING (grp, i, channel, feature) GROUP BY grp, i, channel
)"""


def _quality(members: str, everyone: str) -> str:
    return (
        _pairs("fp", f"SELECT 'fleet' AS grp, host FROM {everyone}", "fleet-quality-v1")
        + _pairs("ip", f"SELECT grp, host FROM {members}", "quality-v1")
        + _overlap("fo", "SELECT * FROM fp", "a", "b")
        + _overlap("io", "SELECT * FROM ip", "a", "b")
        + f""", qual AS (
  SELECT g.grp, g.channel, within, coalesce(within_pairs, 0) AS within_pairs, fleet, coalesce(fleet_pairs, 0) AS fleet_pairs, within - fleet AS delta
  FROM (SELECT DISTINCT grp, c.channel FROM {members}, {_CHANNELS} c) g
    LEFT JOIN (SELECT grp, channel, avg(overlap) AS within, count(*) AS within_pairs FROM io GROUP BY ALL) i ON i.grp = g.grp AND i.channel = g.channel
    LEFT JOIN (SELECT channel, avg(overlap) AS fleet, count(*) AS fleet_pairs FROM fo GROUP BY ALL) f ON f.channel = g.channel
)"""
    )


_PROPOSED = """, est AS (SELECT host, observed_days FROM hd WHERE observed_days >= 7),
en AS (SELECT count(*) AS n, greatest(20, (count(*) + 99) // 100) AS least_n FROM est),
seen AS (SELECT host, feature, prevalence FROM prev JOIN est USING (host), en WHERE channel = 'applications' AND prevalence >= 0.30 AND n >= 40),
sdf AS (SELECT feature, count(*) AS df FROM seen GROUP BY feature),
seeded AS (
  SELECT host, feature AS app, df FROM (
    SELECT seen.host, seen.feature, sdf.df, row_number() OVER (PARTITION BY seen.host ORDER BY prevalence * (1 - sdf.df / en.n) DESC, seen.feature) AS r
    FROM seen JOIN sdf USING (feature), en WHERE sdf.df >= least_n AND sdf.df <= en.n * 80 // 100
  ) WHERE r <= 16
),
paired AS (SELECT x.app AS first, y.app AS second, x.df AS df1, y.df AS df2, count(*) AS members FROM seeded x JOIN seeded y ON y.host = x.host AND x.app < y.app GROUP BY ALL),
prop AS (
  SELECT row_number() OVER (ORDER BY utility DESC, members DESC, first, second) - 1 AS r, first, second, members, lift, utility FROM (
    SELECT first, second, members, members * en.n / (df1 * df2) AS lift, members * log2(members * en.n / (df1 * df2)) AS utility FROM paired, en WHERE members >= least_n AND members <= 0.65 * en.n
  ) WHERE lift >= 1.25 QUALIFY r < 480
)"""

_CHOSEN = """, pm AS (SELECT r, x.host FROM prop JOIN seeded x ON x.app = first JOIN seeded y ON y.app = second AND y.host = x.host),
jac AS (
  SELECT x.r, y.r AS earlier FROM pm x JOIN pm y ON y.host = x.host AND y.r < x.r JOIN prop p ON p.r = x.r JOIN prop q ON q.r = y.r
  GROUP BY x.r, y.r, p.members, q.members HAVING count(*) / (p.members + q.members - count(*)) >= 0.85
),
near AS (SELECT prop.r, list(earlier) FILTER (earlier IS NOT NULL) AS l FROM prop LEFT JOIN jac ON jac.r = prop.r GROUP BY prop.r),
pick(r, taken) AS (
  SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT near.r, CASE WHEN len(taken) >= 80 OR len(list_intersect(taken, coalesce(l, []))) > 0 THEN taken ELSE list_append(taken, near.r) END FROM pick JOIN near ON near.r = pick.r + 1
),
took AS (SELECT unnest(taken) AS r FROM (SELECT taken FROM pick ORDER BY r DESC LIMIT 1)),
grps AS (
  SELECT 'bs-' || substr(sha256('main' || chr(0) || first || chr(0) || second), 1, 16) AS grp, substr(first, 5) AS first, substr(second, 5) AS second, members AS size, members / n AS fraction, r FROM prop JOIN took USING (r), en
),
gm AS (SELECT grp, host FROM grps JOIN pm USING (r))"""


def _residual(groups: str, members: str, hosts: str, prev: str, rows: str, tag: str = "") -> str:
    unmasked = "(CASE WHEN feature LIKE 'pc:%' THEN split_part(substr(feature, 4), '>', 1) NOT IN (first, second) AND substr(feature, 5 + strpos(substr(feature, 4), '>') - 1) NOT IN (first, second) WHEN feature LIKE 'net:%' THEN split_part(feature, ':', 2) NOT IN (first, second) ELSE true END) AND channel IN ('process', 'network')"
    unmasked = unmasked.replace("substr(feature, 5 + strpos(substr(feature, 4), '>') - 1)", "CASE WHEN strpos(feature, '>') > 0 THEN substr(feature, strpos(feature, '>') + 1) ELSE '' END")
    return (
        _pairs(f"rp{tag}", f"SELECT grp, host FROM {members}", "residual-v2")
        + f""", turned{tag} AS (SELECT grp, i, CASE WHEN i % 2 = 0 THEN a ELSE b END AS subject, CASE WHEN i % 2 = 0 THEN b ELSE a END AS other FROM rp{tag}),
bucket{tag} AS (
  SELECT h.host, length(bin(count(p.feature) + 1)) - 1 AS app_bin, greatest(0, CAST(floor((observed_days - 7) / 7) AS INTEGER)) AS day_bin, CAST('0x' || substr(sha256(h.host), 1, 8) AS BIGINT) % 1024 AS slice
  FROM {hosts} h LEFT JOIN {prev} p ON p.host = h.host AND p.channel = 'applications' AND p.prevalence >= 0.30 GROUP BY h.host, observed_days
),
outs{tag} AS (
  SELECT t.grp, t.i, o.host, o.slice, o.app_bin = s.app_bin AND o.day_bin = s.day_bin AS here
  FROM turned{tag} t JOIN bucket{tag} s ON s.host = t.subject JOIN bucket{tag} o ON abs(o.app_bin - s.app_bin) + abs(o.day_bin - s.day_bin) <= 1
    LEFT JOIN {members} m ON m.grp = t.grp AND m.host = o.host WHERE m.host IS NULL
),
rank{tag} AS (
  SELECT *, row_number() OVER (PARTITION BY grp, i ORDER BY slice, host) - 1 AS p, count(*) OVER (PARTITION BY grp, i) AS c
  FROM (SELECT *, bool_or(here) OVER (PARTITION BY grp, i) AS exact FROM outs{tag}) WHERE here OR NOT exact
),
ctl{tag} AS (SELECT grp, i, host AS control FROM rank{tag} WHERE p = CAST('0x' || substr(sha256(grp || ':' || i), 1, 8) AS BIGINT) % c),
asked{tag} AS (SELECT t.grp, t.i, subject, other, control, first, second FROM turned{tag} t JOIN ctl{tag} c ON c.grp = t.grp AND c.i = t.i JOIN {groups} g ON g.grp = t.grp)"""
        + _overlap(f"ro{tag}", f"SELECT * FROM asked{tag}", "subject", "other", rows, unmasked)
        + _overlap(f"rc{tag}", f"SELECT * FROM asked{tag}", "subject", "control", rows, unmasked)
        + f""", res{tag} AS (
  SELECT g.grp, g.channel, x.within, x.control, x.within - x.control AS delta, coalesce(x.pairs, 0) AS pairs, coalesce(s.sampled, 0) AS sampled, coalesce(c.matched, 0) AS matched
  FROM (SELECT grp, unnest(['process', 'network']) AS channel FROM {groups}) g
    LEFT JOIN (SELECT ro{tag}.grp, ro{tag}.channel, avg(ro{tag}.overlap) AS within, avg(rc{tag}.overlap) AS control, count(*) AS pairs FROM ro{tag} JOIN rc{tag} ON rc{tag}.grp = ro{tag}.grp AND rc{tag}.i = ro{tag}.i AND rc{tag}.channel = ro{tag}.channel GROUP BY ALL) x
      ON x.grp = g.grp AND x.channel = g.channel
    LEFT JOIN (SELECT grp, count(*) AS sampled FROM turned{tag} GROUP BY grp) s ON s.grp = g.grp LEFT JOIN (SELECT grp, count(*) AS matched FROM asked{tag} GROUP BY grp) c ON c.grp = g.grp
)"""
    )


_SIMILAR = (
    _PROPOSED
    + _CHOSEN
    + ", ew AS (SELECT w.* FROM w JOIN est USING (host))"
    + _quality("gm", "est")
    + _residual("grps", "gm", "est", "prev", "ew")
    + """, gdays AS (SELECT grp, CAST(trunc(median(observed_days)) AS INTEGER) AS observed_days FROM gm JOIN est USING (host) GROUP BY grp),
assessed AS (
  SELECT g.grp, first, second, size, fraction, d.observed_days, 'stable' AS maturity, a.delta AS application_delta, coalesce(u.n, 0) AS unmasked_views, v.views, v.process_delta, v.network_delta,
    CASE WHEN v.views > 0 AND a.delta >= 0.10 THEN 'supported' ELSE 'exploratory' END AS status
  FROM grps g JOIN gdays d ON d.grp = g.grp LEFT JOIN (SELECT grp, delta FROM qual WHERE channel = 'applications') a ON a.grp = g.grp
    LEFT JOIN (SELECT grp, count(*) AS n FROM qual WHERE channel IN ('process', 'network') AND within_pairs >= 12 AND fleet_pairs >= 12 AND within >= 0.12 AND delta >= 0.08 GROUP BY grp) u ON u.grp = g.grp
    LEFT JOIN (SELECT grp, count(*) FILTER (pairs >= 24 AND within >= 0.12 AND delta >= 0.08) AS views, max(CASE channel WHEN 'process' THEN delta END) AS process_delta, max(CASE channel WHEN 'network' THEN delta END) AS network_delta FROM res GROUP BY grp) v ON v.grp = g.grp
),
cohort AS (SELECT row_number() OVER (ORDER BY status <> 'supported', coalesce(application_delta, -1) DESC, views DESC, size DESC, grp) AS place, * FROM assessed QUALIFY place <= 32),
cm AS (SELECT grp, gm.host FROM gm JOIN cohort USING (grp))"""
)


def _late(sql: str) -> str:
    """The same with tables of other names."""
    return re.sub(r"\b(obs|feats|hd|prev|total|topapps|allpairs|goodpairs|bundles|full_prev|df|weighed|w)\b(?!')", r"\1_late", sql)


_VALIDATED = (
    _profiled(*TRAINING)
    + _SIMILAR
    + _late(_profiled(*LATER))
    + """, lh AS (SELECT host, observed_days FROM hd_late WHERE observed_days >= 3), lm AS (SELECT cm.grp, cm.host FROM cm JOIN lh ON lh.host = cm.host),
lcount AS (SELECT grp, count(*) AS later FROM lm GROUP BY grp), lgrp AS (SELECT cohort.grp, first, second FROM cohort JOIN lcount ON lcount.grp = cohort.grp WHERE later >= 12),
lgm AS (SELECT lm.grp, lm.host FROM lm JOIN lgrp ON lgrp.grp = lm.grp), lw AS (SELECT x.* FROM w_late x JOIN lh ON lh.host = x.host)"""
    + _residual("lgrp", "lgm", "lh", "prev_late", "lw", "_l")
    + """, pers AS (
  SELECT grp, count(*) AS persistent FROM (
    SELECT lm.grp, lm.host FROM lm JOIN cohort c ON c.grp = lm.grp JOIN prev_late p ON p.host = lm.host AND p.channel = 'applications' AND p.prevalence >= 0.30 AND substr(p.feature, 5) IN (c.first, c.second) GROUP BY lm.grp, lm.host HAVING count(*) = 2
  ) GROUP BY grp
),
lview AS (
  SELECT grp, count(*) FILTER (pairs >= 24 AND within >= 0.12 AND delta >= 0.08) AS views, max(CASE channel WHEN 'process' THEN within END) AS process_within, max(CASE channel WHEN 'process' THEN delta END) AS process_delta,
    max(CASE channel WHEN 'process' THEN pairs END) AS process_pairs, max(CASE channel WHEN 'network' THEN within END) AS network_within, max(CASE channel WHEN 'network' THEN delta END) AS network_delta, max(CASE channel WHEN 'network' THEN pairs END) AS network_pairs
  FROM res_l GROUP BY grp
),
valid AS (
  SELECT place, c.grp, size, coalesce(later, 0) AS later, coalesce(persistent, 0) / nullif(later, 0) AS persistence, status = 'supported' AS training,
    coalesce(v.views, 0) > 0 AND coalesce(coalesce(persistent, 0) / nullif(later, 0) >= 0.50, false) AS holds,
    v.process_within, v.process_delta, coalesce(v.process_pairs, 0) AS process_pairs, v.network_within, v.network_delta, coalesce(v.network_pairs, 0) AS network_pairs
  FROM cohort c LEFT JOIN lcount ON lcount.grp = c.grp LEFT JOIN pers ON pers.grp = c.grp LEFT JOIN lview v ON v.grp = c.grp
),
poolable AS (
  SELECT grp, place, later, channel, within, delta, pairs, minimum FROM (
    SELECT grp, place, later, 'process' AS channel, process_within AS within, process_delta AS delta, process_pairs AS pairs FROM valid WHERE training AND holds
    UNION ALL SELECT grp, place, later, 'network', network_within, network_delta, network_pairs FROM valid WHERE training AND holds
  ), (SELECT unnest([0.08::DOUBLE, 0.12::DOUBLE]) AS minimum) WHERE later >= 11 AND pairs >= 24 AND within >= 0.12 AND delta >= minimum
),
pools AS (
  SELECT minimum, channel, host, p.grp, count(*) OVER (PARTITION BY minimum, channel, host) AS possible, row_number() OVER (PARTITION BY minimum, channel, host ORDER BY delta DESC, pairs DESC, later DESC, place) AS r
  FROM lm JOIN poolable p ON p.grp = lm.grp
)"""
)

_WITH, _RECURSIVE = f"WITH {_SUITE}", f"WITH RECURSIVE {_SUITE}"
_MEASURES = "hosts_with_several largest_number in_1 in_2 in_3 in_4 in_5_or_more mean_number pairs_over_half pairs_over_three_quarters largest_overlap".split()

SQL = {
    "analytical_cohorts": f"{_WITH}{_profiled()}{_STRATA} SELECT grp, dimension, band, size, round(fraction, 9) AS fraction, low, high, middle, observed_days, CASE WHEN observed_days < 3 THEN 'provisional' WHEN observed_days < 7 THEN 'growing' ELSE 'stable' END AS maturity FROM strat",
    "analytical_quality": f"{_WITH}{_profiled()}{_STRATA}{_quality('sm', 'hd')} SELECT grp, channel, round(within, 9) AS within, within_pairs, round(fleet, 9) AS fleet, fleet_pairs, round(delta, 9) AS delta, coalesce(within_pairs >= 12 AND fleet_pairs >= 12 AND within >= 0.10 AND delta >= 0.08, false) AS supports FROM qual",
    "analytical_support": f"{_WITH}{_profiled()}{_STRATA}{_quality('sm', 'hd')} SELECT grp, count(*) FILTER (channel <> dimension AND within_pairs >= 12 AND fleet_pairs >= 12 AND within >= 0.10 AND delta >= 0.08) AS independent FROM qual JOIN strat USING (grp) GROUP BY grp",
    "small_group_quality": f"{_WITH}{_profiled()}, tiny AS (SELECT 'g' || (CAST(host AS INT) % 6) AS grp, host FROM hd WHERE CAST(host AS INT) < 72){_quality('tiny', 'hd')} SELECT grp, channel, round(within, 9) AS within, within_pairs, round(fleet, 9) AS fleet, fleet_pairs, round(delta, 9) AS delta FROM qual",
    "similarity_proposals": f"{_WITH}{_profiled()}{_PROPOSED} SELECT CAST(r AS INTEGER) AS r, first, second, members, round(lift, 9) AS lift, round(utility, 9) AS utility FROM prop",
    "similarity_cohorts": f"{_RECURSIVE}{_profiled()}{_SIMILAR} SELECT CAST(place AS INTEGER) AS place, grp, first, second, size, round(fraction, 9) AS fraction, observed_days, maturity, round(application_delta, 9) AS application_delta, unmasked_views, views, status FROM cohort",
    "similarity_members": f"{_RECURSIVE}{_profiled()}{_SIMILAR} SELECT grp, host FROM cm",
    "residual_quality": f"{_RECURSIVE}{_profiled()}{_SIMILAR} SELECT grp, channel, round(within, 9) AS within, round(control, 9) AS control, round(delta, 9) AS delta, pairs, sampled, matched FROM res",
    "residual_controls": f"{_RECURSIVE}{_profiled()}{_SIMILAR} SELECT t.grp, t.i, subject, control FROM turned t LEFT JOIN ctl ON ctl.grp = t.grp AND ctl.i = t.i",
    "similarity_overlaps": f"""{_RECURSIVE}{_profiled()}{_SIMILAR}, number AS (SELECT host, count(*) AS m FROM cm GROUP BY host), csize AS (SELECT grp, count(*) AS s FROM cm GROUP BY grp),
pj AS (SELECT count(*) / (p.s + q.s - count(*)) AS j FROM cm x JOIN cm y ON y.host = x.host AND x.grp < y.grp JOIN csize p ON p.grp = x.grp JOIN csize q ON q.grp = y.grp GROUP BY x.grp, y.grp, p.s, q.s),
one AS (
  SELECT [count(*) FILTER (m > 1), coalesce(max(m), 0), count(*) FILTER (m = 1), count(*) FILTER (m = 2), count(*) FILTER (m = 3), count(*) FILTER (m = 4), count(*) FILTER (m >= 5), coalesce(avg(m), 0),
    (SELECT count(*) FILTER (j >= 0.5) FROM pj), (SELECT count(*) FILTER (j >= 0.75) FROM pj), (SELECT coalesce(max(j), 0) FROM pj)]::DOUBLE[] AS v FROM number
)
SELECT {_MEASURES}[i] AS measure, round(v[i], 9) AS value FROM one, (SELECT unnest(range(1, {len(_MEASURES) + 1})) AS i)""",
    "temporal_validation": f"{_RECURSIVE}{_VALIDATED} SELECT CAST(place AS INTEGER) AS place, grp, size, later, round(persistence, 9) AS persistence, training, holds, round(process_within, 9) AS process_within, round(process_delta, 9) AS process_delta, round(network_within, 9) AS network_within, round(network_delta, 9) AS network_delta, process_pairs, network_pairs FROM valid",
    "preferred_pools": f"{_RECURSIVE}{_VALIDATED} SELECT minimum, channel, host, grp, possible FROM pools WHERE r = 1",
    "pool_summary": f"""{_RECURSIVE}{_VALIDATED}, won AS (SELECT * FROM pools WHERE r = 1), ph AS (SELECT minimum, host, count(*) FILTER (channel = 'process') AS p, count(*) FILTER (channel = 'network') AS n, sum(possible) AS s FROM won GROUP BY ALL),
pu AS (SELECT minimum, grp, count(*) AS c FROM won GROUP BY ALL)
SELECT m.minimum, coalesce(process_hosts, 0) AS process_hosts, coalesce(network_hosts, 0) AS network_hosts, coalesce(any_hosts, 0) AS any_hosts, coalesce(both_hosts, 0) AS both_hosts, coalesce(possible, 0) AS possible, coalesce(pools, 0) AS pools, coalesce(largest, 0) AS largest
FROM (SELECT unnest([0.08::DOUBLE, 0.12::DOUBLE]) AS minimum) m
  LEFT JOIN (SELECT minimum, CAST(sum(p) AS BIGINT) AS process_hosts, CAST(sum(n) AS BIGINT) AS network_hosts, count(*) AS any_hosts, count(*) FILTER (p > 0 AND n > 0) AS both_hosts, CAST(sum(s) AS BIGINT) AS possible FROM ph GROUP BY minimum) h ON h.minimum = m.minimum
  LEFT JOIN (SELECT minimum, count(*) AS pools, max(c) AS largest FROM pu GROUP BY minimum) u ON u.minimum = m.minimum""",
    "cohort_evidence": f"""{_RECURSIVE}{_profiled(LIVE_DAY - 28, LIVE_DAY - 1)}{_SIMILAR},
best AS (
  SELECT host, cohort.grp, size FROM cm JOIN cohort ON cohort.grp = cm.grp WHERE status = 'supported' AND size BETWEEN 2 AND 500 AND greatest(coalesce(process_delta, 0), coalesce(network_delta, 0)) >= 0.08
  QUALIFY row_number() OVER (PARTITION BY host ORDER BY coalesce(process_delta, 0) DESC, coalesce(network_delta, 0) DESC, cohort.grp DESC) = 1
),
ask AS (SELECT DISTINCT host, app, parent, location FROM suite WHERE day = {LIVE_DAY}),
qualified AS (SELECT host, app FROM obs GROUP BY host, app HAVING count(DISTINCT day) >= 7),
peer AS (SELECT a.host, a.app, a.parent, a.location, q.host AS peer FROM ask a JOIN best b ON b.host = a.host JOIN cm ON cm.grp = b.grp AND cm.host <> a.host JOIN qualified q ON q.host = cm.host AND q.app = a.app),
same AS (SELECT DISTINCT host, app, parent, location FROM obs)
SELECT a.host, a.app, a.parent, a.location, b.grp, coalesce(b.size, 0) AS size, count(p.peer) AS qualified, count(s.host) AS with_same, count(p.peer) > 0 AS available
FROM ask a LEFT JOIN best b ON b.host = a.host LEFT JOIN peer p ON p.host = a.host AND p.app = a.app AND p.parent = a.parent AND p.location = a.location
  LEFT JOIN same s ON s.host = p.peer AND s.app = a.app AND s.parent = a.parent AND s.location = a.location
GROUP BY ALL""",
}
