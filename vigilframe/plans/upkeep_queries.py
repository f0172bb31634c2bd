"""Queries on domains, incomplete references, staged batches, retention and roll-ups, and their DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains
from ..operators import novelty, retention, summaries, triage
from ..sources import staged
from ..sources.observations import cohort_view, novelty_view
from . import queries as library
from .finding_oracles import _WINDOWS
from .oracles import _DAYS, _FOUND, _OBS, _REFERENCES, _TEAM, _WINDOW, CLOCK, LIVE_DAY
from .policy import DEFAULT

#: Rules of the query on domains: plain ones, one with any label before it, an exception of it. ``net`` has none.
RULES = ("com", "example.com", "org", "*.example.org", "!theran.example.org", "!ththrn.example.org", "co.uk")


def registrable_domains(spark: SparkSession, d: str) -> DataFrame:
    """The hosts of all pages, with and without a dot at the end or capitals."""
    page = F.col("page_id")
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    name = F.when(page % 5 == 0, F.concat(F.upper(host), F.lit("."))).when(page % 7 == 0, F.regexp_replace(host, r"^[^.]+\.", "")).otherwise(host)
    names = spark.read.parquet(f"{d}/pages.parquet").select(name.alias("domain"))
    return domains.registrable(names, spark.createDataFrame([(r,) for r in RULES], "rule string"))


def dt01_incomplete(spark: SparkSession, d: str) -> DataFrame:
    """Novelty candidates with a mark where orders, as outstanding batches of a source, cover days of their reference."""
    key = F.col("o_orderkey")
    backlog = spark.read.parquet(f"{d}/orders.parquet").where(key % 37 == 0).select((F.col("o_custkey") % 48).alias("source"), (LIVE_DAY - key % 900 - key % 4).cast("int").alias("first_day"), (LIVE_DAY - key % 900).cast("int").alias("last_day"))
    found = novelty.candidates(library._gates(spark, d)).withColumns({"source": F.col("host").cast("long") % 48, "day": F.lit(LIVE_DAY)})
    return novelty.incomplete(found, backlog, DEFAULT).select("host", *novelty.PATTERN, "category", "historical_reference_incomplete")


def incomplete_days(spark: SparkSession, d: str) -> DataFrame:
    """The same for every day of every host."""
    key = F.col("o_orderkey")
    backlog = spark.read.parquet(f"{d}/orders.parquet").where(key % 37 == 0).select((F.col("o_custkey") % 48).alias("source"), (LIVE_DAY - key % 900 - key % 4).cast("int").alias("first_day"), (LIVE_DAY - key % 900).cast("int").alias("last_day"))
    days = novelty_view(spark, d).select("host", "day").distinct().withColumn("source", F.col("host").cast("long") % 48)
    return novelty.incomplete(days, backlog, DEFAULT).select("host", "day", "historical_reference_incomplete")


def findings_rollup(spark: SparkSession, d: str) -> DataFrame:
    return triage.rollup(library._table(spark, d), [["detector", "category", "priority", "location"], ["detector", "category"], ["priority"], []]).withColumn("detector", F.coalesce("detector", F.lit("")))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """Events of 50 as a batch; some were changed after they were sealed, some have lost records, some are read in part."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.floor(F.col("event_id") / 50).alias("b"), F.struct("event_id", "user_id", "event_type").alias("r"))
    grouped = rows.groupBy("b").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    sealed = staged.sealed(grouped.select(F.col("b").alias("batch"), F.when(F.col("b") % 3 == 0, "live").otherwise("backfill").alias("lane"), (F.col("b") % 4).cast("int").alias("shard"), F.to_json("rs").alias("payload"), F.size("rs").cast("long").alias("event_count")))
    b = F.col("batch")
    broken = F.when(b % 11 == 1, F.lit(None)).when(b % 11 == 2, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return sealed.withColumns({"payload": broken, "event_count": F.col("event_count") + F.when(b % 11 == 3, 1).otherwise(0), "size": F.col("size") + F.when(b % 11 == 4, 1).otherwise(0), "processed": F.when(b % 11 == 5, 20).when(b % 11 == 6, 1000).otherwise(0).cast("long")})


def staged_records(spark: SparkSession, d: str) -> DataFrame:
    return staged.decode(_batches(spark, d), "event_id long, user_id long, event_type string")


def staged_failures(spark: SparkSession, d: str) -> DataFrame:
    return staged.failures(_batches(spark, d), CLOCK).select("batch", "lane", "shard", "reason", "stage", "cursor_before_failure", "message_redacted")


def retention_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each table would keep and lose three weeks after the last day."""
    clock = float(CLOCK + 21 * 86400)
    obs = novelty_view(spark, d)
    days = summaries.behavior_days(obs, DEFAULT.maximum_contexts_per_host_day)
    key = F.col("o_orderkey")
    age = lambda step, of: (F.lit(clock) - (key % of) * step * 86400.0)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    tables = {
        "receipts": obs.select((F.col("ts") + 20 * 86400).alias("received")),
        "batch_receipts": orders.select(age(1, 60).alias("received")),
        "behavior_days": days,
        "coverage": summaries.coverage(obs),
        "network_windows": obs.where("kind IS NOT NULL").select("host", "app", "kind", summaries.window_start(F.col("ts")).alias("start")).distinct(),
        "processes": obs.groupBy("host", "k").agg((F.max("ts") + 16 * 86400).alias("last_seen")),
        "jobs": orders.select(F.when(key % 5 == 0, 0.0).otherwise(age(1, 20)).alias("finished")),
        "sessions": orders.select((age(1, 20) + 86400 * 5).alias("expires")),
        "findings": orders.select(F.when(key % 4 != 0, age(3, 60)).alias("closed")),
        "expectations": orders.select(age(10, 60).alias("expires")),
        "audit": orders.select(age(10, 60).alias("created")),
        "staged_batches": orders.select(F.when(key % 3 == 0, "done").otherwise("pending").alias("status"), age(1, 7).alias("finished")),
    }
    counted = [retention.counted(rows, name, clock, DEFAULT) for name, rows in tables.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def detector_retirement(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings of four detectors, a part of them as expectations."""
    key = F.col("o_orderkey")
    named = F.element_at(F.array(*map(F.lit, [retention.RETIRED, "DS-EXEC-001", "DS-EXEC-002", novelty.DETECTOR])), (key % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", named.alias("detector"))
    return retention.retirement(rows, rows.where("o_orderkey % 3 = 0"))


def window_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Half hours in which a kind of event comes from unusually many hosts, right after another such one."""
    rows = novelty_view(spark, d).withColumn("start", summaries.window_start(F.col("ts")))
    windows = rows.groupBy("event_type", "start").agg(F.count_distinct("host").alias("v"))
    return summaries.bursts(windows, ["event_type"], "v", floor=0.2, factor=0.5).withColumn("threshold", F.round("threshold", 6))


def reference_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The live day's contexts of teams as cohorts, every other of which may keep findings back; the last team has none."""
    obs = cohort_view(spark, d)
    team = F.col("host").cast("int") % 6
    cohorts = obs.select("host", F.concat(F.lit("team-"), team.cast("string")).alias("cohort")).distinct().where("cohort <> 'team-5'")
    labels = spark.createDataFrame([(f"team-{t}", t % 2 == 0) for t in range(5)], "label string, suppressing boolean")
    days = summaries.behavior_days(obs, DEFAULT.maximum_contexts_per_host_day)
    return novelty.reference_evidence(obs.where(F.col("day") == LIVE_DAY), days, LIVE_DAY, cohorts, labels, replace(DEFAULT, minimum_peer_hosts=3))


QUERIES = {f.__name__: f for f in (window_bursts, reference_evidence, registrable_domains, dt01_incomplete, incomplete_days, findings_rollup, staged_records, staged_failures, retention_counts, detector_retirement)}

_BACKLOG = f"""back AS (
  SELECT o_custkey % 48 AS source, {LIVE_DAY} - o_orderkey % 900 - o_orderkey % 4 AS first_day, {LIVE_DAY} - o_orderkey % 900 AS last_day FROM orders WHERE o_orderkey % 37 = 0
)"""
_STAGED = """ev AS (SELECT event_id // 50 AS b, event_id, user_id, event_type, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id, user_id, event_type) - 1 AS pos FROM events),
bt AS (SELECT b, count(*) AS n FROM ev GROUP BY b), vd AS (
  SELECT b, CASE b % 11 WHEN 1 THEN 'missing_payload' WHEN 2 THEN 'wrong_digest' WHEN 3 THEN 'wrong_count' WHEN 4 THEN 'wrong_size' WHEN 6 THEN 'wrong_offset' WHEN 5 THEN CASE WHEN n < 20 THEN 'wrong_offset' END END AS reason,
    CASE b % 11 WHEN 5 THEN 20 WHEN 6 THEN 1000 ELSE 0 END AS done FROM bt
)"""
_AT = CLOCK + 21 * 86400


def _age(step: int, of: int) -> str:
    return f"({_AT} - (o_orderkey % {of}) * {step} * 86400)"


def _kept(name: str, rows: str, gone: str) -> str:
    return f"SELECT '{name}' AS name, count(*) FILTER (NOT coalesce({gone}, false)) AS kept, count(*) FILTER (coalesce({gone}, false)) AS deleted FROM ({rows})"


SQL = {
    "window_bursts": f"""WITH {_OBS}{_WINDOWS}, wd AS (SELECT *, CAST(floor(start / 86400) AS INT) AS day FROM win),
th AS (
  SELECT a.event_type, a.day, greatest(0.2, quantile_cont(b.v, 0.95) * 0.5, quantile_cont(b.v, 0.95) + 0.1) AS threshold
  FROM (SELECT DISTINCT event_type, day FROM wd) a JOIN wd b ON b.event_type = a.event_type AND b.day < a.day AND b.day >= a.day - 28 GROUP BY a.event_type, a.day HAVING count(DISTINCT b.day) >= 7 AND count(*) >= 8
),
ov AS (SELECT wd.event_type, wd.start, wd.v, threshold FROM wd JOIN th ON th.event_type = wd.event_type AND th.day = wd.day WHERE wd.v > threshold)
SELECT x.event_type, x.start, x.v, round(x.threshold, 6) AS threshold, y.start AS before FROM ov x JOIN ov y ON y.event_type = x.event_type AND y.start = x.start - 1800""",
    "reference_evidence": f"""WITH {_TEAM}{_DAYS}{_WINDOW}, subject AS (SELECT DISTINCT host, day, app, parent, location FROM obs WHERE day = {LIVE_DAY}),
ref AS (WITH {_REFERENCES[2:]}),
tm AS (SELECT DISTINCT host, 'team-' || (CAST(host AS INT) % 6) AS cohort FROM obs WHERE CAST(host AS INT) % 6 <> 5),
q AS (SELECT host, app FROM win GROUP BY ALL HAVING count(DISTINCT day) >= 7), shown AS (SELECT DISTINCT host, app, parent, location FROM win),
pe AS (
  SELECT s.host, s.app, s.parent, s.location, count(*) AS peer_eligible, count(x.host) AS peer_seen FROM subject s JOIN tm a ON a.host = s.host JOIN tm b ON b.cohort = a.cohort AND b.host <> a.host JOIN q ON q.host = b.host AND q.app = s.app
    LEFT JOIN shown x ON x.host = b.host AND x.app = s.app AND x.parent = s.parent AND x.location = s.location GROUP BY ALL
)
SELECT r.host, r.day, r.app, r.parent, r.location, r.observed_days, r.familiar_days, r.local_new, coalesce(peer_seen, 0) AS peer_seen, coalesce(peer_eligible, 0) AS peer_eligible, coalesce(peer_eligible, 0) > 0 AS peer_evidence_available,
  coalesce(tm.cohort IN ('team-0', 'team-2', 'team-4'), false) AS peer_group_suppression_allowed, coalesce(tm.cohort IN ('team-0', 'team-2', 'team-4'), false) AND coalesce(peer_eligible, 0) >= 3 AS peer_qualified, coalesce(tm.cohort, 'unassigned') AS cohort,
  CASE WHEN established THEN 'established' ELSE 'learning' END AS confidence
FROM ref r LEFT JOIN tm ON tm.host = r.host LEFT JOIN pe ON pe.host = r.host AND pe.app = r.app AND pe.parent = r.parent AND pe.location = r.location""",
    "registrable_domains": f"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages),
n AS (SELECT DISTINCT CASE WHEN page_id % 5 = 0 THEN upper(h) || '.' WHEN page_id % 7 = 0 THEN regexp_replace(h, '^[^.]+\\.', '') ELSE h END AS domain FROM u),
l AS (SELECT domain, string_split(regexp_replace(lower(domain), '\\.+$', ''), '.') AS ls FROM n),
r AS (SELECT unnest({list(RULES)}) AS rule),
p AS (SELECT domain, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
m AS (
  SELECT p.domain, p.i, starts_with(r.rule, '!') AS x FROM p JOIN r ON r.rule = array_to_string(ls[i:], '.') OR r.rule = '!' || array_to_string(ls[i:], '.') OR r.rule = '*.' || array_to_string(ls[i + 1:], '.')
),
b AS (SELECT domain, min(i) FILTER (x) AS own, min(i) FILTER (NOT x) AS suffix FROM m GROUP BY domain)
SELECT l.domain, array_to_string(ls[greatest(1, coalesce(own, suffix - 1, 1)):], '.') AS registrable FROM l LEFT JOIN b ON b.domain = l.domain""",
    "dt01_incomplete": f"""WITH {_FOUND.split(', hits AS')[0]}, {_BACKLOG}
SELECT host, app, parent, location, gate AS category, EXISTS (SELECT 1 FROM back WHERE back.source = CAST(host AS BIGINT) % 48 AND last_day >= {LIVE_DAY - 28} AND first_day <= {LIVE_DAY - 1}) AS historical_reference_incomplete
FROM gated WHERE gate IN ('rare_application', 'rare_launch_relationship')""",
    "incomplete_days": f"""WITH {_OBS}, {_BACKLOG}, hd AS (SELECT DISTINCT host, day FROM obs)
SELECT host, day, EXISTS (SELECT 1 FROM back WHERE back.source = CAST(host AS BIGINT) % 48 AND last_day >= day - 28 AND first_day <= day - 1) AS historical_reference_incomplete FROM hd""",
    "findings_rollup": f"""WITH {_OBS}, f AS (SELECT host, '{novelty.DETECTOR}' AS detector, CASE WHEN k < 50 THEN 'rare_application' ELSE 'rare_launch_relationship' END AS category, CASE WHEN k % 10 = 0 THEN 'high' ELSE 'review' END AS priority, location FROM obs)
SELECT detector, category, priority, location, 0 AS level, count(*) AS findings, count(DISTINCT host) AS hosts FROM f GROUP BY detector, category, priority, location
UNION ALL SELECT detector, category, NULL, NULL, 1, count(*), count(DISTINCT host) FROM f GROUP BY detector, category
UNION ALL SELECT '', NULL, priority, NULL, 2, count(*), count(DISTINCT host) FROM f GROUP BY priority
UNION ALL SELECT '', NULL, NULL, NULL, 3, count(*), count(DISTINCT host) FROM f""",
    "staged_records": f"WITH {_STAGED} SELECT ev.b AS batch, CAST(pos AS INTEGER) AS \"offset\", event_id, user_id, event_type FROM ev JOIN vd ON vd.b = ev.b WHERE reason IS NULL AND pos >= done",
    "staged_failures": f"WITH {_STAGED} SELECT b AS batch, CASE WHEN b % 3 = 0 THEN 'live' ELSE 'backfill' END AS lane, CAST(b % 4 AS INTEGER) AS shard, reason, 'decode' AS stage, CAST(done AS BIGINT) AS cursor_before_failure, true AS message_redacted FROM vd WHERE reason IS NOT NULL",
    "retention_counts": f"WITH {_OBS}{_DAYS} "
    + " UNION ALL ".join(
        [
            _kept("receipts", "SELECT ts + 20 * 86400 AS received FROM obs", f"received < {_AT} - 48 * 3600"),
            _kept("batch_receipts", f"SELECT {_age(1, 60)} AS received FROM orders", f"received < {_AT} - 29 * 86400"),
            _kept("behavior_days", "SELECT day FROM days", f"day < {_AT} // 86400 - 28"),
            _kept("coverage", "SELECT DISTINCT host, day, event_type FROM obs", f"day < {_AT} // 86400 - 28"),
            _kept("network_windows", "SELECT DISTINCT host, app, kind, floor(ts / 1800) * 1800 AS start FROM obs WHERE kind IS NOT NULL", f"start < ({_AT} // 86400 - 28) * 86400"),
            _kept("processes", "SELECT host, k, max(ts) + 16 * 86400 AS last_seen FROM obs GROUP BY host, k", f"last_seen < {_AT} - 7 * 86400"),
            _kept("jobs", f"SELECT CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE {_age(1, 20)} END AS finished FROM orders", f"finished > 0 AND finished < {_AT} - 7 * 86400"),
            _kept("sessions", f"SELECT {_age(1, 20)} + 86400 * 5 AS expires FROM orders", f"expires < {_AT}"),
            _kept("findings", f"SELECT CASE WHEN o_orderkey % 4 <> 0 THEN {_age(3, 60)} END AS closed FROM orders", f"closed < {_AT} - 90 * 86400"),
            _kept("expectations", f"SELECT {_age(10, 60)} AS expires FROM orders", f"expires < {_AT} - 365 * 86400"),
            _kept("audit", f"SELECT {_age(10, 60)} AS created FROM orders", f"created < {_AT} - 365 * 86400"),
            _kept("staged_batches", f"SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'pending' END AS status, {_age(1, 7)} AS finished FROM orders", f"status = 'done' AND finished < {_AT} - 2 * 86400"),
        ]
    ),
    "detector_retirement": """WITH f AS (SELECT o_orderkey AS k FROM orders) SELECT 'findings' AS name, count(*) FILTER (k % 4 = 0) AS retired, count(*) FILTER (k % 4 <> 0) AS kept FROM f
UNION ALL SELECT 'expectations', count(*) FILTER (k % 4 = 0), count(*) FILTER (k % 4 <> 0) FROM f WHERE k % 3 = 0""",
}
