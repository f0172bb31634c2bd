"""DuckDB SQL with the same rows as the queries of ``finding_queries``, written on the tables alone."""

from __future__ import annotations

from .oracles import _DAYS, _OBS, CLOCK, LIVE_DAY

_STORE = (
    _OBS
    + """, st AS (
  SELECT event_id AS id, CASE WHEN CAST(host AS INT) % 10 = 9 THEN 'demo' ELSE 'main' END AS namespace, host, CAST(host AS INT) AS hn, 'PC-' || host AS host_name,
         CASE WHEN k % 4 = 0 THEN 'DS-EXEC-002' ELSE 'DS-BEH-001' END AS detector,
         CASE WHEN k % 8 = 0 THEN 'resolved' WHEN k % 8 = 1 THEN 'expected' WHEN k % 8 = 2 AND event_type = 'view' THEN 'investigating' WHEN k = 3 AND event_type = 'click' THEN 'malicious' ELSE 'new' END AS state,
         CASE WHEN k % 10 = 0 AND event_type <> 'view' THEN 'high' ELSE 'review' END AS priority, ts AS first_seen, ts AS last_seen,
         CASE WHEN k < 50 THEN 'rare_application' WHEN k < 95 THEN 'rare_launch_relationship' END AS category, app, parent, location,
         CASE WHEN k % 13 <> 0 THEN 'C:\\Users\\u' || host || '\\' || event_type || '_updater_9.' || (k % 8) || '.0.exe' ELSE '' END AS image,
         CASE WHEN k % 13 <> 0 THEN event_type || '_updater_9.' || (k % 8) || '.0.exe' ELSE app END AS name,
         CASE WHEN k % 13 <> 0 THEN event_type || '_updater_{number}.{number}.{number}.exe' ELSE event_type || '-v{number}' END AS shape,
         CASE WHEN k % 6 = 0 THEN 'encoded_argument,shell_chain' ELSE '' END AS flags, k, event_type, day, ts
  FROM obs
),
op AS (SELECT * FROM st WHERE state IN ('new', 'investigating', 'malicious'))"""
)

_SIGNED = (
    _STORE
    + """, sg AS (SELECT *, substr(sha256(concat_ws(chr(31), namespace, detector, coalesce(category, 'other'), parent, location, flags, shape)), 1, 24) AS signature FROM st),
so AS (SELECT * FROM sg WHERE state IN ('new', 'investigating', 'malicious') AND namespace <> 'demo'),
fam AS (
  SELECT signature, any_value(namespace) AS namespace, any_value(detector) AS detector, coalesce(any_value(category), 'other') AS category, any_value(parent) AS parent, any_value(location) AS location, any_value(flags) AS flags,
         count(*) AS findings, count(DISTINCT host) AS hosts, count(DISTINCT name) AS variants, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (state = 'malicious') AS malicious,
         count(*) FILTER (state = 'investigating') AS investigating, count(DISTINCT name) >= 2 AS version_churn,
         CASE WHEN count(DISTINCT name) = 1 THEN min(name) WHEN any_value(shape) LIKE '%updater%' THEN min(event_type) || '_updater_9.*.0.exe' ELSE min(event_type) || '-v*' END AS pattern
  FROM so GROUP BY signature HAVING count(*) >= 5 AND count(DISTINCT host) >= 2
),
asked AS (
  SELECT *, CASE WHEN d % 3 = 0 THEN 14 WHEN d % 17 = 1 THEN 60 ELSE 0 END AS suppress_days FROM (SELECT *, CAST('0x' || substr(signature, 1, 2) AS INT) AS d FROM fam)
),
decided AS (
  SELECT *, CASE WHEN suppress_days = 60 THEN 'refused_duration' WHEN suppress_days > 0 AND detector <> 'DS-BEH-001' THEN 'refused_detector' WHEN suppress_days > 0 AND high + malicious > 0 THEN 'refused_malicious_or_high'
    WHEN suppress_days > 0 AND investigating > 0 THEN 'refused_investigating' ELSE 'reviewed' END AS decision FROM asked
)"""
)


def _blob(raw: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::BLOB"


def _hmac(key: bytes, message: str) -> str:
    full = key.ljust(64, b"\0")
    inner, outer = (_blob(bytes(b ^ pad for b in full)) for pad in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || {message})))"


_TRIGGER = """CASE WHEN detector = 'DS-EXEC-002' THEN 'New context + outbound activity' WHEN category = 'rare_application' THEN 'Rare application (3/150 hosts)'
  WHEN category = 'rare_launch_relationship' THEN 'Rare launch (2/3 app hosts)' ELSE 'Unusual local behavior' END"""
_SORTS = {"when": "last_seen", "detector": "detector", "hostname": "host_name", "parent": "coalesce(parent, '')", "process": "coalesce(image, app, '')", "trigger": "coalesce(category, detector)"}
_HOSTS = """, hosts AS (
  SELECT host, 'PC-' || host AS host_name, CASE WHEN CAST(host AS INT) % 10 = 9 THEN 'demo' ELSE 'main' END AS namespace, CASE WHEN CAST(host AS INT) % 7 = 0 THEN 'unassigned' ELSE 'cohort-' || CAST(host AS INT) % 5 END AS cohort,
         max(ts) AS last_seen FROM obs GROUP BY host
)"""
_WINDOWS = ", win AS (SELECT event_type, CAST(floor(ts / 1800) * 1800 AS BIGINT) AS start, count(DISTINCT host) AS v FROM obs GROUP BY ALL)"

SQL = {
    "family_signatures": f"WITH {_SIGNED} SELECT id, shape, signature FROM sg",
    "family_snapshot": f"""WITH {_SIGNED}, total AS (SELECT count(*) AS total FROM so), top AS (SELECT *, round(findings / greatest(total, 1), 4) AS share FROM fam, total ORDER BY findings DESC, hosts DESC, signature LIMIT 30)
      SELECT signature, detector, category, parent, location, flags, pattern, findings, hosts, variants, high, malicious, version_churn, share,
        concat_ws(',', CASE WHEN version_churn THEN 'filename-version-churn' END, CASE WHEN hosts >= 10 THEN 'multi-host-repetition' END, CASE WHEN share >= 0.35 AND total >= 20 THEN 'dominates-findings-stream' END) AS signals FROM top""",
    "family_members_page": f"""WITH {_SIGNED} SELECT id, round(last_seen, 6) AS last_seen FROM so WHERE signature = (SELECT signature FROM fam ORDER BY findings DESC, hosts DESC, signature LIMIT 1)
      ORDER BY so.last_seen DESC, id LIMIT 75 OFFSET 75""",
    "family_reviews": f"WITH {_SIGNED} SELECT signature, suppress_days, decision FROM decided UNION ALL SELECT 'none', 7, 'refused_unknown_family'",
    "family_reviewed_states": f"""WITH {_SIGNED}, c AS (SELECT *, state = 'new' AND priority <> 'high' AND signature IN (SELECT signature FROM decided WHERE decision = 'reviewed') AS changed FROM sg WHERE namespace <> 'demo')
      SELECT CASE WHEN changed THEN 'expected' ELSE state END AS state, count(*) AS findings, count(*) FILTER (changed) AS changed FROM c GROUP BY 1""",
    "family_expected": f"WITH {_SIGNED} SELECT signature, pattern, CAST({CLOCK} + suppress_days * 86400 AS DOUBLE) AS expires FROM decided WHERE decision = 'reviewed' AND suppress_days > 0",
    "findings_merged": f"""WITH {_STORE}, old AS (SELECT *, state IN ('new', 'investigating', 'malicious') AS opened FROM st WHERE ts < {LIVE_DAY * 86400}
        QUALIFY row_number() OVER (PARTITION BY host, detector, app ORDER BY state IN ('new', 'investigating', 'malicious') DESC, last_seen DESC, id DESC) = 1),
      fresh AS (SELECT *, max(last_seen) OVER w AS latest, count(*) OVER w AS times FROM st WHERE ts >= {LIVE_DAY * 86400} WINDOW w AS (PARTITION BY host, detector, app)
        QUALIFY row_number() OVER (PARTITION BY host, detector, app ORDER BY first_seen, id) = 1)
      SELECT o.id, o.host, o.detector, o.app AS context, o.state, round(CASE WHEN opened THEN greatest(o.last_seen, coalesce(latest, o.last_seen)) ELSE o.last_seen END, 6) AS last_seen, CASE WHEN opened THEN 1 + coalesce(times, 0) ELSE 1 END AS occurrences
      FROM old o LEFT JOIN fresh f ON f.host = o.host AND f.detector = o.detector AND f.app = o.app
      UNION ALL SELECT id, host, detector, app, 'new', round(latest, 6), times FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.opened AND f.host = o.host AND f.detector = o.detector AND f.app = o.app)
        AND NOT (parent = 'p1' AND detector = 'DS-BEH-001' AND priority <> 'high') AND NOT (hn % 3 = 0 AND hn % 2 <> 0)""",
    "findings_after_changes": f"""WITH {_STORE}, x AS (SELECT *, state IN ('new', 'investigating', 'malicious') AS was, CASE WHEN id % 5 = 0 THEN ['new', 'investigating', 'resolved', 'malicious', 'expected'][id % 25 // 5 + 1] END AS target FROM st),
      y AS (SELECT *, count(*) FILTER (was) OVER (PARTITION BY host, detector) - CAST(was AS INT) AS others FROM x),
      z AS (SELECT *, CASE WHEN target IS NULL THEN NULL WHEN target = 'expected' THEN 'refused_state' WHEN target <> 'resolved' AND others > 0 THEN 'refused_open' ELSE 'changed' END AS outcome FROM y)
      SELECT id, CASE WHEN outcome = 'changed' THEN target ELSE state END AS state, CASE WHEN outcome = 'changed' THEN target <> 'resolved' ELSE was END AS is_open, outcome FROM z""",
    "findings_expected": f"""WITH {_STORE}, x AS (SELECT *, id % 4 = 0 AND state <> 'malicious' AND id % 120 BETWEEN 1 AND 90 AS ok FROM st)
      SELECT CASE WHEN ok THEN 'expected' ELSE state END AS state, count(*) AS findings, count(*) FILTER (ok) AS expectations, CAST(max(CASE WHEN ok THEN {CLOCK} + (id % 120) * 86400 END) AS DOUBLE) AS last_expiry FROM x GROUP BY 1""",
    "expectations_with_hosts": f"""WITH {_STORE} SELECT CAST(id AS VARCHAR) AS context, host_name, namespace, round(ts + 60, 6) AS created FROM st WHERE state = 'expected' ORDER BY ts + 60 DESC, CAST(id AS VARCHAR) LIMIT 200""",
    "finding_states": f"WITH {_STORE} SELECT state, count(*) AS findings, count(*) FILTER (first_seen >= {CLOCK - 7 * 86400}) AS recent FROM st WHERE detector = 'DS-BEH-001' GROUP BY state",
    "findings_table_sorted": f"WITH {_STORE} "
    + " UNION ALL ".join(f"(SELECT '{name}' AS sorted_by, {down} AS descending, id FROM op ORDER BY {by} {'DESC' if down == 'true' else 'ASC'}, id LIMIT 20)" for name, by in _SORTS.items() for down in ("false", "true")),
    "findings_filtered": f"""WITH {_STORE}, t AS (SELECT id, state, lower(concat_ws(chr(1), host_name, parent, image, app)) AS x FROM st)
      SELECT 'investigating' AS status, id FROM t WHERE state = 'investigating' AND contains(x, 'pc-1') UNION ALL SELECT 'malicious', id FROM t WHERE state = 'malicious' AND contains(x, '_updater_9.3')
      UNION ALL SELECT 'resolved', id FROM t WHERE state = 'resolved' AND contains(x, 'view-v1') UNION ALL SELECT 'other', id FROM t WHERE state IN ('new', 'investigating', 'malicious') AND contains(x, 'p9')""",
    "findings_private": f"""WITH {_STORE} SELECT id, strftime(make_timestamp(CAST(floor(ts * 1000000) AS BIGINT)), '%Y-%m-%d') AS "when", detector, 'host-' || substr({_hmac(b"only for tests", "encode(namespace) || '\\x00'::BLOB || encode(host)")}, 1, 10) AS hostname,
      parent, location || '\\' || name AS process, {_TRIGGER} AS trigger FROM op""",
    "findings_export": f"""WITH {_STORE} SELECT id, concat_ws(',', strftime(make_timestamp(CAST(floor(ts * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S'), detector, host_name, parent,
      CASE WHEN image = '' THEN app || ' (path unavailable)' ELSE image END, {_TRIGGER}) AS line FROM st WHERE state = 'investigating'""",
    "findings_json": f"WITH {_STORE} SELECT id, CAST(json_object('id', id, 'host_name', host_name, 'detector', detector, 'state', state, 'parent', parent, 'image', image) AS VARCHAR) AS json FROM st WHERE state = 'malicious'",
    "endpoint_findings": f"WITH {_STORE} SELECT host, id, row_number() OVER (PARTITION BY host ORDER BY last_seen DESC, id) AS r FROM st QUALIFY r <= 10",
    "global_counts": f"""WITH {_STORE} SELECT 'open_findings' AS what, count(*) AS n FROM op UNION ALL SELECT 'endpoints', count(DISTINCT host) FROM obs
      UNION ALL SELECT 'orphan_processes', count(*) FROM (SELECT DISTINCT host, k FROM obs WHERE event_type = 'purchase' EXCEPT SELECT host, k FROM obs WHERE event_type = 'click')""",
    "hosts_by_cohort": f"WITH {_OBS}{_HOSTS} SELECT cohort, count(*) AS hosts FROM hosts WHERE cohort <> 'unassigned' GROUP BY cohort",
    "endpoints_page": f"WITH {_OBS}{_HOSTS} SELECT host, host_name, round(last_seen, 6) AS last_seen FROM hosts ORDER BY hosts.last_seen DESC, host LIMIT 50",
    "namespace_support": f"WITH {_OBS}{_DAYS}{_HOSTS} SELECT namespace, app, count(DISTINCT host) AS app_hosts FROM days JOIN hosts USING (host) GROUP BY ALL",
    "distinct_labels": f"WITH {_STORE}{_HOSTS} SELECT DISTINCT 'namespace' AS kind, namespace AS label FROM hosts UNION ALL SELECT DISTINCT 'detector', detector FROM st UNION ALL SELECT DISTINCT 'cohort', cohort FROM hosts",
    "covered_hosts": f"WITH {_OBS} SELECT DISTINCT host FROM obs WHERE k < 5 OR k > 97 OR (event_type = 'signup' AND k < 20)",
    "host_views": f"""WITH {_OBS} SELECT host, bool_or(event_type = 'signup' AND k < 50) AND bool_or(event_type = 'purchase' AND k < 30) AS both FROM obs
      WHERE (event_type = 'signup' AND k < 50) OR (event_type = 'purchase' AND k < 30) GROUP BY host""",
    "collection_lag": f"WITH {_OBS} SELECT round({CLOCK} - min(c), 6) AS lag FROM (SELECT max(ts) AS c FROM obs GROUP BY event_type)",
    "fresh_workers": f"WITH {_OBS} SELECT host FROM obs GROUP BY host HAVING max(ts) > {CLOCK - 3600}",
    "context_overflow": f"""WITH {_OBS}{_DAYS} SELECT host, day, count(*) AS contexts, CAST(sum(n) AS BIGINT) AS events FROM (SELECT *, row_number() OVER (PARTITION BY host, day ORDER BY first_seen, app, parent, location) AS r FROM days) WHERE r > 2 GROUP BY ALL""",
    "window_thresholds": f"""WITH {_OBS}{_WINDOWS}, wd AS (SELECT *, CAST(floor(start / 86400) AS INT) AS day FROM win)
      SELECT a.event_type, a.day, count(DISTINCT b.day) AS days, count(*) AS windows, round(greatest(30, quantile_cont(b.v, 0.95) * 4, quantile_cont(b.v, 0.95) + 15), 6) AS threshold
      FROM (SELECT DISTINCT event_type, day FROM wd) a JOIN wd b ON b.event_type = a.event_type AND b.day < a.day AND b.day >= a.day - 28 GROUP BY a.event_type, a.day HAVING count(DISTINCT b.day) >= 7 AND count(*) >= 8""",
    "sustained_windows": f"WITH {_OBS}{_WINDOWS} SELECT x.event_type, x.start, x.v FROM win x JOIN win y ON y.event_type = x.event_type AND y.start = x.start - 1800 WHERE x.v > 1 AND y.v > 1",
    "name_filters": """WITH s AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN replace(s_name, '#', '.') ELSE s_name END AS q FROM supplier)
      SELECT s_suppkey, regexp_full_match(s_name, 'Supplier#.*[1-3].') AS by_glob, regexp_full_match(s_name, 'Supplier#.*[^0-4]') AS by_other, false AS by_case, s_name ILIKE '%supplier#0000000_1%' AS by_search, contains(q, '.') AS is_domain,
        CASE WHEN s_suppkey % 4 <> 0 THEN q ELSE '—' END AS shown FROM s""",
    "next_spans": """WITH o AS (SELECT o_orderkey, greatest(1, o_orderkey % 700) AS span, o_orderkey % 5003 AS got, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 5000 END AS most, o_orderkey % 3 AS tries FROM orders)
      SELECT o_orderkey, CASE WHEN most <= 0 THEN least(span, 600) WHEN tries > 1 OR got / most > 0.75 THEN CASE WHEN got <= 0 THEN least(span, 600) ELSE least(600, greatest(1, CAST(floor(span * 0.65::DOUBLE / (got / most)) AS BIGINT))) END
        WHEN got / most < 0.45 AND span < 600 THEN least(600, greatest(span + 1, span * 2)) ELSE least(span, 600) END AS span FROM o""",
}
