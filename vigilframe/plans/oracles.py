"""DuckDB SQL with the same rows as the queries of this package, written on the tables alone."""

from __future__ import annotations

LIVE_DAY = 19752
CLOCK = (LIVE_DAY + 1) * 86400

_BASE = """e AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS host, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         epoch_us(ts) / 1e6 AS ts, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS INT) AS day
  FROM events
)"""

_OBS = (
    _BASE
    + """, obs AS (
  SELECT event_id, host, event_type || '-v' || CAST(CAST(floor(value / 5) AS BIGINT) AS VARCHAR) AS app, 'p' || CAST(k % 10 AS VARCHAR) AS parent,
         CASE WHEN k < 60 THEN 'windows' WHEN k < 90 THEN 'program-files' ELSE 'user-profile' END AS location,
         CASE event_type WHEN 'purchase' THEN 'ip' WHEN 'click' THEN 'domain' END AS kind, k, event_type, value, ts, day
  FROM e
)"""
)

_TEAM = (
    _BASE
    + """, obs AS (
  SELECT event_id, host, CASE WHEN k % 4 = 0 THEN 'shared-app' || CAST(k % 3 AS VARCHAR) ELSE 'team' || CAST(user_id % 6 AS VARCHAR) || '-app' || CAST(k % 5 AS VARCHAR) END AS app,
         'team' || CAST(user_id % 6 AS VARCHAR) || '-svc' || CAST(k % 2 AS VARCHAR) AS parent, 'program-files' AS location,
         CASE WHEN event_type IN ('view', 'click') THEN 'domain' WHEN event_type = 'purchase' THEN 'ip' END AS kind, ts, day
  FROM e
)"""
)

_DAYS = """, days AS (
  SELECT host, day, app, parent, location, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(event_id, (ts, event_id)) AS sample
  FROM obs GROUP BY ALL
)"""

_WINDOW = f", win AS (SELECT * FROM days WHERE day >= {LIVE_DAY - 28} AND day < {LIVE_DAY})"

_GATES = (
    _OBS
    + _DAYS
    + _WINDOW
    + f""", subject AS (SELECT DISTINCT host, app, parent, location FROM obs WHERE day = {LIVE_DAY}),
observed AS (SELECT host, count(DISTINCT day) AS observed_days FROM win GROUP BY host),
familiar AS (SELECT host, app, parent, location, count(DISTINCT day) AS familiar_days FROM win GROUP BY ALL),
apps AS (SELECT app, count(DISTINCT host) AS app_hosts FROM win GROUP BY app),
patterns AS (SELECT app, parent, location, count(DISTINCT host) AS pattern_hosts FROM win GROUP BY ALL),
fleet AS (SELECT count(DISTINCT host) AS fleet_hosts FROM win),
facts AS (
  SELECT s.*, coalesce(observed_days, 0) AS observed_days, coalesce(familiar_days, 0) AS familiar_days, fleet_hosts, coalesce(app_hosts, 0) AS app_hosts,
         coalesce(pattern_hosts, 0) AS pattern_hosts
  FROM subject s LEFT JOIN observed USING (host) LEFT JOIN familiar USING (host, app, parent, location) LEFT JOIN apps USING (app)
       LEFT JOIN patterns USING (app, parent, location) CROSS JOIN fleet
),
gated AS (
  SELECT *, CASE WHEN observed_days < 7 THEN 'insufficient_local_history' WHEN familiar_days > 0 THEN 'locally_familiar_context' WHEN app IN ('', 'unknown') THEN 'unknown_application'
    WHEN fleet_hosts < 50 THEN 'insufficient_fleet_coverage' WHEN app_hosts <= greatest(2, floor(CAST(fleet_hosts AS DOUBLE) * CAST(0.01 AS DOUBLE))) THEN 'rare_application'
    WHEN app_hosts >= greatest(15, ceil(CAST(fleet_hosts AS DOUBLE) * CAST(0.03 AS DOUBLE))) AND parent NOT IN ('', 'unknown') AND location <> 'unknown'
         AND pattern_hosts <= greatest(2, floor(CAST(app_hosts AS DOUBLE) * CAST(0.02 AS DOUBLE))) THEN 'rare_launch_relationship'
    ELSE 'not_rare_by_fleet_reference' END AS gate
  FROM facts
)"""
)

_FOUND = (
    _GATES
    + f""", hits AS (
  SELECT o.*, g.gate AS category, CASE g.gate WHEN 'rare_launch_relationship' THEN concat_ws('|', 'launch', app, parent, location) ELSE 'application|' || app END AS identity
  FROM obs o JOIN gated g USING (host, app, parent, location) WHERE o.day = {LIVE_DAY} AND g.gate IN ('rare_application', 'rare_launch_relationship')
),
found AS (
  SELECT host, 'DS-BEH-001' AS detector, category, identity, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences, arg_min(parent, (ts, event_id)) AS first_parent
  FROM hits GROUP BY host, category, identity
)"""
)

_SKETCH = """sha256(CAST({v} AS VARCHAR))"""


def _registers(keys: str, value: str, source: str) -> str:
    x = _SKETCH.format(v=value)
    return f"""regs AS (
  SELECT {keys}, CAST(('0x' || substr({x}, 1, 2)) AS INT) AS bucket,
         max(CASE WHEN CAST(('0x' || substr({x}, 3, 14)) AS BIGINT) = 0 THEN 57 ELSE 57 - length(ltrim(bin(CAST(('0x' || substr({x}, 3, 14)) AS BIGINT)), '0')) END) AS rank
  FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL
),
sums AS (SELECT {keys}, sum(pow(2.0, -rank)) + (256 - count(*)) AS z, 256 - count(*) AS zero FROM regs GROUP BY ALL),
est AS (
  SELECT {keys}, CAST(round_even(CASE WHEN zero > 0 AND 0.7213::DOUBLE / (1 + 1.079::DOUBLE / 256) * 65536 / z <= 640 THEN 256 * ln(256.0 / zero)
         ELSE 0.7213::DOUBLE / (1 + 1.079::DOUBLE / 256) * 65536 / z END, 0) AS BIGINT) AS distinct_estimate FROM sums
)"""


_FEATURES = """, feats AS (
  SELECT DISTINCT host, CASE WHEN location = 'windows' THEN 'platform' ELSE 'applications' END AS channel, 'app:' || app AS feature, day FROM obs WHERE app NOT IN ('', 'unknown', '-')
  UNION SELECT host, CASE WHEN location = 'windows' THEN 'platform' ELSE 'process' END, 'pc:' || parent || '>' || app, day FROM obs WHERE app NOT IN ('', 'unknown', '-') AND parent NOT IN ('', 'unknown', '-')
  UNION SELECT host, 'network', 'net:' || app || ':' || kind, day FROM obs WHERE app NOT IN ('', 'unknown', '-') AND kind IS NOT NULL AND location <> 'windows'
  UNION SELECT host, 'activity', 'activity:' || lpad(CAST(h AS VARCHAR), 2, '0') || '-' || lpad(CAST(h + 6 AS VARCHAR), 2, '0') || 'utc', day
        FROM (SELECT host, day, CAST(floor((CAST(floor(ts / 3600) AS BIGINT) % 24) / 6) AS INT) * 6 AS h FROM obs)
),
hd AS (SELECT host, count(DISTINCT day) AS observed_days FROM obs GROUP BY host),
prev AS (SELECT host, channel, feature, count(*) / observed_days AS prevalence FROM feats JOIN hd USING (host) GROUP BY host, channel, feature, observed_days),
total AS (SELECT count(*) AS n FROM hd)"""

_BUNDLES = """, topapps AS (
  SELECT * FROM (SELECT host, substr(feature, 5) AS a, prevalence, row_number() OVER (PARTITION BY host ORDER BY prevalence DESC, feature) AS r FROM prev WHERE channel = 'applications')
  WHERE r <= 18 AND prevalence >= 0.2
),
allpairs AS (SELECT x.host, 'bundle:' || x.a || '|' || y.a AS feature, least(x.prevalence, y.prevalence) AS prevalence FROM topapps x JOIN topapps y ON x.host = y.host AND x.a < y.a),
goodpairs AS (SELECT feature FROM allpairs, total GROUP BY feature, n HAVING count(*) >= CASE WHEN n < 20 THEN 2 ELSE 3 END AND count(*) / n <= CASE WHEN n < 20 THEN 0.80 ELSE 0.65 END),
bundles AS (SELECT host, 'bundles' AS channel, feature, prevalence FROM allpairs WHERE feature IN (SELECT feature FROM goodpairs)),
full_prev AS (SELECT * FROM prev UNION ALL SELECT * FROM bundles)"""

_WEIGHTS = """, df AS (SELECT channel, feature, count(*) AS df FROM full_prev GROUP BY ALL),
weighed AS (
  SELECT host, channel, feature, prevalence * CASE WHEN channel = 'activity' THEN 1.0::DOUBLE ELSE least(2.0::DOUBLE, 0.25::DOUBLE + greatest(0.0::DOUBLE, ln((n + 1) / (df + 1)))) END AS weight
  FROM full_prev JOIN df USING (channel, feature), total
),
w AS (
  SELECT host, channel, feature, weight, r FROM (SELECT *, row_number() OVER (PARTITION BY host, channel ORDER BY weight DESC, feature) AS r FROM weighed)
  WHERE r <= CASE channel WHEN 'applications' THEN 160 WHEN 'network' THEN 64 WHEN 'activity' THEN 8 ELSE 96 END
)"""

def _candidates(name: str, rows: str, keys: str) -> str:
    """Pairs under keys; long postings in a ring of 8, the longest not at all, two shared keys from 20 hosts on."""
    same = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f""", {name}_post AS (
  SELECT {keys}, host, row_number() OVER (PARTITION BY {keys} ORDER BY host) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS c FROM ({rows})
),
{name}_hits AS (
  SELECT DISTINCT least(x.host, y.host) AS a, greatest(x.host, y.host) AS b, {own} FROM {name}_post x JOIN {name}_post y ON {same} AND x.i <> y.i, total
  WHERE x.c BETWEEN 2 AND CASE WHEN n < 20 THEN n ELSE greatest(16, least(300, CAST(floor(n * 0.45::DOUBLE) AS BIGINT))) END AND (x.c <= 24 OR (y.i - x.i + x.c) % x.c BETWEEN 1 AND 8)
),
{name} AS (SELECT a, b FROM {name}_hits, total GROUP BY a, b, n HAVING count(*) >= CASE WHEN n < 20 THEN 1 ELSE 2 END)"""


_CANDIDATES = _candidates("cand", "SELECT * FROM w, total WHERE channel IN ('applications', 'bundles', 'process', 'network') AND (n < 64 OR r <= 8)", "channel, feature")

_SCORED = """, chan AS (SELECT unnest(['applications', 'bundles', 'process', 'network', 'activity']) AS channel),
sides AS (
  SELECT a, b, channel, feature, sum(x) AS x, sum(y) AS y FROM (
    SELECT a, b, channel, feature, weight AS x, 0.0::DOUBLE AS y FROM cand JOIN w ON w.host = a UNION ALL SELECT a, b, channel, feature, 0.0::DOUBLE, weight FROM cand JOIN w ON w.host = b
  ) WHERE channel <> 'platform' GROUP BY ALL
),
chs AS (SELECT a, b, channel, sum(least(x, y)) / sum(greatest(x, y)) AS score, count(*) FILTER (x > 0 AND y > 0) AS shared FROM sides GROUP BY ALL),
piv AS (
  SELECT a, b, coalesce(sum(score) FILTER (channel = 'applications'), 0) AS applications, coalesce(sum(score) FILTER (channel = 'bundles'), 0) AS bundles,
         coalesce(sum(score) FILTER (channel = 'process'), 0) AS process, coalesce(sum(score) FILTER (channel = 'network'), 0) AS network,
         coalesce(sum(score) FILTER (channel = 'activity'), 0) AS activity, CAST(coalesce(sum(shared) FILTER (channel = 'applications'), 0) AS BIGINT) AS shared_apps
  FROM chs GROUP BY a, b
),
scored AS (
  SELECT *, 0.40 * applications + 0.15 * bundles + 0.20 * process + 0.15 * network + 0.10 * activity AS overall FROM piv
),
elig AS (
  SELECT s.*, overall >= 0.50 AND applications >= 0.42 AND shared_apps >= CASE WHEN n < 20 THEN 3 ELSE 4 END
         AND (bundles >= 0.28 OR process >= 0.30 OR network >= 0.30 OR activity >= 0.55) AS eligible FROM scored s, total
)"""

_COMPONENTS = """, link AS (SELECT a, b FROM elig WHERE eligible UNION SELECT b, a FROM elig WHERE eligible),
reach(host, other) AS (SELECT a, a FROM link UNION SELECT r.host, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT host, min(other) AS component FROM reach GROUP BY host)"""

_TECH = """, tdf AS (SELECT channel, feature, count(*) AS df FROM prev GROUP BY ALL),
tv AS (
  SELECT host, channel || ':' || feature AS feature, prevalence * (ln((n + 1) / (df + 1)) + 0.15) AS v FROM prev JOIN tdf USING (channel, feature), total
  WHERE channel <> 'activity' AND df >= CASE WHEN n < 20 THEN 2 ELSE 3 END AND df / n <= 0.55
),
tt AS (SELECT host, feature, v, r FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY v DESC, feature) AS r FROM tv) WHERE r <= 36),
tech AS (SELECT host, feature, v / sqrt(sum(v * v) OVER (PARTITION BY host)) AS value, r FROM tt)"""

_TECH_PAIRS = (
    _candidates("tcand", "SELECT * FROM tech, total WHERE n < 64 OR r <= 32", "feature")
    + """, tpair AS (
  SELECT a, b, sum(x.value * y.value) AS cosine FROM tcand JOIN tech x ON x.host = a JOIN tech y ON y.host = b AND y.feature = x.feature GROUP BY a, b HAVING sum(x.value * y.value) >= 0.72
)"""
)

#: Members against the centroid of their component, over all of its features; members in ``gm`` (host, component), sizes in ``grp``.
_CENTROIDS = """, cent AS (SELECT component, channel, feature, sum(weight) / size AS c FROM w JOIN gm USING (host) JOIN grp USING (component) WHERE channel <> 'platform' GROUP BY component, channel, feature, size),
js AS (
  SELECT m.host, m.component, cent.channel, sum(least(coalesce(w.weight, 0), c)) / sum(greatest(coalesce(w.weight, 0), c)) AS s
  FROM gm m JOIN cent ON cent.component = m.component LEFT JOIN w ON w.host = m.host AND w.channel = cent.channel AND w.feature = cent.feature GROUP BY ALL
),
gs AS (
  SELECT component, size, coalesce(sum(s) FILTER (channel = 'applications'), 0) / size AS applications, coalesce(sum(s) FILTER (channel = 'bundles'), 0) / size AS bundles, coalesce(sum(s) FILTER (channel = 'process'), 0) / size AS process,
         coalesce(sum(s) FILTER (channel = 'network'), 0) / size AS network, coalesce(sum(s) FILTER (channel = 'activity'), 0) / size AS activity FROM js JOIN grp USING (component) GROUP BY component, size
),
go AS (SELECT *, 0.40 * applications + 0.15 * bundles + 0.20 * process + 0.15 * network + 0.10 * activity AS overall FROM gs)"""

_GROUPS = (
    """, grp AS (SELECT component, count(*) AS size FROM comp, total GROUP BY component, n HAVING count(*) >= 3 AND NOT (n >= 10 AND count(*) / n > 0.90)),
gm AS (SELECT comp.host, component FROM comp JOIN grp USING (component))"""
    + _CENTROIDS
    + """, ga AS (
  SELECT component, count(*) AS apps FROM (SELECT component, feature FROM prev JOIN gm USING (host) JOIN grp USING (component) WHERE channel = 'applications' GROUP BY component, feature, size HAVING count(*) / size >= 0.5) GROUP BY component
),
rec AS (
  SELECT go.*, apps FROM go JOIN ga USING (component), total WHERE overall >= 0.50 AND applications >= 0.42 AND apps >= CASE WHEN n < 20 THEN 3 ELSE 4 END
    AND (bundles >= 0.28 OR process >= 0.30 OR network >= 0.30 OR activity >= 0.55)
)"""
)

_CLUSTERS = """, tlink AS (SELECT a, b FROM tpair UNION SELECT b, a FROM tpair),
treach(host, other) AS (SELECT a, a FROM tlink UNION SELECT r.host, l.b FROM treach r JOIN tlink l ON l.a = r.other),
tcomp AS (SELECT host, min(other) AS component FROM treach GROUP BY host),
tsize AS (SELECT component, count(*) AS size FROM tcomp, total GROUP BY component, n HAVING count(*) >= 3 AND NOT (n >= 10 AND count(*) / n > 0.90)),
tcent AS (SELECT component, feature, sum(value) / size AS c FROM tech JOIN tcomp USING (host) JOIN tsize USING (component) GROUP BY component, feature, size),
tnorm AS (SELECT component, sqrt(sum(c * c)) AS norm FROM tcent GROUP BY component),
tcoh AS (SELECT component, size, sum(value * c) / norm / size AS cohesion FROM tech JOIN tcomp USING (host) JOIN tcent USING (component, feature) JOIN tnorm USING (component) JOIN tsize USING (component) GROUP BY component, size, norm)"""

_EXPLAINED = """, fleet AS (SELECT channel, feature, count(*) AS df FROM full_prev GROUP BY ALL),
own AS (SELECT component, channel, feature, count(*) AS c FROM full_prev JOIN member USING (host) GROUP BY ALL),
sc AS (
  SELECT component, channel, feature, (c / size - df / n) * (ln((n + 1) / (df + 1)) + 0.15) AS score,
         CASE split_part(feature, ':', 1) WHEN 'app' THEN substr(feature, 5) WHEN 'pc' THEN split_part(substr(feature, 4), '>', 2) WHEN 'net' THEN split_part(feature, ':', 2) ELSE '' END AS anchor
  FROM own JOIN size USING (component) JOIN fleet USING (channel, feature), total WHERE c / size >= 0.5 AND c / size > df / n
),
one AS (SELECT *, row_number() OVER (PARTITION BY component, anchor ORDER BY score DESC, feature) AS k FROM sc WHERE feature LIKE 'app:%'),
apps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, feature) AS j FROM one WHERE k = 1) WHERE j <= 4),
proc1 AS (SELECT *, row_number() OVER (PARTITION BY component, anchor ORDER BY score DESC, feature) AS k FROM sc WHERE channel = 'process' AND (component, anchor) NOT IN (SELECT (component, anchor) FROM apps)),
proc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, feature) AS j FROM proc1 WHERE k = 1) WHERE j <= 2),
net1 AS (SELECT *, row_number() OVER (PARTITION BY component, anchor ORDER BY score DESC, feature) AS k FROM sc WHERE channel = 'network' AND (component, anchor) NOT IN (SELECT (component, anchor) FROM apps UNION ALL SELECT (component, anchor) FROM proc)),
net AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, feature) AS j FROM net1 WHERE k = 1) WHERE j <= 2),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component, channel ORDER BY score DESC, feature) AS j FROM sc WHERE channel IN ('bundles', 'activity')) WHERE j <= CASE channel WHEN 'bundles' THEN 2 ELSE 1 END),
parent AS (SELECT component, anchor, arg_min(split_part(substr(feature, 4), '>', 1), (-score, feature)) AS launched_by FROM sc WHERE channel = 'process' GROUP BY ALL),
kinds AS (SELECT component, anchor, string_agg(DISTINCT split_part(feature, ':', 3), '/' ORDER BY split_part(feature, ':', 3)) AS network_kinds FROM sc WHERE channel = 'network' GROUP BY ALL),
told AS (
  SELECT component, channel, feature, score, launched_by, network_kinds FROM apps LEFT JOIN parent USING (component, anchor) LEFT JOIN kinds USING (component, anchor)
  UNION ALL SELECT component, channel, feature, score, NULL, NULL FROM (SELECT * FROM proc UNION ALL SELECT * FROM net) UNION ALL SELECT component, channel, feature, score, NULL, NULL FROM few
),
expl AS (
  SELECT *, CASE split_part(feature, ':', 1) WHEN 'app' THEN 'application ' || substr(feature, 5) WHEN 'pc' THEN 'parent-child ' || substr(feature, 4)
      WHEN 'net' THEN split_part(feature, ':', 2) || ' with ' || split_part(feature, ':', 3) || ' network activity' WHEN 'bundle' THEN 'application bundle ' || replace(substr(feature, 8), '|', ' + ')
      ELSE replace(replace(feature, 'activity:', 'activity '), 'utc', ' UTC') END AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, channel, feature) AS r FROM told) WHERE r <= 10
)"""


def _seeds(prev: str, n: str) -> str:
    return f"""sapps AS (SELECT host, feature, prevalence FROM {prev} WHERE channel = 'applications' AND prevalence >= 0.1),
sdf AS (SELECT feature, count(*) AS df FROM sapps GROUP BY feature),
seed AS (
  SELECT host, feature AS app, df FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY prevalence * (1 - df / n) DESC, feature) AS r FROM sapps JOIN sdf USING (feature), {n}) WHERE r <= 16
),
pick AS (SELECT host, app, df, n FROM seed, {n} WHERE df >= 10 AND df <= 0.8 * n),
pairs AS (
  SELECT x.app AS first, y.app AS second, count(*) AS members, count(*) * x.n::DOUBLE / (x.df * y.df) AS lift FROM pick x JOIN pick y ON x.host = y.host AND x.app < y.app
  GROUP BY x.app, y.app, x.df, y.df, x.n
  HAVING count(*) * x.n::DOUBLE / (x.df * y.df) >= 1.25 AND count(*) >= 10 AND count(*) <= 0.65 * x.n
),
best AS (SELECT first, second, members, lift, members * log2(lift) AS utility FROM pairs ORDER BY utility DESC, first, second LIMIT 480),
member AS (SELECT first, second, x.host FROM best JOIN sapps x ON x.feature = first JOIN sapps y ON y.feature = second AND y.host = x.host)"""


_TABLE = (
    _OBS
    + """, tab AS (
  SELECT event_id, host, 'DS-BEH-001' AS detector, CASE WHEN k < 50 THEN 'rare_application' ELSE 'rare_launch_relationship' END AS category, parent, location,
         'C:\\Users\\u' || host || '\\' || event_type || '_updater_9.' || CAST(k % 8 AS VARCHAR) || '.0.exe' AS image, ts AS first_seen, ts AS last_seen,
         CASE WHEN k % 10 = 0 THEN 'high' ELSE 'review' END AS priority, k % 5 AS app_hosts, 150 AS fleet_hosts, k % 3 AS pattern_hosts,
         event_type || '_updater_9.' || CAST(k % 8 AS VARCHAR) || '.0.exe' AS name, event_type || '_updater_{number}.{number}.{number}.exe' AS shape, event_type, k
  FROM obs
)"""
)

_FAMILIES = (
    _TABLE
    + """, fam AS (
  SELECT detector, category, parent, location, shape, count(*) AS findings, count(DISTINCT host) AS hosts, count(DISTINCT name) AS variants, round(min(first_seen), 9) AS first_seen,
         round(max(last_seen), 9) AS last_seen, CASE WHEN count(DISTINCT name) > 1 THEN min(event_type) || '_updater_9.*.0.exe' ELSE min(name) END AS pattern, count(DISTINCT name) >= 2 AS version_churn
  FROM tab GROUP BY detector, category, parent, location, shape HAVING count(*) >= 5 AND count(DISTINCT host) >= 2
)"""
)

_BATCHES = """b AS (
  SELECT o_orderkey AS batch_id, CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'backfill' END AS lane, o_custkey % 64 AS shard,
         CASE WHEN o_orderkey % 97 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'done' END AS status, epoch_us(o_orderdate) / 1e6 AS collected_at,
         o_orderkey % 400 AS events, o_orderkey % 7 AS processed, o_orderkey % 1000 AS bytes FROM orders
)"""

_REFERENCES = """, obsd AS (SELECT DISTINCT host, day AS d FROM days), ctx AS (SELECT DISTINCT host, app, parent, location, day AS d FROM days),
od AS (SELECT s.host, s.day, count(d) AS observed_days FROM (SELECT DISTINCT host, day FROM subject) s JOIN obsd o ON o.host = s.host AND d >= s.day - 28 AND d < s.day GROUP BY ALL),
fd AS (SELECT s.host, s.day, s.app, s.parent, s.location, count(d) AS familiar_days FROM subject s JOIN ctx c ON c.host = s.host AND c.app = s.app AND c.parent = s.parent AND c.location = s.location
       AND d >= s.day - 28 AND d < s.day GROUP BY ALL)
SELECT s.*, coalesce(observed_days, 0) AS observed_days, coalesce(familiar_days, 0) AS familiar_days, coalesce(familiar_days, 0) = 0 AS local_new, coalesce(observed_days, 0) >= 7 AS established
FROM subject s LEFT JOIN od USING (host, day) LEFT JOIN fd USING (host, day, app, parent, location)"""

_GLOBAL = " AND ".join(
    f"NOT (num BETWEEN {low} AND {high})"
    for low, high in (
        (sum(int(x) * 256 ** (3 - k) for k, x in enumerate(net.split("."))), sum(int(x) * 256 ** (3 - k) for k, x in enumerate(net.split("."))) + 2 ** (32 - bits) - 1)
        for net, bits in (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))
    )
)

_OUTBOUND = (
    _OBS
    + _DAYS
    + """, c AS (SELECT host, k AS guid, ts AS created, day, app, parent, location FROM (SELECT *, row_number() OVER (PARTITION BY host, k ORDER BY ts, event_id) AS r FROM obs WHERE event_type = 'click') WHERE r = 1),
      n AS (SELECT c.*, min(o.ts) AS network_ts FROM c JOIN obs o ON o.host = c.host AND o.k = c.guid AND o.event_type = 'purchase' AND o.ts >= c.created AND o.event_id % 10 NOT IN (0, 1) GROUP BY ALL),
      out AS (SELECT * FROM n
        WHERE (location = 'user-profile' OR guid % 10 = 3) AND (SELECT count(DISTINCT day) FROM days d WHERE d.host = n.host AND d.day >= n.day - 28 AND d.day < n.day) >= 7
          AND NOT EXISTS (SELECT 1 FROM days d WHERE d.host = n.host AND d.app = n.app AND d.parent = n.parent AND d.location = n.location AND d.day >= n.day - 28 AND d.day < n.day))"""
)

_TEAMS = ", member AS (SELECT DISTINCT host, CAST(CAST(host AS INT) % 6 AS VARCHAR) AS component FROM obs), size AS (SELECT component, count(*) AS size FROM member GROUP BY component)"

SQL = {
    "host_rollup": f"WITH {_OBS} SELECT host, round(min(ts), 9) AS first_seen, round(max(ts), 9) AS last_seen FROM obs GROUP BY host",
    "coverage": f"WITH {_OBS} SELECT host, day, event_type, count(*) AS n FROM obs GROUP BY ALL",
    "behavior_days": f"WITH {_OBS}{_DAYS} SELECT host, day, app, parent, location, n, round(first_seen, 9) AS first_seen, round(last_seen, 9) AS last_seen, sample FROM days",
    "behavior_days_capped": f"WITH {_OBS}{_DAYS} SELECT host, day, app, parent, location, n FROM (SELECT *, row_number() OVER (PARTITION BY host, day ORDER BY first_seen, app, parent, location) AS r FROM days) WHERE r <= 2",
    "distinct_estimates": f"WITH {_OBS}, {_registers('event_type', 'event_id', 'obs')} SELECT * FROM est",
    "sketch_merge": f"WITH {_OBS}, {_registers('host', 'app', 'obs')} SELECT * FROM est",
    "network_windows": f"""WITH {_OBS}, rows AS (SELECT *, CAST(floor(ts / 1800) * 1800 AS BIGINT) AS start FROM obs WHERE kind IS NOT NULL),
      {_registers('host, app, kind, start', 'k', 'rows')},
      firsts AS (SELECT host, app, kind, start, k, count(*) AS c, min((ts, event_id)) AS first_at FROM rows GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY host, app, kind, start ORDER BY first_at) AS r FROM firsts),
      agg AS (SELECT host, app, kind, start, CAST(sum(c) AS BIGINT) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS samples FROM ranked GROUP BY ALL)
      SELECT agg.*, distinct_estimate FROM agg JOIN est USING (host, app, kind, start)""",
    "references": f"WITH {_OBS}{_DAYS}, subject AS (SELECT DISTINCT host, day, app, parent, location FROM obs WHERE day = {LIVE_DAY}){_REFERENCES}",
    "references_all_days": f"WITH {_OBS}{_DAYS}, subject AS (SELECT DISTINCT host, day, app, parent, location FROM days){_REFERENCES}",
    "app_support": f"WITH {_OBS}{_DAYS}{_WINDOW} SELECT app, count(DISTINCT host) AS app_hosts FROM win GROUP BY app",
    "pattern_support": f"WITH {_OBS}{_DAYS}{_WINDOW} SELECT app, parent, location, count(DISTINCT host) AS pattern_hosts FROM win GROUP BY ALL",
    "fleet_hosts": f"WITH {_OBS}{_DAYS}{_WINDOW} SELECT count(DISTINCT host) AS fleet_hosts FROM win",
    "local_app_days": f"WITH {_OBS}{_DAYS}{_WINDOW} SELECT host, app, count(DISTINCT day) AS local_app_days FROM win GROUP BY ALL",
    "qualified_peers": f"WITH {_TEAM}{_DAYS}{_WINDOW} SELECT host, app, count(DISTINCT day) AS local_app_days FROM win GROUP BY ALL HAVING count(DISTINCT day) >= 7",
    "peer_evidence": f"""WITH {_TEAM}{_DAYS}{_WINDOW}, q AS (SELECT host, app FROM win GROUP BY ALL HAVING count(DISTINCT day) >= 7),
      shown AS (SELECT DISTINCT host, app, parent, location FROM win), subject AS (SELECT DISTINCT host, app, parent, location FROM days WHERE day = {LIVE_DAY})
      SELECT s.host, s.app, s.parent, s.location, count(*) AS peer_eligible, count(p.host) AS peer_seen
      FROM subject s JOIN q ON q.app = s.app AND q.host <> s.host AND CAST(q.host AS INT) % 6 = CAST(s.host AS INT) % 6
      LEFT JOIN shown p ON p.host = q.host AND p.app = s.app AND p.parent = s.parent AND p.location = s.location GROUP BY s.host, s.app, s.parent, s.location""",
    "dt01_novelty": f"WITH {_GATES} SELECT host, app, parent, location, gate AS category, fleet_hosts, app_hosts, pattern_hosts FROM gated WHERE gate IN ('rare_application', 'rare_launch_relationship')",
    "dt02_funnel": f"WITH {_GATES} SELECT gate, count(*) AS n FROM gated GROUP BY gate",
    "dt02_week": "SELECT gate, CAST(sum(n) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"(WITH {_GATES.replace(str(LIVE_DAY - 28), str(d - 28)).replace(str(LIVE_DAY), str(d))} SELECT gate, count(*) AS n FROM gated GROUP BY gate)" for d in range(LIVE_DAY - 6, LIVE_DAY + 1))
    + ") GROUP BY gate",
    "eligible_hosts": f"WITH {_TEAM}, h AS (SELECT host FROM obs GROUP BY host HAVING count(DISTINCT day) >= 7) SELECT host FROM h WHERE (SELECT count(*) FROM h) >= 40",
    "dt03_remote_execution": f"""WITH {_OBS}, x AS (SELECT event_id, host, ['powershell.exe', 'mshta.exe', 'notepad.exe', 'cmd.exe'][k % 4 + 1] AS app,
      ['x https://a.example/p', 'iex (Invoke-WebRequest HTTP://a.example)', 'start-process y', 'javascript:z http://b'][k % 7 % 4 + 1] AS command FROM obs)
      SELECT event_id, host, app, 'high' AS priority FROM x WHERE app <> 'notepad.exe' AND regexp_matches(lower(command), 'https?://')
        AND (app = 'mshta.exe' OR regexp_matches(lower(command), '\\biex\\b|invoke-expression|start-process|javascript:|vbscript:'))""",
    "dt04_outbound_from_new_context": f"WITH {_OUTBOUND} SELECT host, guid, app, parent, location, round(created, 9) AS created, round(network_ts, 9) AS network_ts FROM out",
    "dt04_peers": f"""WITH {_OUTBOUND}, hg AS (SELECT DISTINCT host, CAST(host AS INT) % 6 AS grp FROM obs), sh AS (SELECT grp, app, parent, location, count(DISTINCT host) AS seen FROM obs JOIN hg USING (host) GROUP BY ALL), sz AS (SELECT grp, count(*) AS eligible FROM hg GROUP BY grp)
      SELECT host, guid, app, parent, location FROM out WHERE NOT EXISTS (SELECT 1 FROM sh JOIN sz USING (grp) WHERE grp = CAST(out.host AS INT) % 6 AND sh.app = out.app AND sh.parent = out.parent AND sh.location = out.location
        AND eligible >= 3 AND seen / eligible >= 0.1)""",
    "global_ipv6": """WITH a AS (SELECT o_orderkey, ['2001:db8', '2620:0', 'fe80:1', 'fc00:2', '2001:4', '2001:20', '2400:cb00', '64:ff9b', '0:0', '2002:5'][o_orderkey % 10 + 1] AS f FROM orders)
      SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN f || '::' || lower(hex(o_orderkey)) WHEN 1 THEN f || ':0:0:0:0:0:' || lower(hex(o_orderkey)) ELSE f || ':::' || o_orderkey END AS address,
        o_orderkey % 3 <> 2 AND length(hex(o_orderkey)) <= 4 AND (f IN ('2620:0', '2400:cb00', '2001:20', '64:ff9b') OR (f = '0:0' AND o_orderkey > 1)) AS is_global FROM a""",
    "findings": f"WITH {_FOUND} SELECT host, detector, category, identity, round(first_seen, 9) AS first_seen, round(last_seen, 9) AS last_seen, occurrences, first_parent FROM found",
    "findings_unexpected": f"WITH {_FOUND} SELECT host, identity, occurrences FROM found WHERE NOT (CAST(host AS INT) % 3 = 0 AND CAST(host AS INT) % 2 <> 0)",
    "process_network": f"""WITH {_OBS}, c AS (SELECT host, k, min(ts) AS created FROM obs WHERE event_type = 'click' GROUP BY ALL)
      SELECT c.host, c.k, round(created, 9) AS created, round(min(o.ts), 9) AS network_ts, count(*) AS events FROM c JOIN obs o ON o.host = c.host AND o.k = c.k AND o.event_type = 'purchase' AND o.ts >= created
      GROUP BY c.host, c.k, created""",
    "admission": f"""WITH {_OBS} SELECT CASE WHEN ts < ({LIVE_DAY} - 14) * 86400 THEN 'outside_retention' WHEN ts > {CLOCK - 43200} + 300 THEN 'future' WHEN ts >= {CLOCK - 43200} - 86400 THEN 'live' ELSE 'historical' END AS admission,
      count(*) AS n FROM obs GROUP BY 1""",
    "unseen": f"""WITH {_OBS}, old AS (SELECT DISTINCT host, k FROM obs WHERE ts < {(LIVE_DAY - 15) * 86400})
      SELECT arg_min(event_id, (ts, event_id)) AS event_id, host, k FROM obs o WHERE ts >= {(LIVE_DAY - 15) * 86400} AND NOT EXISTS (SELECT 1 FROM old WHERE old.host = o.host AND old.k = o.k) GROUP BY host, k""",
    "queue_metrics": f"WITH {_BATCHES} SELECT lane, status, count(*) AS batches, CAST(sum(events - processed) AS BIGINT) AS pending, round({CLOCK} - min(collected_at), 3) AS oldest_age, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY ALL",
    "next_batches": f"""WITH {_BATCHES}, ready AS (SELECT * FROM b WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM b f WHERE f.status = 'failed' AND f.lane = b.lane AND f.shard = b.shard))
      SELECT shard, lane, batch_id FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY CASE lane WHEN 'live' THEN 0 ELSE 1 END, collected_at, batch_id) AS r FROM ready) WHERE r = 1""",
    "global_addresses": f"""WITH a AS (SELECT o_orderkey, o_orderkey % 256 AS p, (o_orderkey // 3) % 256 AS q, (o_orderkey // 5) % 256 AS r, o_orderkey % 300 AS s FROM orders),
      n AS (SELECT *, p * 16777216 + q * 65536 + r * 256 + s AS num FROM a)
      SELECT o_orderkey, concat_ws('.', p, q, r, s) AS address, s < 256 AND {_GLOBAL} AS is_global FROM n""",
    "prevalence": f"WITH {_TEAM}{_FEATURES} SELECT host, channel, feature, round(prevalence, 9) AS prevalence FROM prev",
    "bundles": f"WITH {_TEAM}{_FEATURES}{_BUNDLES} SELECT host, feature, round(prevalence, 9) AS prevalence FROM bundles",
    "document_frequency": f"WITH {_OBS}{_FEATURES} SELECT channel, feature, count(*) AS df FROM prev GROUP BY ALL",
    "feature_weights": f"WITH {_TEAM}{_FEATURES}{_BUNDLES}{_WEIGHTS} SELECT host, channel, feature, round(weight, 9) AS weight FROM w",
    "technical_vectors": f"WITH {_TEAM}{_FEATURES}{_TECH} SELECT host, feature, round(value, 9) AS value FROM tech",
    "technical_pairs": f"WITH {_TEAM}{_FEATURES}{_TECH}{_TECH_PAIRS} SELECT a, b, round(cosine, 9) AS cosine FROM tpair",
    "technical_clusters_alone": f"WITH RECURSIVE {_TEAM}{_FEATURES}{_TECH}{_TECH_PAIRS}{_CLUSTERS} SELECT component, size, round(cohesion, 9) AS cohesion FROM tcoh WHERE cohesion >= 0.68",
    "technical_clusters": f"""WITH RECURSIVE {_TEAM}{_FEATURES}{_BUNDLES}{_WEIGHTS}{_CANDIDATES}{_SCORED}{_COMPONENTS}{_GROUPS}{_TECH}{_TECH_PAIRS}{_CLUSTERS}
      SELECT component, size, round(cohesion, 9) AS cohesion FROM tcoh t WHERE cohesion >= 0.68 AND NOT EXISTS (
        SELECT 1 FROM tcomp x JOIN comp y ON y.host = x.host JOIN rec ON rec.component = y.component WHERE x.component = t.component GROUP BY y.component HAVING count(*) / t.size >= 0.80)""",
    "group_catalogue": f"""WITH {_TEAM}{_FEATURES}{_BUNDLES}{_WEIGHTS}{_TEAMS}, grp AS (SELECT * FROM size), gm AS (SELECT * FROM member){_CENTROIDS}{_EXPLAINED},
      fp AS (SELECT component, sha256('main' || chr(10) || string_agg(channel || ':' || feature, chr(10) ORDER BY r)) AS f FROM expl WHERE r <= 6 GROUP BY component),
      od AS (SELECT component, CAST(floor(median(observed_days)) AS INT) AS observed_days FROM hd JOIN member USING (host) GROUP BY component)
      SELECT component, substr(f, 1, 12) AS id, size, observed_days, CASE WHEN observed_days < 3 THEN 'provisional' WHEN observed_days < 7 THEN 'growing' ELSE 'stable' END AS maturity, round(overall, 3) AS cohesion,
        round(least(1, overall * least(1, greatest(1, observed_days) / 7) * least(1, size / 15)), 3) AS confidence,
        CASE greatest(applications, bundles, process, network, activity) WHEN applications THEN 'applications' WHEN bundles THEN 'bundles' WHEN process THEN 'process' WHEN network THEN 'network' ELSE 'activity' END AS dominant_channel
      FROM go JOIN fp USING (component) JOIN od USING (component)""",
    "suppressing_groups": """SELECT s_suppkey AS group_id, s_suppkey % 5 = 0 OR (s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0) AS suppressing FROM supplier""",
    "candidate_pairs": f"WITH {_TEAM}{_FEATURES}{_BUNDLES}{_WEIGHTS}{_CANDIDATES} SELECT a, b FROM cand",
    "peer_pairs": f"""WITH {_TEAM}{_FEATURES}{_BUNDLES}{_WEIGHTS}{_CANDIDATES}{_SCORED} SELECT a, b, round(applications, 9) AS applications, round(bundles, 9) AS bundles, round(process, 9) AS process,
      round(network, 9) AS network, round(activity, 9) AS activity, round(overall, 9) AS overall, shared_apps, eligible FROM elig""",
    "peer_components": f"WITH RECURSIVE {_TEAM}{_FEATURES}{_BUNDLES}{_WEIGHTS}{_CANDIDATES}{_SCORED}{_COMPONENTS} SELECT host, component FROM comp",
    "peer_groups": f"""WITH RECURSIVE {_TEAM}{_FEATURES}{_BUNDLES}{_WEIGHTS}{_CANDIDATES}{_SCORED}{_COMPONENTS}{_GROUPS}
      SELECT component, size, apps, round(applications, 9) AS applications, round(bundles, 9) AS bundles, round(process, 9) AS process, round(network, 9) AS network, round(activity, 9) AS activity, round(overall, 9) AS overall FROM rec""",
    "group_explanations": f"WITH {_TEAM}{_FEATURES}{_BUNDLES}{_TEAMS}{_EXPLAINED} SELECT component, channel, feature, label, round(score, 9) AS score, launched_by, network_kinds FROM expl",
    "group_centroids": f"WITH {_TEAM}{_FEATURES}{_TEAMS} SELECT component, channel, feature, round(sum(prevalence) / size, 9) AS value FROM prev JOIN member USING (host) JOIN size USING (component) GROUP BY component, channel, feature, size",
    "observed_day_bands": f"""WITH {_OBS}, hd AS (SELECT host, count(DISTINCT day) AS n FROM obs GROUP BY host)
      SELECT CASE WHEN n <= 2 THEN '1-2' WHEN n <= 6 THEN '3-6' WHEN n <= 13 THEN '7-13' ELSE '14+' END AS band, count(*) AS hosts, median(n) AS median_days FROM hd GROUP BY 1""",
    "strata": f"""WITH {_TEAM}{_FEATURES}, br AS (SELECT host, channel, count(*) FILTER (prevalence >= 0.2) AS n FROM prev WHERE channel IN ('applications', 'process', 'network', 'activity') GROUP BY ALL),
      s AS (SELECT channel, list_sort(list(n)) AS l FROM br GROUP BY channel), cut AS (SELECT channel, l[(len(l) - 1) // 3 + 1] AS low, l[2 * (len(l) - 1) // 3 + 1] AS high FROM s)
      SELECT channel, host, n, CASE WHEN n <= low THEN 'low' WHEN n <= high THEN 'middle' ELSE 'high' END AS band FROM br JOIN cut USING (channel)""",
    "cohort_seeds": f"WITH {_TEAM}{_FEATURES}, {_seeds('prev', 'total')} SELECT host, app, df FROM seed",
    "app_pairs": f"WITH {_TEAM}{_FEATURES}, {_seeds('prev', 'total')} SELECT first, second, members, round(lift, 9) AS lift, round(utility, 9) AS utility FROM best",
    "cohort_overlaps": f"WITH {_TEAM}{_FEATURES}, {_seeds('prev', 'total')} SELECT cohorts, count(*) AS hosts FROM (SELECT host, count(*) AS cohorts FROM member GROUP BY host) GROUP BY cohorts",
    "cohort_persistence": f"""WITH {_TEAM.replace(', obs AS (', ', allobs AS (')}, obs AS (SELECT * FROM allobs WHERE day BETWEEN {LIVE_DAY - 28} AND {LIVE_DAY - 8}), later AS (SELECT * FROM allobs WHERE day BETWEEN {LIVE_DAY - 7} AND {LIVE_DAY - 1})
      {_FEATURES}, {_seeds('prev', 'total')}, seenh AS (SELECT host FROM later GROUP BY host HAVING count(DISTINCT day) >= 3), shown AS (SELECT DISTINCT host, 'app:' || app AS app FROM later)
      SELECT *, observed >= 12 AND persistent >= 0.5 * observed AS holds FROM (SELECT first, second, count(*) AS members, count(s.host) AS observed, count(s.host) FILTER (EXISTS (SELECT 1 FROM shown x WHERE x.host = m.host AND x.app = m.first) AND EXISTS (SELECT 1 FROM shown x WHERE x.host = m.host AND x.app = m.second)) AS persistent
      FROM member m LEFT JOIN seenh s ON s.host = m.host GROUP BY first, second)""",
    "matched_controls": f"""WITH {_OBS}, b AS (SELECT host, CAST(host AS INT) % 6 AS grp, CAST(floor(log2(count(DISTINCT app) + 1)) AS INT) AS app_bin, CAST(greatest(0, floor((count(DISTINCT day) - 7) / 7)) AS INT) AS day_bin FROM obs GROUP BY host),
      c AS (SELECT m.host, m.grp, m.app_bin, m.day_bin,
          (SELECT count(*) FROM b WHERE b.grp <> m.grp AND b.app_bin = m.app_bin AND b.day_bin = m.day_bin) AS same,
          (SELECT count(*) FROM b WHERE b.grp <> m.grp AND abs(b.app_bin - m.app_bin) + abs(b.day_bin - m.day_bin) = 1) AS beside FROM b AS m)
      SELECT host, grp, app_bin, day_bin, same > 0 AS exact, CASE WHEN same > 0 THEN same ELSE beside END AS controls FROM c""",
    "cohort_pair_overlaps": f"""WITH {_TEAM}, m AS (SELECT DISTINCT host, app FROM obs), s AS (SELECT app, count(*) AS n FROM m GROUP BY app),
      p AS (SELECT x.app AS a, y.app AS b, count(*) AS c FROM m x JOIN m y ON x.host = y.host AND x.app < y.app GROUP BY ALL)
      SELECT a, b, round(c / (sa.n + sb.n - c), 9) AS overlap FROM p JOIN s sa ON sa.app = a JOIN s sb ON sb.app = b""",
    "best_groups": """WITH g AS (SELECT l_suppkey AS host, l_partkey % 40 AS grp, round(avg(l_quantity) / 100, 6) AS delta, count(*) AS pairs, count(DISTINCT l_orderkey) AS members FROM lineitem GROUP BY ALL)
      SELECT host, grp, delta, pairs, members FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY delta DESC, pairs DESC, members DESC, grp) AS r FROM g WHERE delta >= 0.1 AND members >= 3 AND pairs >= 5) WHERE r = 1""",
    "finding_families": f"WITH {_FAMILIES} SELECT detector, category, parent, location, shape, findings, hosts, variants, first_seen, last_seen, pattern, version_churn FROM fam",
    "finding_families_top": f"WITH {_FAMILIES} SELECT detector, category, parent, location, shape, findings, hosts FROM fam ORDER BY findings DESC, hosts DESC, detector, category, parent, location, shape LIMIT 30",
    "variant_examples": f"WITH {_TABLE} SELECT shape, name, findings, r FROM (SELECT shape, name, count(*) AS findings, row_number() OVER (PARTITION BY shape ORDER BY count(*) DESC, name) AS r FROM tab GROUP BY shape, name) WHERE r <= 8",
    "finding_search": f"WITH {_TABLE} SELECT event_id, host, image FROM tab WHERE event_type = 'signup' AND k % 8 = 3 AND k < 50",
    "inbox": f"WITH {_TABLE} SELECT event_id, priority, round(last_seen, 9) AS last_seen FROM (SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, last_seen DESC, event_id) AS r FROM tab) WHERE r <= 30",
    "findings_table_page": f"WITH {_TABLE} SELECT event_id, image FROM (SELECT *, row_number() OVER (ORDER BY lower(image), event_id) AS r FROM tab) WHERE r BETWEEN 101 AND 200",
    "finding_triggers": f"""WITH {_TABLE} SELECT event_id, CASE category WHEN 'rare_application' THEN 'Rare application (' || app_hosts || '/' || fleet_hosts || ' hosts)'
      ELSE 'Rare launch (' || pattern_hosts || '/' || app_hosts || ' app hosts)' END AS trigger FROM tab""",
    "csv_cells": "SELECT c_custkey, CASE WHEN c_custkey % 8 IN (0, 1, 2, 3, 6) THEN '''' ELSE '' END || substr('=+-@ab' || chr(9) || ' ', CAST(c_custkey % 8 + 1 AS INT), 1) || c_name AS cell FROM customer",
    "discover": f"""WITH {_OBS}{_DAYS}, g AS (SELECT host, app, parent, location, min(first_seen) AS f, max(last_seen) AS l, count(*) AS days, CAST(sum(n) AS BIGINT) AS n FROM days GROUP BY ALL)
      SELECT host, app, parent, location, round(f, 9) AS first_seen, round(l, 9) AS last_seen, days, n FROM g ORDER BY l DESC, host, app, parent, location LIMIT 100""",
    "endpoint_coverage": f"WITH {_OBS} SELECT host, event_type, count(DISTINCT day) AS days, count(*) AS n FROM obs GROUP BY ALL",
    "command_flags": """WITH t AS (SELECT page_id, substr(lower(html), 1, 32768) AS x FROM pages), f AS (
      SELECT page_id, regexp_matches(x, 'https?://') AS remote_reference, regexp_matches(x, '(?:^|\\s)-(?:e|en|enc|enco|encodedcommand)\\s+\\S+') AS encoded_argument,
        regexp_matches(x, 'downloadstring|downloadfile|invoke-webrequest|\\biwr\\b|\\bcurl(?:\\.exe)?\\b|start-bitstransfer') AS download_primitive,
        regexp_matches(x, '\\biex\\b|invoke-expression|start-process|javascript:|vbscript:') AS execution_primitive, contains(x, '&&') OR contains(x, '|') AS shell_chain FROM t)
      SELECT page_id, remote_reference, encoded_argument, download_primitive, execution_primitive OR (page_id % 2 = 0 AND remote_reference) AS execution_primitive, shell_chain FROM f""",
    "path_functions": """WITH p AS (SELECT p_partkey, p_partkey % 8 AS m, CASE WHEN p_partkey % 9 <> 0 THEN replace(p_name, ' ', '') || CAST(p_partkey % 40 AS VARCHAR) || '.7.EXE' ELSE '' END AS leaf FROM part),
      q AS (SELECT p_partkey, leaf, ['\\\\srv\\share\\', 'C:\\Temp\\', 'C:/Users/Ann B/Downloads/', 'C:\\Users\\bob\\', 'C:\\Windows\\System32\\', 'C:\\Program Files\\x\\', 'D:\\data\\', ''][m + 1] AS folder, m FROM p),
      s AS (SELECT *, lower(leaf) AS low, regexp_replace(lower(leaf), '\\.[^.]*$', '') AS stem FROM q)
      SELECT p_partkey, ['network-share', 'temporary', 'downloads', 'user-profile', 'windows', 'program-files', 'other', CASE WHEN leaf = '' THEN 'unknown' ELSE 'other' END][m + 1] AS location,
        CASE m WHEN 3 THEN 'C:\\Users\\<user>\\' ELSE folder END || leaf AS redacted, CASE WHEN leaf = '' THEN 'unknown' ELSE low END AS basename,
        CASE WHEN leaf = '' THEN NULL WHEN length(regexp_replace(stem, '[^\\p{L}]', '', 'g')) >= 5 THEN regexp_replace(stem, '[0-9]+', '{number}', 'g') || '.exe' ELSE low END AS shape FROM s""",
    "text_functions": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN '"' || c_name ELSE c_name END AS clean,
        CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey + 1700000000 AS DOUBLE) WHEN 1 THEN (c_custkey * 1000 + 1700000000500) / 1000 END AS epoch,
        CASE WHEN c_custkey % 2 = 0 THEN sha256(c_name) ELSE '' END AS sha256, CASE WHEN c_custkey % 2 = 0 THEN '0000abcd-0000-0000-0000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS guid,
        regexp_replace(regexp_replace(upper(c_mktsegment || ' - ' || c_name), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS symbol FROM customer""",
}
