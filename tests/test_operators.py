"""Behaviour of single operators on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import scalars
from vigilframe.operators import cohorts, correlation, novelty, peers, profiles, summaries, triage
from vigilframe.plans.policy import DEFAULT, Policy

OBS = "event_id long, host string, app string, parent string, location string, kind string, ts double, day int"


def obs(spark, rows):
    """Rows of (host, app, parent, location, day)."""
    return spark.createDataFrame([(k, h, a, p, l, None, d * 86400.0 + k, d) for k, (h, a, p, l, d) in enumerate(rows)], OBS)


def fleet(hosts=50, days=8):
    return [(f"h{h}", "common.exe", "explorer.exe", "program-files", 100 - d) for h in range(hosts) for d in range(1, days + 1)]


def gate(spark, rows, policy=DEFAULT):
    days = summaries.behavior_days(obs(spark, rows), 2000)
    live = obs(spark, [r for r in rows if r[4] == 100])
    return {(r.host, r.app, r.parent): (r.gate, r.fleet_hosts, r.app_hosts, r.observed_days, r.familiar_days) for r in novelty.gates(live, days, 100, policy).collect()}


def test_policy_bounds():
    assert DEFAULT.checked() is DEFAULT
    for wrong in ({"min_fleet_hosts": 5}, {"baseline_days": 91}, {"minimum_days": 28, "baseline_days": 7}):
        with pytest.raises(ValueError):
            Policy(**wrong).checked()


def test_today_never_counts_and_the_fleet_holds_the_subject(spark):
    subject = [("subject", "common.exe", "explorer.exe", "program-files", 100 - d) for d in range(1, 9)]
    got = gate(spark, fleet() + subject + [("subject", "rare.exe", "explorer.exe", "other", 100)] * 3)
    assert got == {("subject", "rare.exe", "explorer.exe"): ("rare_application", 51, 0, 8, 0)}


@pytest.mark.parametrize(
    "live, policy, want",
    [
        (("h1", "common.exe", "explorer.exe", "program-files", 100), DEFAULT, "locally_familiar_context"),
        (("h1", "common.exe", "word.exe", "other", 100), DEFAULT, "rare_launch_relationship"),
        (("h1", "common.exe", "unknown", "other", 100), DEFAULT, "not_rare_by_fleet_reference"),
        (("h1", "unknown", "word.exe", "other", 100), DEFAULT, "unknown_application"),
        (("new", "rare.exe", "word.exe", "other", 100), DEFAULT, "insufficient_local_history"),
        (("h1", "rare.exe", "word.exe", "other", 100), Policy(min_fleet_hosts=60), "insufficient_fleet_coverage"),
        (("h1", "rare.exe", "word.exe", "other", 100), Policy(behavioral_enabled=False), "detector_disabled"),
    ],
)
def test_gates_in_order(spark, live, policy, want):
    assert [g[0] for g in gate(spark, [*fleet(), live], policy).values()] == [want]


def test_one_finding_for_several_contexts_of_a_rare_application(spark):
    rows = fleet() + [("h1", "rare.exe", p, l, 100) for p, l in (("a.exe", "other"), ("b.exe", "other"), ("a.exe", "downloads"))]
    days, live = summaries.behavior_days(obs(spark, rows), 2000), obs(spark, rows).where("day = 100")
    found = novelty.findings(novelty.candidates(novelty.gates(live, days, 100, DEFAULT)), live)
    (r,) = found.collect()
    assert (r.identity, r.occurrences, r.evidence.parent, r.evidence.location) == ("application|rare.exe", 3, "a.exe", "other")
    expected = lambda **c: spark.createDataFrame([{"host": "h1", "detector": novelty.DETECTOR, "identity": "application|rare.exe", "created": 1.0, "expires": 9.0, "revoked": False} | c])
    assert novelty.suppress(found, expected(), 5.0).count() == 0
    for other in ({"revoked": True}, {"expires": 5.0}, {"created": 6.0}, {"host": "h2"}, {"identity": "application|other.exe"}):
        assert novelty.suppress(found, expected(**other), 5.0).count() == 1


def test_sketch_error_and_merge(spark):
    rows = spark.createDataFrame([(str(n), f"v{n}-{k}") for n in (0, 1, 5, 100, 900, 5000) for k in range(n)], "n string, v string")
    for r in summaries.estimates(summaries.registers(rows, ["n"], "v"), ["n"]).collect():
        assert abs(r.distinct_estimate - int(r.n)) <= 0.2 * int(r.n)


def test_network_before_a_start_is_not_attributed(spark):
    creates = spark.createDataFrame([("h", "a", 10.0), ("h", "b", 10.0), ("h", "c", 10.0)], "host string, guid string, created double")
    network = spark.createDataFrame([("h", "a", 9.0), ("h", "b", 10.0), ("h", "b", 12.0), ("other", "c", 11.0)], "host string, guid string, ts double")
    got = correlation.attribute_network(creates, network, ["host", "guid"]).collect()
    assert [(r.guid, r.network_ts, r.events) for r in got] == [("b", 10.0, 2)]


def test_global_addresses(spark):
    cases = {"8.8.8.8": True, "10.1.2.3": False, "172.15.0.1": True, "172.31.255.255": False, "192.168.0.1": False, "256.1.1.1": False, "1.2.3": False, "223.255.255.255": True, "224.0.0.1": False}
    got = spark.createDataFrame(list(cases.items()), "a string, want boolean").select("want", correlation.is_global_ipv4(F.col("a")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_open_findings_are_never_deleted(spark):
    rows = spark.createDataFrame([("open", None), ("old", 0.0), ("new", 95 * 86400.0)], "n string, closed double")
    assert {r.n for r in correlation.retained(rows, 100 * 86400.0, 90).collect()} == {"open", "new"}


def test_export_is_refused_not_cut(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1",), (" @x",), ("plain",)], "c string")
    assert sorted(r.c for r in triage.csv_cells(rows).collect()) == ["' @x", "'=1+1", "plain"]
    with pytest.raises(ValueError):
        triage.write_csv(rows, f"file:{tmp_path}/x", most=2)
    triage.write_csv(rows, f"file:{tmp_path}/y", most=3)
    assert spark.read.option("header", True).csv(f"file:{tmp_path}/y").count() == 3


def test_pages_of_all_orders_in_one_pass(spark):
    """As twelve sorts give them, nulls and ties included."""
    rng = random.Random(6)
    rows = [(f"i{k:03d}", rng.choice([None, 1.5, 2.5, 9.0]), rng.choice([None, "D1", "D2"]), *(rng.choice([None, "", "a", "B", "z"]) for _ in range(5))) for k in range(300)]
    table = spark.createDataFrame(rows, "id string, last_seen double, detector string, host_name string, parent string, image string, app string, category string").repartition(3)
    got = sorted(tuple(r) for r in triage.first_pages(table, 25).collect())
    want = [(c, down, r.id) for c in triage.ORDERS for down in (False, True) for r in triage.page(table, triage.order_by(c, down), 25).select("id").collect()]
    assert got == sorted(want) and len(got) == 300


def test_gates_of_several_days_in_one_pass(spark):
    rng = random.Random(2)
    rows = [(f"h{rng.randrange(12)}", rng.randrange(1, 40), rng.choice(["a.exe", "b.exe", "c.exe"]), rng.choice(["p.exe", "q.exe"]), rng.choice(["windows", "other"])) for _ in range(900)]
    days = spark.createDataFrame(rows, "host string, day int, app string, parent string, location string").distinct()
    policy = Policy(baseline_days=5, minimum_days=2, min_fleet_hosts=3, min_common_app_hosts=3)
    columns = ["host", "day", *novelty.PATTERN, "fleet_hosts", "app_hosts", "pattern_hosts", "gate"]
    got = sorted(map(tuple, novelty.gates_by_day(days, days, 3, 7, policy).select(columns).collect()))
    want = [tuple(r) for day in range(3, 8) for r in novelty.gates(days.where(F.col("day") == day), days, day, policy).select(columns).collect()]
    assert got == sorted(want) and len({r[-1] for r in got}) > 2


def test_versions_of_one_updater_are_a_family(spark):
    rows = [(f"h{k % 149}", novelty.DETECTOR, "rare_application", "p.exe", "other", f"C:\\x\\Fleet_Updater_9.18.{k % 8}.0.exe", float(k), float(k)) for k in range(442)]
    rows += [(f"h{k}", novelty.DETECTOR, "rare_application", "p.exe", "other", f"C:\\x\\a{k}.exe", 1.0, 1.0) for k in range(15)]
    table = spark.createDataFrame(rows, "host string, detector string, category string, parent string, location string, image string, first_seen double, last_seen double")
    (r,) = triage.families(table).collect()
    assert (r.findings, r.hosts, r.variants, r.pattern, r.version_churn) == (442, 149, 8, "fleet_updater_9.18.*.0.exe", True)


def test_short_names_have_no_shape(spark):
    got = spark.createDataFrame([("C:\\a1.exe",), ("C:\\abcde12.exe",), ("C:\\",), ("unknown",)], "i string").select(scalars.name_shape(F.col("i"))).collect()
    assert [r[0] for r in got] == ["a1.exe", "abcde{number}.exe", None, None]


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(f"{rng.randrange(40):02d}", f"{rng.randrange(40):02d}") for _ in range(25)] + [(f"x{k:02d}", f"x{k + 1:02d}") for k in range(30)]
    got = {r.host: r.component for r in peers.components(spark.createDataFrame(links, "a string, b string").where("a <> b")).collect()}
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        if x != y:
            up[y] = x
    assert got == {h: find(h) for a, b in links if a != b for h in (a, b)}


def test_two_teams_are_two_groups(spark):
    rows = [(f"{team}{h}", f"{team}-app{a}", f"{team}-svc", "program-files", 100 + d) for team in ("cad", "office") for h in range(3) for a in range(3) for d in range(5)]
    found, hosts = profiles.with_bundles(obs(spark, rows))
    weighted = profiles.weights(found, hosts)
    scored = peers.kept(peers.pair_scores(peers.candidate_pairs(weighted, hosts), weighted, hosts))
    assert scored.where("eligible").count() == 6
    got = {r.component: (r.size, r.apps) for r in peers.groups(peers.components(scored.where("eligible")), weighted, found, hosts).collect()}
    assert got == {"cad0": (3, 3), "office0": (3, 3)}


def test_equal_values_never_fall_into_two_bands(spark):
    values = [1] * 10 + [2] * 3 + [5] * 8
    breadths = spark.createDataFrame([(f"h{k}", "applications", n) for k, n in enumerate(values)], "host string, channel string, n long")
    bands = {}
    for r in cohorts.strata(breadths).collect():
        bands.setdefault(r.n, set()).add(r.band)
    ordered = sorted(values)
    low, high = ordered[(len(values) - 1) // 3], ordered[2 * (len(values) - 1) // 3]
    assert bands == {n: {"low" if n <= low else "middle" if n <= high else "high"} for n in set(values)}


def test_addresses_as_the_standard_library_sees_them(spark):
    """Whole and shortened IPv6 addresses in and around all special ranges, and text that is none."""
    import ipaddress
    import random

    from vigilframe.operators import correlation

    rng, texts = random.Random(6), ["", "::", "::1", "::2", ":::", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::ffff:1:2", None]
    for first in ("2001:0", "2001:1ff", "2001:200", "2001:db8", "2001:1", "2001:3", "2001:4:112", "2001:20", "2001:30", "2001:40", "2002", "2620", "64:ff9b:1", "64:ff9b:2", "100", "fc00", "fdff", "fe80", "febf", "fec0", "ff02"):
        for _ in range(6):
            tail = ":".join(f"{rng.choice([0, 0, 1, rng.randrange(1 << 16)]):x}" for _ in range(8 - first.count(":") - 1))
            whole = ipaddress.ip_address(f"{first}:{tail}")
            texts += [str(whole), whole.exploded.upper()]
    texts += [str(ipaddress.ip_address(rng.randrange(1 << 32))) for _ in range(40)]

    def wanted(text):
        try:
            return ipaddress.ip_address(text).is_global
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in texts], "a string").repartition(1).select("a", correlation.is_global(F.col("a")).alias("g")).collect()
    assert {r.a: r.g for r in rows if not (r.a or "").startswith("22")} == {t: wanted(t or "") for t in texts if not (t or "").startswith("22")}


def test_globs_as_the_standard_library_sees_them(spark):
    import fnmatch

    from vigilframe.functions import scalars

    names, globs = ["abc", "a.c", "a]c", "ABC", "a\nc", "", "ab", "a-c", "a\\c"], ["a*", "a?c", "a[!b]c", "a[]]c", "a[b-d]*", "*", "a[", "a.c", "[a-c][a-c]", "a\\c"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", *[scalars.matches_glob(F.col("n"), g).alias(str(k)) for k, g in enumerate(globs)]).collect()
    assert [[r[str(k)] for k in range(len(globs))] for r in rows] == [[fnmatch.fnmatchcase(r.n, g) for g in globs] for r in rows]
