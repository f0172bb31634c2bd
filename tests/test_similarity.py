"""Comparison cohorts: sampled pairs, overlap, controls, the choice of cohorts and pools; queries against DuckDB on a fleet large
enough for the fixed limits."""

import functools
import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import profiles as profiles_
from vigilframe.operators import similarity
from vigilframe.plans import cohort_queries

FLEET = "/root/testdata/sf0.01"
FEATURES = "host string, channel string, feature string, {} double"


def rows(df):
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def shared():
    """Steps that several queries begin with, run once."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("_strata", "_similar", "_validated"):
            patch.setattr(cohort_queries, name, functools.cache(getattr(cohort_queries, name)))
        yield


@pytest.mark.parametrize("name", sorted(cohort_queries.QUERIES))
def test_equal(spark, shared, name):
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{FLEET}/events.parquet'")
    got, want = cohort_queries.QUERIES[name](spark, FLEET).toPandas(), duck.sql(cohort_queries.SQL[name]).df()
    assert rows(got) == rows(want) and len(got)


def test_each_query_has_sql():
    assert set(cohort_queries.QUERIES) == set(cohort_queries.SQL)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 18, 19, 40, 160, 161, 162, 700])
def test_sampled_pairs(spark, n):
    members = spark.createDataFrame([("g", f"h{k:03d}") for k in range(n)] + [("one", "x")], "grp string, host string")
    got = similarity.sample_pairs(members, "seed").collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(pairs) == len(got) == min(160, n * (n - 1) // 2) and all(a < b for a, b in pairs)
    assert sorted(r.i for r in got) == list(range(len(got)))
    if n <= 18:
        assert pairs == set(itertools.combinations(sorted(f"h{k:03d}" for k in range(n)), 2))
    if n >= 161:
        assert len({h for p in pairs for h in p}) >= 150  # spread over many hosts


def test_overlap_of_empty_profiles(spark):
    features = spark.createDataFrame([("a", "process", "x", 1.0), ("a", "process", "y", 0.5), ("b", "process", "x", 0.5), ("b", "process", "z", 1.0), ("c", "network", "n", 1.0)], FEATURES.format("weight"))
    pairs = spark.createDataFrame([("g", 0, "a", "b"), ("g", 1, "a", "c"), ("g", 2, "c", "d"), ("g", 3, "d", "e")], "grp string, i int, a string, b string")
    got = {(r.i, r.channel): r.overlap for r in similarity.overlaps(pairs, features, ["grp", "i"]).collect()}
    assert got == {(0, "process"): pytest.approx(0.5 / 2.5), (1, "process"): 0.0, (1, "network"): 0.0, (2, "network"): 0.0}


def test_bands_never_split_equal_hosts(spark):
    def bands(values):
        df = spark.createDataFrame([(f"h{k}", "process", v) for k, v in enumerate(values)], "host string, channel string, n int")
        return {r.host: r.band for r in similarity.bands(df).collect()}

    assert bands([3] * 9) == {}
    two = bands([1] * 8 + [5])
    assert set(two.values()) == {"lower", "higher"} and two["h8"] == "higher"
    three = bands([1, 1, 2, 2, 3, 3, 9, 9, 9])
    assert [three[f"h{k}"] for k in range(9)] == ["lower"] * 4 + ["middle"] * 2 + ["higher"] * 3


def test_choice_of_proposals(spark):
    """In order of rank, without those that are alike with one chosen before; one that is left out keeps none out."""
    sets = {0: range(100), 1: range(5, 100), 2: range(50, 150), 3: range(12, 100), 4: range(200, 230), 5: range(200, 230)}
    members = spark.createDataFrame([(r, f"h{k:03d}") for r, s in sets.items() for k in s], "r int, host string")
    proposed = spark.createDataFrame([(r, len(s)) for r, s in sets.items()], "r int, members long")
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(x, y): jaccard(sets[x], sets[y]) for x in sets for y in sets if y < x and jaccard(sets[x], sets[y]) >= 0.85}
    assert {(r.r, r.earlier): pytest.approx(r.jaccard) for r in similarity.alike(members, proposed).collect()} == want
    taken = []
    for r in sets:
        if all(jaccard(sets[r], sets[t]) < 0.85 for t in taken):
            taken.append(r)
    assert similarity.chosen(proposed, members) == taken == [0, 2, 4]


def test_controls(spark):
    """One outside host of the subject's bucket, else of one beside it, else none; the same one each time."""
    rng = random.Random(4)
    hosts = {f"h{k:03d}": (rng.randrange(3), rng.randrange(2)) for k in range(120)} | {"far": (9, 9), "alone": (5, 0), "near": (6, 0)}
    buckets = spark.createDataFrame([(h, *b) for h, b in hosts.items()], "host string, app_bin int, day_bin int")
    groups = {"g": {h for h in hosts if h < "h040"} | {"far", "alone"}, "all0": {h for h, b in hosts.items() if b == (0, 0)}}
    members = spark.createDataFrame([(g, h) for g, s in groups.items() for h in s], "grp string, host string")
    asked = [(g, i, h) for g, s in groups.items() for i, h in enumerate(sorted(s))]
    got = {(r.grp, r.i): r.control for r in similarity.controls(spark.createDataFrame(asked, "grp string, i int, subject string"), members, buckets).collect()}
    for g, i, h in asked:
        outside = {x: b for x, b in hosts.items() if x not in groups[g]}
        same = {x for x, b in outside.items() if b == hosts[h]}
        beside = {x for x, b in outside.items() if abs(b[0] - hosts[h][0]) + abs(b[1] - hosts[h][1]) == 1}
        assert got.get((g, i)) in (same or beside or {None})
    assert len(set(got.values())) > 20  # spread over the buckets


def profiles(family, derived, seed=5):
    """100 hosts with two suite applications each in ``family``, and 100 others; ``derived``: what the suite starts is all
    they have in common."""
    rng = random.Random(seed)
    raw, weight, days = [], [], []
    for team in (family, "other"):
        for k in range(100):
            h = f"{team}{k:03d}"
            days.append((h, 14))
            apps = [f"{team}-a", f"{team}-b"] + [f"own{rng.randrange(10_000)}" for _ in range(3)]
            for a in apps:
                raw.append((h, "applications", f"app:{a}", 0.9))
                weight.append((h, "applications", f"app:{a}", 0.9))
            launches = [f"pc:{team}-a>{team}-b", f"pc:shell>{team}-a"] + ([] if derived else [f"pc:{team}-tool>{team}-helper"]) + [f"pc:shell{rng.randrange(9999)}>x{rng.randrange(9999)}"]
            weight += [(h, "process", p, 0.8) for p in launches]
            weight += [(h, "network", n, 0.8) for n in [f"net:{team}-a:ip", f"net:x{rng.randrange(9999)}:ip"]]
    return raw, weight, days


@pytest.mark.parametrize("derived, status", [(True, "exploratory"), (False, "supported")])
def test_what_the_seeds_bring_is_no_evidence(spark, derived, status):
    raw, weight, days = profiles("suite", derived)
    prevalence = spark.createDataFrame(raw, FEATURES.format("prevalence"))
    weighted, observed = spark.createDataFrame(weight, FEATURES.format("weight")), spark.createDataFrame(days, "host string, observed_days long")
    groups, members, found, rest = similarity.discover(prevalence, weighted, observed)
    got = {(r.first, r.second): r for r in groups.collect()}
    assert set(got) == {("suite-a", "suite-b"), ("other-a", "other-b")}
    for r in got.values():
        assert (r.size, r.status, r.unmasked_views) == (100, status, 2)
    sampled = rest.where("channel = 'process'").first()
    assert (sampled.sampled, sampled.matched) == (160, 160)
    best = similarity.best_supported(groups, members)
    assert best.count() == (0 if derived else 200)


def test_small_fleets_have_no_similarity_cohorts(spark):
    raw, weight, days = profiles("suite", False)
    some = lambda xs: [x for x in xs if int(x[0][-3:]) < 19]  # noqa: E731  38 hosts
    groups, members, found, rest = similarity.discover(spark.createDataFrame(some(raw), FEATURES.format("prevalence")), spark.createDataFrame(some(weight), FEATURES.format("weight")), spark.createDataFrame(some(days), "host string, observed_days long"))
    assert [df.count() for df in (groups, members, found, rest)] == [0, 0, 0, 0]
    assert {r.value for r in similarity.overlap_summary(members).collect()} == {0.0}


def test_preferred_pools(spark):
    """Each view of a host takes one pool; a stricter delta drops pools."""
    columns = "grp string, place int, training boolean, holds boolean, later long, process_within double, process_delta double, process_pairs long, network_within double, network_delta double, network_pairs long"
    rows_ = [("a", 1, True, True, 20, 0.5, 0.10, 30, 0.5, 0.3, 30), ("b", 2, True, True, 11, 0.5, 0.2, 30, 0.1, 0.9, 99), ("c", 3, True, True, 10, 0.9, 0.9, 90, 0.9, 0.9, 90), ("d", 4, False, True, 50, 0.9, 0.9, 90, 0.9, 0.9, 90), ("e", 5, True, True, 20, 0.5, 0.2, 23, None, None, 0)]
    later = spark.createDataFrame([(g, h) for g in "abcde" for h in ("h1", "h2")] + [("a", "h3")], "grp string, host string")
    found = similarity.preferred_pools(spark.createDataFrame(rows_, columns), later)
    got = {(r.minimum, r.channel, r.host): r.grp for r in found.collect()}
    assert got == {
        (0.08, "process", "h1"): "b", (0.08, "process", "h2"): "b", (0.08, "process", "h3"): "a", (0.08, "network", "h1"): "a", (0.08, "network", "h2"): "a", (0.08, "network", "h3"): "a",
        (0.12, "process", "h1"): "b", (0.12, "process", "h2"): "b", (0.12, "network", "h1"): "a", (0.12, "network", "h2"): "a", (0.12, "network", "h3"): "a",
    }
    summary = {r.minimum: r.asDict() for r in similarity.pool_summary(found).collect()}
    assert summary[0.08] == {"minimum": 0.08, "process_hosts": 3, "network_hosts": 3, "any_hosts": 3, "both_hosts": 3, "possible": 8, "pools": 2, "largest": 4}
    assert [r.any_hosts for r in similarity.pool_summary(found.limit(0)).collect()] == [0, 0]


def test_shown_days(spark):
    """Days on both sides of a word's bounds, before 1970 and null, against distinct counts; observations of one day are one bit."""
    days = [-65, -64, -1, 0, 63, 64, 19_723, 19_723, 19_775, 19_776, None]
    rows_ = [(h, None if d is None else d + k, f"a{(d or 0) % 3}", "p", "program-files", "ip", 3600.0 * k) for k, h in enumerate("xyz") for d in days] + [("none", None, "a0", "p", "windows", None, None)]
    obs = spark.createDataFrame(rows_, "host string, day int, app string, parent string, location string, kind string, ts double")
    shown = profiles_.shown_days(obs)
    assert shown.groupBy("host", "channel", "feature", "word").count().where("count > 1").count() == 0
    found = profiles_.features(obs)
    count = lambda df, *keys: {tuple(r)[:-1]: r[-1] for r in df.groupBy(*keys).agg(F.count_distinct("day")).collect()}
    assert {(r.host,): r.observed_days for r in profiles_.observed_days(shown).collect()} == count(obs, "host")
    each, total = count(found, "host", "channel", "feature"), count(obs, "host")
    seen = profiles_.shares(shown, profiles_.observed_days(shown)).where("host <> 'none'").collect()
    assert {(r.host, r.channel, r.feature): r.prevalence for r in seen} == {k: n / total[k[:1]] for k, n in each.items() if k[0] != "none"}


def test_profiles_store_what_is_shown(spark, monkeypatch):
    """No stored table grows with the observations of a host that does the same all day."""
    sizes, kept = [], cohort_queries.peers.kept
    monkeypatch.setattr(cohort_queries.peers, "kept", lambda df: sizes.append((stored := kept(df)).count()) or stored)
    obs = spark.range(2000).selectExpr("cast(id % 2 AS string) AS host", "cast(id % 3 AS int) AS day", "'a' AS app", "'p' AS parent", "'program-files' AS location", "'ip' AS kind", "0.0D AS ts")
    base, _, observed, hosts = cohort_queries._profile(obs)
    assert (hosts, observed.count(), base.count()) == (2, 2, 8) and sizes and max(sizes) <= 10


def test_features_of_one_host_are_not_joined(spark):
    rows_ = [(f"h{k}", "process", f, 0.5) for k in range(30) for f in ("common", f"own{k}", None)]
    prevalence = spark.createDataFrame(rows_, FEATURES.format("prevalence"))
    got = {(r.host, r.feature): r.weight for r in profiles_.weights(prevalence, 30).collect()}
    weight = lambda df: 0.5 * min(2.0, 0.25 + max(0.0, math.log(31 / (df + 1))))
    assert got == {(f"h{k}", f): pytest.approx(weight(df)) for k in range(30) for f, df in (("common", 30), (f"own{k}", 1))}
    assert "(df#" in (plan := profiles_.weights(prevalence, 30)._jdf.queryExecution().optimizedPlan().toString()) and "> 1)" in plan


def test_pairs_are_hashed_before_they_meet_slices(spark):
    buckets = spark.createDataFrame([(f"h{k}", 1, 0) for k in range(9)], "host string, app_bin int, day_bin int")
    asked, members = spark.createDataFrame([("g", 0, "h0")], "grp string, i int, subject string"), spark.createDataFrame([("g", "h0")], "grp string, host string")
    found = similarity.controls(asked, members, buckets)
    assert found.count() == 1 and "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_reads_the_days_of_compared_hosts(spark, monkeypatch):
    """Of earlier days only those of hosts that others are compared with are summarised."""
    asked, groups = [], []
    days, compared = cohort_queries.summaries.behavior_days, getattr(similarity, "compared", None)
    monkeypatch.setattr(cohort_queries.summaries, "behavior_days", lambda rows, cap: asked.append(rows) or days(rows, cap))
    monkeypatch.setattr(similarity, "compared", lambda *a: groups.append(compared(*a)) or groups[-1], raising=False)
    assert cohort_queries.cohort_evidence(spark, FLEET).count()
    hosts = lambda df: {r.host for r in df.select("host").distinct().collect()}
    earlier = set().union(*(hosts(rows.where(F.col("day") < cohort_queries.LIVE_DAY)) for rows in asked))
    assert groups and earlier == hosts(groups[0]) and len(earlier) < len(hosts(cohort_queries.suite_view(spark, FLEET)))
