"""The registry of groups over two runs, the catalogue, profiles by namespace; queries against DuckDB."""

import functools

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import peers, profiles, registry
from vigilframe.plans import registry_queries

FLEET = "/root/testdata/sf0.01"
GROUP = "fingerprint string, id string, namespace string, suitability string, maturity string, partial boolean, size long"


def rows(df):
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def shared():
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(registry_queries, "_twice", functools.cache(registry_queries._twice))
        yield


@pytest.mark.parametrize("name", sorted(registry_queries.QUERIES))
def test_equal(spark, shared, name):
    duck = duckdb.connect()
    for t in ("events", "lineitem", "supplier"):
        duck.sql(f"create view {t} as select * from '{FLEET}/{t}.parquet'")
    got, want = registry_queries.QUERIES[name](spark, FLEET).toPandas(), duck.sql(registry_queries.SQL[name]).df()
    assert rows(got) == rows(want) and len(got)


def test_each_query_has_sql():
    assert set(registry_queries.QUERIES) == set(registry_queries.SQL)


@pytest.mark.parametrize("label", ["", "unassigned", "Unassigned ", "a b", "x" * 81, "ä"])
def test_labels_are_refused(label):
    with pytest.raises(ValueError):
        registry.slug(label)


def run(spark, groups):
    """groups: (mark, suitability, hosts) of namespace n."""
    table = spark.createDataFrame([(m, m[:12], "n", s, "stable", False, len(h)) for m, s, h in groups], GROUP)
    return table, spark.createDataFrame([(m, x) for m, _, h in groups for x in h], "fingerprint string, host string")


def state(cohorts):
    return {r.host: r.cohort for r in cohorts.where("namespace = 'n'").collect()}


def test_two_runs(spark):
    """Approved groups keep their hosts up to date; what people decided stays; rejected groups aren't suggested again."""
    cohorts = spark.createDataFrame([(h, "n", "mine" if h == "m" else "unassigned") for h in "abcdefm"] + [("a", "other", "unassigned")], "host string, namespace string, cohort string")
    known, rejected = spark.createDataFrame([], registry.REGISTRY), spark.createDataFrame([], "fingerprint string, at double")
    groups, members = run(spark, [("one", "recommended", "abm"), ("two", "technical", "cd"), ("bad", "technical", "ef")])
    known, cohorts, left = registry.approve(known, cohorts, groups, members, "one", " Team-1 ", "ann", 1.0)
    known, cohorts, left = registry.approve(known, cohorts, left, members, "two", "team-2", "ann", 1.0)
    rejected, left = registry.reject(rejected, left, "bad", 1.0)
    assert left.count() == 0 and state(cohorts) == {"a": "team-1", "b": "team-1", "c": "team-2", "d": "team-2", "e": "unassigned", "f": "unassigned", "m": "mine"}
    assert cohorts.where("namespace = 'other'").first().cohort == "unassigned"
    for wrong in ("gone", "one"):
        with pytest.raises(ValueError):
            registry.approve(known, cohorts, left, members, wrong, "x", "ann", 1.0)
    groups, members = run(spark, [("one", "recommended", "acem"), ("two", "technical", "ce"), ("bad", "technical", "ef"), ("new", "recommended", "bf")])
    known, cohorts, left = map(peers.kept, registry.refresh(known, rejected, cohorts, groups, members, 2.0))
    # c and e are in both approved groups: the technical one comes last; b and d left their groups
    assert state(cohorts) == {"a": "team-1", "b": "unassigned", "c": "team-2", "d": "unassigned", "e": "team-2", "f": "unassigned", "m": "mine"}
    assert [r.id for r in left.collect()] == ["new"]
    assert {r.label: (r.size, r.updated_at, r.actor) for r in known.collect()} == {"team-1": (4, 2.0, "ann"), "team-2": (2, 2.0, "ann")}
    again, after, _ = registry.refresh(known, rejected, cohorts, groups.limit(0), members.limit(0), 3.0)
    assert state(after) == state(cohorts) and sorted(map(tuple, again.collect())) == sorted(map(tuple, known.collect()))


def test_groups_made_by_hand(spark):
    cohorts = spark.createDataFrame([("a", "n", "unassigned"), ("b", "n", "legacy")], "host string, namespace string, cohort string")
    known = registry.create(spark.createDataFrame([], registry.REGISTRY), "Desk", "ann", 1.0)
    with pytest.raises(ValueError):
        registry.create(known, "desk", "ann", 2.0)
    groups, members = run(spark, [("one", "recommended", "ab")])
    for taken in ("desk", "legacy"):
        with pytest.raises(ValueError):
            registry.approve(known, cohorts, groups, members, "one", taken, "ann", 1.0)
    hosts = cohorts.where("host = 'a'")
    moved = registry.assign(cohorts, known, hosts, "desk")
    assert state(moved) == {"a": "desk", "b": "legacy"} and state(registry.assign(moved, known, hosts, "unassigned")) == state(cohorts)
    with pytest.raises(ValueError):
        registry.assign(cohorts, known, hosts, "nowhere")
    assert {r.label: r.suppressing for r in registry.suppressing(known, cohorts).collect()} == {"desk": True, "legacy": True}


def test_rejections_are_bounded(spark):
    rejected = spark.createDataFrame([(f"f{k:03d}", float(k)) for k in range(500)], "fingerprint string, at double")
    groups, _ = run(spark, [("new", "technical", "ab")])
    kept, _ = registry.reject(rejected, groups, "new", 1000.0)
    names = {r.fingerprint for r in kept.collect()}
    assert len(names) == 500 and "new" in names and "f000" not in names


def test_days_of_profiles(spark):
    obs = spark.createDataFrame([("a", 100), ("a", 99), ("b", 100), ("c", 60), ("c", 100), ("d", 60)], "namespace string, day int")
    got = {r.namespace: (r.first_day, r.last_day, r.partial) for r in profiles.profile_days(obs, 100).collect()}
    assert got == {"a": (73, 99, False), "b": (73, 100, True), "c": (73, 100, True)}
    for first, last in ((71, 80), (90, 100), (95, 90)):
        with pytest.raises(ValueError):
            profiles.explicit_days(obs, first, last, 100)
    assert profiles.explicit_days(obs, 72, 99, 100).where(F.col("partial")).count() == 0


def test_namespaces_are_no_shuffle_keys(spark, sf_dir):
    import re

    from vigilframe.plans import registry_queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry_queries.namespace_weights(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [namespace#" in plan and not re.search(r"SortMergeJoin \[namespace#\d+\],", plan), plan
