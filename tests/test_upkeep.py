"""Domains, incomplete references, staged batches, retention and roll-ups; queries against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilframe.functions import domains
from vigilframe.operators import novelty, retention, triage
from vigilframe.plans import upkeep_queries
from vigilframe.plans.policy import DEFAULT, Policy
from vigilframe.sources import staged

FLEET = "/root/testdata/sf0.01"
DAY = 86400.0


def rows(df):
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(upkeep_queries.QUERIES))
def test_equal(spark, name):
    duck = duckdb.connect()
    for t in ("events", "orders", "pages"):
        duck.sql(f"create view {t} as select * from '{FLEET}/{t}.parquet'")
    got, want = upkeep_queries.QUERIES[name](spark, FLEET).toPandas(), duck.sql(upkeep_queries.SQL[name]).df()
    assert rows(got) == rows(want) and len(got)


def test_each_query_has_sql():
    assert set(upkeep_queries.QUERIES) == set(upkeep_queries.SQL)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_registrable_domains(spark, monkeypatch, sent):
    monkeypatch.setattr(domains, "BROADCAST", sent)
    rules = spark.createDataFrame([(r,) for r in ("com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "github.io", " ", None)], "rule string")
    want = {
        "example.com": "example.com", "a.b.example.com": "example.com", "COM": "com", "b.example.co.uk": "example.co.uk", "co.uk": "co.uk", "uk": "uk", "WWW.Example.Com.": "example.com", "a.test.ck": "a.test.ck", "b.a.test.ck": "a.test.ck",
        "test.ck": "test.ck", "www.ck": "www.ck", "x.www.ck": "www.ck", "city.kawasaki.jp": "city.kawasaki.jp", "a.city.kawasaki.jp": "city.kawasaki.jp", "x.y.kawasaki.jp": "x.y.kawasaki.jp", "me.github.io": "me.github.io", "a.me.github.io": "me.github.io",
        "io": "io", "host.local": "host.local", "8.8.8.8": "8.8.8.8", "": "", None: None, "a..com": "com",
    }
    want["a..com"] = ".com"  # an empty label is a label
    got = {r.domain: r.registrable for r in domains.registrable(spark.createDataFrame([(n,) for n in [*want, *want]], "domain string"), rules).collect()}
    assert got == want


@pytest.mark.parametrize("baseline", [7, 28])
def test_incomplete_references(spark, baseline):
    """Against every pair of a window and an interval."""
    rng = random.Random(baseline)
    policy = Policy(baseline_days=baseline, minimum_days=2)
    backlog = [(rng.randrange(6), a, a + rng.choice([0, 0, 1, 3, 40, -1])) for a in (rng.randrange(-50, 200) for _ in range(25))]
    subjects = [(s, day) for s in range(7) for day in range(-20, 160)]
    got = {(r.source, r.day): r.historical_reference_incomplete for r in novelty.incomplete(spark.createDataFrame(subjects, "source int, day int"), spark.createDataFrame(backlog, "source int, first_day int, last_day int"), policy).collect()}
    want = {(s, d): any(x == s and a <= b and b >= d - baseline and a <= d - 1 for x, a, b in backlog) for s, d in subjects}
    assert got == want and len(set(want.values())) == 2


EVENT = "host string, n long"


def batches(spark, count=40, most=3):
    df = spark.createDataFrame([(f"h{k % 5}", k, "live" if k % 4 else "backfill", k % 2) for k in range(count)], EVENT + ", lane string, shard int")
    return staged.stage(df, ["lane", "shard"], ["n"], most)


def test_staged_batches_are_bounded_and_in_order(spark):
    found = batches(spark).collect()
    assert max(r.event_count for r in found) <= 3 and sum(r.event_count for r in found) == 40 and len({r.batch for r in found}) == len(found)
    got = staged.decode(spark.createDataFrame(found), EVENT).collect()
    assert sorted(r.n for r in got) == list(range(40))
    for b in {r.batch for r in got}:
        own = [r.n for r in sorted((r for r in got if r.batch == b), key=lambda r: r.offset)]
        assert own == sorted(own)


def test_a_changed_batch_is_refused_and_the_rest_lands_once(spark, tmp_path):
    found = batches(spark)
    broken = found.select("batch").orderBy("batch").first().batch
    changed = found.withColumn("payload", F.when(F.col("batch") == broken, F.replace("payload", F.lit("h"), F.lit("secret"))).otherwise(F.col("payload")))
    lost = found.where(F.col("batch") == broken).first().event_count
    for _ in range(2):  # a run that is repeated overwrites itself
        staged.land(changed, f"file:{tmp_path}/out", f"file:{tmp_path}/ledger", EVENT, 1)
    ledger = spark.read.parquet(f"file:{tmp_path}/ledger")
    assert spark.read.parquet(f"file:{tmp_path}/out").count() == 40 - lost
    (failed,) = staged.failures(staged.committed(changed, ledger), 5.0).collect()
    assert (failed.batch, failed.reason, failed.cursor_before_failure) == (broken, "wrong_digest", 0) and "secret" not in repr(failed)
    # once it is whole again only its records are left
    left = staged.committed(found, ledger)
    assert [r.batch for r in left.collect()] == [broken]
    staged.land(left, f"file:{tmp_path}/out", f"file:{tmp_path}/ledger", EVENT, 2)
    assert sorted(r.n for r in spark.read.parquet(f"file:{tmp_path}/out").collect()) == list(range(40))


def test_decoding_resumes_at_the_committed_offset(spark):
    one = spark.createDataFrame([batches(spark, 200, 100).where("event_count > 4").first()])
    ledger = one.select("batch", F.lit(3).cast("long").alias("upto")).unionByName(one.select("batch", F.lit(1).cast("long").alias("upto")))
    got = staged.decode(staged.committed(one, ledger), EVENT).collect()
    assert min(r.offset for r in got) == 3 and len(got) == one.first().event_count - 3


def test_retention_of_landed_days(spark, tmp_path):
    clock = 100 * DAY + 5
    obs = spark.createDataFrame([(f"h{k % 3}", day, k) for day in range(60, 101) for k in range(4)], "host string, day int, n int")
    path = f"file:{tmp_path}/days"
    retention.store_days(obs, path)
    retention.store_days(obs.where("day = 99").limit(1), path)  # a day that arrives again replaces itself alone
    assert retention.drop_days(spark, path, clock, DEFAULT) == list(range(60, 72))
    left = spark.read.parquet(path)
    assert left.agg(F.min("day"), F.max("day"), F.count(F.lit(1))).first() == (72, 100, 28 * 4 + 1)
    assert retention.keep(obs, "behavior_days", clock, DEFAULT).select("day").distinct().count() == 29
    assert retention.drop_days(spark, path, clock, DEFAULT) == []


def test_open_and_unfinished_rows_stay(spark):
    clock = 1000 * DAY
    some = lambda column, values: spark.createDataFrame([(v,) for v in values], f"{column} double")
    left = lambda table, df: [r[0] for r in retention.keep(df, table, clock, DEFAULT).collect()]
    assert left("findings", some("closed", [None, 0.0, clock])) == [None, clock]
    assert left("jobs", some("finished", [0.0, DAY, clock])) == [0.0, clock]
    batches_ = spark.createDataFrame([("pending", 0.0), ("failed", 0.0), ("done", 0.0), ("done", clock)], "status string, finished double")
    assert sorted(r.status for r in retention.keep(batches_, "staged_batches", clock, DEFAULT).collect()) == ["done", "failed", "pending"]
    with pytest.raises(ValueError):
        retention.expired("unknown", clock, DEFAULT)


def test_retirement(spark):
    findings = spark.createDataFrame([("DS-NET-001",), ("DS-EXEC-001",), (None,)], "detector string")
    left, expected, policy = retention.retire(findings, findings.limit(0), Policy(execution_enabled=True, contextual_enabled=True))
    assert sorted(map(str, (r.detector for r in left.collect()))) == ["DS-EXEC-001", "None"] and expected.count() == 0
    assert not policy.execution_enabled and not policy.contextual_enabled and policy.behavioral_enabled
    assert {tuple(r) for r in retention.retirement(findings, findings).collect()} == {("findings", 1, 2), ("expectations", 1, 2)}


def test_rollup_reads_its_findings_once(spark, capsys):
    table = spark.createDataFrame([("a", "d", "x"), ("a", "d", "y"), ("b", "e", "x")], "host string, detector string, priority string")
    found = triage.rollup(table, [["detector", "priority"], ["detector"], []])
    assert sorted(map(tuple, found.where("level > 0").collect()), key=repr) == [("d", None, 1, 2, 1), ("e", None, 1, 1, 1), (None, None, 2, 3, 2)]
    found.explain()
    assert capsys.readouterr().out.count("Scan") == 1
