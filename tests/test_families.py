"""The families of findings are found in one pass over the store."""

from vigilframe.operators import lifecycle
from vigilframe.plans import finding_queries


def test_a_review_signs_each_finding_once(spark, sf_dir):
    rows = finding_queries._real(spark, sf_dir)
    asked = spark.createDataFrame([("none", 7)], "signature string, suppress_days int")
    after = lifecycle.review(rows, asked, finding_queries.CLOCK)[1]
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and plan.count("parquet") == 1, plan


def test_a_review_keeps_what_is_stored(spark, sf_dir):
    rows = finding_queries._real(spark, sf_dir)
    asked = lifecycle.families(rows).select("signature").withColumn("suppress_days", lifecycle.F.lit(0))
    after = lifecycle.review(rows, asked, finding_queries.CLOCK)[1]
    assert after.columns == [*rows.columns, "changed"] and after.where("changed").count() > 0
    same = [c for c in rows.columns if c not in ("state", "closed")]
    assert after.select(same).exceptAll(rows.select(same)).count() == 0 and after.count() == rows.count()
