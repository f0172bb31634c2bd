"""The stages against brute force on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import ASCII, brute_components


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "1234 !!", None, None, 7)], docs.schema)
    before = docs.unionByName(extra).withColumn("kept", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        after.write.parquet(f"file:{tmp_path}/{name}")
        after = spark.read.parquet(f"file:{tmp_path}/{name}")
        old, new = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        kept[name] = (old, new)
        if name != "packing":
            assert after.columns == before.columns
        before = after
    old, new = kept["language_id"]
    assert old.keys() - new == {900_001, 900_002}
    old, new = kept["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(labels.get(k) == 1 for k in old.keys() - new) <= 0.02 * sum(labels.get(k) == 1 for k in old)
    old, new = kept["exact_dedup"]
    assert new == set({t.translate(ASCII): k for k, t in sorted(old.items())}.values())
    old, new = kept["near_dedup"]
    assert new == {k for k, c in brute_components(old, 5, 80)[0].items() if k == c}
    old, new = kept["packing"]
    assert new == old.keys()
