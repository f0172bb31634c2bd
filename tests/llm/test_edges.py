"""All registered queries on empty tables and on tables with odd rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilframe.llm import entries

TABLES = {"documents": "doc_id", "labels": "doc_id", "pages": "page_id", "embeddings": "vec_id", "benchmark": "item_id"}
CLASHES = ["score", "kept", "slot", "size", "shard", "rank", "length", "piece", "offset", "component_id", "keep_id", "group_size", "text_digest", "held_out", "predicted", "found", "key", "block", "host", "page", "n", "mask", "part", "pos", "row", "step", "win"]
RESULTS = sorted([*entries.queries(), "pipeline"])


def query(name):
    return corpus_pipeline.run if name == "pipeline" else entries.queries()[name]


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """Two folders of tables: empty ones, and the first rows with nulls in each column, repeats and clashing columns."""
    top = tmp_path_factory.mktemp("tables")
    for name, key in TABLES.items():
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.limit(0).write.parquet(f"file:{top}/empty/{name}.parquet")
        some = rows.where(F.col(key) < (120 if name == "embeddings" else 60))
        nulls = [some.where(F.col(key) == 50).withColumn(c, F.lit(None).cast(rows.schema[c].dataType)) for c in rows.columns]
        for more in (*nulls, some.where(F.col(key).isin(0, 50))):
            some = some.unionByName(more)
        some.withColumns({c: F.lit("clash") for c in CLASHES if c not in rows.columns}).write.parquet(f"file:{top}/odd/{name}.parquet")
    return f"file:{top}"


@pytest.mark.parametrize("name", RESULTS)
def test_empty_tables(spark, folders, name):
    assert query(name)(spark, f"{folders}/empty").count() == 0


@pytest.mark.parametrize("name", RESULTS)
def test_odd_rows_and_clashing_columns(spark, folders, name):
    got = query(name)(spark, f"{folders}/odd")
    table = "pages" if name == "op1_html_text" else "embeddings" if name == "op2_nearest" else "documents"
    n = spark.read.parquet(f"{folders}/odd/{table}.parquet").count()
    rows = got.collect()
    if name in ("op2_nearest", "op11_hard_negatives", "op12_filter_audit", "pipeline"):
        assert rows
    elif name == "op6_packing":
        assert sum(r.piece == 0 for r in rows) == n
    else:
        assert len(rows) == n
