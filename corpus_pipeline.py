"""The training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Language ID and the quality classifier reject documents; of exact copies and of near-duplicates one document stays; the
rest is packed into token sequences. All stages but the last return the columns of ``documents``, whatever they are.
A null text counts as empty: it has no language, so the first stage rejects it. An empty table gives no sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import exact_dedup, language, minhash, packing, quality
from vigilframe.llm.common import materialize, table

#: A document stays if a language is found with at least this posterior, and if its quality is at least this.
LANGUAGE_SCORE, QUALITY_SCORE = 0.5, 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language is uncertain."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(model, F.col("text"))
    scored = docs.withColumn("__found", found)
    return scored.where((F.col("__found.lang_pred") != language.UNKNOWN) & (F.col("__found.score") >= LANGUAGE_SCORE)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, learned from ``labels``, predicts to be of low quality."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", quality.score(trees, F.col("text"))).where(F.col("__score") >= QUALITY_SCORE).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; the digests go through an index of this run."""
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", id_type=docs.schema["doc_id"].dataType.simpleString())
    kept = index.append(docs)
    index.drop()
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, similarity of 0.8 or more) the smallest id stays."""
    return minhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("packing", pack),
]

#: Learned models, signatures and tokenizers can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
