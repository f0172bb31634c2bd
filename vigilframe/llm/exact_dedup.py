"""Exact deduplication against a persistent digest index (operator 5, DataFrame operations only).

The index is a table bucketed and sorted by the SHA-256 of the normalised text: (text_digest, keep_id, group_size). Each
batch of rows is reduced to its groups, a group a row, and these are anti-joined with the index (a sort-merge join for
which the index is not shuffled). Groups that the index doesn't hold are appended as its new digests; of groups that it
holds, the batch's largest id and count are appended as further rows of the digest, so files are only ever added, and
``groups`` merges the rows of a digest within its bucket. ``compact`` writes them as one row and one file a bucket again.

Texts are equal when they are identical after lower-casing A-Z; null counts as empty.

Defined results: null and empty texts form one group; a null ``doc_id`` sorts below every other; rows that
repeat a whole document count in ``group_size`` and share their ``kept`` flag in ``assign`` (the flag speaks of a
doc_id), while ``DigestIndex.append`` and ``keep_one`` return exactly one row a group (of rows with one id, that whose
text is larger; of those, any); an empty table gives no rows; extra columns pass through ``keep_one`` and ``append``
unchanged, whatever they are called, and are ignored by ``assign``.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, table

#: A digest with more than 1/HOT_SHARE of all rows is joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 500
#: Batches in which ``assign`` loads its rows.
BATCHES = 2
SCHEMA = "text_digest binary, keep_id {id}, group_size long"


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased, in UTF-8."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lowered, 256))


class DigestIndex:
    """A catalog table (text_digest binary, keep_id, group_size), bucketed and sorted by ``text_digest``; made if it isn't
    there yet."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, id_type: str = "long"):
        self.spark, self.name, self.buckets = spark, name, buckets or partitions(spark)
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], SCHEMA.format(id=id_type)), name)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "text_digest").sortBy("text_digest").saveAsTable(name)

    def read(self) -> DataFrame:
        """All rows: one for each digest and batch that held it."""
        return self.spark.table(self.name)

    def groups(self) -> DataFrame:
        """One row for each digest: the largest id and the number of rows of all batches. Merged bucket by bucket."""
        return self.read().groupBy("text_digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def _known(self) -> DataFrame:
        return self.read().select("text_digest").hint("merge")

    def add(self, digests: DataFrame, id_col: str = "doc_id") -> None:
        """Adds a batch of (id_col, text_digest): its new digests, and what it says of those that the index holds.

        The groups are written first: the planner would put the joins below the aggregate, and so deal all rows of a group.
        """
        batch = digests.groupBy("text_digest").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        batch = materialize(batch, "exact-batch")
        fresh = batch.join(self._known(), "text_digest", "left_anti")
        again = batch.join(self._known(), "text_digest", "left_semi")
        self._write(fresh.unionByName(again).repartition(self.buckets, "text_digest"), self.name)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The documents of a batch whose texts the index hasn't seen, one of each group; the batch joins the index.

        The batch is reduced to one row a group on the map side before anything is shuffled, and the groups, dealt by
        digest as the index is, meet it without another shuffle.
        """
        fresh = materialize(_grouped(docs, id_col, text_col).join(self._known(), "text_digest", "left_anti"), "exact-fresh")
        if not self.read().isEmpty():
            again = docs.select(F.col(id_col).alias("keep_id"), digest(F.col(text_col)).alias("text_digest"))
            again = materialize(again.groupBy("text_digest").agg(F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-batch")
            again = materialize(again.join(self._known(), "text_digest", "left_semi"), "exact-again")
            self._write(again.repartition(self.buckets, "text_digest"), self.name)
        self._write(fresh.select("text_digest", "keep_id", "group_size").repartition(self.buckets, "text_digest"), self.name)
        return fresh.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

    def compact(self) -> None:
        """One row a digest and one sorted file a bucket. The new table is whole before the old one goes."""
        new = f"{self.name}_{uuid.uuid4().hex}"
        self._write(self.groups().repartition(self.buckets, "text_digest"), new)
        self.drop()
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text_digest, keep_id, group_size, row, seen): the groups of a batch, each with its row of the largest id. ``seen`` is
    any number: the planner puts no join below a column that depends on the order of rows, so it stays above the groups."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    largest = F.max_by(row, F.struct(F.col(id_col), F.col(text_col)))
    groups = docs.groupBy(digest(F.col(text_col)).alias("text_digest"))
    return groups.agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"), largest.alias("row")).withColumn("seen", F.monotonically_increasing_id())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, that with the largest id, with all its columns.

    The aggregate combines on the map side, so a group of copies of any size sends one row from each task.
    """
    return _grouped(docs, id_col, text_col).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def assign(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """For each document the group it falls in: id, keep_id, group_size, kept, text_sha256, as the index knows it after
    all of ``docs`` are loaded, together with what earlier batches held.

    Digests are computed once and written; the index takes them in ``batches`` parts by the id's hash, each anti-joined
    with those before it. Digests that hold more than 1/HOT_SHARE of ``docs`` (fewer than HOT_SHARE by count, so their
    broadcast is bounded) are joined without a shuffle; the rest goes through the bucketed sort-merge join.
    """
    digests = materialize(docs.select(F.col(id_col), digest(F.col(text_col)).alias("text_digest")), "digests")
    for b in range(batches):
        index.add(digests.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == b), id_col)
    limit = digests.count() // HOT_SHARE + 1
    hot = digests.groupBy("text_digest").count().where(F.col("count") > limit).select("text_digest")
    hot = index.groups().join(F.broadcast(hot), "text_digest").withColumnsRenamed({"keep_id": "__hot_keep", "group_size": "__hot_size"})
    marked = digests.join(F.broadcast(hot), "text_digest", "left")
    cold = marked.where(F.col("__hot_size").isNull()).drop("__hot_keep", "__hot_size").join(index.groups().hint("merge"), "text_digest")
    warm = marked.where(F.col("__hot_size").isNotNull()).withColumnsRenamed({"__hot_keep": "keep_id", "__hot_size": "group_size"})
    return cold.unionByName(warm).select(
        F.col(id_col),
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_digest")).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all ``documents``, loaded in two batches into an index that is dropped once the result is written."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    found = materialize(assign(table(spark, sf_dir, "documents"), index), "exact-groups")
    index.drop()
    return found


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
