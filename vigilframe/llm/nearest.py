"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes (operator 2).

Fit: several rotations are learned by iterative quantisation on a bounded sample; a vector's code holds the signs of its
rotated coordinates. Two radii are learned on the true neighbours of the sample (in all data the neighbours are nearer, so
the share found is larger). The probing radius is the smallest at which the tables below retrieve ``PROBED`` of them: a
neighbour needs to be near in one substring only, so this radius is far shorter than the distance of the whole codes. Of what
is retrieved, codes within the distance that ``COVERED`` of the neighbours keep to are reranked.

Search: rows and queries meet in blocks of bounded size, dealt by Spark; neither goes through the driver. In a block the
codes are split into substrings of about log2(rows) bits, each with a table from its value to the rows that have it. By
the pigeonhole principle a code within the probing radius is near the query's in some substring: the values within a
substring's share of the radius are enumerated by flipping bits, in order of their number, and looked up, which retrieves
every such code and more; candidates are checked on the whole code and reranked by the cosine of the original vectors in
double precision. Queries that find fewer than k in all blocks are asked again with longer radii, in the end with all bits.
So the answer depends neither on the number of blocks nor on what else is asked. ``retrieved`` tells what share of the rows
the tables and the radius let through.

Defined results: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite
components take no part, nor do rows with a null id; a query never finds rows of its own id; ties go to the smaller id;
of rows that repeat an id the nearest counts, of queries that repeat one the smallest vector; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table

SAMPLE, SAMPLE_QUERIES = 16_384, 512
ROTATIONS, STEPS = 4, 15
COVERED, PROBED = 0.99, 0.96
#: Rows and queries of a block, at most (but for chance: both are dealt by hash).
BLOCK, QUERIES = 32_768, 8_192
#: Bits of a substring, at least and at most.
SHORTEST, LONGEST = 8, 16


def valid(ids: pa.Array, vectors: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors in double precision) of the rows that take part."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    if length is None:
        length = int(np.bincount(sizes[sizes > 0]).argmax()) if (sizes > 0).any() else 0
    take = np.flatnonzero((sizes == length) & ~np.asarray(pc.is_null(ids))) if length else np.zeros(0, int)
    chosen = vectors.take(pa.array(take)).flatten()
    x = np.asarray(pc.fill_null(chosen.cast(pa.float64()), float("nan"))).reshape(len(take), max(length, 1))
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return np.asarray(ids.take(pa.array(take[ok]))), x[ok]


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class Codes:
    """Learned rotations, the radius, and the bits in which the sample's neighbours differ."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 5):
        rng = np.random.Generator(np.random.Philox(seed))
        n, d = sample.shape
        unit = sample / norms(sample)[:, None] if n else sample
        self.mean = unit.mean(axis=0) if n else np.zeros(d)
        centred, self.rotations = unit - self.mean, []
        for _ in range(ROTATIONS):
            r = np.linalg.qr(rng.standard_normal((d, d)))[0]
            for _ in range(STEPS if n > 1 else 0):
                u, _, v = np.linalg.svd(np.sign(centred @ r).T @ centred)
                r = (u @ v).T
            self.rotations.append(r)
        self.bits = ROTATIONS * d
        self.apart = self._apart(sample, k)
        self.radius = int(np.quantile(self.apart.sum(axis=1), COVERED)) if len(self.apart) else self.bits

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bits."""
        unit = x / norms(x)[:, None] - self.mean
        return np.concatenate([unit @ r > 0 for r in self.rotations], axis=1)

    def _apart(self, sample: np.ndarray, k: int) -> np.ndarray:
        """For each of the k neighbours of some rows of the sample, the bits in which the codes differ."""
        if len(sample) <= 2 * k:
            return np.zeros((0, self.bits), bool)
        unit, codes, apart = sample / norms(sample)[:, None], self.encode(sample), []
        for q in range(min(SAMPLE_QUERIES, len(sample))):
            s = unit @ unit[q]
            s[q] = -2
            apart.append(codes[np.argpartition(-s, k)[:k]] ^ codes[q])
        return np.concatenate(apart)

    def probing(self, length: int) -> int:
        """The smallest radius at which tables of substrings of ``length`` bits retrieve PROBED of the neighbours."""
        if not len(self.apart):
            return self.bits
        flips = pieces(self.apart, length).sum(axis=2)
        tables = flips.shape[1]
        return int(np.quantile((flips * tables + np.arange(tables)).min(axis=1), PROBED, method="higher"))


def pieces(bits: np.ndarray, length: int) -> np.ndarray:
    """Bits by substring, the last one filled up with zeros (rows x substrings x length)."""
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % length))).reshape(len(bits), -1, length)


def substring(rows: int) -> int:
    """Bits of a substring for a table of so many rows."""
    return min(LONGEST, max(SHORTEST, int(np.log2(max(rows, 1)))))


class Index:
    """Codes of a block, each substring indexed by its values."""

    def __init__(self, bits: np.ndarray, length: int | None = None):
        self.length = length or substring(len(bits))
        self.words, self.tables = words(bits), []
        for values in self.substrings(bits).T:
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.searchsorted(values[order], np.arange((1 << self.length) + 1))))
        flips = np.arange(1 << self.length)
        weight = np.bitwise_count(flips)
        self.flips = flips[np.argsort(weight, kind="stable")]
        self.ball = np.cumsum(np.bincount(weight, minlength=self.length + 1))  # values within so many flips

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """Values of the substrings (rows x substrings)."""
        return pieces(bits, self.length) @ (1 << np.arange(self.length))

    def within(self, values: np.ndarray, code: np.ndarray, radius: int, kept: int = 0) -> tuple[np.ndarray, int]:
        """(all rows whose codes differ from ``code`` in at most ``radius`` bits, and those within ``kept`` bits that the
        same tables give; the number of rows that were looked at). values: the code's substrings."""
        share, rest = divmod(radius, len(self.tables))
        met = np.zeros(len(self.words), bool)
        for s, (order, first) in enumerate(self.tables):
            allowed = share if s <= rest else share - 1  # else the substrings' distances would sum up to more than radius
            if allowed < 0:
                continue
            probed = self.flips[: self.ball[min(allowed, self.length)]] ^ values[s]
            at = first[probed]
            n = first[probed + 1] - at
            met[order[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.words[rows] ^ code).sum(axis=1) <= max(radius, kept)], len(rows)


def words(bits: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words, filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _search(model: Codes, length: int, more: int, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.Table:
    """The k nearest found of each query in one block, radii longer by ``more`` bits than the learned ones, and for each
    query a row without vec_id: rows, looked at, within."""
    index, size, out, counts = Index(model.encode(x), length), norms(x), [], []
    bits, probing = model.encode(queries), min(model.bits, model.probing(length) + more)
    for q, query, norm, values, code in zip(q_ids.tolist(), queries, norms(queries), index.substrings(bits), words(bits)):
        rows, looked = index.within(values, code, probing, min(model.bits, model.radius + more))
        counts.append((q, None, None, len(ids), looked, len(rows)))
        rows = rows[ids[rows] != q]
        score = (x[rows] * query).sum(axis=1) / (size[rows] * norm)
        best = np.lexsort((ids[rows], -score))
        best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])][:k]  # the nearest of rows that repeat an id
        out += [(q, int(ids[rows[b]]), float(score[b]), 0, 0, 0) for b in best]
    columns = list(zip(*out, *counts)) if out or counts else [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=["query_id", "vec_id", "score", "rows", "looked", "within"])


def _sides(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    columns = [F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")]
    rows = vectors.select(*columns).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return rows, queries.select(*columns).where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _fit(rows: DataFrame, k: int) -> tuple[Codes, int]:
    """(the codes, the number of rows)."""
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
    return Codes(valid(sample["vec_id"].combine_chunks(), sample["embedding"].combine_chunks())[1], k), rows.count()


def _found(rows: DataFrame, asked: DataFrame, model: Codes, n: int, k: int, more: int = 0) -> DataFrame:
    size, bits, m = len(model.mean), substring(min(n, BLOCK)), asked.count()
    blocks, turns = max(1, -(-2 * n // BLOCK), min(partitions(rows.sparkSession), n // 1024)), max(1, -(-2 * m // QUERIES))
    # a block of rows meets every block of queries; rows that repeat an id are spread, since they are dealt by their place
    left = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = asked.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(turns)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(own: pa.Table, asking: pa.Table) -> pa.Table:
        q_ids, q = valid(asking["vec_id"].combine_chunks(), asking["embedding"].combine_chunks(), size)
        ids, x = valid(own["vec_id"].combine_chunks(), own["embedding"].combine_chunks(), size)
        return _search(model, bits, more, q_ids, q, ids, x, k)

    return left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInArrow(searched, "query_id long, vec_id long, score double, rows long, looked long, within long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` found for each row of ``queries``."""
    rows, asked = _sides(vectors, queries, id_col, vector_col)
    model, n = _fit(rows, k)
    order, done = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"), []
    for more in (0, model.bits // 8, model.bits):
        every = _found(rows, asked, model, n, k, more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        # the row without vec_id, last in rank, tells of queries that found nothing
        ranked = every.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) | F.col("vec_id").isNull())
        ranked = materialize(ranked, "ranked")
        short = ranked.groupBy("query_id").agg(F.count("vec_id").alias("n")).where(F.col("n") < k).select("query_id")
        if more == model.bits or not short.limit(1).count():
            done.append(ranked)
            break
        done.append(ranked.join(short, "query_id", "left_anti"))
        asked = asked.join(short.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_semi")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.where("vec_id IS NOT NULL").select("query_id", "rank", "vec_id", "score")


def retrieved(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rows, looked, within: the rows searched, those that the tables gave and those of them that were reranked,
    at the learned radii."""
    rows, asked = _sides(vectors, queries, id_col, vector_col)
    counts = _found(rows, asked, *_fit(rows, k), k).where("vec_id IS NULL")
    return counts.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("rows", "looked", "within")])


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every row of ``embeddings`` whose vec_id is divisible by 50, among all other rows."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 50 = 0"))
