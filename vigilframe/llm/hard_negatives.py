"""Hard negatives by one-dimensional distance keys (operator 11).

Inner products become distances: every row gets one more coordinate that lifts it to the norm of the longest row, anchors
get a zero there, so the order by inner product is the order by distance. Pivots are learned on a bounded sample. A row's key
is (nearest pivot, distance to it); rows are stored sorted by it, in cells that each are an interval of one pivot's distances.
At most PIVOTS * RINGS cells describe the whole store, whatever its size; a cell with many rows is stored in chunks.

A search scans key intervals outwards. By the triangle inequality the rows of a cell are at least ``max(D - high, low - D)``
and at most ``D + high`` from an anchor at distance D of the pivot. Each round takes the next cells by that bound (about GROW
times the rows before); once an anchor has its k rows, all cells that could still hold a nearer one are taken, and it is
certified when none is left. A window of scores is an annulus around the anchor: cells inside its inner radius aren't
scanned at all, and its outer radius certifies where there are fewer than k rows.

In a round anchors are dealt in blocks by key, so those of a block ask for the same cells; a block's asking anchors meet a chunk
as one matrix product. Scores are exact integers. Work grows with anchors times the rows in their annuli, in blocks of
bounded size; nothing is collected but the sample, the cells and a flag a round.

Defined results: rows with a null id, label or vector, with a null or non-finite component, of a squared length of 2**52 or
more in 256ths (below it every score is exact in a double, whatever the order of its sum), or of another length than most
rows take no part; of rows that repeat an id the one with the smallest label, then vector, counts; a row is never its own
positive; ties go to the smaller id; a negative positive score has no negatives; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows that pivots and rings are learned from; pivots, and rings of each, at most; rows for each cell up to that.
SAMPLE, PIVOTS, RINGS, CELL = 4096, 64, 64, 1024
#: Bytes of a chunk's vectors; anchors of a block; anchors that are scored against a chunk at once.
CHUNK, BLOCK, TURN = 4 << 20, 1024, 128
#: Rows of the first round, and how many times as many the next takes while an anchor has too few.
FIRST, GROW = 2048, 4
POSITIVES, NEGATIVES = 5, 10
#: Hundredths of a positive's score between which negatives are hard.
LOW, HIGH = 30, 90
SCALE, TOO_LONG = 256, float(1 << 52)
_FOUND = "qid long, win int, vec_id long, score long"


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, null for vectors that take no part."""
    scaled = lambda x: x.cast("double") * SCALE
    fit = F.forall(vector, lambda x: F.coalesce(F.abs(scaled(x)) < TOO_LONG**0.5, F.lit(False)))  # false for NaN as well
    return F.when(fit, F.transform(vector, lambda x: F.floor(scaled(x)).cast("int")))


def _square() -> Column:
    """The squared length of ``v``."""
    return F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1 if len(flat) else 0).astype(dtype)


class Keys:
    """Pivots, rings and, once the rows are counted, cells."""

    def __init__(self, sample: np.ndarray, rows: int, longest: float, seed: int = 11):
        self.longest, self.slack = longest, 1e-6 * (1 + np.sqrt(longest))
        lifted = self.lift(sample)
        side = int(np.sqrt(max(1, rows // CELL)))
        pivots, rings = min(PIVOTS, side, len(sample)), min(RINGS, side)
        rng = np.random.Generator(np.random.Philox(seed))
        self.pivots = lifted[rng.choice(len(sample), pivots, replace=False)] if pivots else lifted
        for _ in range(5):
            near = self.distances(lifted).argmin(axis=1)
            self.pivots = np.stack([lifted[near == p].mean(axis=0) if (near == p).any() else self.pivots[p] for p in range(len(self.pivots))])
        apart = self.distances(lifted)
        near = apart.argmin(axis=1)
        cut = np.arange(1, rings) / rings
        self.cuts = [np.quantile(apart[near == p, p], cut) if (near == p).any() else np.zeros(len(cut)) for p in range(len(self.pivots))]
        self.rings = rings

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """To all pivots (rows x pivots)."""
        square = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of rows."""
        apart = self.distances(self.lift(x))
        near = apart.argmin(axis=1)
        dist = apart[np.arange(len(x)), near]
        ring = np.zeros(len(x), np.int64)
        for p in np.unique(near):
            ring[near == p] = np.searchsorted(self.cuts[p], dist[near == p], side="right")
        return (near * self.rings + ring).astype(np.int32), dist

    def set_cells(self, cells: list, length: int) -> None:
        """cells: (cell, rows, low, high) of those that have rows."""
        self.cell = np.array([c[0] for c in cells], np.int64)
        self.count, self.low, self.high = (np.array([c[k] for c in cells], np.float64) for k in (1, 2, 3))
        self.pivot = self.cell // self.rings
        self.chunks = np.maximum(1, -(-self.count * max(1, length) * 4 // CHUNK)).astype(int)

    def rounds(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For anchors with windows of scores (NaN: none) and what they have scanned so far: (how near each cell may be, the
        cells that may hold something new, how far the next round goes; NaN where the anchor is certified)."""
        square = (x * x).sum(axis=1)
        apart = self.distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1))[:, self.pivot]
        near = np.maximum(0, np.maximum(apart - self.high, self.low - apart))
        far = apart + self.high
        radius = lambda s: np.sqrt(np.maximum(0, (square + self.longest)[:, None] - 2 * s))
        outer, inner = radius(np.where(np.isnan(kth), low, kth)), radius(high)
        needed = np.zeros(near.shape, bool)
        for w in range(low.shape[1]):
            some = ~np.isnan(high[:, w])
            needed |= some[:, None] & (near <= np.where(np.isnan(outer[:, w]), np.inf, outer[:, w] + self.slack)[:, None]) & (far >= inner[:, w : w + 1] - self.slack)
        open_ = needed & (near > reached[:, None])
        next_ = np.full(len(x), np.nan)
        full = ~(np.isnan(kth) & ~np.isnan(high)).any(axis=1)
        for q in np.flatnonzero(open_.any(axis=1)):
            own = np.flatnonzero(open_[q])
            if full[q]:
                next_[q] = near[q, own].max()
                continue
            own = own[np.argsort(near[q, own], kind="stable")]
            rows = self.count[own].cumsum()
            target = max(FIRST, GROW * self.count[needed[q] & (near[q] <= reached[q])].sum())
            next_[q] = near[q, own[min(len(own) - 1, np.searchsorted(rows, target))]]
        return near, open_, next_


def _asked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(x, low, high, kth, reached) of a batch of anchors; low and high of absent windows are NaN."""
    windows = batch.column("windows").to_pylist()
    width = max((len(w) for w in windows), default=0)
    low, high, kth = (np.full((len(windows), width), np.nan) for _ in range(3))
    for q, own in enumerate(windows):
        for w, (a, b, c) in enumerate((x["low"], x["high"], x["kth"]) for x in own):
            low[q, w], high[q, w], kth[q, w] = (-np.inf if a is None else a), (np.inf if b is None else b), (np.nan if c is None else c)
    return _matrix(batch.column("v")), low, high, kth, np.asarray(batch.column("reached"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows, ``size`` at a time."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            have = sum(b.num_rows for b in rest)
            rest.append(batch.slice(0, size - have))
            batch = batch.slice(size - have)
            if have + rest[-1].num_rows == size:
                yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


_STORED = "cell int, chunk int, side int, n int, ids binary, labels binary, vectors binary, bounds binary"


def _stored(cell: int, chunk: int, side: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bounds: np.ndarray) -> tuple:
    return cell, chunk, side, len(ids), ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), vectors.astype(np.int32).tobytes(), bounds.tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(),) * 4 + (pa.binary(),) * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _STORED.split(", ")])


class DistanceKeys:
    """The store of rows (vec_id long, label long, v array<int>), sorted by distance key."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        n, longest, self.length = rows.agg(F.count(F.lit(1)), F.max(_square()), F.max(F.size("v"))).first()
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
        self.keys = keys = Keys(_matrix(sample["v"]), n, longest or 0.0)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, dist = keys.place(_matrix(batch.column("v")))
                    yield batch.append_column("cell", pa.array(cell)).append_column("dist", pa.array(dist))

        self.rows = materialize(rows.mapInArrow(placed, "vec_id long, label long, v array<int>, cell int, dist double"), "distance-keys")
        cells = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("cell").collect()
        keys.set_cells([tuple(c) for c in cells], self.length or 0)
        chunks = spark.createDataFrame([(int(c), int(k)) for c, k in zip(keys.cell, keys.chunks)], "cell int, chunks int")
        dealt = self.rows.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).drop("chunks")
        self.chunks = materialize(dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "dist", "vec_id").mapInArrow(_packed, _STORED), "distance-chunks")

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(qid, win, vec_id, score): the k best rows in each window of scores of each anchor, of its own label or of others.

        ``asked``: (qid long, label long, v, windows array<struct<low, high>>); nulls are no bound.
        """
        keys = self.keys
        spark = asked.sparkSession
        empty = F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.lit(None).cast("long").alias("kth")))
        todo = asked.select("qid", "label", "v", empty.alias("windows"), F.lit(-1.0).alias("reached"))
        schema = "qid long, label long, v array<int>, windows array<struct<low:long,high:long,kth:long>>, reached double, next double, cell int, dist double"
        found = spark.createDataFrame([], _FOUND)

        def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TURN):
                    some = batch.slice(at, TURN)
                    x, *bounds = _asked(some)
                    next_ = keys.rounds(x, *bounds)[2]
                    cell, dist = keys.place(x)
                    yield some.append_column("next", pa.array(next_)).append_column("cell", pa.array(cell)).append_column("dist", pa.array(dist)).filter(pa.array(~np.isnan(next_)))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches, BLOCK):
                ids, labels, nexts = (np.asarray(block.column(c)) for c in ("qid", "label", "next"))
                x, low, high, kth, reached = _asked(block)
                scan = np.concatenate([_scan(keys, x[a : a + TURN], low[a : a + TURN], high[a : a + TURN], kth[a : a + TURN], reached[a : a + TURN], nexts[a : a + TURN]) for a in range(0, len(x), TURN)])
                bounds = np.stack([np.fmax(low, kth), high], axis=2)
                for c in np.flatnonzero(scan.any(axis=0)):
                    q = np.flatnonzero(scan[:, c])
                    for chunk in range(keys.chunks[c]):
                        yield _rows([_stored(int(keys.cell[c]), chunk, 1, ids[q], labels[q], x[q], bounds[q])])

        while True:
            todo = materialize(todo.mapInArrow(ahead, schema), "anchors")
            if todo.isEmpty():
                return found
            probes = todo.repartitionByRange("cell", "dist", "qid").sortWithinPartitions("cell", "dist", "qid").mapInArrow(dealt, _STORED)
            met = self.chunks.unionByName(probes).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "side")
            new = met.mapInArrow(lambda batches: _scored(batches, k, same), _FOUND)
            best = Window.partitionBy("qid", "win").orderBy(F.col("score").desc(), "vec_id")
            found = materialize(found.unionByName(new).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "found")
            full = found.groupBy("qid", "win").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            full = full.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("win", "kth"))).alias("kths"))  # windows of one anchor
            windows = F.transform("windows", lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.try_element_at("kths", i).alias("kth")))
            windows = F.when(F.col("kths").isNull(), F.col("windows")).otherwise(windows)
            todo = todo.join(full, "qid", "left").select("qid", "label", "v", windows.alias("windows"), F.col("next").alias("reached"))


def _scan(keys: Keys, x: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, reached: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    near, open_, _ = keys.rounds(x, low, high, kth, reached)
    return open_ & (near <= nexts[:, None])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of rows that come sorted by chunk."""
    rest: list[pa.RecordBatch] = []

    def pack() -> pa.RecordBatch:
        own = pa.Table.from_batches(rest)
        get = lambda c: own[c].to_numpy()
        return _rows([_stored(int(get("cell")[0]), int(get("chunk")[0]), 0, get("vec_id"), get("label"), _matrix(own["v"], np.int32), get("dist"))])

    for batch in batches:
        key = np.asarray(batch.column("cell")).astype(np.int64) << 32 | np.asarray(batch.column("chunk"))
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if rest and a < b and (rest[0].column("cell")[0], rest[0].column("chunk")[0]) != (batch.column("cell")[a], batch.column("chunk")[a]):
                yield pack()
                rest = []
            if a < b:
                rest.append(batch.slice(a, b - a))
    if rest:
        yield pack()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["vectors"], np.int32).reshape(len(ids), -1 if row["vectors"] else 0).astype(np.float64)


def _scored(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """The k best of a chunk in each window of each anchor that asks it. A chunk comes before those that ask."""
    key, ids, labels, x = None, None, None, None
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            if row["side"] == 0:
                key = row["cell"], row["chunk"]
                ids, labels, x = _unpacked(row)
                continue
            if key != (row["cell"], row["chunk"]):
                continue
            q_ids, q_labels, q = _unpacked(row)
            bounds = np.frombuffer(row["bounds"]).reshape(len(q_ids), -1, 2)
            out: list[tuple[np.ndarray, ...]] = []
            for a in range(0, len(q_ids), TURN):
                scores = q[a : a + TURN] @ x.T
                for own, label, windows, score in zip(q_ids[a : a + TURN], q_labels[a : a + TURN], bounds[a : a + TURN], scores):
                    fit = (labels == label) & (ids != own) if same else labels != label
                    for w, (low, high) in enumerate(windows):
                        rows = np.flatnonzero(fit & (score >= low) & (score <= high))  # none where a bound is NaN
                        if len(rows) > k:
                            rows = rows[score[rows] >= np.partition(score[rows], -k)[-k]]
                            rows = rows[np.lexsort((ids[rows], -score[rows]))[:k]]
                        if len(rows):
                            out.append((np.full(len(rows), own), np.full(len(rows), w, np.int32), ids[rows], score[rows].astype(np.int64)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=[c.split()[0] for c in _FOUND.split(", ")])


def usable(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, written."""
    some = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), integers(F.col(vector_col)).alias("v"))
    some = some.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    some = materialize(some.where(_square() < TOO_LONG), "vectors")
    most = some.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()  # one row for each length
    return some.where(F.size("v") == (most[0] if most else 0))


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of ``usable`` rows; ``anchors``: a condition
    that tells which of them are."""
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    store = DistanceKeys(rows)
    asking = store.rows.where(anchors).select(F.col("vec_id").alias("qid"), "label", "v")
    bound = lambda c, name: c.cast("long").alias(name)
    everything = F.array(F.struct(bound(F.lit(None), "low"), bound(F.lit(None), "high")))
    found = store.search(asking.withColumn("windows", everything), positives, True).select("qid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    order = Window.partitionBy("qid").orderBy(F.col("positive_score").desc(), "positive_id")
    fit = materialize(found.where("positive_score >= 0").withColumn("win", F.row_number().over(order) - 1), "positives")
    low = F.expr(f"({LOW} * positive_score + pmod(-{LOW} * positive_score, 100)) div 100")
    high = F.expr(f"({HIGH} * positive_score - pmod({HIGH} * positive_score, 100)) div 100")
    windows = fit.select("qid", F.struct("win", bound(low, "low"), bound(high, "high")).alias("w"))
    windows = windows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    hard = store.search(asking.join(windows, "qid"), negatives, False)
    rank = Window.partitionBy("qid", "win").orderBy(F.col("score").desc(), "vec_id")
    return hard.join(fit, ["qid", "win"]).withColumn("rank", F.row_number().over(rank)).select(
        F.col("qid").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth row of ``embeddings``, its five positives and up to ten hard negatives of each."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(rows.withColumn("label", label)), F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
