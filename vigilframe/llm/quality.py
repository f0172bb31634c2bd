"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 4).

Statistics of whole texts (shares of character classes, word and line repetition, word lengths) are cut into at most
``BINS`` bins by quantiles of the learning rows. Trees of fixed depth are grown level by level from gradient histograms
under logistic loss and kept as flat arrays of (feature, bin) with leaf values, so that numpy walks all rows of a batch
down a tree at once.

Learning reads at most ``LEARNED`` labelled rows (those whose hash of the id is smallest); scoring reads every whole text.
Defined results: null and empty texts have statistics of zero and get a score like any other; null labels are left out; of
several labels of one id the largest counts; repeated rows are scored alike; with no labels, or one class only, all scores
are the share of label 1 (0.5 without labels); other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, slices, table
from .shingles import mix, word_hashes

LEARNED = 20_000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
#: Regularisation of a leaf's weight, and the least curvature on each side of a split.
RIDGE, LEAST = 1.0, 5.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13),
    "stop": (44, 46, 59, 58), "mark": (33, 63), "quote": (34, 39, 40, 41, 45), "bar": (124, 95, 126, 94, 96), "sign": (35, 36, 37, 38, 42, 43, 61, 64),
    "bracket": (60, 62, 91, 93, 123, 125, 47, 92), "high": range(128, 256),
}
_class_of = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES.values(), 1):
    _class_of[list(_bytes)] = _k
NAMES = [*_CLASSES, "upper_pairs", "log_bytes", "log_words", "word_bytes", "distinct_words", "repeats", "top_word", "distinct_pairs", "repeated_lines", "line_bytes", "ended_by_sign", "short_words"]


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct hashes, count of the most frequent) of each text."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
    first = np.flatnonzero(new)
    run, top = np.diff(np.r_[first, len(h)]), np.zeros(n, np.int64)
    np.maximum.at(top, o[first], run)
    return np.bincount(o[first], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """texts x NAMES."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n, out = len(texts), np.zeros((len(texts), len(NAMES)))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if n and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    size = np.diff(ends)
    kind = _class_of[raw]
    full = np.flatnonzero(size)

    def total(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(n)
        if len(full):
            sums[full] = np.add.reduceat(flag, ends[full], dtype=np.int64)
        return sums

    share = lambda a, b: a / np.maximum(b, 1)
    for k in range(1, len(_CLASSES) + 1):
        out[:, k - 1] = share(total(kind == k), size)
    c = len(_CLASSES)
    upper, letter = kind == 1, (kind == 1) | (kind == 2)
    out[:, c] = share(total(np.r_[upper[1:] & upper[:-1], False]) if len(raw) else np.zeros(n), np.maximum(total(letter), 1))
    hashes, words = word_hashes(texts)
    count = np.diff(words)
    out[:, c + 1], out[:, c + 2] = np.log1p(size), np.log1p(count)
    out[:, c + 3] = share(size, count)
    distinct, top = _distinct(hashes, words)
    out[:, c + 4], out[:, c + 6] = share(distinct, count), share(top, count)
    owner = np.repeat(np.arange(n), count)
    if len(hashes) > 1:
        inside = owner[1:] == owner[:-1]
        out[:, c + 5] = share(np.bincount(owner[1:][inside & (hashes[1:] == hashes[:-1])], minlength=n), count)
        pair = mix(hashes[1:] * np.uint64(3) + hashes[:-1])[inside]
        pairs, _ = _distinct(pair, np.r_[0, np.cumsum(np.maximum(count - 1, 0))])
        out[:, c + 7] = share(pairs, np.maximum(count - 1, 0))
    breaks = raw == 10
    lines = total(breaks) + (size > 0)
    if len(raw):
        start = np.zeros(len(raw), bool)
        start[1:] = breaks[:-1]
        start[ends[:-1][size > 0]] = True
        at = np.flatnonzero(start)
        sums = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * mix(np.arange(len(raw), dtype=np.uint64) - np.repeat(at, np.diff(np.r_[at, len(raw)])).astype(np.uint64)), at)
        line_of = np.searchsorted(at, ends)
        unlike, _ = _distinct(sums, line_of)
        out[:, c + 8] = 1 - share(unlike, lines)
        gap = (kind == 4) | (kind == 5)
        last = ~gap & np.r_[gap[1:], True]
        out[:, c + 10] = share(total(last & ((kind == 7) | (kind >= 9) & (kind <= 11))), count)
        out[:, c + 11] = share(total(~gap & np.r_[True, gap[:-1]] & np.r_[gap[3:], True, True, True][: len(raw)]), count) if len(raw) > 3 else 0
    out[:, c + 9] = np.log1p(share(size, lines))
    return out


class Trees:
    """Complete binary trees of one depth in flat arrays: node k has the children 2k+1 and 2k+2."""

    def __init__(self, cuts: np.ndarray, base: float):
        self.cuts, self.base = cuts, base
        self.feature, self.bin, self.value = np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64), np.zeros((0, 0))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[:, f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        b, z, rows = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.bin, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            z += value[node - len(feature)]
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Learns from statistics x (rows x features) and labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        mean = y.mean() if len(y) else 0.5
        return Trees(np.zeros((1, x.shape[1])), float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    trees = Trees(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0), float(np.log(y.mean() / (1 - y.mean()))))
    b, z, features = trees.bins(x), np.full(len(y), trees.base), x.shape[1]
    inner, all_f, all_b, all_v = 2**DEPTH - 1, [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            place = (node - first) * BINS
            gain = np.full((width, features, BINS), -np.inf)
            for f in range(features):
                G = np.bincount(place + b[:, f], g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                H = np.bincount(place + b[:, f], h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                GA, HA = G[:, -1:], H[:, -1:]
                better = G**2 / (H + RIDGE) + (GA - G) ** 2 / (HA - H + RIDGE) - GA**2 / (HA + RIDGE)
                gain[:, f] = np.where((H >= LEAST) & (HA - H >= LEAST), better, -np.inf)
            best = gain.reshape(width, -1).argmax(axis=1)
            ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(ok, best // BINS, 0)
            cut[first : first + width] = np.where(ok, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        z += value[leaf]
        all_f.append(feature), all_b.append(cut), all_v.append(value)
    trees.feature, trees.bin, trees.value = np.stack(all_f), np.stack(all_b), np.stack(all_v)
    return trees


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, bound: int = LEARNED) -> Trees:
    """Learns ``labels.quality`` from at most ``bound`` labelled rows outside the held-out part."""
    chosen = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id")).limit(bound)  # so few that they can be sent to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("quality",), dict)
        for batch in slices(batches, "text", 1 << 20):
            x = statistics(batch.column("text"))
            yield pa.record_batch([batch.column("quality").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["quality", "x"])

    found = rows.mapInArrow(described, "quality int, x array<double>").toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, found["quality"].to_numpy()))  # rows come in any order; sums of floats depend on it
    return grow(x[order], found["quality"].to_numpy()[order].astype(float))


def score(trees: Trees, text: Column) -> Column:
    """Quality of a text column, 0 to 1."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held(("quality",), dict)  # no other operator's tables stay beside the statistics
        for texts in batches:
            parts = slices(iter([pa.record_batch([texts], names=["text"])]), "text", 1 << 20)
            yield pa.array(np.concatenate([np.zeros(0), *(trees.scores(statistics(p.column("text"))) for p in parts)]))

    return scored(text)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every text of ``documents``, learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(trees, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
