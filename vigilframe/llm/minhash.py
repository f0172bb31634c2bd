"""MinHash near-duplicates by a multi-index Hamming join (operator 7).

A text's set is its distinct word shingles. Its signature has ``chunks * width`` minimum hashes of ``bits`` bits. By the
pigeonhole principle two signatures that differ in fewer than ``chunks * (errors + 1)`` values have a chunk with at most
``errors`` differing values; each chunk is indexed once for every choice of ``errors`` values left out, so every such
pair meets under a key. (With the defaults, two texts at a similarity of 0.8 miss each other with a chance of 0.0002.)

Texts with the same set form a class and only its smallest document goes on. Under a key the signatures are compared
with each other and joined into a forest, so a key of n members sends n - 1 rows at most. Keys are counted first: members
of a hot key (more than ``COMPARED`` of them, and more than 1/HOT_PARTS of all classes, which bounds the broadcast of such
keys to chunks * width * HOT_PARTS rows) are linked with the first one where they stand and aren't dealt by the key. The
connected candidates form clusters.

The sets of a cluster's texts are compared exactly in two rounds. Texts are dealt into blocks of at most ``BLOCK_TEXTS``;
up to ``HUBS`` texts of the cluster, the smallest ids of as many hash classes, go to all of its blocks. Round one compares
all texts of a block and the hubs, so a cluster of n texts around common ones costs a number of comparisons in proportion
to n. Round two takes what that left outside the largest component of its cluster, in blocks, to every block of the
cluster, since a link may be with any text there: after it, two texts that were never compared are in one component.
A task sends a forest of the links it confirms, and components of these, carried back to all members of the classes, are
the result.

Defined results: null and empty texts have an empty set and stand alone; a null doc_id takes no part in any link, and its
component is null and ``kept`` false; rows that repeat a doc_id with one text get the same answer; an empty table gives
no rows; other columns are ignored, or passed through by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, materialize, slices, table
from .components import Forest, components, linked
from .shingles import fingerprints, mix, shingle_sets, signatures

CHUNKS, WIDTH, ERRORS, BITS = 8, 6, 1, 16
#: Candidates differ in at most this many of the values; a pair at a similarity of 0.8 exceeds it with a chance under 1e-5.
APART = 22
SEED = 11
#: Members of a key from which it may be hot, and the share of all classes from which it is.
COMPARED, HOT_PARTS = 8192, 100_000
#: Shingles and texts in a block of a cluster, and texts of it that are compared with all others in round one.
BLOCK_SHINGLES, BLOCK_TEXTS, HUBS = 1 << 20, 64, 8


def _sign(docs: DataFrame, words: int, chunks: int, width: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), signature (binary)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("minhash",), dict)  # no other operator's tables stay beside the sets
        for batch in slices(batches, "text", 2 << 20):
            sets, offsets = shingle_sets(batch.column("text"), words)
            prints, signature = fingerprints(sets, offsets), signatures(sets, offsets, chunks * width, BITS, SEED)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * chunks * width), len(signature), [None, pa.py_buffer(signature.tobytes())])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), packed.cast(pa.binary())],
                names=["doc_id", "n_shingles", "f1", "f2", "signature"],
            )

    return docs.mapInArrow(signed, "doc_id long, n_shingles long, f1 long, f2 long, signature binary")


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _keys(classes: DataFrame, chunks: int, width: int, errors: int) -> DataFrame:
    """(key, doc_id) for every chunk and choice of values left out of it."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signature, out = _unpack(batch.column("signature")).astype(np.uint64), []
            for c in range(chunks):
                for left in combinations(range(width), width - errors):
                    k = np.full(batch.num_rows, hash((c, left)) & 0x7FFFFFFF, np.uint64)
                    for v in left:
                        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + signature[:, c * width + v] + np.uint64(1))
                    out.append(k)
            yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), pa.concat_arrays([batch.column("doc_id")] * len(out))], names=["key", "doc_id"])

    return classes.select("doc_id", "signature").mapInArrow(keyed, "key long, doc_id long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of equal values of the first ``keys`` columns in sorted batches, several whole runs at a time."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if rest and any(rest[-1].column(k)[-1].as_py() != c[0] for k, c in enumerate(columns)):
            yield pa.Table.from_batches(rest)
            rest = []
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def _bounds(part: pa.Table, keys: int) -> list[tuple[int, int]]:
    change = np.ones(part.num_rows + 1, bool)
    change[1:-1] = False
    for k in range(keys):
        c = part.column(k).to_numpy()
        change[1:-1] |= c[1:] != c[:-1]
    at = np.flatnonzero(change).tolist()
    return [(a, b) for a, b in zip(at, at[1:]) if b - a > 1]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, doc_id), the rows whose key others have too."""
    for part in _runs(batches, 1):
        take = np.zeros(part.num_rows, bool)
        for a, b in _bounds(part, 1):
            take[a:b] = True
        yield from part.filter(pa.array(take)).combine_chunks().to_batches()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, doc_id, signature), a forest of the pairs that differ in at most APART values."""
    for part in _runs(batches, 1):
        ids, links = part.column("doc_id").to_numpy(), []
        signature = _unpack(part.column("signature").combine_chunks())
        for a, b in _bounds(part, 1):
            forest, trees = Forest(), 1
            for i in range(a + 1, b):
                if trees == 1 and (signature[a] != signature[i]).sum() <= APART:  # no other tree is left to be joined
                    forest.join(i, a)
                    links.append((int(ids[i]), int(ids[a])))
                    continue
                before = len(links)
                near = np.flatnonzero((signature[a:i] != signature[i]).sum(axis=1) <= APART)
                links += [(int(ids[i]), int(ids[a + j])) for j in near.tolist() if forest.join(i, a + j)]
                trees += 1 - (len(links) - before)
        if links:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], names=["child", "parent"])


def _confirm(percent: int):
    """Of sorted (cluster, left, right, doc_id, asked, shingles), a forest of the pairs of one (cluster, left, right) that
    are similar enough, of which at least one side is asked."""

    def similar(one: np.ndarray, other: np.ndarray) -> bool:
        shared = len(np.intersect1d(one, other, assume_unique=True))
        return 100 * shared >= percent * (len(one) + len(other) - shared)

    def pairs(sets: list[np.ndarray], asked: np.ndarray) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
        values = values[order]
        new = np.r_[True, values[1:] != values[:-1]]
        first = np.flatnonzero(new)
        many = np.diff(np.r_[first, len(values)])
        # shared shingle -> its owners, for counting one text's overlaps with all others at once
        place = np.empty(len(values), np.int32)
        place[order] = np.cumsum(new) - 1
        del values, order, new
        ends = np.cumsum(size)
        forest, links, trees, hub = Forest(), [], 1, 0
        for i in np.flatnonzero(asked).tolist():
            if i == 0 and asked.all():
                continue
            if asked.all() and trees == 1 and similar(sets[hub], sets[i]):  # no other tree is left to be joined
                forest.join(i, hub)
                links.append((i, hub))
                continue
            trees += 1
            mine = place[ends[i] - size[i] : ends[i]]
            mine = mine[many[mine] > 1]
            if not len(mine):
                continue
            n = many[mine]
            at = np.repeat(first[mine] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            close = 100 * shared >= percent * (size + size[i] - shared)
            close[i:] &= ~asked[i:]  # pairs of two that are asked count once
            near = np.flatnonzero(close).tolist()
            joined = [j for j in near if forest.join(i, j)]
            links += [(i, j) for j in joined]
            trees -= len(joined)
            hub = near[0] if near else hub
        return links

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("minhash",), dict)
        for part in _runs(batches, 3):
            ids, links = part.column("doc_id").to_pylist(), []
            asked = np.asarray(part.column("asked").combine_chunks())
            for a, b in _bounds(part, 3):
                if asked[a:b].any():
                    sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").slice(a, b - a).to_pylist()]
                    links += [(ids[a + i], ids[a + j]) for i, j in pairs(sets, asked[a:b])]
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], names=["child", "parent"])

    return confirm


def _sets(words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("minhash",), dict)
        for batch in slices(batches, "text", 2 << 20):
            sets, offsets = shingle_sets(batch.column("text"), words)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((8 * offsets).astype(np.int64).tobytes()), pa.py_buffer(sets.tobytes())])
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "cluster", "block", "blocks", "hub")), raw.cast(pa.binary())], names=["doc_id", "cluster", "block", "blocks", "hub", "shingles"])

    return build


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """The links in each (cluster, left, right) of (cluster, left, right, doc_id, asked, shingles)."""
    rows = rows.select("cluster", "left", "right", "doc_id", "asked", "shingles").repartition("cluster", "left", "right")
    return linked(rows.sortWithinPartitions("cluster", "left", "right", "doc_id"), _confirm(percent))


def confirmed(texts: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the texts (doc_id, text) whose sets are similar enough, within clusters (doc_id, cluster,
    n_shingles) that hold every candidate pair."""
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int").alias("blocks"))
    large = materialize(blocks.where("blocks > 1"), "large")
    hubs = members.join(large, "cluster", "left_semi").groupBy("cluster", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(HUBS))).agg(F.min("doc_id").alias("doc_id"))
    placed = members.join(large, "cluster", "left").join(hubs.select("doc_id", F.lit(True).alias("hub")), "doc_id", "left")
    placed = placed.select("doc_id", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("hub", F.lit(False)).alias("hub"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    sets = texts.join(placed, "doc_id").select("doc_id", "text", "cluster", "block", "blocks", "hub")
    sets = sets.mapInArrow(_sets(words), "doc_id long, cluster long, block int, blocks int, hub boolean, shingles binary")
    sets = materialize(sets, "sets")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = sets.select("*", F.explode(F.when(F.col("hub"), everywhere).otherwise(F.array("block"))).alias("left"))
    found = components(_compared(one.withColumns({"right": F.lit(0), "asked": F.lit(True)}), percent))
    labels = sets.where("blocks > 1").select("doc_id", "cluster").distinct().join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("label"))
    sizes = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    outside = materialize(labels.join(most, "cluster").where("label <> most").select("doc_id", "cluster"), "outside")
    rounds = outside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias("rounds"))
    if not rounds.limit(1).count():
        return found
    again = sets.join(rounds, "cluster").join(outside.select("doc_id", F.lit(True).alias("asked")).distinct(), "doc_id", "left")
    again = again.withColumns({"asked": F.coalesce("asked", F.lit(False)), "turn": F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.col("rounds")).cast("int")})
    turns = F.sequence(F.lit(0), F.col("rounds") - 1)
    # what is asked goes in its turn to all blocks, all else with its block through all turns
    asked = again.where("asked").select("*", F.explode(everywhere).alias("left"), F.col("turn").alias("right"))
    others = again.select("*", F.col("block").alias("left"), F.explode(turns).alias("right")).where("NOT asked OR turn <> right").withColumn("asked", F.lit(False))
    links = _compared(asked.unionByName(others), percent)
    return components(found.select(F.col("node").alias("child"), F.col("component").alias("parent")).unionByName(links))


def assign(docs: DataFrame, words: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept, for texts whose sets' intersection is at
    least ``percent`` hundredths of their union."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(_sign(texts, words, chunks, width), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")), "classes")
    keyed = _keys(classes, chunks, width, errors)
    limit = max(COMPARED, classes.count() // HOT_PARTS)
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > limit).select("key", "first"), "hot")
    stars = linked(keyed.join(F.broadcast(hot), "key").where("doc_id <> first").select("doc_id", "first"), iter)
    met = keyed.join(F.broadcast(hot), "key", "left_anti").repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_met, "key long, doc_id long")
    near = met.join(classes.select("doc_id", "signature"), "doc_id").select("key", "doc_id", "signature")
    clusters = components(linked(near.repartition("key").sortWithinPartitions("key", "doc_id"), _near).unionByName(stars))
    members = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
    members = members.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(classes.select("doc_id", "n_shingles"), "doc_id")
    links = confirmed(texts, materialize(members, "members"), words, percent)
    found = classes.join(links, classes["doc_id"] == links["node"], "left").select("f1", "f2", F.coalesce("component", "doc_id").alias("component"))
    found = materialize(found, "found")
    some = full.join(found, ["f1", "f2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    none = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the near-duplicates of a document with a smaller id."""
    gone = assign(docs, words, percent, id_col, text_col).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` on 4-word shingles."""
    return assign(table(spark, sf_dir, "documents"))
