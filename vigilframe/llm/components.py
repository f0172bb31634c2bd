"""Connected components of a link table, in DataFrame rounds.

Each partition first reduces its links to a forest (union-find over what it holds), so a node has at most one parent
from each partition. Then every node keeps its smallest parent and links its other parents to that one, until no node
has two; pointer jumping shortens what is left to (node, smallest node reachable). Every round is written to the shared
folder. Nothing is collected but two counts a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_LINKS = "child long, parent long"


class Forest:
    """Union-find over integers in which the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        """True if they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    children = list(forest.up)
    for k in range(0, len(children), 100_000):
        part = children[k : k + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array(list(map(forest.find, part)), pa.int64())], names=["child", "parent"])


def linked(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The links (child, parent) that ``make`` finds in each partition of ``rows``, reduced to a forest by the same
    Python worker. They have no null ends and none links a node with itself."""
    return rows.mapInArrow(lambda batches: _forest(make(batches)), _LINKS)


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links`` that is linked with a smaller one; component is the smallest node
    reachable. Nodes that aren't returned are their own component. Null ends and links with itself count for nothing."""
    return components(links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(_forest, _LINKS))


def components(tree: DataFrame) -> DataFrame:
    """As ``connected``, of (child, parent) where each partition holds a forest."""
    while True:
        tree = materialize(tree, "forest")
        parents = tree.groupBy("child").agg(F.min("parent").alias("low"), F.collect_set("parent").alias("parents"))
        if not tree.groupBy("child").count().where("count > 1").limit(1).count():
            break
        hooked = parents.select("low", F.explode("parents").alias("other"), "child")
        hooked = hooked.select(F.explode(F.array(F.struct("child", F.col("low").alias("parent")), F.struct(F.col("other").alias("child"), F.col("low").alias("parent")))).alias("l")).select("l.*")
        tree = hooked.where("child != parent").distinct().mapInArrow(_forest, _LINKS)
    while True:
        above = tree.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        if not tree.join(above, "parent", "left_semi").limit(1).count():
            return tree.withColumnsRenamed({"child": "node", "parent": "component"})
        tree = materialize(tree.join(above, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent")), "jump")
