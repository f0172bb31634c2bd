"""How filters of documents interact, in every order that they can be applied in (operator 12).

The text is read once. Each document gets a mask, a bit for each filter that it fails; Spark counts documents by (part,
mask), which leaves at most 2**filters cells a part, whatever the number of documents. All orders are then visited by
swapping two neighbours at a time: a swap changes what two steps remove and nothing else, so only these two are summed
again from the cells. The Shapley value of a filter is what it removes, summed along the walk.

The five filters: A under 50 words; B distinct words under 65 % of all; C capital letters A-Z over 5 % of the code points; D
holds one of ``#$%&*|``; E identical to the text of a smaller id, wherever that is. What A to D say depends on the text
alone. For E, rows are reduced to (id, part, mask, digest) and then to (digest, part, mask) before texts meet, so a group of
copies sends one row a task and part.

Defined results: a null text counts as empty (it fails A); a null ``source`` is the part of the empty string; a row with a
null id has no labels, never fails E and makes no other fail; rows that repeat an id count once each and don't make each
other fail E; of several labels of one id, one that says 1 is enough, null labels say nothing; empty tables have no parts and
so no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Limits of the filters.
WORDS, DISTINCT, CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
FILTERS = "ABCDE"
#: Parts whose orders are laid out at once in a task.
PARTS = 64
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def bits(ws: Column) -> Column:
        n, distinct = F.size(ws), F.size(F.array_distinct(ws))
        return F.when(n < WORDS, 1).otherwise(0) + F.when(100 * distinct < DISTINCT * n, 2).otherwise(0)

    of_words = F.element_at(F.transform(F.array(words), bits), 1)  # the words are split once
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return of_words + F.when(100 * capitals.cast("long") > CAPITALS * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(SIGNS), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail, and how many of them are labelled good and toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.sha2(text, 256).alias("digest"))
    facts = materialize(facts, "filter-facts")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = facts.where("id IS NOT NULL").groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    counts = ["n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]]
    rows = rows.join(marks, "id", "left").select("id", "part", "mask", "digest", *counts)
    # of a text's rows in a part, those of the smallest id there may be the first of all; the others never are
    texts = rows.groupBy("digest", "part", "mask").agg(F.min(F.struct("id", "n", "good", "toxic")).alias("first"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    texts = materialize(texts, "filter-texts")
    lowest = texts.groupBy("digest").agg(F.min("first.id").alias("low"))
    own = lambda c: F.when(F.col("first.id") == F.col("low"), F.col(f"first.{c}")).otherwise(0)
    split = F.array(
        F.struct(F.col("mask"), *[own(c).alias(c) for c in ("n", "good", "toxic")]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - own(c)).alias(c) for c in ("n", "good", "toxic")]),
    )
    known = texts.join(lowest, "digest").select("part", F.inline(split))
    nameless = facts.where("id IS NULL").select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def swaps(n: int) -> Iterator[int]:
    """The place i of each swap (i, i + 1) that visits all orders of n things, each once (plain changes): the last thing runs
    from end to end, and between two runs the others make their next change."""
    if n < 2:
        return
    inner = swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the last thing stands in front after running down
        down = not down


def walk(counts: np.ndarray, filters: str = FILTERS) -> Iterator[tuple[str, np.ndarray]]:
    """(order, removed) of every order: removed[step] holds for each part the (n, good, toxic) that the step removes.

    counts: parts x masks x 3. ``removed`` is the same array each time."""
    n = len(filters)
    masks = np.arange(1 << n)
    order = list(range(n))

    def removes(step: int) -> np.ndarray:
        earlier = sum(1 << f for f in order[:step])
        return counts[:, (masks & earlier == 0) & (masks >> order[step] & 1 == 1)].sum(axis=1)

    removed = np.stack([removes(s) for s in range(n)])
    yield "".join(filters[f] for f in order), removed
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        removed[i], removed[i + 1] = removes(i), removes(i + 1)
        yield "".join(filters[f] for f in order), removed


def _audited(parts: list[str], counts: np.ndarray, filters: str) -> pa.RecordBatch:
    """The rows of RESULT for some parts, all orders of one part together."""
    n, p = len(filters), len(parts)
    orders, steps = [], []
    shapley = np.zeros((p, n), np.int64)
    for order, removed in walk(counts, filters):
        orders.append(order)
        steps.append(removed.copy())
        for s, letter in enumerate(order):
            shapley[:, filters.index(letter)] += removed[s, :, 0]
    at = np.array([[filters.index(x) for x in order] for order in orders])  # orders x steps
    gone = np.stack(steps).transpose(2, 0, 1, 3)  # parts x orders x steps x 3
    masks = np.arange(1 << n)
    fails = np.stack([counts[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(n)], axis=1)
    alone = np.stack([counts[:, 1 << f, 0] for f in range(n)], axis=1)
    kept = counts[:, :, 0].sum(axis=1)[:, None, None] - gone[..., 0].cumsum(axis=2)
    columns = [kept, gone[..., 0], fails[:, at] - gone[..., 0], alone[:, at], gone[..., 1], gone[..., 2], shapley[:, at]]
    each = len(orders) * n
    names = [pa.array(parts).take(pa.array(np.repeat(np.arange(p), each))), pa.array(orders).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), n), p)))]
    values = [pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), p * len(orders))), *[pa.array(np.ascontiguousarray(c).reshape(-1)) for c in columns]]
    return pa.record_batch([*names, *values], names=[c.split()[0] for c in RESULT.split(", ")])


def audit(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step of ``cells`` (part, mask, n, good, toxic); bit i of a mask stands for filters[i].

    A part is one row of at most 2**filters cells, so a task never holds more than PARTS of them."""
    size = 1 << len(filters)
    grouped = found.groupBy("part").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("mask", "n", "good", "toxic")])).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PARTS):
                some = batch.slice(k, PARTS)
                counts = np.zeros((some.num_rows, size, 3), np.int64)
                for p, row in enumerate(some.column("cells").to_pylist()):
                    for cell in row:
                        counts[p, cell["mask"]] += cell["n"], cell["good"], cell["toxic"]
                yield _audited(some.column("part").to_pylist(), counts, filters)

    return grouped.mapInArrow(run, RESULT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all ``documents``, for each source."""
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, length(regexp_replace(txt, '[^A-Z]+', '', 'g')) AS caps, min(doc_id) OVER (PARTITION BY txt) AS low FROM t
), d AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * caps > 5 * length(txt), regexp_matches(txt, '[#$%&*|]'), coalesce(w.doc_id > low, false)] AS fails
  FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails
), l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT o, s.i AS step, o[s.i] AS f, o[1 : s.i - 1] AS earlier FROM orders, l s
), x AS (
  SELECT part, o, step, f, n, good, toxic, fails[f] AS failing, len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AS alone FROM c, steps
), r AS (
  SELECT part, o, step, f,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing AND alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, o, step, f
)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
