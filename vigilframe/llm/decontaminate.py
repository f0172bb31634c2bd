"""Benchmark decontamination by a prefix-filtered set join (operator 13, DataFrame operations only).

An item's windows are its runs of WINDOW consecutive words; an item with fewer words is one window. A window is the set of
its shingles of SHINGLE words (of all its words, if it has fewer), each with its place. A text holds a window if it holds
all of its shingles, so one of them, the prefix, has to be there: the rarest, by how often the shingles of the benchmark
occur in all texts. Where it occurs is a candidate, at the place that the shingle's place in the window gives; bounds on
position and length leave out windows that would stick out of the text. A candidate is exact if the shingles that cover the
window, end to end, all stand at their places: shingles are compared by their words, not by hashes, so this compares
the window word by word.

The text is read once: all shingles of a text go by the distinct shingles of the benchmark, and (text, place, shingle) of
those that meet are written, from which the counts, the candidates and the check are made. The benchmark's shingles are
sent to all tasks while there are at most BROADCAST of them; beyond that both sides are dealt by shingle (adaptive execution
splits what a frequent shingle gives), and the places of frequent ones are salted before they meet their windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower case. Defined results: null texts have no words; items
without words have no windows; items that repeat an id are one item with the windows of all of them; a null item_id counts
as the empty string; every row of the documents gives a row, those that repeat an id or have none too; empty tables of
documents give no rows, an empty benchmark marks nothing; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW, SHINGLE = 10, 5
#: Rows of the benchmark's side that are sent to every task, at most (a row of shingles has about 60 bytes).
BROADCAST = 500_000
#: A shingle with more than 1/HOT_SHARE of all places is salted; there are fewer than HOT_SHARE of them.
HOT_SHARE = 500
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _GAP), "")


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words) of all windows of all items."""
    split = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("ws")).where("size(ws) > 0")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1)), lambda i: F.slice(F.col("ws"), i, window))
    return split.select("item", F.explode(runs).alias("words")).distinct()


def _shingles(ws: Column, shingle: int) -> Column:
    """(off, shingle) of an array of words, from 0; of fewer words than ``shingle`` all of them."""
    n = F.greatest(F.lit(1), F.size(ws) - shingle + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("off"), F.array_join(F.slice(ws, i + 1, shingle), " ").alias("shingle")))


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """A table of the benchmark's side of n rows, broadcast if these are few enough."""
    return F.broadcast(rows) if n <= BROADCAST else rows


def _met(docs: DataFrame, known: DataFrame, n_known: int, sizes: list[int], shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, pos, sid): a row with pos 0 for each document, and one for each place (from 1) where a shingle
    of ``known`` (shingle, sid) starts. ``sizes``: numbers of words that these have."""
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("ws"))
    # place 0 has no words: it stands for the document itself
    padded = split.select("row", "doc_id", F.size("ws").alias("n_words"), F.concat(F.array(F.lit(None).cast("string")), "ws").alias("ws"))
    names = [f"w{k}" for k in range(shingle)]
    zipped = F.arrays_zip(*[(F.col("ws") if k == 0 else F.slice("ws", k + 1, F.greatest(F.lit(0), F.size("ws") - k))).alias(n) for k, n in enumerate(names)])
    placed = padded.select("row", "doc_id", "n_words", F.posexplode(zipped).alias("pos", "at")).select("row", "doc_id", "n_words", "pos", *[F.col(f"at.{n}").alias(n) for n in names])
    sizes = sizes or [shingle]
    placed = placed.where((F.col("pos") == 0) | F.col(names[sizes[-1] - 1]).isNotNull())
    # a text of the document's own row never equals a shingle, and spreads where rows are dealt by shingle
    own = F.when(F.col("pos") == 0, F.concat(F.lit("-"), F.col("row").cast("string")))
    key = lambda size: F.coalesce(own, F.when(F.col(names[size - 1]).isNotNull(), F.concat_ws(" ", *names[:size])))
    if len(sizes) == 1:
        keyed = placed.withColumn("shingle", key(sizes[0]))
    else:  # the document's own row is needed once
        keyed = placed.withColumn("shingle", F.explode(F.array(key(sizes[0]), *[F.when(F.col("pos") > 0, key(size)) for size in sizes[1:]]))).where("shingle IS NOT NULL")
    rows = keyed.select("row", "doc_id", "n_words", "pos", "shingle")
    return rows.join(_sent(known, n_known), "shingle", "left").where("pos = 0 OR sid IS NOT NULL").select("row", "doc_id", "n_words", "pos", "sid")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, of every row of ``docs``."""
    found = materialize(windows(items, window, item_col, item_text), "windows")
    distinct = found.select("words").distinct().withColumns({"wid": F.monotonically_increasing_id(), "n": F.size("words")})
    distinct = materialize(distinct, "distinct-windows")
    shingles = distinct.select("wid", "n", F.explode(_shingles(F.col("words"), shingle)).alias("s")).select("wid", "n", "s.off", "s.shingle")
    known = materialize(shingles.select("shingle").distinct().withColumn("sid", F.monotonically_increasing_id()), "known-shingles")
    n_known = known.count()
    sizes = sorted((r[0] for r in distinct.select(F.least("n", F.lit(shingle))).distinct().collect()), reverse=True)  # at most ``shingle`` numbers
    parts = materialize(shingles.join(_sent(known, n_known), "shingle").select("wid", "n", "off", "sid"), "window-shingles")
    met = materialize(_met(docs, known, n_known, sizes, shingle, id_col, text_col), "shingles-met")
    places = met.where("pos > 0").select("row", "n_words", "pos", "sid")

    # the rarest shingle of each window; windows with a shingle that no text holds are out
    counts = materialize(places.groupBy("sid").agg(F.count(F.lit(1)).alias("held")), "rarity")
    ranked = parts.join(_sent(counts, n_known), "sid", "left")
    best = Window.partitionBy("wid").orderBy("held", "sid")
    prefix = ranked.withColumns({"r": F.row_number().over(best), "least": F.min(F.coalesce("held", F.lit(0))).over(Window.partitionBy("wid"))})
    prefix = materialize(prefix.where("r = 1 AND least > 0").select("sid", "wid", "n", "off", "held"), "prefixes")
    n_windows = prefix.count()

    start = F.col("pos") - F.col("off")
    if n_windows <= BROADCAST:
        candidates = places.join(F.broadcast(prefix), "sid")
    else:  # the places of a frequent shingle are dealt over as many tasks as they fill, and meet its windows in each
        limit = places.count() // HOT_SHARE + 1
        salts = F.ceil(F.col("held") / limit).cast("int")
        hot = counts.where(F.col("held") > limit).select("sid", salts.alias("salts"))
        salted = places.join(F.broadcast(hot), "sid", "left").withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.coalesce("salts", F.lit(1))).cast("int"))
        candidates = salted.join(prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), ["sid", "salt"])
    candidates = candidates.select("row", "n_words", start.alias("start"), "wid", "n").where("start >= 1 AND start + n - 1 <= n_words")

    # shingles end to end, the last one flush with the window's end, hold each of its words
    covers = parts.where((F.col("off") % shingle == 0) | (F.col("off") == F.col("n") - shingle)).select("wid", "off", "sid")
    needed = materialize(candidates, "candidates").join(_sent(covers, n_known if n_known > BROADCAST else n_windows * (window // shingle + 1)), "wid")
    needed = needed.select("row", "start", "wid", "n", (F.col("start") + F.col("off")).alias("pos"), "sid")
    total = covers.groupBy("wid").agg(F.count(F.lit(1)).alias("covers"))
    held = needed.join(places.select("row", "pos", "sid"), ["row", "pos", "sid"]).groupBy("row", "start", "wid", "n").agg(F.count(F.lit(1)).alias("c"))
    exact = materialize(held.join(_sent(total, n_windows), "wid").where("c = covers").select("row", "start", "wid", "n"), "exact-windows")

    # words that some window covers: what each start adds beyond the ends of those before it
    runs = exact.groupBy("row", "start").agg(F.max("n").alias("n")).withColumn("end", F.col("start") + F.col("n"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    hit = runs.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))))
    hit = hit.groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = found.join(distinct.select("words", "wid"), "words").select("wid", "item")
    of_items = exact.select("row", "wid").distinct().join(named, "wid").select("row", "item").distinct().groupBy("row")
    of_items = of_items.agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    rows = met.where("pos = 0").join(hit, "row", "left").join(of_items, "row", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of ``benchmark`` in all ``documents``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item, array_to_string(ws[i : i + 9], ' ') AS w, least(10, len(ws)) AS n
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM iw WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM win), places AS (
  SELECT r, s.n, unnest(range(1, len(ws) - s.n + 2)) AS i, ws FROM dw, sizes s WHERE len(ws) >= s.n
), hits AS (
  SELECT p.r, p.i, p.n, win.item FROM (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM places) p JOIN win ON win.w = p.w AND win.n = p.n
), covered AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered ON covered.r = dw.r LEFT JOIN items ON items.r = dw.r
"""
