"""Registrable domains by a table of public suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are sent to every task, at most; a larger table is dealt by rule.
BROADCAST = 100_000


def registrable(names: DataFrame, rules: DataFrame, name: str = "domain", rule: str = "rule") -> DataFrame:
    """(name, registrable) of each distinct name.

    ``rules`` are suffixes, ``*.suffix`` for any one label before it, and ``!name`` for names that such a rule doesn't mean. The
    longest rule that matches is the public suffix, an exception goes before all; the registrable domain is that and the label
    before it. Names that no rule matches, or that are a public suffix themselves, stay whole: the last two labels are never
    guessed. Names and rules are compared in lower case without dots at the end; names in other scripts match rules that are
    written as they are. Null stays null. Each name is looked up by its own suffixes, so nothing is joined by pattern.
    """
    known = rules.select(F.lower(F.trim(rule)).alias("key")).where("key IS NOT NULL AND key <> ''").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST else known
    labels = F.split(F.regexp_replace(F.lower(F.col(name)), r"\.+$", ""), r"\.")
    each = names.select(name).distinct().withColumn("labels", labels)
    tail = lambda i: F.array_join(F.slice("labels", i + 1, F.size("labels")), ".")
    placed = each.where(F.col(name).isNotNull()).select(name, "labels", F.explode(F.sequence(F.lit(0), F.size("labels") - 1)).alias("i"))
    keys = F.array(F.struct(tail(F.col("i")).alias("key"), F.lit(False).alias("exception")), F.struct(F.concat(F.lit("*."), tail(F.col("i") + 1)).alias("key"), F.lit(False).alias("exception")), F.struct(F.concat(F.lit("!"), tail(F.col("i"))).alias("key"), F.lit(True).alias("exception")))
    hits = placed.select(name, "i", F.inline(keys)).join(known, "key", "left_semi")
    best = hits.groupBy(name).agg(F.min(F.when(F.col("exception"), F.col("i"))).alias("own"), F.min(F.when(~F.col("exception"), F.col("i"))).alias("suffix"))
    start = F.greatest(F.lit(0), F.coalesce("own", F.col("suffix") - 1, F.lit(0)))
    return each.join(best, name, "left").select(name, tail(start).alias("registrable"))
