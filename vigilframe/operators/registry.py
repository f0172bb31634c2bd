"""The catalogue of discovered groups and the registry of approved ones, carried from run to run.

A run's groups are two tables: (fingerprint, id, namespace, suitability, size, ...) and members (fingerprint, host). A group
is recognised by its fingerprint, which is made of its namespace and what sets it apart. The registry holds (label, kind,
status, fingerprint, suitability, maturity, partial, size, updated_at); cohorts are (host, namespace, cohort). Every function
takes such tables and returns new ones; none changes what a person decided by hand.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import peers
from .profiles import CHANNEL_WEIGHTS

#: The cohort of hosts without one, names that labels may have, fingerprints of rejections that are kept.
NONE, LABEL, REJECTIONS, SAMPLES = "unassigned", r"[a-z0-9_-]{1,80}", 500, 8
REGISTRY = "label string, kind string, status string, fingerprint string, suitability string, maturity string, partial boolean, size long, actor string, updated_at double"
#: Columns of a registered group that a later run renews.
RENEWED = ("suitability", "maturity", "partial", "size")
#: Why a group is recommended as peers, or isn't.
REASONS = {
    "recommended": "Broad application-footprint similarity with support from another behavioral view.",
    "applications": "Narrow software similarity; broader behavioral agreement is insufficient for detector peers.",
    "other": "Strong narrow technical similarity, but insufficient multi-view agreement for detector peers.",
}


def slug(label: str) -> str:
    """The label, lower case and without white space around it, if it may be one."""
    value = str(label).strip().lower()
    if not re.fullmatch(LABEL, value) or value == NONE:
        raise ValueError(f"Use 1-80 lowercase letters, numbers, - or _; {NONE} is reserved")
    return value


def described(members: DataFrame, explained: DataFrame, scores: DataFrame, observed: DataFrame, names: DataFrame, namespace: str, partial: bool) -> DataFrame:
    """The catalogue rows of groups of both kinds: ``members`` (component, host, suitability, cohesion), where technical clusters
    bring their cohesion and recommended groups take their overall similarity.

    Groups without an explanation have no row; two components of one fingerprint are one group, the recommended one, then
    the larger. ``names``: (host, name), of which the first SAMPLES are kept (by a bounded rank, not by collecting)."""
    six = explained.where("r <= 6").groupBy("component").agg(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(":", "channel", "feature").alias("f")))).alias("f"))
    mark = six.select("component", F.sha2(F.concat(F.lit(namespace + "\n"), F.array_join("f.f", "\n")), 256).alias("fingerprint"))
    kinds = members.groupBy("component").agg(F.max("suitability").alias("suitability"), F.max("cohesion").alias("technical"))
    days = members.join(observed, "host").groupBy("component").agg(F.percentile("observed_days", 0.5).cast("int").alias("observed_days"), F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("component").orderBy("name", "host")
    ranked = members.select("component", "host").join(names, "host").withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLES)
    samples = ranked.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("sample_clients"))
    rows = days.join(mark, "component").join(kinds, "component").join(scores, "component").join(samples, "component", "left")
    provisional = F.lit(partial) | (F.col("observed_days") < 3)
    maturity = F.when(provisional, "provisional").when(F.col("observed_days") < 7, "growing").otherwise("stable")
    recommended = F.col("suitability") == "recommended"
    cohesion = F.when(recommended, F.col("overall")).otherwise(F.coalesce(F.when(F.col("technical") != 0, F.col("technical")), F.col("overall")))
    largest = F.greatest(*map(F.col, CHANNEL_WEIGHTS))
    dominant = F.coalesce(*[F.when(F.col(c) == largest, c) for c in CHANNEL_WEIGHTS])
    rows = rows.withColumns({"maturity": maturity, "cohesion": cohesion, "dominant_channel": dominant, "partial": F.lit(partial), "namespace": F.lit(namespace)})
    confidence = F.least(F.lit(1.0), F.col("cohesion") * F.least(F.lit(1.0), F.greatest(F.lit(1), F.col("observed_days")) / 7) * F.least(F.lit(1.0), F.col("size") / 15))
    reason = F.when(recommended, REASONS["recommended"]).when(F.col("dominant_channel") == "applications", REASONS["applications"]).otherwise(REASONS["other"])
    one = Window.partitionBy("fingerprint").orderBy(~recommended, F.col("size").desc(), "component")
    rows = rows.withColumns({"confidence": confidence, "reason": reason, "k": F.row_number().over(one)}).where("k = 1")
    return rows.select(
        "component", "fingerprint", F.substring("fingerprint", 1, 12).alias("id"), "namespace", "suitability", "reason", "size", "observed_days", "maturity", "partial", "cohesion", "confidence", "dominant_channel", "overall", *CHANNEL_WEIGHTS, "sample_clients",
    )


def _approved(registry: DataFrame) -> DataFrame:
    """(fingerprint, label) of approved automatic groups; of two labels for one fingerprint the last."""
    own = registry.where("kind = 'auto' AND status = 'approved' AND fingerprint IS NOT NULL")
    return own.groupBy("fingerprint").agg(F.max("label").alias("label"))


def _follow(cohorts: DataFrame, wanted: DataFrame, automatic: DataFrame, renewed: DataFrame) -> DataFrame:
    """Cohorts once their hosts follow ``wanted`` (host, namespace, label).

    A host without a cohort or in an automatic one goes where it is wanted; one that is in a group of ``renewed`` labels and is
    no longer wanted leaves it; cohorts that a person gave stay."""
    marked = cohorts.join(automatic.withColumnsRenamed({"label": "cohort"}).select("cohort", F.lit(True).alias("auto")), "cohort", "left")
    marked = marked.join(renewed.withColumnsRenamed({"label": "cohort"}).select("cohort", F.lit(True).alias("renewed")), "cohort", "left")
    marked = marked.join(wanted, ["host", "namespace"], "left")
    free = (F.col("cohort") == NONE) | F.col("auto")
    after = F.when(F.col("label").isNotNull() & free, F.col("label")).when(F.col("label").isNull() & F.col("renewed"), NONE).otherwise(F.col("cohort"))
    return marked.select("host", "namespace", after.alias("cohort"))


def refresh(registry: DataFrame, rejected: DataFrame, cohorts: DataFrame, groups: DataFrame, members: DataFrame, clock: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, cohorts, suggestions) after a run that found ``groups``.

    A group whose fingerprint is approved renews its registry row, and its hosts follow it; where a host is in several
    such groups the last in the catalogue's order decides (recommended before technical, then larger, then by id). Other groups
    are suggested unless they are rejected (fingerprint). Approved groups that the run doesn't find stay as they are."""
    approved = _approved(registry)
    found = groups.join(approved, "fingerprint")
    rank = F.struct(F.col("suitability") != "recommended", -F.col("size"), F.col("id"))
    # the namespace is the group's: hosts of another one never follow it
    placed = members.join(found.select("fingerprint", "namespace", "label", rank.alias("rank")), "fingerprint")
    wanted = placed.groupBy("host", "namespace").agg(F.max_by("label", "rank").alias("label"))
    automatic = registry.where("kind = 'auto'").select("label").distinct()
    after = _follow(cohorts, wanted, automatic, found.select("label").distinct())
    new = found.select("label", *[F.col(c).alias(f"new_{c}") for c in RENEWED])
    renewed = registry.join(new, "label", "left")
    hit = F.col("new_size").isNotNull()
    renewed = renewed.select(*[F.when(hit, F.lit(clock)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in RENEWED else c for c in registry.columns])
    suggestions = groups.join(approved, "fingerprint", "left_anti").join(rejected.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return renewed, after, suggestions


def approve(registry: DataFrame, cohorts: DataFrame, suggestions: DataFrame, members: DataFrame, identifier: str, label: str, actor: str, clock: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, cohorts, suggestions) once a suggestion has got a label. Its hosts without a cohort or in an automatic one
    join it. A label of a group made by hand, or of a cohort that isn't registered, is refused."""
    label = slug(label)
    group = suggestions.where(F.col("id") == identifier)
    if group.isEmpty():
        raise ValueError("Peer-group suggestion no longer exists; refresh and review the current suggestions")
    known = registry.where(F.col("label") == label)
    if not known.where("kind <> 'auto'").isEmpty():
        raise ValueError("That peer-group label already exists")
    if known.isEmpty() and not cohorts.where(F.col("cohort") == label).isEmpty():
        raise ValueError("That cohort label already exists; choose another name")
    row = group.select(F.lit(label).alias("label"), F.lit("auto").alias("kind"), F.lit("approved").alias("status"), "fingerprint", *RENEWED, F.lit(actor).alias("actor"), F.lit(clock).alias("updated_at"))
    wanted = members.join(group.select("fingerprint", "namespace"), "fingerprint").select("host", "namespace", F.lit(label).alias("label")).distinct()
    after = _follow(cohorts, wanted, registry.where("kind = 'auto'").select("label").distinct(), registry.limit(0).select("label"))
    return registry.where(F.col("label") != label).unionByName(row), after, suggestions.where(F.col("id") != identifier)


def reject(rejected: DataFrame, suggestions: DataFrame, identifier: str, clock: float) -> tuple[DataFrame, DataFrame]:
    """(rejected, suggestions) once a suggestion is turned down. The last REJECTIONS fingerprints (fingerprint, at) are kept."""
    group = suggestions.where(F.col("id") == identifier)
    if group.isEmpty():
        raise ValueError("Peer-group suggestion no longer exists")
    every = rejected.unionByName(group.select("fingerprint", F.lit(clock).alias("at"))).groupBy("fingerprint").agg(F.min("at").alias("at"))
    return every.orderBy(F.col("at").desc(), "fingerprint").limit(REJECTIONS), suggestions.where(F.col("id") != identifier)


def create(registry: DataFrame, label: str, actor: str, clock: float) -> DataFrame:
    """The registry with a group that is made by hand."""
    label = slug(label)
    if not registry.where(F.col("label") == label).isEmpty():
        raise ValueError("That peer-group label already exists")
    row = registry.sparkSession.createDataFrame([(label, "manual", "approved", None, "manual", "manual", False, None, actor, clock)], REGISTRY)
    return registry.unionByName(row)


def catalogued(registry: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(label, kind, status): registered groups, and cohorts that hosts have without being registered (made by hand)."""
    others = cohorts.where(F.col("cohort") != NONE).select(F.col("cohort").alias("label")).distinct().join(registry, "label", "left_anti")
    return registry.select("label", "kind", "status").unionByName(others.select("label", F.lit("manual").alias("kind"), F.lit("approved").alias("status")))


def assign(cohorts: DataFrame, registry: DataFrame, hosts: DataFrame, label: str) -> DataFrame:
    """Cohorts once ``hosts`` (host, namespace) are in the group of that label, or in none."""
    label = str(label).strip().lower()
    if label != NONE:
        label = slug(label)
        if catalogued(registry, cohorts).where(F.col("label") == label).isEmpty():
            raise ValueError("Select an existing peer group or create it first")
    chosen: Column = F.coalesce(F.col("chosen"), F.lit(False))
    marked = cohorts.join(hosts.select("host", "namespace").distinct().withColumn("chosen", F.lit(True)), ["host", "namespace"], "left")
    return marked.select("host", "namespace", F.when(chosen, label).otherwise(F.col("cohort")).alias("cohort"))


def suppressing(registry: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(label, suppressing) of all labels that hosts may have."""
    rows = catalogued(registry, cohorts).join(registry.select("label", "suitability", "maturity", "partial"), "label", "left")
    judged = peers.may_suppress(rows.withColumns({"origin": F.col("kind"), "approved": F.col("status") == "approved"}))
    return judged.select("label", "suppressing")
