"""The store of findings: new evidence of open ones, analysts' decisions, families and what may be expected of them.

A store has (id, namespace, host, detector, context, state, priority, first_seen, last_seen, occurrences, closed) and what
a finding shows (category, app, parent, location, image, flags). A finding is open while it isn't closed; open ones have
their own (host, detector, context). Every operator returns a new store; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, name_shape
from .peers import kept

#: States of open findings, detectors whose findings may be expected, bounds of decisions and of a family.
OPEN = ("new", "investigating", "malicious")
EXPECTABLE = ("DS-BEH-001", "DS-EXEC-002")
DETECTOR = "DS-BEH-001"
SUPPRESS_DAYS = (0, 7, 14, 30)
FAMILY_FINDINGS, FAMILY_HOSTS, FAMILIES, DOMINANT, DOMINANT_OF, MANY_HOSTS = 5, 2, 30, 0.35, 20, 10
KEY = ["host", "detector", "context"]
FAMILY_KEY = ["namespace", "detector", "category", "parent", "location", "flags", "shape"]
DAY = 86400


def is_open() -> Column:
    return F.col("state").isin(*OPEN)


def with_family(findings: DataFrame) -> DataFrame:
    """The findings with name, shape and signature of their family; those without a name have neither."""
    low = lambda c, n: F.substring(F.lower(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown"))), 1, n)
    image = F.coalesce(F.when(F.col("image") != "", F.col("image")), F.col("app"))
    rows = findings.withColumns({"shape": name_shape(image), "name": basename(image), "parent": low("parent", 255), "location": low("location", 32)})
    rows = rows.withColumns({"category": F.substring(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("other")), 1, 80), "flags": F.array_join(F.sort_array("flags"), ",")})
    signature = F.substring(F.sha2(F.concat_ws("\x1f", *FAMILY_KEY), 256), 1, 24)
    return rows.withColumn("signature", F.when(F.col("shape").isNotNull(), signature))


def consensus(names: DataFrame, key: str) -> DataFrame:
    """(key, pattern): of distinct names with one shape, the first with ``*`` for each run of digits that varies."""
    split = names.select(key, F.posexplode(F.expr(r"regexp_extract_all(name, '[0-9]+|[^0-9]+', 0)")).alias("p", "part"))
    parts = split.groupBy(key, "p").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    part = F.when((F.col("low") != F.col("high")) & F.col("low").rlike("^[0-9]"), "*").otherwise(F.col("low"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", part.alias("part")))), lambda s: s.getField("part")), "").alias("pattern"))


def families(findings: DataFrame) -> DataFrame:
    """Families of open findings, with what an analyst has to know before reviewing one. ``findings``: a store."""
    # one pass over the findings: all that follows reads one row for each (family, host, name); the signature stands for its key
    rows = with_family(findings.where(is_open())).where("signature IS NOT NULL").groupBy("signature", "host", "name").agg(
        *[F.first(c).alias(c) for c in FAMILY_KEY], F.count(F.lit(1)).alias("findings"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.count_if(F.col("priority") == "high").alias("high"), F.count_if(F.col("state") == "malicious").alias("malicious"), F.count_if(F.col("state") == "investigating").alias("investigating"),
    )
    rows = kept(rows)
    most = lambda what: rows.groupBy("signature", what)
    hosts = most("host").agg(F.lit(1).alias("one")).groupBy("signature").agg(F.count(F.lit(1)).alias("hosts"))
    names = most("name").agg(F.lit(1).alias("one")).select("signature", "name")
    found = rows.groupBy("signature").agg(
        *[F.first(c).alias(c) for c in FAMILY_KEY], F.sum("findings").alias("findings"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *[F.sum(c).alias(c) for c in ("high", "malicious", "investigating")]
    )
    found = found.where(F.col("findings") >= FAMILY_FINDINGS).join(hosts.where(F.col("hosts") >= FAMILY_HOSTS), "signature").join(names.groupBy("signature").agg(F.count("name").alias("variants")), "signature")
    names = names.join(found.select("signature"), "signature", "left_semi")
    return found.join(consensus(names, "signature"), "signature").withColumn("version_churn", F.contains("shape", F.lit("{number}")) & (F.col("variants") >= 2))


def snapshot(findings: DataFrame, limit: int = FAMILIES) -> DataFrame:
    """The largest families with their share of all open findings and the signals of their quality."""
    total = findings.where(is_open()).agg(F.count(F.lit(1)).alias("total"))  # one row
    top = families(findings).orderBy(F.col("findings").desc(), F.col("hosts").desc(), "signature").limit(limit).crossJoin(F.broadcast(total))
    share = F.round(F.col("findings") / F.greatest(F.col("total"), F.lit(1)), 4)
    signals = F.array(
        F.when(F.col("version_churn"), "filename-version-churn"),
        F.when(F.col("hosts") >= MANY_HOSTS, "multi-host-repetition"),
        F.when((share >= DOMINANT) & (F.col("total") >= DOMINANT_OF), "dominates-findings-stream"),
    )
    return top.withColumn("share", share).withColumn("signals", F.array_join(F.array_compact(signals), ",")).drop("total")


def family_page(findings: DataFrame, signature: str, number: int = 0, size: int = 75) -> DataFrame:
    """A page of a family's open findings, the latest first."""
    rows = with_family(findings.where(is_open())).where(F.col("signature") == signature)
    return rows.orderBy(F.col("last_seen").desc(), "id").offset(size * number).limit(size)


def review(findings: DataFrame, reviews: DataFrame, clock: float, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applies ``reviews`` (signature, suppress_days) of families: (decisions, the store after them, expectations).

    New findings of a family that aren't of high priority become expected. A review that also asks for future findings to
    be expected is refused for other detectors than the novelty detector, and for families with findings of high
    priority, malicious or under investigation; then nothing of the family changes. ``known``: the families, where the caller
    has them already.
    """
    known = (families(findings) if known is None else known).select("signature", "namespace", "detector", "pattern", "high", "malicious", "investigating")
    asked = reviews.groupBy("signature").agg(F.max("suppress_days").alias("suppress_days")).join(known, "signature", "left")
    suppresses = F.col("suppress_days") > 0
    decision = (
        F.when(~F.col("suppress_days").isin(*SUPPRESS_DAYS), "refused_duration")
        .when(F.col("detector").isNull(), "refused_unknown_family")
        .when(suppresses & (F.col("detector") != DETECTOR), "refused_detector")
        .when(suppresses & ((F.col("high") > 0) | (F.col("malicious") > 0)), "refused_malicious_or_high")
        .when(suppresses & (F.col("investigating") > 0), "refused_investigating")
        .otherwise("reviewed")
    )
    decided = asked.withColumn("decision", decision)
    done = decided.where("decision = 'reviewed'")
    signed = with_family(findings.select("*", F.struct(*findings.columns).alias("__f"))).select("__f.*", "signature")  # as stored, with the signature beside it
    changes = F.coalesce("reviewed", F.lit(False)) & (F.col("state") == "new") & (F.col("priority") != "high")
    joined = signed.join(done.select("signature", F.lit(True).alias("reviewed")), "signature", "left").drop("signature").withColumn("changed", changes)
    after = joined.withColumns({"state": F.when(F.col("changed"), "expected").otherwise(F.col("state")), "closed": F.when(F.col("changed"), F.lit(clock)).otherwise(F.col("closed"))})
    expected = done.where(suppresses).select("signature", "namespace", "detector", "pattern", (F.lit(clock) + F.col("suppress_days") * DAY).alias("expires"))
    return decided.select("signature", "suppress_days", "decision"), after.drop("reviewed"), expected


def revoke(expectations: DataFrame, revoked: DataFrame, key: list[str]) -> DataFrame:
    """Expectations without the revoked ones."""
    return expectations.join(revoked.select(*key), key, "left_anti")


def merge(findings: DataFrame, fresh: DataFrame, expectations: DataFrame, family_expectations: DataFrame, clock: float) -> DataFrame:
    """The store after a run: one row of ``fresh`` for each (host, detector, context).

    Where a finding of that key is open, its last time and its occurrences grow and its evidence stays. Else the novelty
    detector's findings that aren't of high priority are taken for expected where their family is, those of detectors that
    allow it where the host's own expectation holds; all others are added as new.
    """
    more = fresh.select(*KEY, F.col("last_seen").alias("__last"), F.col("occurrences").alias("__more"))
    opened = is_open()
    grown = findings.where(opened).join(more, KEY, "left").withColumns({"last_seen": F.greatest("last_seen", "__last"), "occurrences": F.col("occurrences") + F.coalesce("__more", F.lit(0))}).drop("__last", "__more")
    unknown = fresh.join(findings.where(opened).select(*KEY), KEY, "left_anti")
    active = family_expectations.where(F.col("expires") > clock).select("signature").distinct().withColumn("__expected", F.lit(True))
    marked = with_family(unknown).select("id", "signature").join(active, "signature").select("id", "__expected")
    unknown = unknown.join(marked, "id", "left").where(~(F.coalesce("__expected", F.lit(False)) & (F.col("detector") == DETECTOR) & (F.col("priority") != "high"))).drop("__expected")
    holds = expectations.where((F.col("created") <= clock) & (F.col("expires") > clock) & ~F.col("revoked")).select(*KEY).distinct().where(F.col("detector").isin(*EXPECTABLE))
    unknown = unknown.join(holds, KEY, "left_anti")
    return grown.unionByName(findings.where(~opened)).unionByName(unknown.select(*findings.columns))


def change_states(findings: DataFrame, changes: DataFrame, clock: float) -> DataFrame:
    """The store with ``outcome`` after analysts' ``changes`` (id, to): to resolve closes a finding; any other state opens
    it, unless another finding of its key is open. Findings without a change have no outcome."""
    opened = findings.where(is_open()).groupBy(*KEY).agg(F.count(F.lit(1)).alias("open_now"))
    rows = findings.join(changes.select("id", "to"), "id", "left").join(opened, KEY, "left")
    others = F.coalesce("open_now", F.lit(0)) - is_open().cast("int")
    outcome = F.when(F.col("to").isNull(), F.lit(None)).when(~F.col("to").isin("new", "investigating", "resolved", "malicious"), "refused_state").when((F.col("to") != "resolved") & (others > 0), "refused_open").otherwise("changed")
    rows = rows.withColumn("outcome", outcome)
    changed = F.coalesce(F.col("outcome") == "changed", F.lit(False))
    closed = F.when(changed & (F.col("to") == "resolved"), F.lit(clock)).when(~changed, F.col("closed"))
    return rows.withColumns({"closed": closed, "state": F.when(changed, F.col("to")).otherwise(F.col("state"))}).drop("to", "open_now")


def expect(findings: DataFrame, asked: DataFrame, clock: float) -> tuple[DataFrame, DataFrame]:
    """(the store, expectations) after analysts expect findings: ``asked`` (id, days). Malicious findings and detectors that
    don't allow it are left alone, as are durations of less than a day or more than 90."""
    ok = F.col("detector").isin(*EXPECTABLE) & (F.col("state") != "malicious") & F.col("days").between(1, 90)
    rows = findings.join(asked.select("id", "days"), "id", "left").withColumn("__ok", F.coalesce(ok, F.lit(False)))
    made = rows.where("__ok").select(*KEY, F.lit(clock).alias("created"), (F.lit(clock) + F.col("days") * DAY).alias("expires"), F.lit(False).alias("revoked"))
    after = rows.withColumns({"state": F.when(F.col("__ok"), "expected").otherwise(F.col("state")), "closed": F.when(F.col("__ok"), F.lit(clock)).otherwise(F.col("closed"))})
    return after.drop("__ok", "days"), made


def state_counts(findings: DataFrame, detector: str, clock: float) -> DataFrame:
    """(state, findings, recent): of one detector, all and those of the last seven days."""
    return findings.where(F.col("detector") == detector).groupBy("state").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("first_seen") >= clock - 7 * DAY).alias("recent"))


def latest_of_each(findings: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The latest findings of each host (or other key)."""
    order = Window.partitionBy(key).orderBy(F.col("last_seen").desc(), "id")
    return findings.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
