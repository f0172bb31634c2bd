"""The analyst's side: families of repetitive findings, the findings table with filters and order, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, csv_safe, name_shape, shown

#: When findings are a family and how many are shown.
FAMILY_FINDINGS, FAMILY_HOSTS, FAMILIES, VARIANTS = 5, 2, 30, 8
FAMILY_KEY = ["detector", "category", "parent", "location", "shape"]


def consensus(names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pattern): of distinct names with one shape, the first with ``*`` for each run of digits that varies."""
    split = names.select(*keys, F.posexplode(F.expr(r"regexp_extract_all(name, '[0-9]+|[^0-9]+', 0)")).alias("p", "part"))
    parts = split.groupBy(*keys, "p").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    part = F.when((F.col("low") != F.col("high")) & F.col("low").rlike("^[0-9]"), "*").otherwise(F.col("low"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", part.alias("part")))), lambda s: s.getField("part")), "").alias("pattern"))


def families(open_findings: DataFrame) -> DataFrame:
    """Findings (host, detector, category, parent, location, image, first_seen, last_seen) that share a name's shape,
    parent and place: counts, variants, the pattern and whether only versions differ."""
    rows = open_findings.withColumn("name", basename(F.col("image"))).withColumn("shape", name_shape(F.col("image"))).where(F.col("shape").isNotNull())
    grouped = rows.groupBy(*FAMILY_KEY).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("host").alias("hosts"), F.count_distinct("name").alias("variants"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    grouped = grouped.where((F.col("findings") >= FAMILY_FINDINGS) & (F.col("hosts") >= FAMILY_HOSTS))
    patterns = consensus(rows.select(*FAMILY_KEY, "name").distinct(), FAMILY_KEY)
    churn = F.col("shape").contains("{number}") & (F.col("variants") >= 2)
    return grouped.join(patterns, FAMILY_KEY).withColumn("version_churn", churn)


def top_families(found: DataFrame, limit: int = FAMILIES) -> DataFrame:
    return found.orderBy(F.col("findings").desc(), F.col("hosts").desc(), *FAMILY_KEY).limit(limit)


def variant_examples(open_findings: DataFrame, limit: int = VARIANTS) -> DataFrame:
    """The most frequent names of each shape."""
    rows = open_findings.select(basename(F.col("image")).alias("name"), name_shape(F.col("image")).alias("shape")).where("shape IS NOT NULL")
    counts = rows.groupBy("shape", "name").agg(F.count(F.lit(1)).alias("findings"))
    order = Window.partitionBy("shape").orderBy(F.col("findings").desc(), "name")
    return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)


def search(findings: DataFrame, text: str | None = None, detector: str | None = None, category: str | None = None, columns: tuple[str, ...] = ("host", "parent", "image")) -> DataFrame:
    """Findings of a detector and category that hold ``text`` literally, without regard to case, in any of the columns."""
    kept = findings
    if detector:
        kept = kept.where(F.col("detector") == detector)
    if category:
        kept = kept.where(F.col("category") == category)
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        kept = kept.where(hit)
    return kept


def page(findings: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page in a total order."""
    return findings.orderBy(*order).offset(size * number).limit(size)


def trigger() -> Column:
    """What a finding says in one line."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    novelty = (
        F.when(F.col("category") == "rare_application", F.concat(F.lit("Rare application ("), number("app_hosts"), F.lit("/"), number("fleet_hosts"), F.lit(" hosts)")))
        .when(F.col("category") == "rare_launch_relationship", F.concat(F.lit("Rare launch ("), number("pattern_hosts"), F.lit("/"), number("app_hosts"), F.lit(" app hosts)")))
        .otherwise("Unusual local behavior")
    )
    return F.when(F.col("detector") == "DS-EXEC-001", "Remote execution characteristics").when(F.col("detector") == "DS-EXEC-002", "New context + outbound activity").when(F.col("detector") == "DS-NET-001", "Network diversity shift").otherwise(novelty)


#: Columns by which the findings table is ordered.
ORDERS = ("when", "detector", "hostname", "parent", "process", "trigger")


def _sort_keys() -> dict[str, Column]:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    by = (F.col("last_seen"), F.col("detector"), F.col("host_name"), text("parent"), F.coalesce("image", "app", F.lit("")), F.coalesce("category", "detector"))
    return dict(zip(ORDERS, by))


def order_by(column: str, descending: bool) -> list[Column]:
    """The order of the findings table by one of its six columns, ties by id."""
    by = _sort_keys()[column]
    return [by.desc() if descending else by.asc(), F.col("id").asc()]


def first_pages(findings: DataFrame, size: int) -> DataFrame:
    """(sorted_by, descending, id): the first page in each of the six orders, both ways, in one pass over the findings.

    Each finding stands in every order with one of four keys, a time or a text that rises or falls; the others are null. A
    partition sends no more than a page of each order on.
    """
    views = []
    for name, by in _sort_keys().items():
        kind = "at" if name == "when" else "text"
        for down in (False, True):
            keys = [(by if c == (kind, down) else F.lit(None)).cast("double" if c[0] == "at" else "string").alias(f"{c[0]}_{'down' if c[1] else 'up'}") for c in (("at", False), ("at", True), ("text", False), ("text", True))]
            views.append(F.struct(F.lit(name).alias("sorted_by"), F.lit(down).alias("descending"), *keys))
    rows = findings.select("id", F.explode(F.array(*views)).alias("v")).select("id", "v.*")
    order = Window.partitionBy("sorted_by", "descending").orderBy("at_up", F.desc("at_down"), "text_up", F.desc("text_down"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("sorted_by", "descending", "id")


def in_state(findings: DataFrame, status: str = "open") -> DataFrame:
    """Findings of a state, of all states, or (``open``, and for unknown ones) of those that are open."""
    if status == "all":
        return findings
    return findings.where(F.col("state") == status) if status in ("new", "investigating", "malicious", "resolved", "expected") else findings.where(F.col("state").isin("new", "investigating", "malicious"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed digest of a text, in hexadecimal. key: 64 bytes at most."""
    full = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in full)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


#: Places that may be told.
PLACES = ("windows", "program-files", "user-profile", "downloads", "temporary", "network-share", "other", "unknown")


def table_rows(findings: DataFrame, privacy_key: bytes | None = None) -> DataFrame:
    """(id, when, detector, hostname, parent, process, trigger) as shown and exported.

    With a key, hosts are aliases that hold for this key only, times are dates, and paths a place and a file name.
    """
    at = F.timestamp_seconds("last_seen")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    if privacy_key is None:
        when, name = F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.col("host_name")
        process = F.when(has("image"), F.col("image")).when(has("app"), F.concat("app", F.lit(" (path unavailable)"))).otherwise("—")
    else:
        when = F.date_format(at, "yyyy-MM-dd")
        name = F.concat(F.lit("host-"), F.substring(hmac_sha256(privacy_key, F.concat("namespace", F.lit("\0"), "host")), 1, 10))
        place = F.when(F.col("location").isin(*PLACES), F.col("location")).otherwise("unknown")
        last = lambda c: F.regexp_extract(F.translate(F.col(c), "/", "\\"), r"([^\\]*)$", 1)
        leaf = F.when(has("image"), last("image")).otherwise(last("app"))
        process = F.when(has("image") | has("app"), F.concat(place, F.lit("\\"), F.when(leaf == "", "unknown").otherwise(leaf))).otherwise("—")
    return findings.select("id", when.alias("when"), "detector", name.alias("hostname"), shown(F.col("parent")).alias("parent"), process.alias("process"), trigger().alias("trigger"))


#: The head of an export.
HEADERS = ("Last seen (UTC)", "Detector", "Hostname", "Parent", "Process (path)", "Trigger")


def csv_lines(rows: DataFrame) -> DataFrame:
    """(id, line) of ``table_rows``: cells that no spreadsheet takes for a formula, quoted where they need it."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    cells = ["when", "detector", "hostname", "parent", "process", "trigger"]
    return rows.select("id", *[csv_safe(F.col(c)).alias(c) for c in cells]).select("id", F.concat_ws(",", *map(quoted, cells)).alias("line"))


def write_export(findings: DataFrame, path: str, privacy_key: bytes | None = None, most: int = 10_000) -> None:
    """One file with a byte order mark, a head and CRLF line ends; refused beyond ``most`` rows, which bounds its one task."""
    lines = csv_lines(table_rows(bounded(findings, most).orderBy(F.col("last_seen").desc(), "id"), privacy_key))
    head = findings.sparkSession.range(1).select(F.lit("\ufeff" + ",".join(HEADERS)).alias("line"))
    ordered = head.withColumn("o", F.lit(-1).cast("long")).unionByName(lines.select("line", F.monotonically_increasing_id().alias("o")))
    ordered.coalesce(1).sortWithinPartitions("o").select("line").write.option("lineSep", "\r\n").text(path)


def as_json(findings: DataFrame, columns: list[str]) -> DataFrame:
    """(id, json) of each finding."""
    return findings.select("id", F.to_json(F.struct(*columns)).alias("json"))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows, if there are at most ``most`` of them; an export is refused, never cut."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; narrow the filter")
    return rows


def csv_cells(rows: DataFrame) -> DataFrame:
    """All columns as text that no spreadsheet takes for a formula."""
    return rows.select(*[csv_safe(F.col(c).cast("string")).alias(c) for c in rows.columns])


def write_csv(rows: DataFrame, path: str, most: int = 10_000) -> None:
    csv_cells(bounded(rows, most)).write.option("header", True).option("lineSep", "\r\n").csv(path)


def rollup(findings: DataFrame, levels: list[list[str]], host: str = "host") -> DataFrame:
    """(columns of the levels, level, findings, hosts): counts of all levels in one pass over the findings, and no names of hosts.
    A column that a level doesn't have is null there; ``level`` is the level's place."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    asked = [[F.col(c) for c in level] for level in levels]
    counted = findings.groupingSets(asked, *columns).agg(F.grouping_id(*columns).alias("id"), F.count(F.lit(1)).alias("findings"), F.count_distinct(host).alias("hosts"))
    place = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level): k for k, level in enumerate(levels)}
    which = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("id").cast("int")]
    return counted.select(*columns, which.alias("level"), "findings", "hosts")
