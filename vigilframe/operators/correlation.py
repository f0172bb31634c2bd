"""Processes and their network activity, receipts, queues and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let

#: The special-purpose IPv4 ranges that count as not global (first address, prefix length).
SPECIAL_IPV4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def ipv4_number(address: Column) -> Column:
    """The address as a number, null if it is none."""
    parts = F.split(address, r"\.")
    ok = address.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(ok, sum((F.element_at(parts, k + 1).cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0)))


def is_global_ipv4(address: Column) -> Column:
    def ordinary(number: Column) -> Column:
        special = F.lit(False)
        for block in SPECIAL_IPV4:
            first, bits = block.split("/")
            low = sum(int(x) * 256 ** (3 - k) for k, x in enumerate(first.split(".")))
            special = special | number.between(low, low + 2 ** (32 - int(bits)) - 1)
        return number.isNotNull() & ~special

    return let(ipv4_number(address), ordinary)


#: The special-purpose IPv6 ranges that count as not global, and the parts of them that do, by the first
#: hexadecimal digits of the whole address.
SPECIAL_IPV6 = ("0" * 31 + "1", "0" * 32, "0" * 20 + "ffff", "0064ff9b0001", "0100000000000000", "200100", "200101", "20010db8", "2002", "fc", "fd", "fe8", "fe9", "fea", "feb")
GLOBAL_IPV6 = ("2001000100000000" + "0" * 15 + "1", "2001000100000000" + "0" * 15 + "2", "20010003", "200100040112", "2001002", "2001003")


def ipv6_digits(address: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address (with ``::`` or without), null if it is none."""
    group = r"[0-9a-f]{1,4}"

    def of(a: Column) -> Column:
        groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
        digits = lambda side: F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), "")
        both = lambda sides: F.struct(groups(F.get(sides, F.lit(0))).alias("l"), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("r"))
        given = lambda s: F.size(s["l"]) + F.size(s["r"])
        filled = let(both(F.split(a, "::")), lambda s: F.when(given(s) <= 7, F.concat(digits(s["l"]), F.repeat(F.lit("0000"), 8 - given(s)), digits(s["r"]))))
        return F.when(a.rlike(rf"^{group}(:{group}){{7}}$"), digits(groups(a))).when(a.rlike(rf"^(({group})(:{group})*)?::(({group})(:{group})*)?$"), filled)

    return let(F.lower(F.trim(address)), of)


def _begins(prefixes: tuple[str, ...]) -> str:
    return f"^({'|'.join(prefixes)})"


def is_global_ipv6(address: Column) -> Column:
    return let(ipv6_digits(address), lambda d: d.isNotNull() & (~d.rlike(_begins(SPECIAL_IPV6)) | d.rlike(_begins(GLOBAL_IPV6))))


def is_global(address: Column) -> Column:
    return F.coalesce(F.when(F.contains(address, F.lit(":")), is_global_ipv6(address)).otherwise(is_global_ipv4(address)), F.lit(False))


def attribute_network(creates: DataFrame, network: DataFrame, keys: list[str]) -> DataFrame:
    """Process starts with the first network event of the same process at or after them: (keys, created, network_ts).
    Order of arrival doesn't matter."""
    met = creates.join(network.select(*keys, F.col("ts").alias("network_ts")), keys).where(F.col("network_ts") >= F.col("created"))
    return met.groupBy(*keys, "created").agg(F.min("network_ts").alias("network_ts"), F.count(F.lit(1)).alias("events"))


def unseen(batch: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch whose key the ledger doesn't hold, one of each key (the earliest)."""
    fresh = batch.join(ledger.select(*key), key, "left_anti")
    row = F.struct(*batch.columns)
    return fresh.groupBy(*key).agg(F.min_by(row, F.struct("ts", "event_id")).alias("r")).select("r.*")


def admission(rows: DataFrame, clock: float, baseline_days: int) -> DataFrame:
    """Labels rows as outside_retention, future, historical or live at the collection clock."""
    day0 = (int(clock) // 86400 - baseline_days) * 86400
    ts = F.col("ts")
    return rows.withColumn("admission", F.when(ts < day0, "outside_retention").when(ts > clock + 300, "future").when(ts >= clock - 86400, "live").otherwise("historical"))


def queue_metrics(batches: DataFrame, clock: float) -> DataFrame:
    """Per lane and status: batches, events left, age of the oldest and bytes."""
    return batches.groupBy("lane", "status").agg(F.count(F.lit(1)).alias("batches"), F.sum(F.col("events") - F.col("processed")).alias("pending"), (F.lit(clock) - F.min("collected_at")).alias("oldest_age"), F.sum("bytes").alias("bytes"))


def next_batches(batches: DataFrame) -> DataFrame:
    """The next batch of each shard: live before backfill, oldest first; a failed batch blocks its lane and shard."""
    blocked = batches.where("status = 'failed'").select("lane", "shard").distinct()
    ready = batches.where("status = 'pending'").join(blocked, ["lane", "shard"], "left_anti")
    return ready.groupBy("shard").agg(F.min(F.struct((F.col("lane") != "live").cast("int").alias("l"), "collected_at", "batch_id", "lane")).alias("m")).select("shard", "m.lane", "m.batch_id")


def retained(findings: DataFrame, clock: float, closed_days: int) -> DataFrame:
    """All findings but those closed before the retention; open ones are never deleted."""
    return findings.where(F.col("closed").isNull() | (F.col("closed") >= clock - closed_days * 86400))
