"""Raw records made of the driver's events, in all layouts, through the normalizer; and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import payloads

DAY0 = 1_700_000_000


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Events as records of process starts, connections and DNS questions; some of them broken. A file of events has few row
    groups, and a record takes far longer to read than an event, so the events are dealt out first."""
    k = F.col("k")
    n = F.col("event_id")
    text = lambda c: F.coalesce(c, F.lit("")).cast("string")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    events = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")  # a number, or small shuffles would be put together again
    return events.select(
        "event_id", (n % 5).cast("int").alias("layout"), F.element_at(F.array(*map(F.lit, [1, 3, 22, 7])), (k % 4 + 1).cast("int")).alias("kind"), F.concat(F.lit("PC-"), F.col("user_id"), F.lit(".Example.")).alias("computer"),
        (F.lit(DAY0) + n).cast("string").alias("time"), F.concat(F.lit("C:\\Windows\\Temp\\"), "event_type", F.lit(".EXE")).alias("image"), F.concat(F.lit("C:\\x\\Parent"), (k % 5).cast("string"), F.lit(".exe")).alias("parent"),
        F.concat(F.lit("run -enc abc https://h/"), text(k)).alias("command"), F.when(k % 9 == 0, "nowhere").otherwise(F.concat(F.lit("8.8.4."), (k % 200).cast("string"))).alias("ip"), (n % 70000).cast("string").alias("port"),
        F.when(k % 11 == 2, "two words.example").otherwise(F.concat(F.lit("Host"), (n % 50).cast("string"), F.lit(".Example."))).alias("query"), F.when(k % 17 == 5, "Other-Provider").otherwise("Microsoft-Windows-Sysmon").alias("provider"),
        F.concat(F.lit("{0000abcd-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"), F.lit("}")).alias("guid"),
    )


NAMES = {"ProcessGuid": "guid", "Image": "image", "ParentImage": "parent", "CommandLine": "command", "DestinationIp": "ip", "DestinationPort": "port", "QueryName": "query"}


def raw(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, record): flat JSON, nested JSON, winlog JSON, XML and rendered text in turn."""
    rows = _fields(spark, d)
    kind = F.col("kind").cast("string")
    named = [F.col(c).alias(n) for n, c in NAMES.items()]
    flat = F.to_json(F.struct(F.col("provider").alias("Provider"), kind.alias("EventID"), F.col("computer").alias("Computer"), F.col("time").alias("UtcTime"), *named))
    system = F.struct(F.struct(F.col("provider").alias("@Name")).alias("Provider"), F.struct(kind.alias("#text")).alias("EventID"), F.col("computer").alias("Computer"), F.struct(F.col("time").alias("@SystemTime")).alias("TimeCreated"))
    data = F.struct(F.array(*[F.struct(F.lit(n).alias("Name"), F.col(c).alias("_value")) for n, c in NAMES.items()]).alias("Data"))
    nested = F.to_json(F.struct(F.struct(system.alias("System"), data.alias("EventData")).alias("Event")))
    winlog = F.to_json(F.struct(F.struct(F.struct(*named).alias("event_data"), kind.alias("event_id"), F.col("computer").alias("computer_name"), F.col("provider").alias("provider_name")).alias("winlog"), F.col("time").alias("timestamp")))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="'), "provider", F.lit('"/><EventID>'), kind, F.lit('</EventID><TimeCreated SystemTime="'), "time", F.lit('"/><Computer>'), "computer",
        F.lit("</Computer></System><EventData>"), *[F.concat(F.lit(f'<Data Name="{n}">'), c, F.lit("</Data>")) for n, c in NAMES.items()], F.lit("</EventData></Event>"),
    )
    text = F.concat_ws("\n", F.concat(F.lit("Provider: "), "provider"), F.concat(F.lit("EventID: "), kind), F.concat(F.lit("Computer: "), "computer"), F.concat(F.lit("UtcTime: "), "time"), *[F.concat(F.lit(f"{n}: "), c) for n, c in NAMES.items()])
    layout = F.col("layout")
    return rows.select("event_id", F.when(layout == 0, flat).when(layout == 1, nested).when(layout == 2, winlog).when(layout == 3, xml).otherwise(text).alias("record"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return payloads.normalize(raw(spark, d).withColumnRenamed("event_id", "n"))


def raw_accepted(spark: SparkSession, d: str) -> DataFrame:
    rows = _normalized(spark, d).where("status = 'accepted'")
    return rows.select("n", "host", "event_id", F.col("ts").cast("long").alias("ts"), "guid", "app", "parent", "location", "destination", "port", "query", F.coalesce("flags.encoded_argument", F.lit(False)).alias("encoded"), F.coalesce("flags.remote_reference", F.lit(False)).alias("remote"))


def raw_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select("n", "status", "reason")


def raw_report(spark: SparkSession, d: str) -> DataFrame:
    return payloads.report(_normalized(spark, d))


def raw_malformed(spark: SparkSession, d: str) -> DataFrame:
    return payloads.malformed_groups(payloads.normalize(raw(spark, d).where("event_id % 5 = 0").withColumnRenamed("event_id", "n"))).select("reason", "n", F.size("samples").alias("samples"))


def raw_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Records in payloads of up to ten: lists, results, lines and XML collections by the tens' rest; how many come out."""
    rows = raw(spark, d).where("event_id % 5 IN (0, 3)").withColumn("payload", (F.col("event_id") / 50).cast("long"))
    json, xml = rows.where("event_id % 5 = 0"), rows.where("event_id % 5 = 3")
    records = F.sort_array(F.collect_list("record"))
    lists = json.groupBy("payload").agg(records.alias("r"))
    form = F.col("payload") % 3
    listed = F.concat(F.lit("["), F.array_join("r", ","), F.lit("]"))
    value = F.when(form == 0, listed).when(form == 1, F.concat(F.lit('{"results": '), listed, F.lit("}"))).otherwise(F.array_join("r", "\n"))
    events = xml.groupBy("payload").agg(records.alias("r")).select((-F.col("payload") - 1).alias("payload"), F.concat(F.lit("<Events>"), F.array_join("r", ""), F.lit("</Events>")).alias("value"))
    every = lists.select("payload", value.alias("value")).unionByName(events)
    return payloads.records(every).groupBy("payload").agg(F.count(F.lit(1)).alias("records"))


def _deep(spark: SparkSession, d: str) -> DataFrame:
    """(n, record): events below 3 to 62 layers of other names, lists in between; some hold more layers than are read."""
    rows = _fields(spark, d)
    n = F.col("event_id")
    layers = (3 + n % 60).cast("int")
    named = [F.struct(F.struct(F.lit(name).alias("Name")).alias("@"), F.col(c).alias("value")) for name, c in NAMES.items()]
    kind = F.struct(F.struct(F.col("kind").cast("string").alias("#text")).alias("EventID"))
    inner = F.to_json(F.struct(F.struct(F.col("provider").alias("@Name")).alias("Provider"), F.lit("not an id").alias("Id2"), F.struct(F.col("time").alias("@SystemTime")).alias("TimeCreated"), kind.alias("ids"), F.col("computer").alias("Computer"), F.array(*named).alias("rows")))
    lists = F.when(layers.between(8, 50), layers % 4).otherwise(0).cast("int")  # each list is a layer too
    text = F.concat(F.repeat(F.lit('{"layer":'), layers - 3 - lists), F.repeat(F.lit("["), lists), inner, F.repeat(F.lit("]"), lists), F.repeat(F.lit("}"), layers - 3 - lists))
    deeper = F.concat(F.repeat(F.lit('{"layer":'), F.lit(70)), inner, F.repeat(F.lit("}"), F.lit(70)))
    return rows.select(n.alias("n"), F.when(n % 101 == 0, deeper).otherwise(text).alias("record"))


def raw_deep(spark: SparkSession, d: str) -> DataFrame:
    """Observations of records in which every field lies below layers that no adapter knows."""
    rows = payloads.normalize(_deep(spark, d), search_deep=True)
    return rows.select("n", "status", "reason", "host", F.coalesce("event_id", F.lit(0)).alias("event_id"), F.coalesce(F.col("ts").cast("long"), F.lit(0)).alias("ts"), "guid", "app", "parent")


#: What the query below breaks, by the rest of the event's number by 17.
BROKEN = [
    "accepted", "invalid: empty record", "invalid: unsafe or oversized XML", "invalid: JSON nested too deeply", "invalid: malformed JSON", "ignored: other provider", "ignored: other channel", "ignored: known other event of the flat dialect",
    "invalid: no event id", "ignored: other event", "invalid: no endpoint", "invalid: no time in range", "invalid: destination", "invalid: query name", "accepted", "invalid: no event id", "accepted",
]


def raw_every_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Each verdict: whole records but for one thing. The last three are the flat dialect: an id inferred from the task, one
    that the payload doesn't bear out, and one from a symbol."""
    rows = _fields(spark, d)
    n = F.col("event_id")
    case = (n % 17).cast("int")
    is_ = lambda *k: case.isin(*k)
    unless = lambda cond, c: F.when(~cond, c)
    flat = is_(7, 14, 15, 16)
    fields = {
        "Provider": F.when(is_(5), "Other").when(~is_(6) & ~flat, "Microsoft-Windows-Sysmon"),
        "Channel": F.when(is_(6), "Application").when(flat, "Microsoft-Windows-Sysmon/Operational"),
        "EventID": F.when(is_(9), "7").when(is_(12), "3").when(is_(13), "22").when(~is_(8) & ~flat, "1"),
        "Computer": F.when(is_(10), "two words").otherwise(F.col("computer")),
        "UtcTime": F.when(is_(11), "soon").otherwise(F.col("time")),
        "sourceMachineID": F.when(flat, F.col("computer")), "Name": F.when(flat, "'Microsoft-Windows-Sysmon'"), "Guid": F.when(flat, "{5770385f-c22a-43e0-bf4c-06f5698ffbd9}"), "SystemTime": F.when(flat, F.col("time")), "EventRecordID": F.when(flat, n.cast("string")),
        "Task": F.when(is_(7), "11").when(is_(14), "1").when(is_(15), "3").when(is_(16), "255"), "ID": F.when(is_(16), "DNS_QUERY"),
        "ProcessGuid": F.col("guid"), "Image": F.col("image"), "ParentImage": F.col("parent"),
        "TargetFilename": F.when(is_(7), "x"), "CreationUtcTime": F.when(is_(7), "y"),
        "DestinationIp": F.when(is_(12), "nowhere"), "DestinationPort": F.when(is_(12), "443"),
        "QueryName": F.when(is_(13), "two words.example").when(is_(16), F.col("query")),
    }
    whole = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    deep = F.concat(F.repeat(F.lit('{"a":'), F.lit(65)), F.lit("1"), F.repeat(F.lit("}"), F.lit(65)))
    xml = F.concat(F.lit('<!DOCTYPE x [<!ENTITY e "'), "computer", F.lit('">]><Event/>'))
    record = F.when(is_(1), "  ").when(is_(2), xml).when(is_(3), deep).when(is_(4), F.concat(whole, F.lit("{"))).otherwise(whole)
    found = payloads.normalize(rows.select(n.alias("n"), F.when(is_(4), F.substring(whole, 1, 40)).otherwise(record).alias("record")))
    return found.select("n", "status", "reason", F.coalesce("event_id", F.lit(0)).alias("event_id"), F.size(F.coalesce("warnings", F.array())).alias("warnings"))


QUERIES = {f.__name__: f for f in (raw_accepted, raw_verdicts, raw_report, raw_malformed, raw_payloads, raw_deep, raw_every_verdict)}

_RAW = f"""r AS (SELECT event_id AS n, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
f AS (
  SELECT *, [1, 3, 22, 7][k % 4 + 1] AS kind, {DAY0} + n AS ts, k % 9 = 0 AS bad_ip, k % 11 = 2 AS bad_query, k % 17 = 5 AS other, 'host' || (n % 50) || '.example' AS query, n % 70000 AS port FROM r
),
v AS (
  SELECT *, CASE WHEN other THEN 'ignored: other provider' WHEN kind = 7 THEN 'ignored: other event' WHEN kind = 3 AND (bad_ip OR port > 65535) THEN 'invalid: destination' WHEN kind = 22 AND bad_query THEN 'invalid: query name' ELSE 'accepted' END AS verdict FROM f
)"""

SQL = {
    "raw_accepted": f"""WITH {_RAW} SELECT n, 'pc-' || user_id || '.example' AS host, kind AS event_id, ts, '0000abcd-0000-0000-0000-' || lpad(CAST(n AS VARCHAR), 12, '0') AS guid, event_type || '.exe' AS app, 'parent' || (k % 5) || '.exe' AS parent,
      'temporary' AS location, CASE WHEN kind = 3 THEN '8.8.4.' || (k % 200) ELSE '' END AS destination, CASE WHEN kind = 3 THEN port ELSE 0 END AS port, CASE WHEN bad_query THEN 'two words.example' ELSE query END AS query,
      kind = 1 AS encoded, kind = 1 AS remote FROM v WHERE verdict = 'accepted'""",
    "raw_verdicts": f"WITH {_RAW} SELECT n, split_part(verdict, ': ', 1) AS status, nullif(split_part(verdict, ': ', 2), '') AS reason FROM v",
    "raw_report": f"WITH {_RAW} SELECT split_part(verdict, ': ', 1) AS status, nullif(split_part(verdict, ': ', 2), '') AS reason, count(*) AS n FROM v GROUP BY ALL",
    "raw_malformed": f"WITH {_RAW} SELECT split_part(verdict, ': ', 2) AS reason, count(*) AS n, CAST(least(3, count(*)) AS INT) AS samples FROM v WHERE n % 5 = 0 AND verdict LIKE 'invalid%' GROUP BY 1",
    "raw_deep": f"""WITH {_RAW}, g AS (SELECT *, CASE WHEN n % 101 = 0 THEN 'invalid: JSON nested too deeply' ELSE verdict END AS w FROM v)
      SELECT n, split_part(w, ': ', 1) AS status, nullif(split_part(w, ': ', 2), '') AS reason, CASE WHEN w = 'accepted' THEN 'pc-' || user_id || '.example' END AS host, CASE WHEN w = 'accepted' THEN kind ELSE 0 END AS event_id, CASE WHEN w = 'accepted' THEN ts ELSE 0 END AS ts,
        CASE WHEN w = 'accepted' THEN '0000abcd-0000-0000-0000-' || lpad(CAST(n AS VARCHAR), 12, '0') END AS guid, CASE WHEN w = 'accepted' THEN event_type || '.exe' END AS app, CASE WHEN w = 'accepted' THEN 'parent' || (k % 5) || '.exe' END AS parent FROM g""",
    "raw_every_verdict": f"""WITH c AS (SELECT event_id AS n, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 17 AS i, {BROKEN}[event_id % 17 + 1] AS w FROM events),
      x AS (SELECT n, i, CASE WHEN i = 16 AND k % 11 = 2 THEN 'invalid: query name' ELSE w END AS w FROM c)
      SELECT n, split_part(w, ': ', 1) AS status, nullif(split_part(w, ': ', 2), '') AS reason, CASE WHEN w <> 'accepted' THEN 0 WHEN i = 16 THEN 22 ELSE 1 END AS event_id, CASE WHEN w = 'accepted' AND i IN (14, 16) THEN 1 ELSE 0 END AS warnings FROM x""",
    "raw_payloads": """SELECT event_id // 50 AS payload, count(*) AS records FROM events WHERE event_id % 5 = 0 GROUP BY 1 UNION ALL SELECT -(event_id // 50) - 1, count(*) FROM events WHERE event_id % 5 = 3 GROUP BY 1""",
}
