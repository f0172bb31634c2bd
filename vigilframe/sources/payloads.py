"""Raw records (XML, JSON in several layouts, rendered text) to observations, as one projection.

Every record stays a row: ``status`` says whether it was accepted, ignored (not an event of interest) or invalid, and
``reason`` why; nothing aborts a batch. A JSON object is read as a map from field to text in which nested objects stay
JSON, so a field is looked up in the layers that may hold it (named data, event data, system, the event itself), by the
last part of its name in lower case without punctuation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators.peers import kept

#: The providers, channel and provider id that are trusted, and the event ids of interest.
PROVIDERS = ("microsoft-windows-sysmon", "linux-sysmon", "sysmon")
CHANNEL = "microsoft-windows-sysmon/operational"
PROVIDER_GUID = "5770385f-c22a-43e0-bf4c-06f5698ffbd9"
EVENTS = (1, 3, 22)
#: Names of fields in order of precedence, in lower case without punctuation.
ALIASES = {
    "provider": ["provider", "providername", "sourcename"],
    "channel": ["channel"],
    "provider_guid": ["guid"],
    "event_id": ["eventid", "eventcode"],
    "computer": ["computer", "computername", "machinename", "sourcemachineid"],
    "record_id": ["eventrecordid", "recordid", "recordnumber"],
    "time": ["utctime", "systemtime", "timecreated", "timestamp", "time"],
    "image": ["image"],
    "parent_image": ["parentimage"],
    "command": ["commandline"],
    "process_guid": ["processguid"],
    "parent_guid": ["parentprocessguid"],
    "sha": ["sha256"],
    "hashes": ["hashes"],
    "destination": ["destinationip"],
    "port": ["destinationport"],
    "source_ip": ["sourceip"],
    "source_port": ["sourceport"],
    "protocol": ["protocol"],
    "initiated": ["initiated"],
    "query": ["queryname"],
    "query_status": ["querystatus"],
}
#: Event ids that symbolic ids stand for, and what task numbers of other events come with.
SYMBOLS = {"PROCESS_CREATE": 1, "NETWORK_CONNECT": 3, "DNS_QUERY": 22}
OTHER_TASKS = {
    2: ["processguid", "targetfilename", "creationutctime", "previouscreationutctime"],
    4: ["state", "schemaversion"],
    5: ["processguid", "image"],
    6: ["imageloaded", "hashes", "signed"],
    7: ["processguid", "image", "imageloaded"],
    8: ["sourceprocessguid", "targetprocessguid", "newthreadid", "startaddress"],
    11: ["processguid", "targetfilename", "creationutctime"],
    12: ["processguid", "targetobject", "eventtype"],
    13: ["processguid", "targetobject", "eventtype", "details"],
    15: ["processguid", "image", "targetfilename", "creationutctime", "hash"],
    16: ["configuration", "configurationfilehash"],
}
#: The names of fields that ``normalize`` looks up, in lower case without punctuation.
READ = tuple(dict.fromkeys([*(n for names in ALIASES.values() for n in names), *(n for names in OTHER_TASKS.values() for n in names), "name", "id", "task"]))
MAXIMUM_XML, MAXIMUM_DEPTH, MAXIMUM_RECORDS = 512_000, 64, 5000
TEXTS = ["#text", "text", "value", "Value", "_value", "$text", "_text"]
_WRAPS, _NAMES, _ATTRIBUTES = frozenset(TEXTS), ("@Name", "Name", "name"), ("@", "_attributes", "attributes", "attrs", "_attr")
_MAP = "map<string,string>"
_XML = "System struct<Provider:struct<_Name:string>,EventID:string,Computer:string,EventRecordID:string,Channel:string,TimeCreated:struct<_SystemTime:string>>,EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _named(entries: Column) -> Column:
    """Array of (name, value) of a list of named data nodes."""
    name = lambda m: F.coalesce(m["@Name"], m["Name"], m["name"])
    pairs = F.transform(F.from_json(entries, f"array<{_MAP}>"), lambda m: F.struct(name(m).alias("key"), F.coalesce(*[m[t] for t in TEXTS]).alias("value")))
    return F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))


def _entries(m: Column) -> Column:
    return F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))


def _scalars(entries: Column) -> Column:
    """The entries with objects that wrap one text replaced by it; other objects and lists are left out."""

    def value(e: Column) -> Column:
        parsed = F.when(e["value"].rlike(r"^\s*\{\s*[\"}]"), F.from_json(e["value"], _MAP))
        wrapped = lambda inner: F.coalesce(*[inner[t] for t in [*TEXTS, "@Name", "Name", "@SystemTime", "SystemTime"]])
        plain = F.when(~F.startswith(F.ltrim(e["value"]), F.lit("[")), e["value"])
        return F.struct(e["key"].alias("key"), S.let(parsed, lambda inner: F.when(inner.isNotNull(), wrapped(inner)).otherwise(plain)).alias("value"))

    return F.filter(F.transform(entries, value), lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != "")


def _object(text: Column) -> Column:
    """A JSON object as a map; null for other texts, most of which aren't given to the parser."""
    return F.when(text.rlike(r"^[ \t\r\n]*\{"), F.from_json(text, _MAP))


def with_json_fields(rows: DataFrame, top: str) -> DataFrame:
    """Adds ``__json``, the array of (key, value) of a JSON event whose map is the column ``top``, the layers in order of
    precedence. Each layer is a column of its own, so that it is parsed once however many fields are taken from it."""
    event = F.coalesce(F.from_json(F.col(top)["Event"], _MAP), F.col(top))
    rows = rows.withColumn("__event", event)
    rows = rows.withColumns({f"__{to}": F.from_json(F.col("__event")[name], _MAP) for to, name in (("data", "EventData"), ("winlog", "winlog"), ("system", "System"))})
    event, data, winlog = F.col("__event"), F.col("__data"), F.col("__winlog")
    winlog_names = F.filter(_entries(winlog), lambda e: e["key"].isin("event_id", "computer_name", "provider_name", "record_id"))
    ids = F.transform(F.filter(_entries(event), lambda e: e["key"].isin("Id", "RecordId")), lambda e: F.struct(F.when(e["key"] == "Id", "EventID").otherwise("EventRecordID").alias("key"), e["value"].alias("value")))
    fields = F.concat(
        _scalars(_entries(F.from_json(winlog["event_data"], _MAP))), _scalars(winlog_names), _named(data["Data"]), _scalars(_entries(data)), _scalars(_entries(F.col("__system"))),
        _scalars(_entries(event)), _scalars(ids), F.coalesce(F.when(event["Message"].isNotNull(), rendered_fields(event["Message"])), F.array().cast("array<struct<key:string,value:string>>")),
    )
    return rows.withColumn("__json", F.when(F.col(top).isNotNull(), fields)).drop("__event", "__data", "__winlog", "__system")


def too_deep(text: Column) -> Column:
    """Whether a JSON text nests more than MAXIMUM_DEPTH objects and lists; brackets in quoted text don't count. Depths are
    summed over runs of opening and of closing brackets, and only for texts that hold more opening ones than are allowed.
    The patterns don't repeat a group by going back, so that they take a few steps a character and no stack."""
    many = text.rlike(rf"\A(?:[^\[{{]*[\[{{]){{{MAXIMUM_DEPTH + 1}}}+")
    brackets = F.regexp_replace(text, r'"[^"\\]*(?:\\.[^"\\]*)*+"|[^\[\]{}"]+', "")
    runs = F.transform(F.regexp_extract_all(brackets, F.lit(r"[\[{]++|[\]}]++"), F.lit(0)), lambda run: F.when(F.substring(run, 1, 1).isin("[", "{"), F.length(run)).otherwise(-F.length(run)))
    step = lambda now, run: F.struct((now["depth"] + run).alias("depth"), F.greatest(now["most"], now["depth"] + run).alias("most"))
    most = F.aggregate(runs, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")), step, lambda a: a["most"])
    return F.when(many, most > MAXIMUM_DEPTH).otherwise(False)


def _first(node: dict[str, object], names: Iterable[str], kinds: type | tuple[type, ...]) -> object:
    for name in names:
        if name in node and isinstance(node[name], kinds):
            return node[name]
    return None


def _wrapped(key: str | None, node: dict[str, object]) -> tuple[str, str] | None:
    """The name and the text of an object that wraps one text."""
    text = _first(node, TEXTS, (str, int, float))
    if text is None:
        return None
    name = _first(node, _NAMES, str)
    if name is None and (attributes := _first(node, _ATTRIBUTES, dict)):
        name = _first(attributes, _NAMES, str)
    return (name or key, str(text)) if name or key is not None else None


def _pairs(top: object) -> list[tuple[str, str]]:
    """(key, value) of all scalars below a node, as ``leaves`` has them."""
    out: list[tuple[str, str]] = []
    # what is left of each open node and whether a key around it names a provider: whole paths would cost their length at each node
    stack: list[tuple[Iterator[tuple[str | None, object]], bool]] = [(iter([(None, top)]), False)]
    add, push = out.append, stack.append
    while stack:
        items, around = stack.pop()
        for key, node in items:
            inside = around
            while type(node) is dict and len(node) == 1:
                ((name, child),) = node.items()
                if name in _WRAPS and (found := _wrapped(key, node)):
                    add(found)
                inside = inside or (key is not None and len(key) == 8 and key.lower() == "provider")
                key, node = name, child
            if type(node) is str:
                if key is not None:
                    add(("Provider" if inside and key.lower().strip("@") == "name" else key, node))
            elif type(node) is dict:
                if not _WRAPS.isdisjoint(node) and (found := _wrapped(key, node)):
                    add(found)
                push((items, around))
                push((iter(node.items()), inside or (key is not None and len(key) == 8 and key.lower() == "provider")))
                break
            elif type(node) is list:
                if node and key is not None and isinstance(node[0], (str, int, float)):
                    add((key, str(node[0])))
                push((items, around))
                push((iter([(key, value) for value in node if isinstance(value, (dict, list))]), inside))
                break
            elif node is not None and key is not None:
                add(("Provider" if inside and key.lower().strip("@") == "name" else key, str(node)))
    return out


def _loaded(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def leaves(text: str | None) -> list[dict[str, str]] | None:
    """(key, value) of all scalars of a JSON text in document order, at any depth; an object that wraps one text, or the
    first of a list of scalars, stands under the key around it, named data under their name."""
    return None if text is None else [{"key": key, "value": value} for key, value in _pairs(_loaded(text))]


@lru_cache(4096)
def _place(key: str) -> int | None:
    """The place in READ of a field's name, as ``normalize`` writes names."""
    name = re.sub("[^A-Za-z0-9]", "", key.rsplit(".", 1)[-1].rsplit("/", 1)[-1]).lower()
    return READ.index(name) if name in READ else None


def read_leaves(text: str) -> dict[int, str]:
    """Of the leaves of a JSON text, the first clean value that isn't empty of each name in READ, by the name's place."""
    found: dict[int, str] = {}
    for key, value in _pairs(_loaded(text)):
        at = _place(key)
        if at is not None and at not in found:
            value = value.strip(" ")
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1].strip(" ")
            if value:
                found[at] = value if value.isascii() else value.encode("utf-8", "replace").decode()
    return found


@F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in READ]))
def _leaves(texts: pa.Array) -> pa.Array:
    columns: list[list[str | None]] = [[None] * len(texts) for _ in READ]
    for row, text in enumerate(texts.to_pylist()):
        for at, value in read_leaves(text).items() if text is not None else ():
            columns[at][row] = value
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], list(READ))


def rendered_fields(text: Column) -> Column:
    """Array of (key, value) of ``Key: value`` or ``Key= value`` lines."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.rlike(r"^\s*[A-Za-z][A-Za-z0-9_. ]{0,70}\s*[:=]"))
    part = lambda s, k: F.trim(F.regexp_extract(s, r"^\s*([A-Za-z][A-Za-z0-9_. ]{0,70}?)\s*[:=]\s*(.*?)\s*$", k))
    return F.transform(lines, lambda s: F.struct(F.regexp_replace(part(s, 1), " ", "").alias("key"), part(s, 2).alias("value")))


def xml_fields(x: Column) -> Column:
    """Array of (key, value) of an XML event, parsed by the schema that names what is read; any namespace will do."""
    system = x["System"]
    named = F.transform(x["EventData"]["Data"], lambda d: F.struct(d["_Name"].alias("key"), d["_VALUE"].alias("value")))
    fixed = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in (("EventID", system["EventID"]), ("Computer", system["Computer"]), ("EventRecordID", system["EventRecordID"]), ("Channel", system["Channel"]), ("SystemTime", system["TimeCreated"]["_SystemTime"]), ("Provider", system["Provider"]["_Name"]))])
    return F.concat(F.coalesce(named, F.array().cast("array<struct<key:string,value:string>>")), fixed)


def records(payloads: DataFrame, column: str = "value") -> DataFrame:
    """One row for each record of whole payloads: an array, ``{"results": [...]}``, lines of JSON, an ``Events`` document
    or a single record. Payload columns stay; ``record`` is new."""
    text = F.trim(F.regexp_replace(F.col(column), "^\\ufeff", ""))
    results = F.get_json_object(text, "$.results")
    listed = F.when(F.startswith(text, F.lit("[")), text).when(F.startswith(results, F.lit("[")), results)
    array = F.transform(F.from_json(listed, "array<variant>"), lambda v: F.to_json(v))
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: F.trim(s) != "")
    many = F.startswith(text, F.lit("{")) & (F.size(lines) > 1) & F.forall(lines, lambda s: F.startswith(F.ltrim(s), F.lit("{")) & F.endswith(F.rtrim(s), F.lit("}")))
    events = F.when(text.rlike(r"^(<\?xml[^>]*>\s*)?<Events[\s>]"), F.regexp_extract_all(text, F.lit(r"(?s)<Event[\s>].*?</Event>"), F.lit(0)))
    return payloads.withColumn("record", F.explode(F.coalesce(events, array, F.when(many, lines), F.array(text))))


def too_many(payloads: DataFrame, key: str, most: int = MAXIMUM_RECORDS) -> DataFrame:
    """(key, n) of payloads with more records than are taken from one; such a payload is refused as a whole."""
    return records(payloads).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def first_errors(normalized: DataFrame, key: str, most: int = 20) -> DataFrame:
    """(key, reason, r): the first invalid records of each payload, in the order of their text."""
    order = Window.partitionBy(key).orderBy("reason", "record")
    bad = normalized.where("status = 'invalid'").withColumn("r", F.row_number().over(order))
    return bad.where(F.col("r") <= most).select(key, "reason", "r")


def normalize(rows: DataFrame, record: str = "record", collector_host: str | None = None, search_deep: bool = False) -> DataFrame:
    """Adds the columns of an observation, ``status`` and ``reason`` to rows with a raw record each.

    With ``search_deep`` JSON records that name no event id, endpoint or time in the known layers are searched at all
    depths, by a Python function that sees only these."""
    # what is used more than once is a column of its own: inside a branch it would be computed again at each use
    rows = rows.withColumn("__outer", _object(F.col(record)))
    rows = rows.withColumn("__result", F.from_json(F.col("__outer")["result"], _MAP))
    rows = rows.withColumn("__inner", F.coalesce("__result", "__outer"))
    inner = F.col("__inner")
    rows = rows.withColumn("__raw", F.coalesce(inner["_raw"], F.when(F.col("__result").isNotNull(), F.col("__outer")["result"]), F.col(record)))
    raw = F.ltrim(F.when(F.startswith("__raw", F.lit("\ufeff")), F.substring("__raw", 2, 2**31 - 1)).otherwise(F.col("__raw")))
    rows = rows.withColumn("__host", F.lower(F.coalesce(inner["host"], F.col(collector_host) if collector_host else F.lit("")))).withColumn("__raw", raw)
    r = F.col("__raw")
    unsafe = r.rlike("(?i)<!(DOCTYPE|ENTITY)") | (F.length(r) > MAXIMUM_XML)
    kind = F.when(F.startswith(r, F.lit("<")), F.when(unsafe, "unsafe").otherwise("xml")).when(F.startswith(r, F.lit("{")), "json").when(F.trim(r) == "", "empty").otherwise("text")
    rows = rows.withColumn("__kind", kind)
    k = F.col("__kind")
    rows = rows.withColumns({"__too_deep": F.when(k == "json", too_deep(r)), "__object": F.when(k == "json", F.when(r == F.col(record), F.col("__outer")).otherwise(F.from_json(r, _MAP))), "__xml": F.when(k == "xml", F.from_xml(r, _XML))})
    rows = rows.withColumn("__malformed", (k == "json") & F.col("__object").isNull()).withColumn("__object", F.when(~F.col("__too_deep"), F.col("__object")))
    rows = with_json_fields(rows, "__object")
    fields = F.when(k == "xml", xml_fields(F.col("__xml"))).when((k == "json") & ~F.col("__too_deep"), F.coalesce("__json", F.array().cast("array<struct<key:string,value:string>>"))).when(k == "text", rendered_fields(r))
    name = lambda e: F.lower(F.regexp_replace(F.substring_index(F.substring_index(e["key"], ".", -1), "/", -1), "[^A-Za-z0-9]", ""))
    plain = lambda found: F.filter(F.transform(found, lambda e: F.struct(name(e).alias("key"), S.clean_text(e["value"]).alias("value"))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    rows = rows.withColumn("__fields", plain(fields))
    if search_deep:
        named = lambda c: F.exists(F.col("__fields"), lambda e: e["key"].isin(*ALIASES[c]))
        lacking = (k == "json") & F.col("__fields").isNotNull() & ~(named("event_id") & named("computer") & named("time"))
        rows = rows.withColumn("__deep", _leaves(F.when(lacking, r)))
    # filters on the verdict aren't put below a column that depends on the order of rows: they would repeat all of the above
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumns({f"__{c}s": F.transform("__fields", lambda e: e[c]) for c in ("key", "value")})  # noqa: B023
    first = known = lambda n: F.get("__values", F.array_position("__keys", n).cast("int") - 1)
    if search_deep:
        # by place: a position and a deep field for each name make a method that the JVM takes to be too large to compile
        rows = rows.withColumn("__known", F.when(F.size("__keys") > 0, F.transform(F.array(*map(F.lit, READ)), known)))
        first = lambda n: F.coalesce(F.get("__known", F.lit(READ.index(n))), F.col("__deep")[n])
    has = lambda n: first(n).isNotNull()
    value = {c: F.coalesce(*map(first, names)) for c, names in ALIASES.items()}
    rows = rows.withColumns({f"__{c}": v for c, v in value.items()})
    get = lambda c: F.col(f"__{c}")

    # the flat collector dialect: an event id may be inferred from a symbol or task, if the payload bears it out
    flat = sum((F.col("__fields").isNotNull() & has(n)).cast("int") for n in ("task", "guid", "channel", "sourcemachineid", "systemtime", "eventrecordid")) >= 3
    provider = F.lower(F.coalesce(get("provider"), F.when(flat, first("name"))))
    trusted = F.coalesce(provider.isin(*PROVIDERS), F.lit(False)) | F.coalesce(F.lower(get("channel")) == CHANNEL, F.lit(False)) | F.coalesce(F.regexp_replace(F.lower(get("provider_guid")), "[{}]", "") == PROVIDER_GUID, F.lit(False))
    borne_out = {
        1: has("processguid") & has("image") & (has("parentprocessguid") | has("parentimage")),
        3: has("destinationip") & has("destinationport") & (has("processguid") | has("image")),
        22: has("queryname") & (has("processguid") | has("image")),
    }
    symbol, task = S.symbol(first("id")), first("task").try_cast("int")
    symbolic = F.coalesce(symbol, F.lit("")) != ""
    hint = F.coalesce(*[F.when(symbol == s, e) for s, e in SYMBOLS.items()], symbol.try_cast("int"), F.when(~symbolic, task))
    inferred = F.coalesce(*[F.when((hint == e) & ok, e) for e, ok in borne_out.items()])
    other = _any([(hint == t) & _all(list(map(has, needed))) for t, needed in OTHER_TASKS.items()]) | (symbolic & symbol.try_cast("int").isNull() & ~symbol.isin(*SYMBOLS) & (task == 255) & ~_any(list(borne_out.values())))
    event_id = F.coalesce(get("event_id").try_cast("int"), F.when(get("event_id").isNull() & flat & trusted, inferred))
    host = F.coalesce(F.nullif(F.rtrim(F.lower(get("computer")), F.lit(".")), F.lit("")), F.nullif(F.rtrim(F.col("__host"), F.lit(".")), F.lit("")))
    ts, query = S.epoch(get("time")), F.rtrim(F.lower(get("query")), F.lit("."))
    encoded = F.when(query.rlike("^[\\x00-\\x7f]*$"), query).otherwise(F.expr("try_reflect('java.net.IDN', 'toASCII', rtrim('.', lower(`__query`)))"))
    port = F.coalesce(get("port"), F.lit("0")).try_cast("int")
    address_ok = F.coalesce(get("destination").rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$") | get("destination").rlike("(?i)^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}$"), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(True))
    verdict = (
        F.when(k == "empty", "invalid: empty record")
        .when(k == "unsafe", "invalid: unsafe or oversized XML")
        .when((k == "json") & F.col("__too_deep"), "invalid: JSON nested too deeply")
        .when(F.col("__malformed"), "invalid: malformed JSON")
        .when(provider.isNotNull() & ~provider.isin(*PROVIDERS), "ignored: other provider")
        .when(provider.isNull() & (F.lower(get("channel")) != CHANNEL), "ignored: other channel")
        .when(event_id.isNull() & get("event_id").isNull() & flat & trusted & F.coalesce(other, F.lit(False)), "ignored: known other event of the flat dialect")
        .when(event_id.isNull(), "invalid: no event id")
        .when(~event_id.isin(*EVENTS), "ignored: other event")
        .when(no(host.isNull() | (F.length(host) > 255) | host.rlike(r"\s")), "invalid: no endpoint")
        .when(no((ts <= 0) | (ts >= 4102444800)), "invalid: no time in range")
        .when((event_id == 3) & (~address_ok | no(port.isNull() | (port < 0) | (port > 65535))), "invalid: destination")
        .when((event_id == 22) & no((F.coalesce(encoded, F.lit("")) == "") | (F.length(encoded) > 253) | query.rlike(r"\s")), "invalid: query name")
        .otherwise("accepted")
    )
    app, image = F.when(get("image").isNull(), "unknown").otherwise(S.basename(get("image"))), F.coalesce(get("image"), F.lit(""))
    sha = F.lower(F.coalesce(F.when(get("sha").rlike("^[0-9a-fA-F]{64}$"), get("sha")), S.sha256_of(get("hashes"))))
    command = F.coalesce(get("command"), F.lit(""))
    flags = F.when(event_id == 1, F.struct(*[c.alias(n) for n, c in S.command_flags(command, app).items()]))
    warning = lambda test, text: F.when(test, text)
    warnings = F.array_compact(F.array(warning(get("computer").isNull(), "endpoint is the collector's host"), warning(get("image").isNull(), "no image"), warning(S.guid(get("process_guid")).isNull(), "no process guid"), warning(provider.isNull(), "no provider"), warning(get("event_id").isNull() & inferred.isNotNull(), "event id inferred")))
    identity = F.sha2(F.to_json(F.struct(host.alias("h"), event_id.alias("e"), ts.alias("t"), *[get(c) for c in ("process_guid", "record_id", "image", "parent_guid", "command", "destination", "port", "source_ip", "source_port", "protocol", "query", "query_status")], sha.alias("s"))), 256)
    found = {
        "id": identity, "host": host, "event_id": event_id, "ts": ts, "guid": F.coalesce(S.guid(get("process_guid")), F.lit("")), "parent_guid": F.coalesce(S.guid(get("parent_guid")), F.lit("")), "app": app,
        "parent": F.when(get("parent_image").isNull(), "unknown").otherwise(S.basename(get("parent_image"))), "image": S.redact_path(image), "location": S.location(image), "sha256": sha, "flags": flags,
        "destination": F.when(event_id == 3, F.lower(get("destination"))).otherwise(""), "port": F.when(event_id == 3, port).otherwise(0), "protocol": F.substring(F.lower(F.coalesce(get("protocol"), F.lit(""))), 1, 16),
        "initiated": F.when(F.lower(get("initiated")) == "true", True).when(F.lower(get("initiated")) == "false", False), "query": F.coalesce(encoded, F.lit("")), "query_status": F.substring(F.coalesce(get("query_status"), F.lit("")), 1, 32), "warnings": warnings,
    }
    rows = rows.withColumns({**{f"__out_{n}": c for n, c in found.items()}, "__verdict": verdict})
    keep = [c for c in rows.columns if not c.startswith("__")]
    rows = rows.withColumn("__verdict", F.when(F.col("__at") >= 0, F.col("__verdict")))
    accepted = F.col("__verdict") == "accepted"
    return rows.select(*[F.col(c) for c in keep if c not in found], *[F.when(accepted, F.col(f"__out_{n}")).alias(n) for n in found], F.split("__verdict", ": ")[0].alias("status"), F.get(F.split("__verdict", ": "), F.lit(1)).alias("reason"))


def report(normalized: DataFrame) -> DataFrame:
    """Records by status and reason."""
    return normalized.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def malformed_groups(normalized: DataFrame, limit: int = 50, samples: int = 3, record: str = "record") -> DataFrame:
    """The most frequent kinds of invalid records: (reason, layout, n, samples); the layout is the sorted field names."""
    keys = F.coalesce(F.array_join(F.sort_array(F.map_keys(F.from_json(F.col(record), _MAP))), ","), F.lit(""))
    bad = normalized.where("status = 'invalid'").withColumn("layout", F.substring(keys, 1, 500)).select("reason", "layout", record)
    bad = kept(bad)  # used twice, and joined with itself below
    top = bad.groupBy("reason", "layout").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason", "layout").limit(limit)
    texts = bad.select("reason", "layout", F.substring(F.col(record), 1, 200).alias("text")).join(F.broadcast(top.select("reason", "layout")), ["reason", "layout"]).distinct()
    order = Window.partitionBy("reason", "layout").orderBy("text")
    few = texts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples).groupBy("reason", "layout").agg(F.sort_array(F.collect_list("text")).alias("samples"))
    return top.join(few, ["reason", "layout"], "left").withColumn("samples", F.coalesce("samples", F.array())).orderBy(F.col("n").desc(), "reason", "layout")
