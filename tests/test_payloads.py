"""Records in all layouts give the same observation."""

import json

import pytest

from vigilframe.sources import payloads

CLOCK = 1_700_000_000
GUID = "00000000-0000-0000-0000-000000000001"
BASE = {"Provider": "Microsoft-Windows-Sysmon", "EventID": 1, "Computer": "Workstation.Example.", "UtcTime": CLOCK - 60, "ProcessGuid": "{" + GUID + "}", "Image": "C:\\Program Files\\Utility\\utility.exe", "ParentImage": "C:\\Windows\\explorer.exe", "CommandLine": "utility.exe -enc abc | x", "Hashes": "SHA256=" + "A" * 64}
XML = (
    '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Microsoft-Windows-Sysmon"/><EventID>1</EventID><TimeCreated SystemTime="2023-11-14T22:12:20Z"/>'
    "<EventRecordID>7</EventRecordID><Channel>Microsoft-Windows-Sysmon/Operational</Channel><Computer>Workstation.Example.</Computer></System><EventData>"
    + "".join(f'<Data Name="{k}">{BASE[k]}</Data>' for k in ("ProcessGuid", "Image", "ParentImage", "CommandLine", "Hashes"))
    + "</EventData></Event>"
)
TEXT = "\n".join(f"{k}: {v}" for k, v in BASE.items())
FLAT = {"sourceMachineID": "Workstation.Example.", "Name": "'Microsoft-Windows-Sysmon'", "Guid": "{5770385f-c22a-43e0-bf4c-06f5698ffbd9}", "Task": "1", "Channel": "Microsoft-Windows-Sysmon/Operational", "SystemTime": "2023-11-14T22:12:20Z", "EventRecordID": "9", **{k: BASE[k] for k in ("ProcessGuid", "Image", "ParentImage", "CommandLine", "Hashes")}}
NESTED = {"Event": {"System": {"Provider": {"@Name": "Microsoft-Windows-Sysmon"}, "EventID": {"#text": "1"}, "Computer": "Workstation.Example.", "TimeCreated": {"@SystemTime": "2023-11-14T22:12:20Z"}}, "EventData": {"Data": [{"Name": k, "_value": BASE[k]} for k in ("ProcessGuid", "Image", "ParentImage", "CommandLine", "Hashes")]}}}
DOTTED = {**{f"Event.System.{k}": BASE[k] for k in ("Provider", "EventID", "Computer", "UtcTime")}, **{f"Event.EventData.{k}": BASE[k] for k in ("ProcessGuid", "Image", "ParentImage", "CommandLine", "Hashes")}}
LAYOUTS = {"flat": json.dumps(BASE), "xml": XML, "text": TEXT, "result": json.dumps({"result": BASE}), "raw_json": json.dumps({"_raw": json.dumps(BASE), "host": "collector"}), "raw_xml": json.dumps({"_raw": XML, "host": "collector"}), "dialect": json.dumps(FLAT), "nested": json.dumps(NESTED), "dotted": json.dumps(DOTTED)}


def normalized(spark, texts):
    return payloads.normalize(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, record string")).orderBy("n").collect()


def test_layouts_agree(spark):
    for name, row in zip(LAYOUTS, normalized(spark, LAYOUTS.values())):
        assert (row.status, row.reason) == ("accepted", None), name
        assert (row.host, row.event_id, row.ts, row.guid, row.app, row.parent, row.location, row.sha256) == ("workstation.example", 1, CLOCK - 60, GUID, "utility.exe", "explorer.exe", "program-files", "a" * 64), name
        assert row.flags.encoded_argument and row.flags.shell_chain and not row.flags.remote_reference, name


CASES = [
    ({}, "invalid", "no event id"),
    ({**BASE, "Provider": "Other"}, "ignored", "other provider"),
    ({**BASE, "EventID": 7}, "ignored", "other event"),
    ({**BASE, "EventID": "x"}, "invalid", "no event id"),
    ({**BASE, "Computer": "two words"}, "invalid", "no endpoint"),
    ({**BASE, "UtcTime": "never"}, "invalid", "no time in range"),
    ({**BASE, "EventID": 3, "DestinationIp": "8.8.8.8", "DestinationPort": "443", "Initiated": "true"}, "accepted", None),
    ({**BASE, "EventID": 3, "DestinationIp": "8.8.8.8", "DestinationPort": "70000"}, "invalid", "destination"),
    ({**BASE, "EventID": 3, "DestinationIp": "nine", "DestinationPort": "1"}, "invalid", "destination"),
    ({**BASE, "EventID": 22, "QueryName": "bücher.example."}, "accepted", None),
    ({**BASE, "EventID": 22}, "invalid", "query name"),
    ({**FLAT, "Task": "11"}, "invalid", "no event id"),
    ({**FLAT, "Task": "11", "TargetFilename": "x", "CreationUtcTime": "y"}, "ignored", "known other event of the flat dialect"),
    ({**FLAT, "ID": "PROCESS_CREATE", "Task": "255"}, "accepted", None),
    ({**{k: v for k, v in FLAT.items() if k not in ("ProcessGuid", "Image")}, "ID": "Queue", "Task": "255"}, "ignored", "known other event of the flat dialect"),
]


def test_verdicts(spark):
    rows = normalized(spark, [json.dumps(c[0]) for c in CASES] + ["", '{"a": ', "<!DOCTYPE x><Event/>"])
    assert [(r.status, r.reason) for r in rows] == [(c[1], c[2]) for c in CASES] + [("invalid", "empty record"), ("invalid", "malformed JSON"), ("invalid", "unsafe or oversized XML")]
    assert rows[6].initiated is True and rows[6].port == 443 and rows[9].query == "xn--bcher-kva.example"


def test_payloads_split_into_records(spark):
    one = json.dumps(BASE)
    texts = [json.dumps([BASE, BASE]), json.dumps({"results": [BASE, BASE, BASE]}), one + "\n" + one + "\n", f"<Events>{XML}{XML}</Events>", one, TEXT]
    rows = payloads.records(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, value string"))
    assert {r.n: r["count"] for r in rows.groupBy("n").count().collect()} == {0: 2, 1: 3, 2: 2, 3: 2, 4: 1, 5: 1}
    assert {r.status: r.n for r in payloads.report(payloads.normalize(rows)).collect()} == {"accepted": 11}


def test_malformed_groups(spark):
    rows = payloads.normalize(spark.createDataFrame([("{}",), ("{}",), ('{"a": 1}',)], "record string"))
    assert [(r.layout, r.n, r.samples) for r in payloads.malformed_groups(rows).collect()] == [("", 2, ["{}"]), ("a", 1, ['{"a": 1}'])]


@pytest.mark.parametrize("value, seconds", [("1700000000.5", 1700000000.5), ("/Date(1700000000123+0000)/", 1700000000.123), ("2023-11-14 22:13:20", 1700000000.0), ("2023-11-15T00:13:20+02:00", 1700000000.0), ("soon", None)])
def test_times(spark, value, seconds):
    from pyspark.sql import functions as F

    from vigilframe.functions.scalars import epoch

    assert spark.createDataFrame([(value,)], "t string").select(epoch(F.col("t"))).first()[0] == seconds


def test_depth_bound(spark):
    deep = lambda n: '{"a":' * n + '"[[{{"' + "}" * n
    rows = normalized(spark, [deep(64), deep(65), json.dumps({**BASE, "x": "[" * 200})])
    assert [r.reason for r in rows] == ["no event id", "JSON nested too deeply", None]


def test_deep_search(spark):
    """Fields below layers of other names are found, if asked for."""
    odd = {"outer": [{"layer": {"Provider": {"@Name": "Microsoft-Windows-Sysmon"}, "ids": {"EventID": {"#text": "1"}}, "where": {"Computer": "Workstation.Example."}, "when": {"TimeCreated": {"@SystemTime": "2023-11-14T22:12:20Z"}}}}, {"rows": [{"@": {"Name": "Image"}, "value": "C:\\x\\y.exe"}]}]}
    rows = spark.createDataFrame([(json.dumps(odd),), (json.dumps(BASE),)], "record string")
    assert [r.status for r in payloads.normalize(rows).collect()] == ["invalid", "accepted"] or payloads.normalize(rows).where("status = 'accepted'").count() == 1
    found = {r.record == json.dumps(BASE): r for r in payloads.normalize(rows, search_deep=True).collect()}
    assert (found[False].status, found[False].host, found[False].event_id, found[False].app) == ("accepted", "workstation.example", 1, "y.exe")
    assert found[True].app == "utility.exe"


def test_errors_and_sizes_of_payloads(spark):
    many = spark.createDataFrame([(1, json.dumps([{"n": k} for k in range(30)])), (2, json.dumps(BASE))], "payload int, value string")
    rows = payloads.normalize(payloads.records(many))
    assert [(r.payload, r.r) for r in payloads.first_errors(rows, "payload").orderBy("r").collect()] == [(1, k) for k in range(1, 21)]
    assert [tuple(r) for r in payloads.too_many(many, "payload", 29).collect()] == [(1, 30)]


def test_each_layer_is_parsed_once(spark):
    rows = payloads.normalize(spark.createDataFrame([(0, TEXT)], "n int, record string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    parsed = {f: plan.count(f"{f}(") for f in ("from_xml", "from_json")}
    assert parsed["from_xml"] == 1 and parsed["from_json"] <= 20, parsed


def test_depth_counts_runs_and_skips_quoted_brackets(spark):
    deep = lambda n, inner="1": '{"a":' * n + inner + "}" * n
    texts = [deep(64), deep(65), deep(40, "[" * 24 + "]" * 24), deep(40, "[" * 25 + "]" * 25), deep(3, '"' + "[{" * 90 + '\\" ]"'), deep(2, "[" + ",".join(["[{}]"] * 90) + "]"), '{"a":' * 70]
    found = spark.createDataFrame(list(enumerate(texts)), "n int, record string").select("n", payloads.too_deep(payloads.F.col("record")).alias("d")).orderBy("n").collect()
    assert [r.d for r in found] == [False, True, False, True, False, False, True]


class Counted(str):
    """A key that counts how often it is put into lower case."""

    asked = 0

    def lower(self):
        Counted.asked += 1
        return str.lower(self)


def test_leaves_cost_one_step_a_layer(monkeypatch):
    node = {"@Name": "p"}
    for _ in range(200):
        node = {Counted("layer"): node, "@Name": "x"}
    monkeypatch.setattr(payloads.json, "loads", lambda text: {Counted("Provider"): node})
    Counted.asked = 0
    found = payloads.leaves("{}")
    assert [f["key"] for f in found] == ["Provider"] * 201 and Counted.asked <= 1000


def deep(fields, layers):
    return '{"layer":' * layers + json.dumps(fields) + "}" * layers


def test_layers_that_wrap_nothing_cost_no_calls():
    import sys

    calls = []
    text = deep({"Computer": "a", "rows": [1]}, 60)
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        found = payloads.leaves(text)
    finally:
        sys.setprofile(None)
    assert [f["key"] for f in found] == ["Computer", "rows"] and len(calls) <= 60, len(calls)


def test_deep_search_reads_the_first_clean_value_of_each_name():
    text = deep({"Event.Computer": " ' ' ", "junk": [{"x": str(k)} for k in range(500)], "rows": [{"@": {"Name": "Com-puter"}, "value": " ' pc ' "}, {"Computer": "later"}], "Provider": {"@Name": "p"}}, 5)
    assert {payloads.READ[at]: value for at, value in payloads.read_leaves(text).items()} == {"computer": "pc", "name": "Com-puter", "provider": "p"}


def test_deep_search_takes_half_characters(spark):
    rows = spark.createDataFrame([(0, deep({**BASE, "CommandLine": "x \ud800 -enc abc"}, 5)), (1, None), (2, deep(BASE, 64)), (3, json.dumps(BASE))], "n int, record string")
    found = {r.n: r for r in payloads.normalize(rows, search_deep=True).collect()}
    assert [(found[n].status, found[n].reason) for n in (0, 2, 3)] == [("accepted", None), ("invalid", "JSON nested too deeply"), ("accepted", None)]
    assert found[0].flags.encoded_argument and found[0].host == found[3].host == "workstation.example"


def test_depth_of_long_texts(spark):
    rows = normalized(spark, [json.dumps({**BASE, "x": [[]] * 80, "y": ("a" * 9 + "\\") * 20_000}), '{"y": "' + "a" * 200_000 + '", "x": ' + "[" * 64 + "]" * 64 + "}"])
    assert [(r.status, r.reason) for r in rows] == [("accepted", None), ("invalid", "JSON nested too deeply")]
