from __future__ import annotations

import json

from pyspark.sql import functions as F

from labelwright.llm.tool_calls import canonical, format_calls

SCHEMAS = [("f", "n", "integer", True), ("f", "s", "string", False), ("g", "x", "number", False), ("g", "o", "object", False)]
CALLS = [
    (1, 0, "a", "f", '{"s": "q\\u00e9", "n": 1}', None), (1, 1, "b", "f", '{"n":"1"}', "a"), (1, 2, "c", "g", '{"x":2,"o":{"z":1,"a":[1, 2]}}', "b"),
    (1, 3, "a", "f", '{"n":2}', "c"), (1, 4, "d", "nope", None, "missing"), (1, 5, "e", "f", "[1]", "d"), (1, 6, "g", "f", "{bad", None), (1, 7, None, "g", None, "a"),
    (2, 0, "x", "g", "{}", "y"), (2, 1, "y", "g", '{"q":1}', "x"), (2, 2, "z", "g", '{"x":1.5}', "y"), (2, 3, "s", "g", "{}", "s"), (None, 0, "a", "g", "{}", None),
]
CALLS += [(3, t, f"k{t}", "g", "{}", f"k{t - 1}") for t in range(70)]
RESULTS = [(1, 10, "a", "late"), (1, 9, "a", "first"), (1, 11, "zz", "lost"), (1, 12, None, "none"), (2, 5, "x", None), (None, 3, "a", "no conversation")]


def run(spark, calls=CALLS, results=RESULTS, schemas=SCHEMAS):
    c = spark.createDataFrame([(*x, "x") for x in calls], "conv_id bigint, turn bigint, call_id string, name string, arguments string, after string, status string")
    r = spark.createDataFrame([(*x, 0) for x in results], "conv_id bigint, turn bigint, call_id string, content string, level int")
    return format_calls(c, r, spark.createDataFrame(schemas, "name string, key string, type string, required boolean")).collect()


def test_calls(spark):
    rows = {(r.conv_id, r.turn, r.call_id): r for r in run(spark)}
    assert len(rows) == len(CALLS) + 3
    status = {k: r.status for k, r in rows.items() if k[0] != 3}
    assert status == dict.fromkeys(status, "unanswered") | {
        (1, 0, "a"): "linked", (2, 0, "x"): "linked", (None, 0, "a"): "linked", (1, 3, "a"): "duplicate", (1, 7, None): "unlinked",
        (1, 10, "a"): "orphan", (1, 11, "zz"): "orphan", (1, 12, None): "orphan",
    }
    levels = {k[1]: r.level for k, r in rows.items() if k[0] == 1 and r.status != "orphan"}
    assert levels == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1, 6: 0, 7: 1}
    assert [rows[2, t, c].level for t, c in ((0, "x"), (1, "y"), (2, "z"), (3, "s"))] == [None] * 4
    assert [rows[3, t, f"k{t}"].level for t in range(70)] == [*range(70)]
    problems = {k[1]: r.problems for k, r in rows.items() if k[0] == 1 and r.status != "orphan"}
    assert problems == {0: "", 1: "type of n", 2: "", 3: "", 4: "unknown tool", 5: "not an object", 6: "not an object", 7: ""}
    assert (rows[2, 1, "y"].problems, rows[2, 2, "z"].problems, rows[2, 2, "z"].valid) == ("unknown q", "", True)
    assert rows[1, 0, "a"].line == '{"arguments":{"n":1,"s":"qé"},"call_id":"a","content":"first","level":0,"name":"f","status":"linked","valid":true}'
    assert json.loads(rows[1, 2, "c"].line)["arguments"] == {"o": {"a": [1, 2], "z": 1}, "x": 2} and '"o":{"a":[1,2],"z":1},"x":2' in rows[1, 2, "c"].line
    assert json.loads(rows[1, 6, "g"].line)["arguments"] is None


def test_empty(spark):
    assert run(spark, calls=[], results=[]) == []
    assert [r.status for r in run(spark, calls=[])] == ["orphan"] * len(RESULTS)
    assert {r.problems for r in run(spark, schemas=[], results=[])} == {"unknown tool"}


def test_canonical_json(spark):
    cases = {
        '{"\\ud83d\\ude00":1,"\\ufb01":2,"a":"x\\u00e9\\/\\\\\\"\\n"}': '{"a":"xé/\\\\\\"\\n","ﬁ":2,"😀":1}',
        '{"b":1,"a":[1, 2.50,1e2,-0,0.0,1E-7,-12.340e1,1e401,0.00001,100]}': '{"a":[1,2.5,100,0,0,1e-7,-123.4,1e401,0.00001,100],"b":1}',
        "[12345678901234567890123456789012345678901234]": "[12345678901234567890123456789012345678901234]",
        '{"k":{"b":true,"a":null,"b":false},"k2":[{"z":{},"y":[[]]}]}': '{"k":{"a":null,"b":false},"k2":[{"y":[[]],"z":{}}]}',
        '{"a":1,"a":2}': '{"a":2}', '{"a" : "{[,:]}" , "e":[ ] }': '{"a":"{[,:]}","e":[]}', " 5 ": "5", '"x"': '"x"', "{bad": None, "": None, None: None,
        "[" * 60 + "]" * 60: "[" * 60 + "]" * 60,
    }
    df = spark.createDataFrame([(c,) for c in cases], "j string")
    got = {r.j: r.c for r in df.select("j", canonical(F.col("j")).alias("c")).collect()}
    assert got == cases
    assert all(json.loads(k) == json.loads(v) for k, v in cases.items() if v is not None and "e401" not in v)


def test_repeated_and_very_large_arguments(spark):
    calls = [
        (1, 0, "a", "f", '{"n":"x","n":3}', None), (1, 1, "b", "f", '{"n":12345678901234567890123456789012345678901234}', None), (1, 2, "c", "f", '{"n":1e2}', None), (1, 3, "d", "f", '{"n":1.5}', None),
        (1, 4, "e", "f", json.dumps({"s": "x" * 200_000, "n": 1}), None),
    ]
    rows = {r.call_id: r for r in run(spark, calls, [])}
    assert rows["a"].problems == "repeated n" and json.loads(rows["a"].line)["arguments"] == {"n": 3} and not rows["a"].valid
    assert rows["b"].valid and "12345678901234567890123456789012345678901234" in rows["b"].line
    assert rows["d"].problems == "type of n" and len(json.loads(rows["e"].line)["arguments"]["s"]) == 200_000


def test_repeated_rows_and_ties(spark):
    calls = [(1, 0, "a", "f", '{"n":1}', None)] * 3 + [(1, 1, "b", "f", '{"n":1}', "a")] * 2
    rows = run(spark, calls, [(1, 5, "a", "r"), (1, 5, "a", "r")])
    assert sorted(r.status for r in rows) == ["duplicate", "duplicate", "duplicate", "linked", "orphan", "unanswered"]
    assert {r.level for r in rows if r.call_id == "b"} == {1}
