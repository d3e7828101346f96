import json
import random

import pytest

from pyspark.sql import functions as F

from gridlake.llm import tool_calls
from gridlake.llm.common import stored
from gridlake.llm.tool_calls import canonical, check_call, depths, link_calls

SCHEMAS = {
    "sum": {
        "type": "object",
        "required": ["a", "b"],
        "additionalProperties": False,
        "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}, "how": {"enum": ["up", "down"]}},
    },
    "list": {"type": "object", "properties": {"of": {"type": "array", "items": {"type": "string", "pattern": "^x", "maxLength": 3}}}},
}

CALLS = "conv_id bigint, call_id string, turn bigint, tool string, arguments string, after array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, result string"


def test_validation():
    assert check_call('{"b": 1.5, "a": 2}', SCHEMAS["sum"]) == ('{"a":2,"b":1.5}', [])
    assert check_call('{"a": -1, "c": 0, "how": "x"}', SCHEMAS["sum"])[1] == [
        "$.b: missing",
        "$.c: unknown",
        "$.a: too small",
        "$.how: not one of the allowed values",
    ]
    assert check_call('{"of": ["x", "y", "xxxx", 1]}', SCHEMAS["list"])[1] == [
        "$.of[1]: does not match",
        "$.of[2]: too long",
        "$.of[3]: not string",
    ]
    assert check_call("{", SCHEMAS["sum"]) == (None, ["$: not JSON"])
    assert check_call(None, None) == (None, ["$: not JSON"])
    assert check_call("[true]", SCHEMAS["sum"]) == ("[true]", ["$: not object"])
    assert check_call("1", None) == ("1", ["$: unknown tool"])
    assert canonical({"b": ["é\n\"", 1.0], "a": None}) == '{"a":null,"b":["é\\n\\"",1.0]}'


def test_links(spark):
    calls = [
        (1, "c", 3, "sum", '{"b":null,"a":1}', ["a", "b"]),
        (1, "a", 1, "list", "{}", None),
        (1, "b", 2, "list", '{"of":["é \\" \\\\ \\n"]}', ["a", "gone"]),
        (1, "b", 2, "list", '{"of":["é \\" \\\\ \\n"]}', ["a", "gone"]),
        (1, "x", 1, "sum", "no", ["y"]),
        (1, "y", 1, "sum", "{}", ["x"]),
        (1, "z", 9, "sum", "{}", ["y"]),
        (2, "a", None, None, None, []),
        (None, "a", 1, "sum", "{}", []),
        (2, None, 1, "sum", "{}", []),
    ]
    results = [(1, "a", 5, "late"), (1, "a", 4, "two"), (1, "a", 4, "one"), (1, "c", 4, None), (1, "gone", 1, "?"), (None, "a", 1, "?"), (2, "c", 4, "other")]
    df = spark.createDataFrame(calls, CALLS).withColumns({k: F.lit(1) for k in ("depth", "position", "n_results")})
    rows = {(r["conv_id"], r["call_id"]): r for r in link_calls(df, spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    assert {k: (r["position"], r["depth"]) for k, r in rows.items()} == {
        (1, "a"): (1, 0), (1, "b"): (2, 1), (1, "c"): (3, 2), (1, "x"): (4, None), (1, "y"): (5, None), (1, "z"): (6, None), (2, "a"): (1, 0),
    }
    assert {k: (r["result"], r["n_results"]) for k, r in rows.items() if r["n_results"]} == {(1, "a"): ("one", 3), (1, "c"): (None, 1)}
    for r in rows.values():
        if r["arguments"] is None:
            assert r["call_json"] is None and r["problems"] == ["$: not JSON"]
            continue
        value = {"arguments": json.loads(r["arguments"]), "id": r["call_id"], "result": r["result"], "tool": r["tool"]}
        assert r["call_json"] == canonical(value)


def brute_depths(calls):
    after = {c: [x for x in on if x in {k for k, _ in calls}] for c, on in calls}
    depth = {}
    while True:
        ready = {c: max([depth[x] + 1 for x in on], default=0) for c, on in after.items() if c not in depth and all(x in depth for x in on)}
        if not ready:
            return {c: depth.get(c) for c in after}
        depth |= ready


def test_depths_of_graphs(spark):
    rng = random.Random(7)
    graphs = {}
    for conv in range(12):
        n = rng.randint(1, 40)
        calls = [(f"c{k}", [f"c{rng.randrange(k)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if k else []) for k in range(n)]
        if conv % 3 == 0:  # cycles, and calls behind them
            calls += [("x", ["y"]), ("y", ["x"]), ("z", ["y", "c0"]), ("s", ["s"]), ("t", ["z"])]
        graphs[conv] = calls
    graphs[99] = [(f"c{k}", [f"c{k - 1}"]) for k in range(400)]
    rows = [(conv, c, k, "sum", "{}", on) for conv, calls in graphs.items() for k, (c, on) in enumerate(calls)]
    got = {(r["conv_id"], r["call_id"]): r["depth"] for r in depths(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {(conv, c): d for conv, calls in graphs.items() for c, d in brute_depths(calls).items()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(tool_calls, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    calls = [(1, f"c{k}", k, "sum", "{}", [f"c{k - 1}"]) for k in range(400)]
    got = depths(spark.createDataFrame(calls, CALLS)).collect()
    assert {r["call_id"]: r["depth"] for r in got} == {f"c{k}": k for k in range(400)}
    assert rounds.count("call-chains") <= 10 and rounds.count("call-depths") == 1


def test_odd_json():
    assert check_call('"\\ud800"', {}) == (None, ["$: not Unicode"])
    assert check_call("[" * 100_000 + "]" * 100_000, {})[0] is None
    assert check_call("true", {"enum": [1]})[1] == ["$: not one of the allowed values"]
    assert check_call("1.0", {"enum": [1]})[1] == []
    assert len(check_call(json.dumps("x" * 2_000_000), {"type": "string"})[0]) == 2_000_002


@pytest.mark.parametrize("schema", [{"anyOf": []}, {"type": "text"}, {"properties": {"a": {"const": 1}}}, {"items": {"minItems": 2}}, {"additionalProperties": {}}])
def test_schemas_that_are_not_understood_raise(spark, schema):
    with pytest.raises(ValueError, match="understood|must be"):
        link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), {"sum": schema})


def test_long_chain_and_nothing(spark):
    calls = [(1, f"c{k}", k, "sum", "{}", [f"c{k - 1}"]) for k in range(12)]
    got = depths(spark.createDataFrame(calls, CALLS)).collect()
    assert {r["call_id"]: r["depth"] for r in got} == {f"c{k}": k for k in range(12)}
    assert link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect() == []
