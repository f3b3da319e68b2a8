"""Linking, order, validation and canonical text of tool calls."""

from __future__ import annotations

import json
import random

import pytest

from advisorylake.llm import queries, tool_calls as tc

SCHEMAS = {"f": {"type": "object", "required": ["q"], "additionalProperties": False,
                 "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 0, "maximum": 9},
                                "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}}, "any": {}}
CALL = "conv_id long, call_id string, seq long, name string, arguments string, after string, line string"
RESULT = "call_id string, seq long, result string, errors int"


def run(spark, calls, results):
    frame = tc.link(spark.createDataFrame([(*c, "x") for c in calls], CALL),
                    spark.createDataFrame([(*r, 1) for r in results], RESULT), SCHEMAS)
    return {r.call_id: r for r in frame.collect()}


def test_links_and_first_of_repeats(spark):
    calls = [(1, "a", 1, "any", "{}", None), (1, "a", 0, "any", '{"k":1}', None), (1, "b", 2, "any", "[1.0, 2.5]", "a"),
             (None, "c", None, None, None, None), (1, None, 3, "any", "{}", None)]
    got = run(spark, calls, [("a", 5, "late"), ("a", 4, "r"), ("zz", 1, "orphan"), (None, 1, "x"), ("b", 1, None)])
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].n_calls, got["a"].n_results, got["a"].level) == (2, 2, 0)
    assert got["a"].line == '{"after":null,"arguments":{"k":1},"id":"a","name":"any","result":"r"}'
    assert got["b"].line == '{"after":"a","arguments":[1,2.5],"id":"b","name":"any","result":null}' and got["b"].level == 1
    assert got["c"].line is None and got["c"].errors == ["$: not JSON"] and got["c"].n_results == 0


def test_levels_of_chains_trees_and_cycles(spark):
    rnd = random.Random(1)
    after = {f"n{i}": (f"n{rnd.randrange(i)}" if i and rnd.random() < 0.9 else None) for i in range(120)}
    after |= {f"l{i}": f"l{i - 1}" if i else None for i in range(70)}
    after |= {"x": "y", "y": "z", "z": "x", "tail": "x", "self": "self", "lost": "nowhere"}
    got = run(spark, [(1, k, 1, "any", "{}", v) for k, v in after.items()], [])

    def level(k, seen=()):
        if k in seen:
            return None
        up = after.get(k)
        if up not in after:
            return 0
        above = level(up, (*seen, k))
        return None if above is None else above + 1

    assert {k: got[k].level for k in after} == {k: level(k) for k in after}


@pytest.mark.parametrize("text,errors", [
    ('{"q":"x","n":3,"tags":["a"]}', []), ('{"n":3}', ["$.q: missing"]), ('{"q":1}', ["$.q: not string"]), ('{"q":"x","z":1}', ["$.z: unknown"]),
    ('{"q":"x","n":10}', ["$.n: above the maximum"]), ('{"q":"x","n":-1}', ["$.n: below the minimum"]), ('{"q":"x","n":true}', ["$.n: not integer"]),
    ('{"q":"x","tags":["a","c"]}', ["$.tags[1]: not one of the allowed values"]), ("[]", ["$: not object"]), ("{", ["$: not JSON"]),
    ('{"q":"x","q":"y"}', ["$: not JSON"]), ('{"q":NaN}', ["$: not JSON"]), ("[" * 100_000, ["$: not JSON"])])
def test_validation(spark, text, errors):
    batch = list(tc._format_batches(iter([tc.pa.RecordBatch.from_pylist(
        [{"call_id": "a", "name": "f", "arguments": text, "after": None, "result": None}])]), type("B", (), {"value": SCHEMAS})))[0]
    assert batch.column("errors")[0].as_py() == errors and (batch.column("line")[0].as_py() is None) == bool(errors)


def test_canonical_text():
    value = {"b": 1.0, "a": [True, None, 1e21, 0.1, -0.0], "é": " \"\n", "\U0001f600": {}, "דּ": 2**60}
    text = tc.canonical(value)
    assert json.loads(text) == value and text.index("\U0001f600") < text.index("דּ") and " " not in text
    assert tc.canonical(json.loads(text)) == text


def test_empty_tables(spark):
    assert run(spark, [], []) == {}


def test_query_covers_every_assistant_turn(spark, sf_dir):
    out = queries.op5_tool_calls(spark, sf_dir)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'").select("conv_id", "turn").distinct().count()
    assert out.count() == turns and out.where("line IS NULL").count() > 0 and out.where("level > 0").count() > 0
