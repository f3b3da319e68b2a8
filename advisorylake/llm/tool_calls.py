"""Chat formatting: tool calls linked to results, ordered, validated and serialised."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from advisorylake.session import Scratch

_KINDS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def canonical(value) -> str:
    """JSON without spaces, keys in UTF-16 order, whole numbers without a fraction."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return str(int(value)) if value == int(value) and abs(value) < 1 << 53 else repr(value)
    return json.dumps(value, ensure_ascii=False)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value: type, required, properties, additionalProperties, items, enum, minimum, maximum."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the allowed values")
    if _KINDS["number"](value):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below the minimum")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above the maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    return found


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def parse(text: str):
    def bad(name):
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=_unique, parse_constant=bad)


def _format_batches(batches: Iterator[pa.RecordBatch], schemas: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
            errors, lines = [], []
            for row in part.to_pylist():
                found, value = [], None
                try:
                    value = parse(row["arguments"] or "")
                    text = canonical(value)
                except (ValueError, RecursionError):
                    found, text = ["$: not JSON"], None
                if text is not None and row["name"] not in schemas.value:
                    found = ["unknown tool"]
                elif text is not None:
                    found = problems(value, schemas.value[row["name"]])
                errors.append(found)
                lines.append(None if found else canonical({
                    "after": row["after"], "arguments": value, "id": row["call_id"], "name": row["name"], "result": row["result"]}))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())],
                [*part.schema.names, "errors", "line"])


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(call_id, level): how many calls must come before each; null on a cycle or behind one.

    ``calls`` has unique call_id and ``after``. Pointers double their reach each round, so a chain of n calls takes
    log n rounds, whatever conversation holds it; a reference to no call is no reference.
    """
    ids = calls.select(F.col("call_id").alias("after"))
    open_ = calls.where(F.col("after").isNotNull()).join(ids, "after", "left_semi")
    links = scratch.write(calls.select("call_id").join(
        open_.select("call_id", "after"), "call_id", "left").select(
        "call_id", F.col("after").alias("up"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("level")), "links")
    before = None
    while True:
        left = links.where(F.col("up").isNotNull()).count()
        if left in (0, before):  # what no longer shrinks leads to a cycle
            break
        before = left
        above = links.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = links.where(F.col("up").isNotNull()).join(above, "up").select(
            "call_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        links = scratch.write(moved.unionByName(links.where(F.col("up").isNull())), "links")
        scratch.keep_only(links)
    return links.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: conv_id, call_id, seq, level, name, n_calls, n_results, errors, line.

    ``calls`` has conv_id, call_id, seq, name, arguments (JSON text) and after (the id of the call it builds on, or
    null); ``results`` has call_id, seq and result. ``line`` is the canonical JSON of call and result, null if ``errors`` says
    what is wrong with the arguments. Rising (level, seq) is a topological order of a conversation; it is given
    as columns, so no conversation has to fit a task.

    Rows without call_id are left out; of repeated ids the first by seq, then by content, is the call
    (or result), and n_calls and n_results tell how many there were. A call without a result has a null result, a result
    without a call is not returned. Calls on a cycle have a null level. ``schemas`` is a small
    constant of the deployment; extra columns are ignored.
    """
    spark = calls.sparkSession
    scratch = Scratch(spark, "calls")
    first = F.min(F.struct("seq", "name", "arguments", "after", "conv_id")).alias("c")
    one = scratch.write(calls.where(F.col("call_id").isNotNull()).select(
        F.col("call_id").cast("string").alias("call_id"), "seq", "name", "arguments", F.col("after").cast("string").alias("after"), "conv_id")
        .groupBy("call_id").agg(first, F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls"), "calls")
    answers = scratch.write(results.where(F.col("call_id").isNotNull()).select(
        F.col("call_id").cast("string").alias("call_id"), "seq", "result").groupBy("call_id").agg(
        F.min(F.struct("seq", "result")).alias("r"), F.count("*").alias("n_results")).select("call_id", "r.result", "n_results"), "results")
    order = levels(one.select("call_id", "after"), Scratch(spark, "levels"))
    joined = one.join(answers, "call_id", "left").join(order, "call_id").select(
        "conv_id", "call_id", "seq", "level", "name", "n_calls",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "arguments", "after", "result")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema)
    sent = spark.sparkContext.broadcast(schemas)
    return joined.mapInArrow(partial(_format_batches, schemas=sent), f"{fields}, errors array<string>, line string").drop(
        "arguments", "after", "result")
