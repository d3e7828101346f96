"""Tool calls of conversations: calls linked to results, ordered, validated and written as JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import stored

# JSON types that a schema may name, and what each accepts.
_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


# The keywords of a schema that are understood, and those that say nothing of a value.
KEYWORDS = frozenset(
    "type enum required properties additionalProperties items minimum maximum minLength maxLength pattern".split()
)
NOTES = frozenset("title description default examples $schema $id $comment".split())


def check_schema(schema: dict, at: str = "$") -> None:
    """Raise if a schema has a keyword or a type that is not understood."""
    for keyword in sorted(schema.keys() - KEYWORDS - NOTES):
        raise ValueError(f"{at}: the keyword {keyword} is not understood")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _TYPES:
            raise ValueError(f"{at}: the type {kind} is not understood")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties must be true or false")
    if not isinstance(schema.get("items", {}), dict):
        raise ValueError(f"{at}: items must be one schema")
    for name, inner in schema.get("properties", {}).items():
        check_schema(inner, f"{at}.{name}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def _same(a: object, b: object) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def canonical(value: object) -> str:
    """JSON with sorted keys, without spaces, and with every character as itself."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value under a schema, in a fixed order.

    Understood: ``type`` (one or several), ``enum``, ``required``, ``properties``, ``additionalProperties``
    (true or false), ``items``, ``minimum``, ``maximum``, ``minLength``, ``maxLength``, ``pattern``.
    """
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(_same(value, one) for one in schema["enum"]):
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known.keys() & value.keys()):
            out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, item in enumerate(value):
            out += problems(item, schema["items"], f"{at}[{k}]")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: does not match")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    return out


def check_call(arguments: str | None, schema: dict | None) -> tuple[str | None, list[str]]:
    """Canonical JSON of the arguments, or ``None`` if they are not JSON, and what is wrong with them.

    JSON that Unicode cannot hold, for half of a surrogate pair, or that is nested too deeply, has no
    canonical form either. A number of more than 4,300 digits is not JSON here.
    """
    try:
        value = json.loads(arguments or "")
        text = canonical(value)
        text.encode()
        if schema is None:
            return text, ["$: unknown tool"]
        return text, problems(value, schema)
    except UnicodeEncodeError:
        return None, ["$: not Unicode"]
    except ValueError:
        return None, ["$: not JSON"]
    except RecursionError:
        return None, ["$: nested too deeply"]


def _check(batches: Iterable[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, wrong = [], []
        for tool, arguments in zip(batch["tool"].to_pylist(), batch["arguments"].to_pylist()):
            text, found = check_call(arguments, schemas.get(tool))
            texts.append(text)
            wrong.append(found)
        names = [n for n in batch.schema.names if n != "arguments"]
        yield pa.RecordBatch.from_arrays(
            [batch[n] for n in names] + [pa.array(texts, pa.string()), pa.array(wrong, pa.list_(pa.string()))],
            names=[*names, "arguments", "problems"],
        )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _chains(start: DataFrame) -> DataFrame:
    """``conv_id, call_id, anchor, steps``: the end of the chain before each call, and how far it is.

    ``start`` has ``conv_id, call_id, n, on``: the number of predecessors, and one of them. A chain leads
    from a call with one predecessor to that, and ends at a call with none or several. In each round every
    call that is not there yet jumps as far again as it has come, so a chain takes rounds by the logarithm
    of its length. Calls whose chain is a cycle, or comes from one, are left out.
    """
    key = ["conv_id", "call_id"]
    ends = start.where("n <> 1").select(*key, F.col("call_id").alias("anchor"), F.lit(0).alias("steps"))
    done = [ends]
    waiting = start.where("n = 1").select(*key, "on", F.lit(1).alias("steps"))
    count = waiting.count()
    while count:
        known = _union(done).select("conv_id", F.col("call_id").alias("on"), "anchor", F.col("steps").alias("rest"))
        further = waiting.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("to"), F.col("steps").alias("more"))
        moved = waiting.join(known, ["conv_id", "on"], "left").join(further, ["conv_id", "on"], "left")
        steps = F.col("steps") + F.coalesce("rest", "more")
        moved = stored(moved.select(*key, "anchor", "to", steps.cast("int").alias("steps")), "call-chains")
        done.append(moved.where("anchor IS NOT NULL").select(*key, "anchor", "steps"))
        waiting = moved.where("anchor IS NULL").select(*key, F.col("to").alias("on"), "steps")
        left = waiting.count()
        if left == count:
            break
        count = left
    return stored(_union(done), "call-anchors")


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth``: the number of calls in the longest chain of ``after`` before a call.

    Calls that wait for a call that isn't there don't wait. Calls in a cycle, and those behind one, get a
    null depth. Chains are contracted first; what remains are the calls with several predecessors. Each
    further round settles those of them whose predecessors are all settled, and carries on the others.
    """
    key = ["conv_id", "call_id"]
    known = calls.select(*key).distinct()
    edges = calls.select(*key, F.explode("after").alias("on")).distinct()
    edges = stored(edges.join(known.withColumnRenamed("call_id", "on"), ["conv_id", "on"]), "call-edges")
    before = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("on").alias("on"))
    start = stored(known.join(before, key, "left").withColumn("n", F.coalesce("n", F.lit(0))), "call-starts")
    chains = _chains(start)
    settled = [start.where("n = 0").select("conv_id", F.col("call_id").alias("anchor"), F.lit(0).alias("base"))]
    # Edges of calls with several predecessors, to the ends of the chains of these.
    several = start.where("n > 1").select(*key)
    by_anchor = edges.join(several, key, "left_semi").join(
        chains.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left"
    )
    waiting = stored(by_anchor.select(*key, "anchor", "steps"), "call-waiting")
    count = waiting.count()
    while count:
        got = waiting.join(_union(settled), ["conv_id", "anchor"], "left")
        ready = got.groupBy(*key).agg(F.max(F.col("base") + F.col("steps") + 1).alias("base"), F.count_if(F.col("base").isNull()).alias("open"))
        ready = stored(ready.where("open = 0").select("conv_id", F.col("call_id").alias("anchor"), F.col("base").cast("int").alias("base")), "call-depths")
        settled.append(ready)
        waiting = stored(waiting.join(ready.select("conv_id", F.col("anchor").alias("call_id")), key, "left_anti"), "call-waiting")
        left = waiting.count()
        if left == count:
            break
        count = left
    found = chains.join(_union(settled), ["conv_id", "anchor"]).select(*key, (F.col("base") + F.col("steps")).cast("int").alias("depth"))
    return stored(known.join(found, key, "left"), "call-depths")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call: ``conv_id, call_id, position, depth, tool, arguments, problems, result,
    n_results, call_json``.

    ``calls`` has ``conv_id, call_id, turn, tool, arguments`` (JSON as text) and ``after`` (ids of calls of the same
    conversation that come before); ``results`` has ``conv_id, call_id, turn, result``. ``schemas`` holds the JSON schema of
    each tool. Calls and results are joined on both ids; of several results the one of the earliest turn, and of
    equal turns the smallest text, is linked, and ``n_results`` counts them. ``position`` numbers the calls
    of a conversation in topological order: by depth, turn and id, cycles last. ``call_json`` is the call with its
    arguments and result as canonical JSON, null where the arguments are not JSON.

    Calls without both ids are dropped, and of repeated ids the call of the earliest turn, and then of the smallest
    tool and arguments, stays. Null arguments are not JSON; a null list has no members; results without a call
    are ignored. A conversation with very many calls is sorted by one task, on ids and turns only. A schema
    with a keyword or a type that is not understood raises.
    """
    for schema in schemas.values():
        check_schema(schema)
    order = F.struct(F.col("turn").isNull(), "turn", "tool", "arguments", "after")
    named = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    named = named.groupBy("conv_id", "call_id").agg(F.min(order).alias("x"))
    named = stored(named.select("conv_id", "call_id", "x.turn", "x.tool", "x.arguments", "x.after"), "calls")
    answers = results.groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.col("turn").isNull(), "turn", "result"))["result"].alias("result"), F.count("*").alias("n_results")
    )
    by_depth = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("depth"), F.asc_nulls_last("turn"), "call_id")
    places = depths(named).join(named.select("conv_id", "call_id", "turn"), ["conv_id", "call_id"])
    places = places.select("conv_id", "call_id", "depth", F.row_number().over(by_depth).alias("position"))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    checked = named.select("conv_id", "call_id", "tool", "arguments").mapInArrow(
        lambda batches: _check(batches, schemas),
        f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, tool string, arguments string, problems array<string>",
    )
    linked = checked.join(places, ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "left")
    # Keys in sorted order; arguments are canonical JSON already.
    quoted = lambda c: F.coalesce(_quoted(F.col(c).cast("string")), F.lit("null"))
    text = F.concat(
        F.lit('{"arguments":'), "arguments",
        F.lit(',"id":'), quoted("call_id"),
        F.lit(',"result":'), quoted("result"),
        F.lit(',"tool":'), quoted("tool"),
        F.lit("}"),
    )
    return linked.select(
        "conv_id",
        "call_id",
        "position",
        "depth",
        "tool",
        "arguments",
        "problems",
        "result",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        text.alias("call_json"),
    )


def _quoted(text: Column) -> Column:
    """A JSON string, by way of an array of one: Spark escapes as :func:`canonical` does."""
    array = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(array, F.lit(2), F.length(array) - 2))
