"""Operator 9, chat formatting: tool calls linked with their results.

Calls and results are hash-joined by conversation and call id.  A call may name an earlier call whose
result it uses (``after``); its step is the length of that chain, found by pointer
doubling, so that a chain of n calls takes about log2(n) joins on unique ids and no
conversation is ever gathered in one task.  Arguments are parsed and checked against
the tool's schema, and each linked pair is written as canonical JSON: sorted keys, no
white space, no escapes beyond those JSON needs.  Order by (conv_id, step, call_id).

Edge cases, by ``status``: ``ok``; ``no_result``; ``orphan`` (a result whose call does
not exist, or without an id; its content is the message); ``message`` (a turn that is
neither call nor result, as it stands); ``bad_json``; ``no_schema``; ``bad_arguments`` (``error``
says where; all three keep the message of call and result); ``cycle`` (calls that wait for each other: step null).  An ``after`` that
names no call counts as none.  Repeated calls with one id: the least by its other
columns stands, ``n_calls`` tells how many there were; likewise results, ``n_results``;
every further distinct call or result is a row of status ``duplicate`` (how many of it
there were, its message, and as ``error`` what is wrong with it).  Tables whose results
name no conversation have global ids, and there only the numbers tell of repeats.
A call without an id, or without the conversation, links with nothing.  Empty tables give an empty result.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import bounded_batches, saved

_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list}


def _is(kind: str, value) -> bool:
    if kind == "null":
        return value is None
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, _KINDS[kind])


def violation(schema: dict, value, at: str = "$") -> str | None:
    """The first breach of a JSON schema (type, enum, bounds, required, properties,
    additionalProperties, items), as path and rule; None if there is none."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(k, value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: type"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: enum"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            return f"{at}: length"
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            return f"{at}: range"
    elif isinstance(value, list):
        for i, x in enumerate(value):
            if found := violation(schema.get("items", {}), x, f"{at}[{i}]"):
                return found
    elif isinstance(value, dict):
        for key in schema.get("required", []):
            if key not in value:
                return f"{at}.{key}: required"
        known = schema.get("properties", {})
        for key in sorted(value):
            if key in known:
                if found := violation(known[key], value[key], f"{at}.{key}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{key}: unknown"
    return None


def canonical(value) -> str:
    """Canonical JSON; whole floats are written as integers."""
    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(name: str):
    raise ValueError(name)


def render(call_id, name, arguments, content, schemas: dict) -> tuple[str | None, str | None, str | None]:
    """status (None: fine), error and message of one linked call; a call that fails keeps
    its message, with arguments that are no JSON as the string they are."""
    status = error = None
    try:
        args = json.loads(arguments or "", parse_constant=_refuse)
        canonical(args).encode()
    except (ValueError, RecursionError):
        status, args = "bad_json", arguments
    else:
        if name not in schemas:
            status, error = "no_schema", name
        elif found := violation(schemas[name], args):
            status, error = "bad_arguments", found
    messages = [{"role": "assistant", "tool_calls": [{"id": call_id, "name": name, "arguments": args}]}]
    if content is not None:
        messages.append(tool_message(call_id, content))
    return status, error, canonical(messages)


def tool_message(call_id, content, turn=None) -> dict:
    """A result as a message; with its turn, if that is known."""
    made = {"role": "tool", "tool_call_id": call_id, "content": content}
    return made if turn is None else made | {"turn": turn}


def steps(calls: DataFrame) -> DataFrame:
    """(scope, call_id, step) by pointer doubling over ``after``; step is null in a cycle."""
    ids = calls.select("scope", F.col("call_id").alias("up"))
    now = saved(calls.select("scope", "call_id", F.col("after").alias("up"))
                .join(ids.withColumn("there", F.lit(1)), ["scope", "up"], "left")
                .select("scope", "call_id", F.when(F.col("there") == 1, F.col("up")).alias("up"))
                .withColumn("step", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    n = now.count()
    for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
        if now.where("up IS NOT NULL").isEmpty():
            break
        above = now.select("scope", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("step").alias("more"))
        now = saved(now.where("up IS NOT NULL").join(above, ["scope", "up"])
                    .select("scope", "call_id", F.col("next").alias("up"), (F.col("step") + F.col("more")).alias("step"))
                    .unionByName(now.where("up IS NULL")))
    return now.select("scope", "call_id", F.when(F.col("up").isNull(), F.col("step")).alias("step"))


def _least(kinds: DataFrame, parts: list[str], n: str) -> DataFrame:
    """The least of the distinct rows of an id, ``n`` of all of them, and ``kinds``, their number."""
    return kinds.groupBy("scope", "call_id").agg(
        F.min(F.struct(*parts)).alias("least"), F.sum(n).alias(n), F.count(F.lit(1)).alias("kinds"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """``calls``: conv_id, call_id, name, arguments, after; ``results``: call_id, content
    and, if there are such columns, conv_id and turn.

    One row per call, per orphan and, where results tell their conversation, per further
    distinct row of an id: conv_id, step, call_id, status, error, n_calls, n_results,
    message.  Results with conv_id link within it; without, ids are global."""
    local, kind = "conv_id" in results.columns, calls.schema["conv_id"].dataType
    for c, own in (("conv_id", kind), ("turn", "long")):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast(own))
    scope = F.col("conv_id") if local else F.lit(0).cast("long")
    calls, results = calls.withColumn("scope", scope), results.withColumn("scope", scope)
    there = F.col("call_id").isNotNull() & F.col("scope").isNotNull()

    of_call = ["conv_id", "name", "arguments", "after"]
    call_kinds = saved(calls.where(there).groupBy("scope", "call_id", *of_call).agg(F.count(F.lit(1)).alias("n_calls")))
    named = saved(_least(call_kinds, of_call, "n_calls").select("scope", "call_id", "least", "least.*", "n_calls", "kinds"))
    of_result = ["none", "content", "conv_id", "turn"]
    result_kinds = saved(results.where(there).withColumn("none", F.col("content").isNull())
                         .groupBy("scope", "call_id", *of_result).agg(F.count(F.lit(1)).alias("n_results")))
    given = saved(_least(result_kinds, of_result, "n_results")
                  .select("scope", "call_id", "least", F.coalesce("least.content", F.lit("")).alias("content"),
                          F.col("least.conv_id").alias("r_conv"), "least.turn", "n_results", "kinds"))
    step = saved(steps(named.drop("least", "kinds")))
    linked = named.drop("least", "kinds").withColumn("is_call", F.lit(True)) \
        .join(given.drop("least", "kinds"), ["scope", "call_id"], "full").join(step, ["scope", "call_id"], "left")
    bare = calls.where(~there).select(
        "call_id", "conv_id", "name", "arguments", "after", F.lit(1).cast("long").alias("n_calls"),
        F.lit(True).alias("is_call"), F.lit(0).cast("long").alias("step"))
    lost = results.where(~there).select(
        "call_id", "content", F.col("conv_id").alias("r_conv"), "turn", F.lit(1).cast("long").alias("n_results"))
    rows = linked.drop("scope").unionByName(bare, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True) \
        .withColumn("again", F.lit(False))
    if local:
        def others(kinds, least, parts):
            firsts = least.where("kinds > 1").select("scope", "call_id", "least")
            return kinds.join(firsts, ["scope", "call_id"]).where(~F.struct(*parts).eqNullSafe(F.col("least"))) \
                .join(step, ["scope", "call_id"], "left").drop("scope", "least").withColumn("again", F.lit(True))

        more = others(call_kinds, named, of_call).withColumn("is_call", F.lit(True))
        more_results = others(result_kinds, given, of_result).drop("none").withColumnRenamed("conv_id", "r_conv")
        rows = rows.unionByName(more, allowMissingColumns=True).unionByName(more_results, allowMissingColumns=True)
    rows = rows.select(F.coalesce("conv_id", "r_conv").alias("conv_id"), "turn", "again", "step", "call_id", "name", "arguments", "content",
                       F.coalesce("is_call", F.lit(False)).alias("is_call"),
                       F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))

    def run(batches):
        names = ["conv_id", "step", "call_id", "status", "error", "n_calls", "n_results", "message"]
        for b in batches:
            made = []
            for r in b.to_pylist():
                status, error, message = ("orphan", None, canonical([tool_message(r["call_id"], r["content"], r["turn"])])) \
                    if not r["is_call"] else render(r["call_id"], r["name"], r["arguments"], r["content"], schemas)
                if r["again"]:
                    status, error = "duplicate", error or (status if r["is_call"] else None)
                elif status is None:
                    status = "cycle" if r["step"] is None else "no_result" if r["content"] is None else "ok"
                made.append((status, error, message))
            cols = [pa.array([m[k] for m in made], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names[:3]), *cols[:2], b.column("n_calls"), b.column("n_results"), cols[2]], names)

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, step long, call_id string, status string, error string, "
                                "n_calls long, n_results long, message string")


#: Tools that ``calls_of`` puts on the turns of a plain conversation.
SCHEMAS = {
    "note": {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
             "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "answer": {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
               "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
}


#: Turns that are results.
_RESULT = "role = 'user' AND (turn > 0 OR turn IS NULL)"


def _plain_turns(turns: DataFrame) -> DataFrame:
    """The four columns; conversations keep the type of their ids, a turn that is no number has none."""
    return turns.select("conv_id", F.col("turn").cast("string").try_cast("long").alias("turn"), "role", "text")


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text): an assistant's
    turn is a call (``note`` up to 200 characters, else ``answer``) that uses the result
    of the assistant's turn two before; a user's turn is the result of the turn before."""
    key = lambda step: F.concat_ws(":", F.col("conv_id"), F.col("turn") - step)
    turns = _plain_turns(turns)
    there = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = turns.where("role = 'assistant'").select(
        "conv_id", F.when(there, key(0)).alias("call_id"),
        F.when(F.length("text") <= 200, "note").otherwise("answer").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"), F.when(there & (F.col("turn") >= 2), key(2)).alias("after"))
    results = turns.where(_RESULT).select(
        "conv_id", "turn", F.when(there, key(1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def messages_of(turns: DataFrame) -> DataFrame:
    """Every turn that ``calls_of`` makes neither a call nor a result of (system turns,
    opening prompts, other and null roles), as a message of its own: status ``message``."""
    kind = turns.schema["conv_id"].dataType
    plain = _plain_turns(turns).where(f"NOT coalesce(role = 'assistant', false) AND NOT coalesce({_RESULT}, false)")

    def run(batches):
        for b in batches:
            made = [canonical([{"role": r["role"], "turn": r["turn"], "content": r["text"]}]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(made, pa.string())], ["conv_id", "message"])

    none = lambda of: F.lit(None).cast(of)
    bounded_batches(turns.sparkSession)
    zero = F.lit(0).cast("long")
    return plain.mapInArrow(run, f"conv_id {kind.simpleString()}, message string").select(
        "conv_id", none("long").alias("step"), none("string").alias("call_id"), F.lit("message").alias("status"),
        none("string").alias("error"), zero.alias("n_calls"), zero.alias("n_results"), "message")


def chat(turns: DataFrame) -> DataFrame:
    """All turns of a table: linked calls and results, orphans, and plain messages."""
    return link_calls(*calls_of(turns), SCHEMAS).unionByName(messages_of(turns))
