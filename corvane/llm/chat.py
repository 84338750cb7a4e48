"""Chat formatting: link tool calls to results, order them, validate arguments, serialise canonical JSON.

Events are messages, calls and results. Calls and results are hash-joined by
(conversation, call id): every join on that key is hinted as a shuffled hash join. A call
may name results it needs, as {"$result": "<call id>"} in its arguments; its level is one
more than the highest level among those calls, and a result has its call's level, so
order by (level, turn, step) is topological. Arguments are validated against a JSON
Schema for each tool, compiled to one Column.
Only DataFrame functions are used, and no step gathers a conversation in one task.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.numbers import variant_text
from corvane.llm.shared import Table
from corvane.plans.lower import Lowering, Value, as_column
from corvane.plans.model import SchemaError


class _Columns(Lowering):
    """Schemas as Columns alone: what needs a Python worker is refused."""

    def evaluated(self, s: Any, v: Value) -> Column:
        raise SchemaError("a recursive schema has no finite Column")


def valid_against(value: Column, schema: dict[str, Any]) -> Column:
    """Whether a VARIANT meets a JSON Schema, all keywords of draft 2020-12 but formats. Never null; a missing value fails."""
    lowering = _Columns(schema)
    return value.isNotNull() & F.coalesce(as_column(lowering.pred(lowering.schema, Value(value, T.VariantType(), False))), F.lit(False))


def hash_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """The join with a hash table of the right side's partitions."""
    return left.join(right.hint("shuffle_hash"), key, how)


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that (conv_id, call_id, needs array<string>) lists once each.

    Each call starts with its needs as targets, one step away; in every round a target is
    replaced by its own targets, so steps double until all targets are calls without
    needs, and the level is the longest way to one. A need that is no call of the
    conversation is ignored. Calls on or behind a cycle never come to an end; they have
    no level and are left out.
    """
    key = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("to"))
    links = calls.select(*key, F.explode("needs").alias("to")).distinct().transform(hash_join, known, ["conv_id", "to"], "left_semi")
    links = Table(links, "needs")
    roots = Table(hash_join(calls.select(*key), links.df.select(*key).distinct(), key, "left_anti"), "roots")
    ends = roots.df.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("end"))
    steps = hash_join(links.df, ends, ["conv_id", "to"], "left").select(*key, "to", F.lit(1).cast("long").alias("steps"), F.coalesce("end", F.lit(False)).alias("end"))
    steps = Table(steps, "steps")
    ended = [steps]  # each round writes only what came to an end in it, and what goes on
    most = calls.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    hops = steps.df
    for _ in range(most.bit_length()):
        going = steps.df.filter(~F.col("end"))
        if going.isEmpty():
            break
        hop = hops.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("end").alias("ends"))
        moved = hash_join(going, hop, ["conv_id", "to"]).select(*key, F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("end"))
        steps = Table(moved.groupBy(*key, "to").agg(F.max("steps").alias("steps"), F.max("end").alias("end")), "steps")
        ended.append(steps)
        # a call's targets after this round: those that had ended, and where the others got to
        hops = reduce(DataFrame.unionByName, [t.df.filter("end") for t in ended[:-1]], steps.df)
    every = reduce(DataFrame.unionByName, [t.df.filter("end") for t in ended], steps.df.filter(~F.col("end")))
    levels = every.groupBy(*key).agg(F.max("steps").cast("int").alias("level"), F.bool_and("end").alias("_ended")).filter("_ended").drop("_ended")
    out = Table(roots.df.withColumn("level", F.lit(0)).unionByName(levels), "levels")
    for table in (links, roots, *ended):
        table.drop()
    return out.df


def format_chat(events: DataFrame, tools: dict[str, dict[str, Any]]) -> DataFrame:
    """Link, order, validate and serialise events.

    Events have conv_id, turn, role, kind ("message", "call" or "result"), call_id,
    name, arguments (JSON text) and content. Returns for every event, repeated ones
    too: conv_id, turn, role, kind, call_id, linked_turn (of the first result for a
    call, of the first call for a result; null if there is none), level, step (0, or 1
    for results), status ("plain", "linked", "open" call, "orphan" result, "cyclic"),
    valid (1 or 0 for calls, else null), message (canonical JSON: keys sorted at every
    level, numbers in shortest plain notation, nulls of the event left out). Arguments that aren't JSON are invalid and are written as a
    string. A null or empty conv_id or call_id links with nothing. Of several calls
    with one id the earliest counts. Other columns are ignored; no events give none.
    """
    key = ["conv_id", "call_id"]
    events = events.select("conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "content")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    usable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & (F.col("call_id") != "")
    first = F.min(F.struct("turn", "arguments"))
    calls = Table(events.filter(is_call & usable).groupBy(key).agg(first.alias("c")).select(*key, F.col("c.turn").alias("call_turn"), needs_of("c.arguments").alias("needs")), "calls").df
    results = events.filter(is_result & usable).groupBy(key).agg(F.min("turn").alias("result_turn"))
    levels = call_levels(calls.select(*key, "needs"))
    linked = hash_join(hash_join(calls.drop("needs"), results, key, "left"), levels, key, "left")
    rows = hash_join(events, linked.unionByName(hash_join(results, calls, key, "left_anti").withColumns({"call_turn": F.lit(None).cast(linked.schema["call_turn"].dataType), "level": F.lit(None).cast("int")})), key, "left")
    has_call = F.col("call_turn").isNotNull() & usable
    other = F.when(is_call & usable, F.col("result_turn")).when(is_result & usable, F.col("call_turn"))
    status = (
        F.when(~(is_call | is_result), "plain")
        .when(has_call & F.col("level").isNull(), "cyclic")
        .when(is_call, F.when(other.isNull(), "open").otherwise("linked"))
        .otherwise(F.when(other.isNull(), "orphan").otherwise("linked"))
    )
    value = F.try_parse_json("arguments")
    valid = F.lit(False)
    for name, schema in tools.items():
        valid = F.when(F.col("name") == name, valid_against(value, schema)).otherwise(valid)
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("name"), F.col("role"), F.lit("call").alias("type")))
    raw = F.when(F.col("arguments").isNull(), F.lit("{}")).otherwise(F.to_json(F.struct(F.col("arguments").alias("raw"))))
    text = F.when(is_call, F.concat(F.lit('{"arguments":'), F.coalesce(variant_text(value), raw), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))).when(is_result, F.to_json(F.struct(F.col("call_id"), F.col("content"), F.col("role"), F.lit("result").alias("type")))).otherwise(
        F.to_json(F.struct(F.col("content"), F.col("role"), F.lit("message").alias("type")))
    )
    return rows.select(
        "conv_id", "turn", "role", "kind", "call_id", other.alias("linked_turn"), F.coalesce("level", F.lit(0)).alias("level"), is_result.cast("int").alias("step"),
        status.alias("status"), F.when(is_call, valid.cast("int")).alias("valid"), text.alias("message"),
    )


def needs_of(arguments: str) -> Column:
    """The call ids that arguments name as {"$result": id}, at any depth: a member's name or a string is one token of the JSON."""
    string = r'"(?:[^"\\]|\\.)*+"'
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(arguments)), F.lit(rf'"\$result":{string}|{string}'), F.lit(0))
    named = F.filter(tokens, lambda t: t.startswith('"$result":"'))
    ids = F.transform(named, lambda t: F.from_json(F.concat(F.lit("["), F.substring(t, F.lit(11), F.length(t)), F.lit("]")), "array<string>")[0])
    return F.coalesce(F.filter(ids, lambda i: i != ""), F.array().cast("array<string>"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Conversation turns (conv_id, turn, role, text) as events.

    A user's turn calls the tool `search` with the turn's text and number, and names
    the result of the user's turn two before; an assistant's turn is the result for the
    turn before it; other turns are messages.
    """
    call_id = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    is_user, is_result = F.col("role") == "user", F.col("role") == "assistant"
    follows = F.when(F.col("turn") >= 2, F.struct(call_id(2).alias("$result")))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query"), F.col("turn").alias("page"), follows.alias("after")))
    return turns.select(
        "conv_id", "turn", "role", F.when(is_user, "call").when(is_result, "result").otherwise("message").alias("kind"),
        F.when(is_user, call_id(0)).when(is_result, call_id(1)).alias("call_id"), F.when(is_user, "search").alias("name"), F.when(is_user, arguments).alias("arguments"),
        F.when(~is_user | F.col("role").isNull(), F.col("text")).alias("content"),
    )


#: The tool that events_of_turns() calls.
SEARCH = {
    "search": {
        "type": "object", "required": ["query", "page"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 40}, "page": {"type": "integer", "minimum": 0, "maximum": 4}, "after": {"type": "object", "required": ["$result"]}},
    }
}
