"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON.

Messages are (conv_id, turn, role, text).  A message whose text is a JSON object with `tool_calls` makes calls (each with id, name,
arguments and, if it builds on another call, `after`); a message of role `tool` whose text is a JSON object with `tool_call_id` is a
result; every other message is plain.  What a message with calls says beside them (content, a role other than assistant, further fields)
is a message row of its own; further fields of calls and results stay in their JSON.  Calls and results meet in a hash join on conversation and identifier.  A call's place comes
from its chain of `after` calls: depth and latest turn of the chain, found by pointer doubling, so a chain of n calls takes log2(n)
joins.  (seq_turn, level, kind) sorts each conversation so that a call follows the calls it builds on and a result follows its call,
keeping turns where they allow it.  Arguments are checked against the schema of the tool; JSON is written with sorted keys and no
blanks.  Built-in functions only; nothing is collected by conversation, so one of any length stays spread over tasks.

Result, one row per plain message, call and result: conv_id, turn, kind (message, call, result), call_id, name, level, seq_turn,
status, errors (comma-joined codes, empty if none), json.  Status of a call: linked or no_result; of a result: linked, orphan (no such
call) or repeated (a later result of a call that has one); of a call in or behind a ring of `after`: cyclic; of a second call with
a used identifier: repeated_id (its result is that of the first); of a call without identifier beside others: missing_id; of a message:
plain, or beside_calls.

Cases: a null or empty text is a plain message with null or empty content; text that is not JSON is plain; a null role is written as
null; null conversations form one conversation; equal (turn, id) ties are broken by the JSON itself; of exactly repeated calls one
counts as the first; a message whose calls all lack an identifier is plain; the role of a result is that of its message, a `role` inside
its text gives way; an unknown tool, broken or missing arguments are errors, not crashes; further columns are left aside; an empty
table gives an empty result.
"""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm.rows import quoted
from graftline.plans.lineage import cut

#: Tools and their parameters: type (string, integer, number, boolean, array, object), required, minimum, maximum, max_length, choices.
SCHEMAS: dict[str, dict[str, dict[str, Any]]] = {
    "search": {"query": {"type": "string", "required": True, "max_length": 400}, "limit": {"type": "integer", "required": True, "minimum": 1, "maximum": 50}, "lang": {"type": "string", "choices": ["en", "de", "fr", "es"]}},
    "lookup": {"key": {"type": "string", "required": True}, "exact": {"type": "boolean"}},
}
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
OUTPUT = ["conv_id", "turn", "kind", "call_id", "name", "level", "seq_turn", "status", "errors", "json"]


def json_text(value: Column) -> Column:
    """A string as JSON, null as null."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.char_length(whole) - 6)


def further_fields(text: Column, known: list[str]) -> Column:
    """(key, canonical JSON) of the fields of a JSON object other than the known ones; an empty array if there are none."""
    fields = F.map_entries(F.from_json(text, "map<string,variant>"))
    left = F.filter(fields, lambda e: ~e["key"].isin(known))
    pairs = F.transform(left, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")))
    return F.coalesce(pairs, F.array().cast("array<struct<key:string,json:string>>"))


def json_object(fields: dict[str, Column], further: Column | None = None) -> Column:
    """An object of ready JSON values and the further fields, keys sorted."""
    if further is not None:
        own = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("json")) for k, v in fields.items()])
        pieces = F.transform(F.array_sort(F.concat(own, further)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["json"]))
        return F.when(F.size(further) == 0, json_object(fields)).otherwise(F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}")))
    parts: list[Column] = []
    for i, k in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{k}":'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, dict[str, Any]]]) -> Column:
    """Codes of what is wrong with a call's arguments (a JSON text), sorted and comma-joined."""
    tree = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(tree).startswith("OBJECT")
    by_tool: Column = F.array(F.lit("unknown_tool"))
    for tool, parameters in schemas.items():
        checks: list[Column] = []
        for p, rule in sorted(parameters.items()):
            part = F.try_variant_get(tree, f"$.{p}", "variant")
            kind = F.regexp_extract(F.schema_of_variant(part), r"^(\w+)", 1)
            kind = F.when(kind.startswith("DECIMAL"), F.when(F.regexp_extract(F.schema_of_variant(part), r",\s*(\d+)\)", 1) == "0", "BIGINT").otherwise("DOUBLE")).otherwise(kind)
            absent = part.isNull() | (kind == "VOID")
            if rule.get("required"):
                checks.append(F.when(absent, f"{p}:missing"))
            right = kind.isin(_TYPES[rule["type"]])
            checks.append(F.when(~absent & ~right, f"{p}:type"))
            number, text = F.try_variant_get(tree, f"$.{p}", "double"), F.try_variant_get(tree, f"$.{p}", "string")
            if "minimum" in rule:
                checks.append(F.when(~absent & right & (number < rule["minimum"]), f"{p}:minimum"))
            if "maximum" in rule:
                checks.append(F.when(~absent & right & (number > rule["maximum"]), f"{p}:maximum"))
            if "max_length" in rule:
                checks.append(F.when(~absent & right & (F.char_length(text) > rule["max_length"]), f"{p}:max_length"))
            if "choices" in rule:
                checks.append(F.when(~absent & right & ~text.isin(rule["choices"]), f"{p}:choice"))
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in parameters])), lambda k: F.concat(k, F.lit(":unknown")))
        by_tool = F.when(name == tool, F.concat(F.array_compact(F.array(*checks)), extra)).otherwise(by_tool)
    return F.concat_ws(",", F.sort_array(F.when(tree.isNull() | ~F.coalesce(is_object, F.lit(False)), F.when(name.isin(list(schemas)), F.array(F.lit("arguments:not_an_object"))).otherwise(F.array(F.lit("unknown_tool")))).otherwise(by_tool)))


def read_messages(messages: DataFrame) -> DataFrame:
    """Messages taken apart: conv_id, turn, role, text, result_id (of a tool result) and calls (array of id, name, arguments, after, raw)."""
    text = F.col("text")
    listed = F.get_json_object(text, "$.tool_calls")
    calls = F.zip_with(F.from_json(listed, "array<struct<id:string,name:string,arguments:string,after:string>>"), F.from_json(listed, "array<string>"),
                       lambda c, raw: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments"), c["after"].alias("after"), raw.alias("raw")))
    return (messages.select(*[quoted(c).alias(c) for c in ("conv_id", "turn", "role", "text")])
            .withColumn("looks", F.ltrim("text").startswith("{"))
            .select("conv_id", "turn", "role", "text", F.when(F.col("looks") & (F.col("role") == "tool"), F.get_json_object(text, "$.tool_call_id")).alias("result_id"),
                    F.when(F.col("looks") & F.contains(text, F.lit('"tool_calls"')), F.when(F.exists(calls, lambda c: c["id"].isNotNull()), calls)).alias("calls")))


def chain_places(calls: DataFrame) -> DataFrame:
    """(conv, id, level, seq_turn, cyclic) of each call: depth and latest turn of its chain of `after` calls, by pointer doubling."""
    links = calls.select("conv", "id", "turn", "after").alias("c")
    known = calls.select(F.col("conv").alias("k_conv"), F.col("id").alias("k_id"))
    # an `after` that names no call of the conversation is no link
    state = cut(links.join(known, (F.col("conv") == F.col("k_conv")) & (F.col("after") == F.col("k_id")), "left")
                .select("conv", "id", F.col("k_id").alias("up"), F.when(F.col("k_id").isNull(), 0).otherwise(1).cast("long").alias("level"), F.col("turn").alias("seq_turn")))
    total = state.filter("up is not null").count()
    reach = 1
    while total and reach <= total and state.filter("up is not null").limit(1).count():
        above = state.select(F.col("conv").alias("a_conv"), F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("level").alias("a_level"), F.col("seq_turn").alias("a_turn"))
        state = cut(state.join(above, (F.col("conv") == F.col("a_conv")) & (F.col("up") == F.col("a_id")), "left")
                    .select("conv", "id", F.col("a_up").alias("up"), (F.col("level") + F.coalesce("a_level", F.lit(0))).alias("level"), F.greatest("seq_turn", "a_turn").alias("seq_turn")))
        reach *= 2
    return state.select("conv", "id", F.when(F.col("up").isNull(), F.col("level")).alias("level"), "seq_turn", F.col("up").isNotNull().alias("cyclic"))


def format_chats(messages: DataFrame, schemas: dict[str, dict[str, dict[str, Any]]] | None = None) -> DataFrame:
    """One row per plain message, call and result, with its place, status and canonical JSON."""
    schemas = SCHEMAS if schemas is None else schemas
    conv = F.to_json(F.struct(F.col("conv_id").alias("c")))  # null conversations are one
    parts = cut(read_messages(messages).withColumn("conv", conv))
    plain = parts.filter("result_id is null and (calls is null or size(calls) = 0)").select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("level"), F.col("turn").alias("seq_turn"),
        F.lit("plain").alias("status"), F.lit("").alias("errors"), json_object({"content": json_text(F.col("text")), "role": json_text(F.col("role"))}).alias("json"))
    said = parts.filter("result_id is null and size(calls) > 0").withColumn("content", F.get_json_object("text", "$.content")).withColumn("further", further_fields(F.col("text"), ["content", "role", "tool_calls"]))
    beside = said.filter(F.col("content").isNotNull() | ~F.col("role").eqNullSafe("assistant") | (F.size("further") > 0)).select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("level"), F.col("turn").alias("seq_turn"),
        F.lit("beside_calls").alias("status"), F.lit("").alias("errors"), json_object({"content": json_text(F.col("content")), "role": json_text(F.col("role"))}, F.col("further")).alias("json"))
    made = cut(parts.filter("size(calls) > 0").select("conv_id", "conv", "turn", F.posexplode("calls").alias("nth", "call")).select("conv_id", "conv", "turn", "nth", "call.*")
               .withColumn("errors", argument_errors(F.col("name"), F.col("arguments"), schemas))
               .withColumn("further", further_fields(F.col("raw"), ["after", "arguments", "id", "name"]))
               .withColumn("json", json_object({"after": json_text(F.col("after")), "arguments": F.coalesce(F.to_json(F.try_parse_json("arguments")), json_text(F.col("arguments"))), "id": json_text(F.col("id")), "name": json_text(F.col("name"))}, F.col("further"))).drop("raw", "further"))
    nameless = made.filter("id is null").select("conv_id", "turn", F.lit("call").alias("kind"), F.col("id").alias("call_id"), "name", F.lit(-1).cast("long").alias("level"), F.col("turn").alias("seq_turn"), F.lit("missing_id").alias("status"), "errors", "json")
    made = made.filter("id is not null")
    order = F.struct("turn", "nth", "json")
    first = made.groupBy("conv", "id").agg(F.min(order).alias("first"), F.min_by("after", order).alias("after")).select("conv", "id", "after", F.col("first.turn").alias("turn"), "first")
    places = chain_places(first)
    given = parts.filter("result_id is not null").select("conv_id", "conv", "turn", F.col("result_id").alias("id"), F.get_json_object("text", "$.content").alias("content"), further_fields(F.col("text"), ["content", "role", "tool_call_id", "tool_calls"]).alias("further"))
    given = given.withColumn("json", json_object({"content": json_text(F.col("content")), "role": F.lit('"tool"'), "tool_call_id": json_text(F.col("id"))}, F.col("further"))).drop("further")
    answered = given.groupBy("conv", "id").agg(F.min(F.struct("turn", "json")).alias("answer"))
    linked = cut(first.select("conv", "id", "first").join(places, ["conv", "id"]).join(answered.hint("shuffle_hash"), ["conv", "id"], "left"))
    calls = (made.join(linked, ["conv", "id"]).withColumn("again", F.struct("turn", "nth", "json") != F.col("first"))
             .select("conv_id", "turn", F.lit("call").alias("kind"), F.col("id").alias("call_id"), "name", F.coalesce("level", F.lit(-1)).cast("long").alias("level"), F.greatest("turn", "seq_turn").alias("seq_turn"),
                     F.when(F.col("cyclic"), "cyclic").when(F.col("again"), "repeated_id").when(F.col("answer").isNull(), "no_result").otherwise("linked").alias("status"), "errors", "json"))
    results = (given.join(linked.select("conv", "id", "level", "seq_turn", "answer"), ["conv", "id"], "left").withColumn("same", F.struct("turn", "json") == F.col("answer"))
               .select("conv_id", "turn", F.lit("result").alias("kind"), F.col("id").alias("call_id"), F.lit(None).cast("string").alias("name"), F.coalesce("level", F.lit(-1)).cast("long").alias("level"),
                       F.greatest("turn", "seq_turn").alias("seq_turn"), F.when(F.col("answer").isNull(), "orphan").when(F.col("same"), "linked").otherwise("repeated").alias("status"), F.lit("").alias("errors"), "json"))
    return plain.unionByName(beside).unionByName(calls).unionByName(nameless).unionByName(results).select(*OUTPUT)
