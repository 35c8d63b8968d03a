"""Chat formatting: tool calls linked to their results, checked and serialised.

Messages are rows (conv_id, turn, role, text). An assistant's text that is a
JSON object with `tool_calls`, a list of {"id", "name", "arguments"} or of
{"id", "function": {"name", "arguments"}}, makes calls; a text of role `tool` that is a JSON object with `tool_call_id` is a
result. An argument "$id" stands for the result of the call with that id. All
else is plain content.

Column functions only; a conversation is never gathered into one value, so one
that holds a third of all rows is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import stored

CALLS = "array<struct<id:string,name:string,arguments:string,raw:string>>"
#: For each tool its parameters: (JSON type, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]

# JSON types by the type that a parsed value shows.
JSON_TYPES = {
    "STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "DOUBLE": "number", "VOID": "null",
}


def _json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    out = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
    for shown, name in JSON_TYPES.items():
        out = out.when(kind == shown, name)
    return out.when(kind.startswith("DECIMAL"), "number")


def _problems(call: Column, schemas: Schemas) -> Column:
    """What is wrong with a call: unknown tool, arguments missing or misfit."""
    given = F.from_json(call["arguments"], "map<string,variant>")
    types = F.transform_values(given, lambda _, v: _json_type(v))
    known = F.lit(False)
    wrong = F.array(F.concat(F.lit("unknown tool "), F.coalesce(call["name"], F.lit(""))))
    for tool, parameters in sorted(schemas.items()):
        extra = F.array_except(F.map_keys(given), F.array(*map(F.lit, sorted(parameters))).cast("array<string>"))
        checks = [F.transform(extra, lambda k: F.concat(F.lit("unexpected "), k))]
        for name, (kind, required) in sorted(parameters.items()):
            found = F.try_element_at(types, F.lit(name))
            fits = (found == kind) | ((F.lit(kind) == "number") & (found == "integer"))
            missing = F.when(F.lit(required) & ~F.map_contains_key(types, F.lit(name)), f"missing {name}")
            misfit = F.when(F.map_contains_key(types, F.lit(name)) & ~F.coalesce(fits, F.lit(False)), f"type of {name}")
            checks.append(F.array_compact(F.array(missing, misfit)))
        own = F.when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.concat(*checks)))
        wrong = F.when(call["name"] == tool, own).otherwise(wrong)
    return wrong


def _calls(listed: Column) -> Column:
    """The calls among the JSON texts of a list, in either form."""
    either = lambda c, name: F.coalesce(F.get_json_object(c, f"$.{name}"), F.get_json_object(c, f"$.function.{name}"))
    return F.transform(
        F.filter(listed, lambda c: c.startswith("{")),
        lambda c: F.struct(
            F.get_json_object(c, "$.id").alias("id"),
            either(c, "name").alias("name"),
            either(c, "arguments").alias("arguments"),
            c.alias("raw"),
        ),
    )


def _messages(conversations: DataFrame, schemas: Schemas) -> DataFrame:
    """The messages with their calls, the id they answer, and what is wrong."""
    text = F.coalesce("text", F.lit(""))
    looks_json = text.rlike(r"^\s*\{")
    listed = F.from_json(F.get_json_object(text, "$.tool_calls"), "array<string>")
    listed = F.when((F.col("role") == "assistant") & looks_json, listed)
    calls = _calls(listed)
    answers = F.when((F.col("role") == "tool") & looks_json, F.get_json_object(text, "$.tool_call_id"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("text"),
        F.coalesce(calls, F.array().cast(CALLS)).alias("calls"),
        answers.alias("answers"),
        F.coalesce(F.size(calls) < F.size(listed), F.lit(False)).alias("other"),
    )
    return rows.withColumn("problems", F.transform("calls", lambda c: _problems(c, schemas)))


def _keys(text: Column) -> Column:
    """How many keys a JSON text has, at all depths."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', '"')
    return F.regexp_count(plain, F.lit(r'"\s*:'))


def _read(text: Column) -> Column:
    """The parsed text; NULL if it is no JSON or an object repeats a key, of which one value would stay."""
    parsed = F.try_parse_json(text)
    return F.when(_keys(text) == _keys(F.to_json(parsed)), parsed)


def _fields(value: Column, *but: str) -> Column:
    """The fields of an object, without those named."""
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    return F.map_filter(fields, lambda k, _: ~k.isin(*but))


def _given(**values: Column) -> Column:
    """Those values that are not NULL, by name."""
    named = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("variant"))])
    return F.map_filter(named, lambda _, v: v.isNotNull())


def canonical() -> Column:
    """The message as JSON: keys in order, no white space, every field kept.

    Calls are written with `name` and `arguments` of their own, whichever form
    they had; arguments that are no JSON, or repeat a key, stay a string. A
    message that is not read whole (it repeats a key, names another role, or
    lists what is no call) has its text under `raw` as well.
    """
    called, answered = F.size("calls") > 0, F.col("answers").isNotNull()
    arguments = lambda c: F.coalesce(_read(c["arguments"]), c["arguments"].cast("variant"))

    def whole_call(c: Column) -> Column:
        parsed = _read(c["raw"])
        # `function` keeps what it holds beside the name and the arguments
        function = F.try_variant_get(parsed, "$.function", "variant")
        inner = F.coalesce(_fields(function, "name", "arguments"), F.create_map().cast("map<string,variant>"))
        outer = F.coalesce(_fields(parsed, "id", "name", "arguments"), F.create_map().cast("map<string,variant>"))
        nested = F.get_json_object(c["raw"], "$.name").isNull() | F.get_json_object(c["raw"], "$.arguments").isNull()
        read = nested & F.coalesce(F.schema_of_variant(function).startswith("OBJECT"), F.lit(False))
        rest = F.when(F.size(inner) > 0, F.to_variant_object(inner))
        kept = F.when(read, F.map_filter(outer, lambda k, _: k != "function")).otherwise(outer)
        own = F.when(read, _given(function=rest)).otherwise(F.create_map().cast("map<string,variant>"))
        return F.to_variant_object(
            F.map_concat(kept, own, _given(id=c["id"], name=c["name"], arguments=arguments(c)))
        )

    parsed = _read(F.col("text"))
    role = F.try_variant_get(parsed, "$.role", "string")
    whole = parsed.isNotNull() & ~F.col("other") & F.coalesce(role == F.col("role"), F.lit(True))
    links = _given(
        role=F.col("role"),
        tool_call_id=F.when(answered, F.col("answers")),
        tool_calls=F.when(called, F.to_variant_object(F.transform("calls", whole_call))),
    )
    taken = F.when(called, F.array(F.lit("role"), F.lit("tool_calls"))).otherwise(F.array(F.lit("role"), F.lit("tool_call_id")))
    others = F.map_filter(F.try_variant_get(parsed, "$", "map<string,variant>"), lambda k, _: ~F.array_contains(taken, k))
    short = F.transform("calls", lambda c: F.struct(arguments(c).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    in_part = F.struct(
        F.get_json_object("text", "$.content").alias("content"),
        F.col("text").alias("raw"),
        F.col("role").alias("role"),
        F.col("answers").alias("tool_call_id"),
        F.when(called, short).alias("tool_calls"),
    )
    return (
        F.when(~called & ~answered, F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"))))
        .when(whole, F.to_json(F.to_variant_object(F.map_concat(others, links))))
        .otherwise(F.to_json(in_part))
    )


def _ready(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, id, at, level): when the calls' results are there.

    `at` is the latest turn that a call, its result and all that it needs
    take; `level` counts calls on the longest way. Calls are taken out level
    by level, those that need nothing first; calls on a cycle, or behind one,
    or that need a missing result, are never taken out and keep their turn.
    """
    taken = stored(
        calls.where(F.size("needs") == 0)
        .join(results, ["conv_id", "id"], "left")
        .select("conv_id", "id", F.greatest("turn", F.coalesce("result", "turn")).alias("at"), F.lit(0).alias("level")),
        "ready",
    )
    waiting = calls.where(F.size("needs") > 0)
    while not waiting.isEmpty():
        needed = (
            waiting.select("conv_id", "id", F.size("needs").alias("n"), F.explode("needs").alias("need"))
            .join(taken.select("conv_id", F.col("id").alias("need"), "at", "level"), ["conv_id", "need"])
            .groupBy("conv_id", "id", "n")
            .agg(F.count("*").alias("met"), F.max("at").alias("at"), F.max("level").alias("level"))
            .where("met = n")
        )
        new = stored(
            needed.join(waiting.select("conv_id", "id", "turn"), ["conv_id", "id"])
            .join(results, ["conv_id", "id"], "left")
            .select(
                "conv_id",
                "id",
                F.greatest("at", "turn", F.coalesce("result", "turn")).alias("at"),
                (F.col("level") + 1).alias("level"),
            ),
            "ready",
        )
        if new.isEmpty():
            break
        waiting = stored(waiting.join(new, ["conv_id", "id"], "left_anti"), "waiting")
        taken = taken.union(new)
    return taken


def format_chats(conversations: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message, with its place in the order and its JSON.

    Sorting a conversation by (order_turn, level, turn) puts every result
    behind its call and every call behind the results it needs. `linked`: a
    result's call is there. `valid`: all calls of a message fit their schema;
    NULL without calls. Several calls with one id in a conversation: the first
    one counts; several results: each is linked. NULL roles and texts count as
    empty, text that is no JSON is content, rows without conv_id or turn are
    kept and linked to nothing, repeated rows stay, an empty table gives no
    rows, extra columns are not read.
    """
    rows = _messages(conversations, schemas or {})
    # Stored once, so that texts are parsed once and links are found on few columns.
    rows = stored(rows, "messages")
    needs = F.array_distinct(F.regexp_extract_all(F.col("c.arguments"), F.lit(r'"\$([^"]+)"'), F.lit(1)))
    calls = (
        rows.where(F.size("calls") > 0)
        .select("conv_id", "turn", F.explode("calls").alias("c"))
        .select("conv_id", F.col("c.id").alias("id"), "turn", F.coalesce(needs, F.array().cast("array<string>")).alias("needs"))
        .where("id IS NOT NULL")
        .groupBy("conv_id", "id")
        .agg(F.min("turn").alias("turn"), F.min_by("needs", "turn").alias("needs"))
    )
    calls = stored(calls, "calls")
    results = (
        rows.where("answers IS NOT NULL")
        .groupBy("conv_id", F.col("answers").alias("id"))
        .agg(F.max("turn").alias("result"))
    )
    ready = calls.join(_ready(calls, results).drop("turn"), ["conv_id", "id"], "left").select(
        "conv_id", "id", F.col("turn").alias("called"), F.coalesce("at", "turn").alias("at"), F.coalesce("level", F.lit(0)).alias("level")
    )
    # A result follows its call; a call follows the results it needs.
    of_result = ready.select("conv_id", F.col("id").alias("answers"), "called", F.col("level").alias("_level"))
    needed = (
        calls.select("conv_id", "turn", F.explode("needs").alias("id"))
        .join(ready, ["conv_id", "id"])
        .groupBy("conv_id", "turn")
        .agg(F.max("at").alias("_after"), F.max("level").alias("_above"))
    )
    at_result = F.greatest("turn", "called")
    return (
        rows.join(of_result, ["conv_id", "answers"], "left")
        .join(needed, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.size("calls").cast("long").alias("n_calls"),
            F.col("answers").alias("call_id"),
            F.when(F.col("answers").isNotNull(), F.col("called").isNotNull()).alias("linked"),
            F.when(F.size("calls") > 0, F.size(F.flatten("problems")) == 0).alias("valid"),
            F.array_join(F.flatten("problems"), "; ").alias("problems"),
            F.greatest(at_result, "_after", "turn").cast("long").alias("order_turn"),
            F.when(F.col("called").isNotNull(), 2 * F.col("_level") + 1)
            .when(F.col("_above").isNotNull(), 2 * F.col("_above") + 2)
            .otherwise(0)
            .cast("long")
            .alias("level"),
            canonical().alias("message"),
        )
    )
