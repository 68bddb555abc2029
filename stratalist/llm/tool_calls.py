"""Operator 8 [native]: chat formatting with tool-call linking.

Calls and results are joined by (conversation, identifier), ordered topologically along the calls' parents, validated
against the tools' schemas and written as canonical JSON: keys sorted, no white space, absent values left out. Each call,
each result without a call and each plain message is one row with its level and turn, so no conversation is ever gathered into
one group. Levels come from pointer doubling: a round doubles the distance that every call knows about, by one equi-join.
Everything is DataFrame expressions; arguments are canonicalised as VARIANT values, whose keys are sorted.

Defined results: a call without a result is ``pending``, a result without a call is ``orphan``, a call whose parents
lead back to itself is a ``cycle`` of level -1; of several calls, or results, with one identifier the one of the lowest
turn (then name, then arguments or content) is linked and the others are ``repeated``; equal rows count once; rows without an
identifier or conversation are linked with nothing; a parent that is no call counts as none;
null or unreadable arguments are an error, not a crash; null texts are left out of the JSON; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

#: JSON types by the first word of the type that Spark tells for a VARIANT value.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


#: What a schema may say of a value besides its type: what to measure, and the message if the limit is broken.
LIMITS = {
    "minimum": (lambda v, x: F.try_variant_get(v, x, "double"), lambda n, limit: n < limit, "below {}"),
    "maximum": (lambda v, x: F.try_variant_get(v, x, "double"), lambda n, limit: n > limit, "above {}"),
    "minLength": (lambda v, x: F.length(F.try_variant_get(v, x, "string")), lambda n, limit: n < limit, "shorter than {}"),
    "maxLength": (lambda v, x: F.length(F.try_variant_get(v, x, "string")), lambda n, limit: n > limit, "longer than {}"),
}

Schemas = dict[str, dict[str, tuple]]


def errors_of(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments (a VARIANT), sorted. schemas: tool, argument, (type, required, limits by name or nothing)."""
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        wrong = []
        for argument, (kind, required, *limits) in sorted(schema.items()):
            found = F.regexp_extract(F.schema_of_variant(F.variant_get(arguments, f"$.{argument}", "variant")), "^[A-Z]+", 0)
            missing = found.isNull() | (found == "VOID")
            error = F.when(missing, f"{argument}: missing" if required else None).when(~found.isin(TYPES[kind]), f"{argument}: not {kind}")
            for limit, value in (limits[0] if limits else {}).items():
                measure, breaks, says = LIMITS[limit]
                error = error.when(breaks(measure(arguments, f"$.{argument}"), value), f"{argument}: {says.format(value)}")
            wrong.append(error)
        out = F.when(name == tool, F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")).otherwise(out)
    readable = F.regexp_extract(F.schema_of_variant(arguments), "^[A-Z]+", 0) == "OBJECT"
    return F.when(~F.coalesce(readable, F.lit(False)), F.array(F.lit("arguments: not an object"))).otherwise(F.coalesce(out, F.array(F.lit("unknown tool"))))


def _first(rows: DataFrame, *order: str) -> DataFrame:
    """Marks the first row of each identifier. Repeats of one identifier are split over tasks: only their minimum is shared."""
    rows = rows.withColumn("__order", F.struct(*order))
    low = rows.groupBy("conv_id", "call_id").agg(F.min("__order").alias("__low"))
    # A row without an identifier is linked with nothing, so it is first on its own.
    rows = rows.join(low, ["conv_id", "call_id"], "left").withColumn("first", F.coalesce(F.col("__order") == F.col("__low"), F.lit(True)))
    return rows.withColumn("link", F.when(F.col("first"), F.col("call_id"))).drop("__order", "__low")


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of each distinct call: 0 without a parent, else one more than its parent; -1 in a cycle."""
    ids = calls.groupBy("conv_id", "call_id").agg(F.min("parent_id").alias("up"))
    known = ids.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("known"))
    state = ids.join(known, ["conv_id", "up"], "left").select("conv_id", "call_id", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level"))
    state = materialize(state, "levels")
    open_before = None
    while True:
        still = state.where("up is not null").agg(F.count("*"), F.max("level")).first()
        # A chain of n calls ends after log2(n) rounds; what is still open when more steps than calls were taken is a cycle.
        if not still[0] or (open_before == still[0] and still[1] > state.count()):
            break
        open_before = still[0]
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = state.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        state = materialize(state, "levels")
    return state.select("conv_id", "call_id", F.when(F.col("up").isNotNull(), -1).otherwise(F.col("level")).cast("long").alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, turn, level, kind, call_id, status, errors, json, one row for each call and each unlinked result.

    calls: conv_id, call_id, parent_id, turn, name, arguments (JSON). results: conv_id, call_id, turn, content.
    """
    calls = _first(calls.select("conv_id", "call_id", "parent_id", "turn", "name", "arguments").distinct(), "turn", "name", "arguments")
    results = _first(results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content").distinct(), "result_turn", "content")
    calls = materialize(calls.join(call_levels(calls), ["conv_id", "call_id"], "left"), "calls")
    results = results.select("conv_id", "link", "result_turn", "content", F.col("call_id").alias("result_id"), F.col("first").alias("result_first"))
    both = calls.join(results, ["conv_id", "link"], "full_outer")
    both = both.withColumns({"first": F.coalesce("first", "result_first"), "call_id": F.coalesce("call_id", "result_id")})
    parsed = F.try_parse_json("arguments")
    both = both.withColumn("v", parsed).withColumn("errors", F.when(F.col("turn").isNull(), F.array().cast("array<string>")).otherwise(errors_of(F.col("name"), F.col("v"), schemas)))
    status = F.when(~F.col("first"), "repeated").when(F.col("turn").isNull(), "orphan").when(F.col("level") < 0, "cycle").when(F.col("result_turn").isNull(), "pending").otherwise("linked")
    call = F.struct(F.col("v").alias("arguments"), F.col("call_id").alias("id"), "name")
    result = F.struct("content", F.col("result_turn").alias("turn"))
    json = F.to_json(F.struct(F.when(F.col("turn").isNotNull(), call).alias("call"), F.when(F.col("result_turn").isNotNull(), result).alias("result"), status.alias("status"), "turn"))
    return both.select("conv_id", F.coalesce("turn", "result_turn").alias("turn"), F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.when(F.col("turn").isNull(), "result").otherwise("call").alias("kind"), "call_id", status.alias("status"), F.array_join("errors", "; ").alias("errors"), json.alias("json"))


#: The tool that plain chats are read as calls of: a request of the user, answered by the next turn of the assistant.
REPLY = {"reply": {"chars": ("integer", True, {"maximum": 256}), "text": ("string", True, {"minLength": 40}), "turn": ("integer", True, {"minimum": 0, "maximum": 8})}}


def chat_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of plain chats (conv_id, turn, role, text).

    A user's turn t is call ``t`` with the call of turn t - 2 as parent; the assistant's turn t + 1 is its result.
    """
    calls = messages.where("role = 'user'").select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), (F.col("turn") - 2).cast("string").alias("parent_id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn"), "text", F.length("text").alias("chars"))).alias("arguments"),
    )
    results = messages.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results, messages.where("role is null or role not in ('user', 'assistant')")


def format_chats(messages: DataFrame) -> DataFrame:
    calls, results, other = chat_calls(messages)
    other = other.select(
        "conv_id", "turn", F.lit(0).cast("long").alias("level"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"), F.lit("").alias("errors"),
        F.to_json(F.struct(F.col("text").alias("content"), "role", "turn")).alias("json"),
    )
    return link_calls(calls, results, REPLY).unionByName(other)


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op8_tool_calls": op8_tool_calls}

_CALL = "json_object('arguments', json_object('chars', length(c.text), 'text', c.text, 'turn', c.turn), 'id', CAST(c.turn AS VARCHAR), 'name', 'reply')"
_RESULT = "json_object('content', r.text, 'turn', r.turn)"
ORACLES = {
    "op8_tool_calls": f"""
WITH RECURSIVE c AS (SELECT * FROM conversations WHERE role = 'user'), r AS (SELECT * FROM conversations WHERE role = 'assistant'),
lv AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(lv.level, 0) AS level,
  CASE WHEN c.turn IS NULL THEN 'result' ELSE 'call' END AS kind, coalesce(CAST(c.turn AS VARCHAR), CAST(r.turn - 1 AS VARCHAR)) AS call_id,
  CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'pending' ELSE 'linked' END AS status,
  CASE WHEN c.turn IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN length(c.text) > 256 THEN 'chars: above 256' END, CASE WHEN length(c.text) < 40 THEN 'text: shorter than 40' END,
    CASE WHEN c.turn > 8 THEN 'turn: above 8' END) END AS errors,
  CAST(CASE WHEN c.turn IS NULL THEN json_object('result', {_RESULT}, 'status', 'orphan')
    WHEN r.turn IS NULL THEN json_object('call', {_CALL}, 'status', 'pending', 'turn', c.turn)
    ELSE json_object('call', {_CALL}, 'result', {_RESULT}, 'status', 'linked', 'turn', c.turn) END AS VARCHAR) AS json
FROM c FULL JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn
UNION ALL SELECT conv_id, turn, 0, 'message', NULL, 'plain', '', CAST(json_object('content', text, 'role', role, 'turn', turn) AS VARCHAR) FROM conversations WHERE role NOT IN ('user', 'assistant')"""
}
