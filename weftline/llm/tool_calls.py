"""Chat formatting: tool-call linking, DataFrame operations only.

Messages hold calls in two forms. An assistant's JSON text ``{"tool_calls": [{"id", "name", "arguments", "after": [ids]}]}`` makes
calls, and a tool's ``{"tool_call_id", "content"}`` a result. A plain user turn is a call of the tool ``respond`` with its text and
turn as arguments, after the user turn two before it, and the plain assistant turn that follows is its result. Calls and results
meet in a hash join on the conversation and identifier. Calls are ordered topologically: what a call comes after must stand in an
earlier message or be ordered before it in its own, so (turn, step) is an order, where step is the longest chain of calls of the same message
before the call; a cycle or a later call is reported. Arguments are checked against the tools' schemas, and call and result
become one line of canonical JSON: keys sorted at every level, no white space.

Defined results: a null text is a plain message whose prompt is null, which the schema refuses; null turns and
conversations of calls are carried, but link to nothing; of repeated results the first by turn and content counts; repeated calls are kept
and linked each; text that is no JSON object is plain; an empty table gives no rows; other input columns are not read.

The result holds calls only. Messages that are part of no call (system messages, other or null roles), results whose identifier no
call has, further results of an answered call and assistant turns without a user turn before them leave no row there;
``left_out`` gives each of them with its reason.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import table

#: Of each tool, its parameters: type, whether it must be there, and the bounds that the type allows.
SCHEMAS: dict[str, dict[str, dict]] = {
    "respond": {"prompt": {"type": "string", "required": True, "min_length": 1}, "turn": {"type": "integer", "required": True, "minimum": 0}},
    "search": {"query": {"type": "string", "required": True, "min_length": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}},
    "calculate": {"expression": {"type": "string", "required": True, "min_length": 1}, "exact": {"type": "boolean"}},
}
_KINDS = {"string": "^STRING$", "integer": "^BIGINT$|^DECIMAL\\([0-9]+,0\\)$", "number": "^BIGINT$|^DOUBLE$|^DECIMAL", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}
_CALLS = "array<struct<id string, name string, arguments variant, after array<string>>>"


def _argument_error(arguments: Column, name: str, rule: Mapping) -> Column:
    path = f"$.{name}"
    kind = F.schema_of_variant(F.try_variant_get(arguments, path, "variant"))
    here = F.try_variant_get(arguments, path, "variant").isNotNull() & (kind != "VOID")
    wrong = ~kind.rlike(_KINDS[rule["type"]])
    for key, cast, bad in (
        ("min_length", "string", lambda v, b: F.length(v) < b), ("max_length", "string", lambda v, b: F.length(v) > b),
        ("minimum", "double", lambda v, b: v < b), ("maximum", "double", lambda v, b: v > b), ("enum", "string", lambda v, b: ~v.isin(*b)),
    ):
        if key in rule:
            wrong = wrong | F.coalesce(bad(F.try_variant_get(arguments, path, cast), rule[key]), F.lit(True))
    missing = F.lit(f"missing {name}") if rule.get("required") else F.lit(None).cast("string")
    return F.when(~F.coalesce(here, F.lit(False)), missing).when(wrong, F.lit(f"bad {name}"))


def schema_error(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, Mapping]] = SCHEMAS) -> Column:
    """The first complaint, null if the arguments fit: unknown tool, no object, a missing or bad parameter, an unknown one."""
    out = F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool"))
    out = out.when(arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("arguments are no object"))
    for tool, rules in schemas.items():
        errors = [_argument_error(arguments, n, r) for n, r in sorted(rules.items())]
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments.cast("string")), F.array().cast("array<string>")), F.array(*[F.lit(n) for n in sorted(rules)]))
        unknown = F.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_min(extra)))
        out = out.when(name == tool, F.coalesce(*errors, unknown))
    return out


def _steps(calls: Column) -> Column:
    """For each call of one message the longest chain of its own calls before it; as many as there are calls means a cycle. Levels are
    raised until they stay as they are, after as many rounds as the longest chain has calls; the rounds left then cost nothing."""
    n = F.size(calls)
    level = lambda c, levels: F.array_max(F.transform(F.filter(F.arrays_zip(calls.getField("id").alias("id"), levels.alias("level")), lambda z: F.array_contains(c["after"], z["id"])), lambda z: z["level"] + 1))
    raised = lambda levels: F.transform(calls, lambda c: F.least(n, F.coalesce(level(c, levels), F.lit(0))))
    step = lambda at: F.get(F.transform(F.array(raised(at["levels"])), lambda x: F.struct(x.alias("levels"), (x != at["levels"]).alias("moved"))), F.lit(0))
    start = F.struct(F.transform(calls, lambda _: F.lit(0)).alias("levels"), F.lit(True).alias("moved"))
    return F.aggregate(F.sequence(F.lit(1), n), start, lambda at, _: F.when(at["moved"], step(at)).otherwise(at), lambda at: at["levels"])


def _own_id(back: int) -> Column:
    return F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), F.col("turn") - back)


def _messages(messages: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Messages with what they say of calls; and of results, the call that they answer (null of other messages) and content."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    looks = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    m = m.withColumn("json", F.when(looks, F.try_parse_json("text")))
    made = F.when(F.col("role") == "assistant", F.try_variant_get("json", "$.tool_calls", _CALLS))
    answer = F.when(F.col("role") == "tool", F.try_variant_get("json", "$.tool_call_id", "string"))
    m = m.withColumn("made", made).withColumn("answer", answer)
    content = F.when(F.col("answer").isNotNull(), F.try_variant_get("json", "$.content", "string")).otherwise(F.col("text"))
    plain = (F.col("role") == "assistant") & F.col("made").isNull()
    return m, {"call_id": F.coalesce("answer", F.when(plain, _own_id(1))), "content": content, "is": F.col("answer").isNotNull() | plain}


def messages_to_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text)."""
    m, of = _messages(messages)
    arguments = F.parse_json(F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")), {"ignoreNullFields": "false"}))
    plain = F.struct(_own_id(0).alias("id"), F.lit("respond").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(_own_id(2))).otherwise(F.array().cast("array<string>")).alias("after"))
    calls = m.where(F.col("made").isNotNull()).select("conv_id", "turn", "made")
    calls = calls.withColumn("step", _steps(F.col("made"))).withColumn("n_calls", F.size("made"))
    calls = calls.select("conv_id", "turn", "n_calls", F.explode(F.arrays_zip("made", "step")).alias("z")).select("conv_id", "turn", F.col("z.made").alias("call"), F.col("z.step").alias("step"), "n_calls")
    turns = m.where((F.col("role") == "user") & F.col("made").isNull()).select("conv_id", "turn", plain.alias("call"), F.lit(0).alias("step"), F.lit(1).alias("n_calls"))
    cols = ["conv_id", "turn", "step", "n_calls", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"), F.col("call.after").alias("after")]
    calls = calls.select(*cols).unionByName(turns.select(*cols))
    results = m.where(of["is"])
    return calls, results.select("conv_id", of["call_id"].alias("call_id"), F.col("turn").alias("result_turn"), of["content"].alias("result"))


def link_calls(messages: DataFrame, schemas: Mapping[str, Mapping[str, Mapping]] = SCHEMAS) -> DataFrame:
    """conv_id, turn, step, call_id, name, error, result_turn (-1 without a result) and message (canonical JSON) of every call."""
    calls, results = messages_to_calls(messages)
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "result")).alias("r"))
    where = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("at"))
    needs = calls.select("conv_id", "turn", F.explode(F.array_distinct("after")).alias("call_id")).distinct()
    order = needs.join(where, ["conv_id", "call_id"], "left").withColumn("bad", F.when(F.col("at").isNull(), F.concat(F.lit("no call "), F.col("call_id"))).when(F.col("at") > F.col("turn"), F.concat(F.lit("later call "), F.col("call_id"))))
    # which of a call's needs fail: its own list against those of its message's turn
    bad = order.where("bad is not null").groupBy("conv_id", "turn").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("call_id", "bad")))).alias("bad"))
    linked = calls.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(bad, ["conv_id", "turn"], "left")
    unmet = F.array_min(F.transform("after", lambda a: F.element_at("bad", a)))
    error = F.coalesce(
        schema_error(F.col("name"), F.col("arguments"), schemas), F.when(F.col("step") >= F.col("n_calls"), F.lit("cycle")), unmet, F.when(F.col("r").isNull(), F.lit("no result"))
    )
    out = linked.withColumn("error", error)
    line = F.to_json(F.struct(F.col("arguments"), F.col("error"), F.col("call_id").alias("id"), F.col("name"), F.col("r.result").alias("result")), {"ignoreNullFields": "false"})
    return out.select("conv_id", "turn", "step", "call_id", "name", "error", F.coalesce("r.result_turn", F.lit(-1).cast("long")).alias("result_turn"), line.alias("message"))


def left_out(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and reason of every message that neither makes a call nor is the result that a call got."""
    calls, results = messages_to_calls(messages)
    m, at = _messages(messages)
    known = calls.select("conv_id", "call_id").distinct().withColumn("known", F.lit(True))
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "result")).alias("r"))
    makes = (F.coalesce(F.size("made") > 0, F.lit(False))) | (F.coalesce(F.col("role") == "user", F.lit(False)) & F.col("made").isNull())
    rest = m.where(~makes).withColumn("call_id", at["call_id"]).withColumn("_result", at["content"])
    rest = rest.join(known, ["conv_id", "call_id"], "left").join(first, ["conv_id", "call_id"], "left")
    same = F.col("r").eqNullSafe(F.struct(F.col("turn").alias("result_turn"), F.col("_result").alias("result")))
    nth = F.row_number().over(Window.partitionBy("conv_id", "call_id", "turn", "_result").orderBy("text"))
    rest = rest.withColumn("_nth", nth)
    reason = F.when(F.col("call_id").isNull(), F.lit("no call or result")).when(F.col("known").isNull(), F.lit("result of no call")).when(~same | (F.col("_nth") > 1), F.lit("further result"))
    return rest.withColumn("reason", reason).where("reason is not null").select("conv_id", "turn", "role", "text", "reason")


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every conversation, linked, ordered, validated and serialised."""
    return link_calls(table(spark, sf_dir, "conversations"))


ORACLE_OP7 = """
WITH c AS (
  SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, text, 'call_' || conv_id || '_' || (turn - 2) AS need
  FROM conversations WHERE role = 'user'),
r AS (
  SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, min(turn) AS result_turn, arg_min(text, (turn, text)) AS result
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
w AS (SELECT DISTINCT conv_id, call_id FROM c),
j AS (
  SELECT c.conv_id, c.turn, c.call_id, c.text, r.result_turn, r.result,
    CASE WHEN c.text IS NULL THEN 'missing prompt' WHEN c.text = '' THEN 'bad prompt' WHEN c.turn IS NULL THEN 'missing turn' WHEN c.turn < 0 THEN 'bad turn'
      WHEN c.turn >= 2 AND w.call_id IS NULL THEN 'no call ' || c.need WHEN r.call_id IS NULL THEN 'no result' END AS error
  FROM c LEFT JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN w ON c.conv_id = w.conv_id AND c.need = w.call_id)
SELECT conv_id, turn, CAST(0 AS INTEGER) AS step, call_id, 'respond' AS name, error, coalesce(result_turn, -1) AS result_turn,
  '{"arguments":{"prompt":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '},"error":' || coalesce(CAST(to_json(error) AS VARCHAR), 'null')
  || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":"respond","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS message
FROM j"""
