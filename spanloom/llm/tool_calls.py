"""Tool-call linking; DataFrame and SQL functions only.

Calls and results are hash-joined by conversation and identifier, calls are put in topological order of what they come
after, their arguments are validated against the tool's schema, and each call is serialised as one line of canonical
JSON (keys sorted, no spaces).

Turns that carry JSON are read as they are: {"tool_calls": [{"id", "name", "arguments", "after": [ids]}]} calls, and
{"tool_call_id", "content"} (role tool) answers.  A plain user turn is a call of the tool ``reply`` with its text and
turn, identified by its turn; a plain assistant turn answers the turn before it.  Other plain turns are neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settle

#: Arguments of each tool, all required, by JSON type.
SCHEMAS = {"reply": {"text": "string", "turn": "integer"}}

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*", "object": "^OBJECT<.*"}
_CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>>"
_RESULT = "struct<tool_call_id: string, content: string>"


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return whole.substr(F.lit(2), F.length(whole) - 2)


def parse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of (conv_id, turn, role, text)."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    json = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    asked = F.when(json, F.from_json("text", _CALLS)["tool_calls"])
    said = F.when(json & (F.col("role") == "tool"), F.from_json("text", _RESULT))
    turns = turns.withColumns({"asked": asked, "said": said}).withColumn("plain", F.col("asked").isNull() & F.col("said")["tool_call_id"].isNull())
    own = F.struct(F.col("turn").cast("string").alias("id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.array().cast("array<string>").alias("after"))
    calls = turns.select("conv_id", "turn", F.posexplode(F.when(F.col("plain") & (F.col("role") == "user"), F.array(own)).otherwise(F.col("asked"))).alias("ord", "c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), "turn", "ord", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    answer = F.when(F.col("plain"), F.when(F.col("role") == "assistant", (F.col("turn") - 1).cast("string"))).otherwise(F.col("said")["tool_call_id"])
    results = turns.select("conv_id", answer.alias("call_id"), "turn", F.when(F.col("plain"), F.col("text")).otherwise(F.col("said")["content"]).alias("content")).where("call_id is not null")
    return calls, results


def _problems(schemas: dict[str, dict[str, str]]) -> Column:
    """What is wrong with ``arguments`` (text) and ``value`` (variant) for ``name``, as an array of strings."""
    keys = F.json_object_keys("arguments")
    found = F.when(F.col("name").isNull(), F.array(F.lit("no name")))
    for name, schema in schemas.items():
        checks = [F.concat(F.lit("unknown "), F.array_join(F.array_sort(F.array_except(keys, F.array(*map(F.lit, schema)))), " "))]
        checks = [F.when(F.size(F.array_except(keys, F.array(*map(F.lit, schema)))) > 0, checks[0])]
        for arg, kind in sorted(schema.items()):
            has = F.schema_of_variant(F.expr(f"try_variant_get(value, '$.{arg}', 'variant')"))
            checks.append(F.when(has.isNull() | (has == "VOID"), F.lit(f"missing {arg}")).when(~has.rlike(_TYPES[kind]), F.lit(f"not {kind} {arg}")))
        found = found.when(F.col("name") == name, F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(*checks))))
    return found.otherwise(F.array(F.lit("unknown tool")))


def levels(calls: DataFrame) -> DataFrame:
    """``calls`` with level: 0 without something to come after, else one above the highest of these; null in a cycle.

    Each round places the calls all of whose predecessors are placed, so the rounds are as many as the longest chain of
    explicit dependencies.  Identifiers that no call has are ignored.
    """
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("before"))
    if edges.isEmpty():
        return calls.withColumn("level", F.lit(0))
    known = calls.select("conv_id", F.col("call_id").alias("before")).distinct()
    edges = settle(edges.distinct().join(known, ["conv_id", "before"]))
    placed = settle(calls.select("conv_id", "call_id").distinct().join(edges.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    done, level = placed, 0
    while not edges.isEmpty():
        level += 1
        met = edges.join(done.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi")
        left = settle(edges.join(met, ["conv_id", "call_id", "before"], "left_anti"))
        new = settle(met.select("conv_id", "call_id").distinct().join(left, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty() and met.isEmpty():
            break
        done, edges, placed = new, left, placed.unionByName(new)
    return calls.join(placed, ["conv_id", "call_id"], "left")


def link(turns: DataFrame, schemas: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One row for each call, and for each identifier that is only answered.

    conv_id, call_id, turn (of the call), level, name, n_calls, n_results, status, problems, line.  status: ``orphan``
    (no call), ``cycle``, ``invalid``, ``unanswered`` or ``ok``, the first that holds.  (conv_id, level, turn, ord) is a
    topological order.  An identifier that is called several times keeps its first call (by turn and place in it), and
    the first answer counts; n_calls and n_results tell how many there were.  Calls without conversation or identifier
    link with nothing and are left out; null texts make invalid calls (missing text) and null contents.  An empty table
    gives an empty result.
    """
    calls, results = parse(turns)
    first = F.min(F.struct("turn", "ord", "name", "arguments", "after"))
    calls = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(first.alias("c"), F.count(F.lit(1)).alias("n_calls")).select("conv_id", "call_id", "c.*", "n_calls")
    calls = levels(calls)
    answers = results.where("conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")).select("conv_id", "call_id", F.col("r.content").alias("content"), "n_results")
    linked = calls.join(answers, ["conv_id", "call_id"], "full").withColumn("value", F.try_parse_json("arguments"))
    linked = linked.withColumn("found", F.when(F.col("n_calls").isNotNull(), _problems(SCHEMAS if schemas is None else schemas)).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.size("found") > 0, "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("ok")
    )
    line = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("value"), F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), F.coalesce(_quoted(F.col("name")), F.lit("null")), F.lit(',"result":'), F.when(F.col("content").isNull(), F.lit("null")).otherwise(_quoted(F.col("content"))), F.lit("}"))
    return linked.select("conv_id", "call_id", "turn", F.col("ord").cast("long").alias("ord"), F.col("level").cast("long").alias("level"), "name", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), status.alias("status"), F.array_join("found", "; ").alias("problems"), line.alias("line"))


#: The same for plain turns in DuckDB's SQL, over conversations.
SQL = """
with calls as (select conv_id, turn::varchar as call_id, min(turn) as turn, arg_min(text, coalesce('{"text":' || to_json(text)::varchar || ',', '{') ) as text, count(*) as n_calls
    from conversations where role = 'user' and conv_id is not null and turn is not null group by conv_id, turn),
answers as (select conv_id, (turn - 1)::varchar as call_id, min(text) as content, count(*) as n_results from conversations where role = 'assistant' and conv_id is not null and turn is not null group by conv_id, turn),
linked as (select coalesce(c.conv_id, a.conv_id) as conv_id, coalesce(c.call_id, a.call_id) as call_id, c.turn, c.text, c.n_calls, a.content, a.n_results from calls c full join answers a on c.conv_id = a.conv_id and c.call_id = a.call_id)
select conv_id, call_id, turn, case when n_calls is not null then 0 end::bigint as ord, case when n_calls is not null then 0 end::bigint as level, case when n_calls is not null then 'reply' end as name,
    coalesce(n_calls, 0)::bigint as n_calls, coalesce(n_results, 0)::bigint as n_results,
    case when n_calls is null then 'orphan' when text is null then 'invalid' when n_results is null then 'unanswered' else 'ok' end as status,
    case when n_calls is not null and text is null then 'missing text' else '' end as problems,
    '{"arguments":' || case when n_calls is null then 'null' else '{' || coalesce('"text":' || to_json(text)::varchar || ',', '') || '"turn":' || turn || '}' end || ',"id":' || to_json(call_id)::varchar
    || ',"name":' || case when n_calls is null then 'null' else '"reply"' end || ',"result":' || coalesce(to_json(content)::varchar, 'null') || '}' as line
from linked
"""
