"""Tool-call linking with DataFrame functions only.

Calls and results meet in a hash join on their identifier; calls are put in
topological order of what they depend on; arguments are checked against the
schema of their tool; each call becomes one line of canonical JSON (keys
sorted, no blanks).
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, measured, table, written

#: A tool's fields, each with its type or types, whether it must be there, an enum, and limits.
Schema = dict[str, dict[str, dict[str, Any]]]
#: How a variant reports each JSON type.
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL%", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "null": ["VOID"], "object": ["OBJECT%"], "array": ["ARRAY%"]}
#: Dependencies of a call that are looked at for ones that others imply; longest wait list that is passed on; longest that grows.
IMPLIED, PASSED, GROWING = 16, 16, 64


def _is(kind: Column, types: list[str]) -> Column:
    return reduce(or_, (kind.like(p) for t in types for p in _TYPES[t]))


def _types_of(rule: dict[str, Any]) -> list[str]:
    types = [rule["type"]] if isinstance(rule.get("type", "string"), str) and "type" in rule else list(rule.get("type", []))
    if unknown := set(types) - set(_TYPES):
        raise ValueError(f"unknown schema types {sorted(unknown)}; known are {sorted(_TYPES)}")
    return types


def problems(name: Column, arguments: Column, schemas: Schema, text: Column | None = None) -> Column:
    """What is wrong with parsed JSON arguments, as a sorted array of texts; empty if nothing is.

    A field's rule may have type (one or a list of string, integer, number,
    boolean, null, object, array), required, enum (JSON texts or plain
    values), min_length, max_length, minimum and maximum. With ``text``, the
    JSON text of the arguments, fields that the schema doesn't have are
    reported too. A null field is there, with the type null.
    """
    found = [F.when(arguments.isNull(), F.lit("arguments: not JSON")), F.when(~name.isin(*schemas) | name.isNull(), F.lit("name: no such tool"))]
    unknown = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        of_tool = (name == tool) & arguments.isNotNull()
        for field, rule in fields.items():
            value = F.try_variant_get(arguments, f"$['{field}']", "variant")
            kind, plain = F.schema_of_variant(value), F.try_variant_get(arguments, f"$['{field}']", "string")
            there = of_tool & value.isNotNull()
            is_number = _is(kind, ["number"])
            checks = [("missing", of_tool & value.isNull(), rule.get("required")), ("not one of enum", there & ~F.to_json(value).isin(*(json.dumps(e, ensure_ascii=False) for e in rule.get("enum", [""]))), "enum" in rule)]
            types = _types_of(rule)
            checks += [(f"not {' or '.join(types)}", there & ~_is(kind, types), True)] if types else []
            checks += [("too short", there & kind.like("STRING") & (F.length(plain) < rule.get("min_length", 0)), "min_length" in rule), ("too long", there & kind.like("STRING") & (F.length(plain) > rule.get("max_length", 0)), "max_length" in rule)]
            checks += [("too small", there & is_number & (plain.try_cast("double") < rule.get("minimum", 0)), "minimum" in rule), ("too large", there & is_number & (plain.try_cast("double") > rule.get("maximum", 0)), "maximum" in rule)]
            found += [F.when(test, F.lit(f"{field}: {what}")) for what, test, wanted in checks if wanted]
        if text is not None:
            more = F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*(F.lit(f) for f in fields)).cast("array<string>"))
            unknown = F.when(of_tool, F.transform(more, lambda f: F.concat(f, F.lit(": unknown")))).otherwise(unknown)
    every = F.array_compact(F.array(*found))
    return F.array_sort(every if text is None else F.concat(every, F.coalesce(unknown, F.array().cast("array<string>"))))


_CALL = ["group_id", "position", "name", "arguments", "after"]


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results by call_id, and a status for each row.

    Of an identifier, the least call and the least result make one row, whose
    status is linked, unanswered or orphan and which counts all calls and
    results of it. Each other call or result that differs is kept as a row of
    its own, repeated_call or repeated_result, with the number of its copies.
    Rows without an identifier stay as they are, unidentified. Both sides are
    aggregated before they meet, so a hot identifier is one row on each side.
    """
    known = F.col("call_id").isNotNull()
    count, none = F.count("*").alias("n"), F.lit(0).cast("long")
    one_call = calls.where(known).groupBy("call_id").agg(F.min(F.struct(*_CALL)).alias("c"), F.count("*").alias("n_calls"))
    one_result = results.where(known).groupBy("call_id").agg(F.min("content").alias("result"), F.count("*").alias("n_results"))
    status = F.when(F.col("n_results").isNull(), "unanswered").when(F.col("n_calls").isNull(), "orphan").otherwise("linked")
    linked = one_call.join(one_result, "call_id", "full").select("call_id", "c.*", "result", F.coalesce("n_calls", none).alias("n_calls"), F.coalesce("n_results", none).alias("n_results"), status.alias("status"))
    # Only rows of repeated identifiers are gone over again.
    more_calls = calls.join(one_call.where("n_calls > 1").select("call_id", "c"), "call_id").where(~F.struct(*_CALL).eqNullSafe(F.col("c"))).groupBy("call_id", *_CALL).agg(count)
    more_calls = more_calls.select("call_id", *_CALL, F.lit(None).cast("string").alias("result"), F.col("n").alias("n_calls"), none.alias("n_results"), F.lit("repeated_call").alias("status"))
    # The least content is null only where there is no other.
    more_results = results.join(one_result.where("n_results > 1").select("call_id", F.col("result").alias("least")), "call_id").where(~F.col("content").eqNullSafe(F.col("least"))).groupBy("call_id", "content").agg(count)
    more_results = more_results.select("call_id", F.col("content").alias("result"), none.alias("n_calls"), F.col("n").alias("n_results"), F.lit("repeated_result").alias("status"))
    lost = calls.where(~known).select("call_id", *_CALL, F.lit(None).cast("string").alias("result"), F.lit(1).cast("long").alias("n_calls"), none.alias("n_results"), F.lit("unidentified").alias("status"))
    lost_results = results.where(~known).select("call_id", F.col("content").alias("result"), none.alias("n_calls"), F.lit(1).cast("long").alias("n_results"), F.lit("unidentified").alias("status"))
    return linked.unionByName(more_calls).unionByName(lost).unionByName(more_results.unionByName(lost_results), allowMissingColumns=True)


_WAITS = "array<struct<p:string,w:bigint>>"


def _first_waits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, parents): what each call waits for, without what another of its few dependencies waits for.

    In a cycle each may stand in for another, so only those that a call which
    stays stands in for are left out.
    """
    deps = edges.groupBy(F.col("child").alias("call_id")).agg(F.collect_set("parent").alias("parents"))
    few = (F.size("parents") > 1) & (F.size("parents") <= IMPLIED)
    before = deps.where(F.size("parents") <= IMPLIED).select(F.col("call_id").alias("parent"), F.col("parents").alias("before"))
    met = deps.where(few).select("call_id", F.explode("parents").alias("parent")).join(before, "parent", "left").select("call_id", "parent", F.coalesce("before", F.array().cast("array<string>")).alias("before"))
    direct = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array_remove(x["before"], x["parent"]))))
    kept = F.filter("e", lambda x: ~F.array_contains("direct", x["parent"]))
    implied = F.flatten(F.transform("kept", lambda x: x["before"]))
    met = met.groupBy("call_id").agg(F.collect_list(F.struct("parent", "before")).alias("e")).withColumn("direct", direct).withColumn("kept", kept)
    pruned = met.select("call_id", F.array_union(F.col("kept.parent"), F.array_except(F.col("e.parent"), implied)).alias("parents"))
    return nodes.join(deps.where(~few).unionByName(pruned), "call_id", "left")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 without dependencies, else one more than the highest of them; null in a cycle and after it.

    ``calls`` has call_id and after, an array of call_ids; ids that don't
    exist, nulls and repeats in it are passed over. A call keeps the least
    level known for it and the calls it still waits for, each with a distance.
    In a round, each wait for a call that has PASSED waits at most is replaced
    by those, distances added. So chains, and layers of few calls, halve their
    length in each round, and a settled call frees all that wait for it. Lists
    above GROWING take over single waits only. The rounds end with one in
    which no call moved: then what still waits lies in a cycle or behind one.
    """
    nodes = calls.where("call_id is not null").select("call_id").distinct()
    asked = calls.where("call_id is not null").select(F.col("call_id").alias("child"), F.explode("after").alias("parent")).where("parent is not null").distinct()
    edges = written(asked.join(nodes.select(F.col("call_id").alias("parent")), "parent", "left_semi"), "call-edges")
    figures = {"n": F.count(F.lit(1)), "open": F.count_if(F.size("waits") > 0), "moved": F.count_if("moved")}
    steps = F.transform("parents", lambda p: F.struct(p.alias("p"), F.lit(1).cast("long").alias("w")))
    first = _first_waits(nodes, edges).select("call_id", F.lit(0).cast("long").alias("base"), F.coalesce(steps, F.array().cast(_WAITS)).alias("waits"), F.lit(True).alias("moved"))
    state, seen = measured(first, "call-levels", **figures)
    # A longest way has n - 1 steps at most: a longer distance is one round a cycle.
    most = seen["n"]
    while seen["open"] and seen["moved"]:
        passing = state.where((F.size("waits") <= PASSED) & F.forall("waits", lambda x: x["w"] <= most)).select(F.col("call_id").alias("p"), F.col("base").alias("p_base"), F.col("waits").alias("next"))
        met = state.where(F.size("waits") > 0).select("call_id", "base", (F.size("waits") <= GROWING).alias("grows"), F.explode("waits").alias("wait")).select("call_id", "base", "grows", "wait.p", "wait.w").join(passing, "p", "left")
        met = met.withColumn("moves", F.col("p_base").isNotNull() & (F.col("w") <= most) & (F.col("grows") | (F.size("next") <= 1)))
        further = F.when(F.col("moves"), F.transform("next", lambda x: F.struct(x["p"].alias("p"), (x["w"] + F.col("w")).alias("w")))).otherwise(F.array(F.struct("p", "w")))
        met = met.select("call_id", F.greatest("base", F.when(F.col("moves"), F.col("p_base") + F.col("w"))).alias("base"), further.alias("further"), "moves")
        met = met.groupBy("call_id").agg(F.max("base").alias("base"), F.flatten(F.collect_list("further")).alias("waits"), F.max("moves").alias("moved"))
        farthest = F.transform(F.array_distinct(F.col("waits.p")), lambda p: F.struct(p.alias("p"), F.array_max(F.transform(F.filter("waits", lambda x: x["p"] == p), lambda x: x["w"])).alias("w")))
        settled = state.where(F.size("waits") == 0).withColumn("moved", F.lit(False))
        further, seen = measured(settled.union(met.select("call_id", "base", farthest.cast(_WAITS).alias("waits"), "moved")), "call-levels", **figures)
        discard(state)
        state = further
    return state.select("call_id", F.when(F.size("waits") == 0, F.col("base")).alias("level"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """One JSON object with sorted keys and no blanks; null values stay as null."""
    pairs = [F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def json_string(text: Column) -> Column:
    """A text as a JSON string literal; null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """Rows of ``link``: group_id, position, call_id, level, status, valid, problems, n_calls, n_results, line.

    ``calls``: call_id, group_id, position (place in the group), name,
    arguments (JSON text), after (array of call_ids); ``results``: call_id,
    content. Other columns are left out. A row without a call has no group and
    no level and is not valid. Sorting by (group_id, level, position, call_id)
    puts every call after those it depends on; calls in a cycle have no level.
    Empty tables give no rows.
    """
    rows = link(calls, results).join(levels(calls), "call_id", "left")
    rows = rows.withColumn("_parsed", F.try_parse_json("arguments"))
    wrong = problems(F.col("name"), F.col("_parsed"), schemas, F.col("arguments"))
    wrong = F.when(F.col("n_calls") == 0, F.array(F.lit("call: missing"))).when(F.col("status") == "repeated_call", F.array_sort(F.array_append(wrong, "identifier: repeated"))).otherwise(wrong)
    level = F.when(F.col("n_calls") > 0, F.col("level")).alias("level")
    line = canonical_json({"id": json_string(F.col("call_id")), "name": json_string(F.col("name")), "arguments": F.to_json("_parsed"), "result": json_string(F.col("result"))})
    return rows.withColumn("problems", wrong).select("group_id", "position", "call_id", level, "status", (F.size("problems") == 0).alias("valid"), F.concat_ws("; ", "problems").alias("problems"), "n_calls", "n_results", line.alias("line"))


#: The tools that turns of `conversations` call.
TURN_SCHEMAS: Schema = {
    "ask": {"text": {"type": "string", "required": True, "min_length": 40}, "turn": {"type": "integer", "required": True, "minimum": 0}},
    "configure": {"text": {"type": "string", "required": True, "min_length": 1}, "turn": {"type": "integer", "required": True, "minimum": 0}},
}


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns ask and system turns configure; an assistant's turn answers the turn before it.

    A call is named by its conversation and turn and depends on the calls one
    and two turns before it.
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    t = F.col("turn")
    arguments = F.concat(F.lit('{"turn": '), t.cast("string"), F.lit(', "text": '), json_string(F.col("text")), F.lit("}"))
    calls = turns.where(F.col("role").isin("user", "system")).select(
        name(t).alias("call_id"), F.col("conv_id").alias("group_id"), t.cast("long").alias("position"), F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"), arguments.alias("arguments"), F.array(name(t - 1), name(t - 2)).alias("after")
    )
    results = turns.where(F.col("role") == "assistant").select(name(t - 1).alias("call_id"), F.col("text").alias("content"))
    return link_tool_calls(calls, results, TURN_SCHEMAS)


OP4_SQL = r"""
WITH RECURSIVE some_calls AS (
  SELECT conv_id AS group_id, conv_id || '-' || turn AS call_id, turn::bigint AS turn, count(*) AS n,
    {'name': CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END, 'text': text} AS c
  FROM conversations WHERE role IN ('user', 'system') GROUP BY ALL),
some_results AS (
  SELECT conv_id || '-' || (turn - 1) AS call_id, text AS result, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
calls AS (SELECT group_id, call_id, turn, min(c) AS c, sum(n)::bigint AS n_calls FROM some_calls GROUP BY 1, 2, 3),
results AS (SELECT call_id, min(result) AS result, sum(n)::bigint AS n_results FROM some_results GROUP BY 1),
edges AS (
  SELECT a.call_id AS parent, b.call_id AS child
  FROM calls a JOIN calls b ON a.group_id = b.group_id AND b.turn - a.turn IN (1, 2)),
walks AS (
  SELECT call_id, 0 AS level FROM calls
  UNION
  SELECT e.child, w.level + 1 FROM walks w JOIN edges e ON e.parent = w.call_id),
depth AS (SELECT call_id, max(level)::bigint AS level FROM walks GROUP BY 1),
every AS (
  SELECT group_id, turn, call_id, CASE WHEN n_results IS NULL THEN 'unanswered' WHEN n_calls IS NULL THEN 'orphan' ELSE 'linked' END AS status,
    c, result, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results
  FROM calls FULL JOIN results USING (call_id)
  UNION ALL
  SELECT s.group_id, s.turn, call_id, 'repeated_call', s.c, NULL, n, 0 FROM some_calls s JOIN calls USING (call_id) WHERE s.c IS DISTINCT FROM calls.c
  UNION ALL
  SELECT NULL, NULL, call_id, 'repeated_result', NULL, s.result, 0, n FROM some_results s JOIN results r USING (call_id) WHERE s.result IS DISTINCT FROM r.result),
judged AS (
  SELECT *, list_filter([CASE WHEN n_calls = 0 THEN 'call: missing' END, CASE WHEN status = 'repeated_call' THEN 'identifier: repeated' END,
    CASE WHEN n_calls > 0 AND c.text IS NULL THEN 'arguments: not JSON' END,
    CASE WHEN c.name = 'configure' AND length(c.text) < 1 OR c.name = 'ask' AND length(c.text) < 40 THEN 'text: too short' END], lambda x: x IS NOT NULL) AS wrong
  FROM every)
SELECT group_id, turn AS position, call_id, CASE WHEN n_calls > 0 THEN level END AS level, status, len(wrong) = 0 AS valid,
  array_to_string(list_sort(wrong), '; ') AS problems, n_calls::bigint AS n_calls, n_results::bigint AS n_results,
  '{"arguments":' || coalesce('{"text":' || to_json(c.text)::varchar || ',"turn":' || turn || '}', 'null')
    || ',"id":' || to_json(call_id)::varchar || ',"name":' || coalesce(to_json(c.name)::varchar, 'null')
    || ',"result":' || coalesce(to_json(result)::varchar, 'null') || '}' AS line
FROM judged LEFT JOIN depth USING (call_id)
"""
