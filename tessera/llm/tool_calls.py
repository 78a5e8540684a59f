"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

A message is (conversation, turn, role, text). Calls and results come from

* assistant texts that are JSON objects with ``tool_calls``: a list of {id, name, arguments, after},
  where ``after`` lists ids that the call depends on;
* tool texts that are JSON objects with ``tool_call_id`` and ``content``;
* all other texts, plain ones: a user turn is a call of ``reply`` and a system turn one of ``system``,
  with the text as argument and ``turn:<turn>`` as id; an assistant turn is the result of the call of
  the turn before it, a plain tool turn as well.

Calls and results are joined by (conversation, id, number): an id that a conversation uses anew is
numbered, calls by (turn, place) and results by turn, ties by their JSON, and the first call gets the first result.
Messages repeated whole are one, and n_calls, n_results tell how often they stood there. Nothing else is
dropped: the result has a row for each call and each result without one, and no row gathers a
conversation, however long it is.

Order: sorting a conversation by (level, turn, place) puts every call after those it depends on. Where
all dependencies point back, turn and place do that already and level is 0. In other conversations the level is
the longest chain of dependencies below a call, worked out in one row for conversations of up to MOST
calls, and by a join a level for larger ones; calls on a cycle, or behind one, get level -1. An
id that stands for several calls depends on what any of them does.

Arguments are checked against schemas ({function: {parameter: (type, required)}}); errors lists what
is wrong, in order. JSON is canonical: keys sorted, no spaces, numbers in shortest form. A null text
counts as empty; rows with a null conversation or turn keep those nulls and link with nothing. An empty table
gives an empty one. Only conv_id, turn, role and text are read, so other columns may have any names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

# The types of a schema and what Spark calls values of them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": r"BIGINT|DECIMAL\(.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "any": ".*"}
SCHEMAS = {"reply": {"text": ("string", True)}, "system": {"text": ("string", True)}}
#: Calls, and dependencies, of a conversation whose order is worked out in one row.
MOST = 256


def messages_apart(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of (conv_id, turn, role, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    objects = F.when(F.col("role").isin("assistant", "tool") & text.rlike(r"^\s*\{"), F.try_parse_json(text))
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"), objects.alias("object"))
    listed = F.expr("try_variant_get(object, '$.tool_calls', 'array<variant>')")
    m = m.withColumn("listed", F.when(F.col("role") == "assistant", listed)).withColumn("answers", F.when(F.col("role") == "tool", F.expr("try_variant_get(object, '$.tool_call_id', 'string')")))
    own = F.concat(F.lit("turn:"), F.col("turn").cast("string"))
    plain = F.to_variant_object(F.struct("text"))
    calls = m.filter(F.col("listed").isNotNull()).select("conv_id", "turn", F.posexplode("listed").alias("place", "c")).selectExpr(
        "conv_id", "turn", "place", "try_variant_get(c, '$.id', 'string') AS call_id", "try_variant_get(c, '$.name', 'string') AS name", "coalesce(try_variant_get(c, '$.arguments', 'variant'), parse_json('{}')) AS arguments", "coalesce(try_variant_get(c, '$.after', 'array<string>'), array()) AS after"
    )
    spoken = m.filter(F.col("role").isin("user", "system") | ~F.col("role").isin("assistant", "tool")).select("conv_id", "turn", F.lit(0).alias("place"), own.alias("call_id"), F.when(F.col("role") == "system", "system").otherwise("reply").alias("name"), plain.alias("arguments"), F.array().cast("array<string>").alias("after"))
    before = F.concat(F.lit("turn:"), (F.col("turn") - 1).cast("string"))
    content = F.coalesce(F.expr("CASE WHEN answers IS NOT NULL THEN try_variant_get(object, '$.content', 'variant') END"), F.when(F.col("answers").isNull(), F.col("text").cast("variant")))
    results = m.filter(F.col("role").isin("assistant", "tool") & F.col("listed").isNull()).select("conv_id", "turn", F.coalesce("answers", before).alias("call_id"), content.alias("result"))
    return calls.unionByName(spoken), results


def numbered(rows: DataFrame, order: list[str], count: str) -> DataFrame:
    """rows, each whole row once, with their count and their number among the rows of (conv_id, call_id)."""
    each = rows.groupBy("conv_id", "call_id", *order).agg(F.count(F.lit(1)).alias(count))
    # rows that can't link need no number; they must not meet in one task either
    apart = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.xxhash64(*order))
    return each.withColumn("number", F.row_number().over(Window.partitionBy("conv_id", "call_id", apart).orderBy(*order)))


def levels(calls: DataFrame, most: int) -> DataFrame | None:
    """(conv_id, call_id, level) for conversations whose dependencies don't all point back."""
    needs = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", F.struct("turn", "place").alias("at"), F.explode("after").alias("need"))
    if needs.isEmpty():
        return None
    held = calls.groupBy("conv_id", F.col("call_id").alias("need")).agg(F.min(F.struct("turn", "place")).alias("need_at"))
    edges = written(needs.join(held, ["conv_id", "need"]).groupBy("conv_id", "call_id", "need").agg(F.min(F.col("need_at") < F.col("at")).alias("back")), "call-edges")
    mixed = edges.filter(~F.col("back")).select("conv_id").distinct()
    ids = written(calls.join(mixed, "conv_id", "left_semi").select("conv_id", "call_id").filter("call_id IS NOT NULL").distinct(), "calls-unordered")
    edges = edges.join(mixed, "conv_id", "left_semi").select("conv_id", "call_id", "need")
    sizes = ids.groupBy("conv_id").count().unionByName(edges.groupBy("conv_id").count()).groupBy("conv_id").agg(F.max("count").alias("n"))
    large = sizes.filter(F.col("n") > most).select("conv_id")
    # small conversations: a row each, with the places of the calls that each call needs
    small = ids.join(large, "conv_id", "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list("call_id")).alias("ids"))
    wanted = edges.join(large, "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "need")).alias("edges"))
    found = small.join(wanted, "conv_id").withColumn("needs", F.expr("transform(ids, x -> transform(filter(edges, e -> e.call_id = x), e -> int(array_position(ids, e.need))))"))
    longest = F.expr("aggregate(ids, transform(ids, x -> 0), (chain, x) -> transform(needs, n -> coalesce(array_max(transform(n, k -> chain[k - 1] + 1)), 0)))")
    done = found.withColumn("chain", longest).select("conv_id", F.expr("size(ids) AS n"), F.explode(F.arrays_zip("ids", "chain")).alias("x")).select("conv_id", F.col("x.ids").alias("call_id"), F.when(F.col("x.chain") >= F.col("n"), -1).otherwise(F.col("x.chain")).alias("level"))
    left = ids.join(large, "conv_id", "left_semi")
    return done if left.isEmpty() else done.unionByName(peeled(written(left, "calls-left"), edges))


def peeled(left: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level), a join for each level."""
    done, level = left.limit(0).withColumn("level", F.lit(0)), 0
    while not left.isEmpty():
        open_edges = edges.join(left.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
        blocked = open_edges.select("conv_id", "call_id").distinct()
        free = written(left.join(blocked, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), f"calls-level-{level}")
        if free.isEmpty():
            return done.unionByName(left.withColumn("level", F.lit(-1)))
        done = done.unionByName(free)
        left, level = written(left.join(free, ["conv_id", "call_id"], "left_anti"), "calls-left"), level + 1
    return done


def argument_errors(schemas: dict) -> Column:
    """What is wrong with the arguments of a call, in order of parameter."""
    flat = [{"fn": f, "param": p, "kind": t, "like": TYPES[t], "must": must} for f, ps in sorted(schemas.items()) for p, (t, must) in sorted(ps.items())]
    rules = F.from_json(F.lit(json.dumps(flat)), "array<struct<fn:string,param:string,kind:string,like:string,must:boolean>>")
    own = F.filter(rules, lambda r: r["fn"] == F.col("name"))
    given = F.coalesce(F.map_entries(F.from_json("arguments", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    missing = F.transform(F.filter(own, lambda r: r["must"] & ~F.exists(given, lambda e: e["key"] == r["param"])), lambda r: F.concat(F.lit("missing "), r["param"]))
    wrong = F.transform(F.filter(own, lambda r: F.exists(given, lambda e: (e["key"] == r["param"]) & ~F.rlike(F.schema_of_variant(e["value"]), F.concat(F.lit("^(?:"), r["like"], F.lit(")$"))))), lambda r: F.concat(r["param"], F.lit(" is no "), r["kind"]))
    unknown = F.transform(F.filter(given, lambda e: ~F.exists(own, lambda r: r["param"] == e["key"])), lambda e: F.concat(F.lit("unknown "), e["key"]))
    return F.when(~F.coalesce(F.col("name"), F.lit("")).isin(list(schemas)), F.array(F.lit("unknown function"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))


def link(messages: DataFrame, schemas: dict = SCHEMAS, *, most: int = MOST) -> DataFrame:
    """One row for each call or orphan result: conv_id, call_id, number, turn, place, level, name, status,
    n_calls, n_results, result_turn, errors and json."""
    calls, results = messages_apart(messages)
    calls = numbered(calls.withColumn("arguments", F.to_json("arguments")), ["turn", "place", "name", "arguments", "after"], "n_calls")
    results = numbered(results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.to_json("result").alias("result")), ["result_turn", "result"], "n_results")
    rows = calls.join(results, ["conv_id", "call_id", "number"], "full_outer")
    ranked = levels(calls, most)
    rows = rows.join(ranked, ["conv_id", "call_id"], "left") if ranked else rows.withColumn("level", F.lit(0))
    status = F.when(F.col("n_calls").isNull(), "orphan result").when(F.col("name") == "system", "notice").when(F.col("n_results").isNull(), "no result").when(F.col("result_turn") < F.col("turn"), "result before call").otherwise("linked")
    body = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", F.try_parse_json("result").alias("result"), "turn")
    none = F.array().cast("array<string>")
    return rows.select(
        "conv_id", "call_id", "number", "turn", "place", F.coalesce("level", F.lit(0)).alias("level"), "name", status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "result_turn",
        F.array_join(F.when(F.col("n_calls").isNull(), none).otherwise(argument_errors(schemas)), "; ").alias("errors"), F.to_json(body).alias("json"),
    )


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


#: The schema of the calls that linked_tool_calls makes.
NOTE = {"note": {"flag": ("boolean", True), "n": ("integer", True), "text": ("string", True)}}


def linked_tool_calls(spark, sf_dir: str) -> DataFrame:
    """link over a table with real tool calls: each message of `conversations` becomes a call, and three of four
    get a result. Calls depend on later and on earlier ones, and some arguments are missing, unknown or of a wrong type."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).distinct()
    t, name = F.col("turn"), lambda x: F.concat(F.lit("c"), x.cast("string"))
    flag = F.when(t % 3 == 0, F.lit(True).cast("variant")).when(t % 3 == 1, F.lit("yes").cast("variant"))
    arguments = F.struct(F.col("text").alias("text"), t.alias("n"), flag.alias("flag"), F.when(t % 5 == 0, t).alias("x"))
    needed = F.when(t % 4 == 0, t + 1).when(t % 4 == 2, t - 1).when(t % 4 == 3, t - 3)
    after = F.when(needed.isNotNull(), F.array(name(needed))).otherwise(F.array().cast("array<string>"))
    call = F.struct(F.array(F.struct(name(t).alias("id"), F.lit("note").alias("name"), arguments.alias("arguments"), after.alias("after"))).alias("tool_calls"))
    calls = m.select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(call).alias("text"))
    answer = F.struct(name(t).alias("tool_call_id"), F.struct(F.char_length("text").alias("size"), t.alias("of")).alias("content"))
    answers = m.filter(t % 4 != 1).select("conv_id", (t + 100_000).alias("turn"), F.lit("tool").alias("role"), F.to_json(answer).alias("text"))
    return link(calls.unionByName(answers), NOTE)


LINKED_SQL = """
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS number FROM m),
has AS (SELECT DISTINCT conv_id, turn FROM m),
first AS (SELECT conv_id, turn, EXISTS (FROM has h WHERE h.conv_id = has.conv_id AND h.turn = has.turn + 1 AND has.turn % 4 = 0) AS forward FROM has),
mixed AS (SELECT conv_id FROM first GROUP BY conv_id HAVING bool_or(forward)),
lv AS (SELECT f.conv_id, f.turn, CASE WHEN f.conv_id NOT IN (FROM mixed) THEN 0
  WHEN f.turn % 4 = 0 THEN forward::INT
  WHEN f.turn % 4 = 2 THEN EXISTS (FROM has h WHERE h.conv_id = f.conv_id AND h.turn = f.turn - 1)::INT
  WHEN f.turn % 4 = 3 THEN coalesce((SELECT 1 + g.forward::INT FROM first g WHERE g.conv_id = f.conv_id AND g.turn = f.turn - 3), 0)
  ELSE 0 END AS level FROM first f),
x AS (SELECT k.*, level, CASE turn % 3 WHEN 0 THEN '"flag":true,' WHEN 1 THEN '"flag":"yes",' ELSE '' END AS flag, turn % 4 <> 1 AS answered FROM k JOIN lv USING (conv_id, turn))
SELECT conv_id, 'c' || turn AS call_id, number::INT AS number, turn, 0 AS place, level::INT AS level, 'note' AS name,
 CASE WHEN answered THEN 'linked' ELSE 'no result' END AS status, 1::BIGINT AS n_calls, answered::BIGINT AS n_results, CASE WHEN answered THEN turn + 100000 END AS result_turn,
 concat_ws('; ', CASE turn % 3 WHEN 1 THEN 'flag is no boolean' WHEN 2 THEN 'missing flag' END, CASE WHEN turn % 5 = 0 THEN 'unknown x' END) AS errors,
 '{"arguments":{' || flag || '"n":' || turn || ',"text":' || to_json(text) || CASE WHEN turn % 5 = 0 THEN ',"x":' || turn ELSE '' END || '},"id":"c' || turn || '","name":"note"'
 || CASE WHEN answered THEN ',"result":{"of":' || turn || ',"size":' || length(text) || '}' ELSE '' END || ',"turn":' || turn || '}' AS json
FROM x
"""

SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, 'turn:' || turn AS call_id, turn, CASE WHEN role = 'system' THEN 'system' ELSE 'reply' END AS name, '{"text":' || to_json(text) || '}' AS arguments FROM m WHERE role NOT IN ('assistant', 'tool')),
r AS (SELECT conv_id, 'turn:' || (turn - 1) AS call_id, turn AS result_turn, to_json(text)::VARCHAR AS result FROM m WHERE role IN ('assistant', 'tool')),
c1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY name, arguments) AS number FROM (SELECT conv_id, call_id, turn, name, arguments, count(*) AS n_calls FROM c GROUP BY ALL)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY result) AS number FROM (SELECT conv_id, call_id, result_turn, result, count(*) AS n_results FROM r GROUP BY ALL))
SELECT coalesce(c1.conv_id, r1.conv_id) AS conv_id, coalesce(c1.call_id, r1.call_id) AS call_id, coalesce(c1.number, r1.number)::INTEGER AS number, turn, CASE WHEN n_calls > 0 THEN 0 END::INTEGER AS place, 0::INTEGER AS level, c1.name AS name,
 CASE WHEN n_calls IS NULL THEN 'orphan result' WHEN c1.name = 'system' THEN 'notice' WHEN n_results IS NULL THEN 'no result' ELSE 'linked' END AS status,
 coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, result_turn, '' AS errors,
 '{' || CASE WHEN n_calls > 0 THEN '"arguments":' || c1.arguments || ',' ELSE '' END || '"id":"' || coalesce(c1.call_id, r1.call_id) || '"' || CASE WHEN n_calls > 0 THEN ',"name":"' || c1.name || '"' ELSE '' END || CASE WHEN n_results > 0 THEN ',"result":' || result ELSE '' END || CASE WHEN n_calls > 0 THEN ',"turn":' || turn ELSE '' END || '}' AS json
FROM c1 FULL OUTER JOIN r1 ON c1.conv_id = r1.conv_id AND c1.call_id = r1.call_id AND c1.number = r1.number
"""
