"""Chat formatting by tool-call linking (DataFrame functions only).

``link`` takes calls ``(conv_id, call_id, after_id, turn, name, arguments)`` and results ``(conv_id, call_id, turn,
content)``. Results are first reduced to one row an identifier (the earliest turn, then the smallest text, with the number
of results), so that repeats of an identifier multiply nothing; then calls and results meet in a hash join by
(conv_id, call_id). The identifier's other results are rows of their own with status ``repeated``; none is lost. Calls depend on at most one other call (``after_id``); their topological depth comes from pointer
doubling: in each round a call adds the steps of the call it points at and points where that one points, so a chain of n
calls takes log2(n) joins, and calls of a cycle, which never reach a root, get depth -1. Arguments are parsed as variants
and checked against a schema: required fields present, types right, no field unknown. The output is canonical JSON: keys
sorted, no spaces.

Conversations become calls through ``exchanges``: a user or system turn is a call of the tool ``respond`` or
``configure``, the turn after it by another role its result, and the same conversation's call two turns before (or the
one before, if that is a system turn) what it depends on. All keys are (conversation, turn), so one huge conversation
spreads like many small ones.

Edge cases: a null id, turn, name or text: null identifiers link with nothing and have depth 0; null arguments are
invalid; a null text is an empty one; repeated calls are kept as rows, all linked with the one result their identifier
has; further results of an identifier are returned with status ``repeated``; results without a call are returned with status ``orphan``; invalid JSON makes ``valid`` false and arguments null.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import Scratch

#: Tool schemas: field -> (variant type, required).
SCHEMAS = {
    "respond": {"prompt": ("STRING", True), "turn": ("BIGINT", True)},
    "configure": {"instructions": ("STRING", True), "turn": ("BIGINT", True)},
}
#: Fields of a schema that may not be empty.
LEAST_LENGTH = {("respond", "prompt"): 1, ("configure", "instructions"): 1}


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conversations(conv_id, turn, role, text)``."""
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    t = conversations.select(conv.alias("conv_id"), turn.alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    asks = F.col("role").isin("user", "system")
    name = F.when(F.col("role") == "system", "configure").otherwise("respond")
    field = F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("instructions"), "turn"), {"ignoreNullFields": "false"})).otherwise(
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"}))
    ident = lambda back: F.concat_ws(":", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    system = t.where(F.col("role") == "system").select("conv_id", (F.col("turn") + 1).alias("turn")).distinct().withColumn("sys", F.lit(True))
    calls = t.where(asks).join(system, ["conv_id", "turn"], "left").select(
        "conv_id", F.when(known, ident(0)).alias("call_id"), F.when(known, F.when(F.col("sys"), ident(1)).otherwise(ident(2))).alias("after_id"), "turn",
        name.alias("name"), field.alias("arguments"))
    results = t.where(~asks | F.col("role").isNull()).select("conv_id", F.when(known, ident(1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, call_id, depth)`` per distinct call: calls before it on its chain; -1 on or behind a cycle."""
    one = calls.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("after_id").alias("p"))
    there = one.select("conv_id", F.col("call_id").alias("p"), F.lit(True).alias("is"))
    now = scratch.pin(one.join(there, ["conv_id", "p"], "left").select(
        "conv_id", "call_id", F.when(F.col("is"), F.col("p")).alias("p"), F.when(F.col("is"), 1).otherwise(0).cast("long").alias("depth")))
    calls_n, reach, open_before = now.count(), 1, None
    while reach <= calls_n:
        open_now = now.where("p IS NOT NULL").count()
        if not open_now:
            break
        ahead = now.select("conv_id", F.col("call_id").alias("p"), F.col("p").alias("pp"), F.col("depth").alias("more"))
        nxt = scratch.pin(now.join(ahead, ["conv_id", "p"], "left").select(
            "conv_id", "call_id", "pp", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).withColumnRenamed("pp", "p"))
        scratch.drop(now)
        now, reach = nxt, reach * 2
    return now.select("conv_id", "call_id", F.when(F.col("p").isNull(), F.col("depth")).otherwise(-1).alias("depth"))


def _valid(name: Column, args: Column) -> Column:
    """Whether the arguments (a variant) fit their tool's schema; false for unknown tools and null arguments."""
    out = F.lit(False)
    for tool, fields in SCHEMAS.items():
        ok = F.schema_of_variant(args).startswith("OBJECT<")
        for f, (kind, required) in fields.items():
            got = F.try_variant_get(args, f"$.{f}", "variant")
            fits = F.schema_of_variant(got) == kind
            if (tool, f) in LEAST_LENGTH:
                fits &= F.length(F.try_variant_get(args, f"$.{f}", "string")) >= LEAST_LENGTH[tool, f]
            ok &= F.coalesce(fits, F.lit(not required) & got.isNull())
        names = F.map_keys(F.from_json(F.to_json(args), "map<string,string>"))
        ok &= F.coalesce(F.size(F.array_except(names, F.array(*map(F.lit, fields)))) == 0, F.lit(False))
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Linked calls: conv_id, call_id, name, turn, depth, status (linked, open, repeated, orphan), n_results, valid, json."""
    scratch = Scratch(calls.sparkSession, "calls")
    answer = results.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("a"), F.count(F.lit(1)).alias("n")).select(
        "conv_id", "call_id", F.col("a.content").alias("content"), F.col("a.turn").alias("result_turn"), "n")
    numbered = depths(calls, scratch)
    args = F.try_parse_json("arguments")
    told = (calls.join(answer, ["conv_id", "call_id"], "left").join(numbered, ["conv_id", "call_id"], "left")
            .withColumn("args", args))
    status = F.when(F.col("n").isNull(), "open").otherwise("linked")
    shown = F.struct(F.to_json("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))
    linked = told.select(
        "conv_id", "call_id", "name", "turn", F.coalesce("depth", F.lit(0)).alias("depth"), status.alias("status"),
        F.coalesce("n", F.lit(0)).alias("n_results"), _valid(F.col("name"), F.col("args")).alias("valid"),
        F.to_json(shown).alias("json"))
    named = calls.select("conv_id", "call_id").distinct()
    plain = results.select("conv_id", "call_id", "turn", "content")
    spare = plain.join(named, ["conv_id", "call_id"], "left_anti")
    # equal results are counted before they meet the one that is linked, of which one row is taken out
    counted = plain.groupBy("conv_id", "call_id", "turn", "content").agg(F.count(F.lit(1)).alias("k"))
    several = answer.where("n > 1").join(named, ["conv_id", "call_id"], "left_semi").withColumnRenamed("content", "first")
    same = F.col("turn").eqNullSafe(F.col("result_turn")) & F.col("content").eqNullSafe(F.col("first"))
    further = (counted.join(several, ["conv_id", "call_id"]).withColumn("k", F.col("k") - same.cast("int")).where("k > 0")
               .select("conv_id", "call_id", "turn", "content", F.explode(F.sequence(F.lit(1).cast("long"), "k"))))

    def alone(rows: DataFrame, status: str) -> DataFrame:
        return rows.select(
            "conv_id", "call_id", F.lit(None).cast("string").alias("name"), "turn", F.lit(0).cast("long").alias("depth"), F.lit(status).alias("status"),
            F.lit(1).cast("long").alias("n_results"), F.lit(False).alias("valid"),
            F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"))

    return linked.unionByName(alone(further, "repeated")).unionByName(alone(spare, "orphan"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(role IN ('user', 'system'), false) AS asks FROM conversations),
c AS (
  SELECT t.conv_id, t.turn, 'call:' || t.conv_id || ':' || t.turn AS call_id,
    CASE role WHEN 'system' THEN 'configure' ELSE 'respond' END AS name,
    CASE role WHEN 'system' THEN 'instructions' ELSE 'prompt' END AS field, text,
    CASE WHEN s.turn IS NOT NULL THEN t.turn - 1 ELSE t.turn - 2 END AS before
  FROM t LEFT JOIN (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'system') s ON s.conv_id = t.conv_id AND s.turn = t.turn - 1 WHERE asks),
r AS (
  SELECT conv_id, turn - 1 AS turn, arg_min(text, struct_pack(a := turn, b := text)) AS content, count(*) AS n FROM t WHERE NOT asks GROUP BY conv_id, turn),
u AS (SELECT conv_id, turn, min(before) AS before FROM c GROUP BY ALL),
runs AS (
  WITH RECURSIVE x(conv_id, turn, depth) AS (
    SELECT u.conv_id, u.turn, CAST(0 AS BIGINT) FROM u LEFT JOIN u v ON v.conv_id = u.conv_id AND v.turn = u.before WHERE v.turn IS NULL
    UNION ALL
    SELECT u.conv_id, u.turn, depth + 1 FROM x JOIN u ON u.conv_id = x.conv_id AND u.before = x.turn)
  SELECT * FROM x)
SELECT c.conv_id, call_id, name, c.turn, depth, CASE WHEN n IS NULL THEN 'open' ELSE 'linked' END AS status, coalesce(n, 0) AS n_results,
  text <> '' AS valid,
  '{"arguments":' || CAST(to_json('{' || CASE WHEN field < 'turn' THEN '"' || field || '":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || c.turn END || '}') AS VARCHAR)
    || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || CAST(to_json(name) AS VARCHAR)
    || CASE WHEN n IS NULL THEN '' ELSE ',"result":' || CAST(to_json(content) AS VARCHAR) END || '}' AS json
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn JOIN runs ON runs.conv_id = c.conv_id AND runs.turn = c.turn
UNION ALL
SELECT conv_id, 'call:' || conv_id || ':' || (turn - 1), NULL, turn, 0, 'orphan', 1, false,
  '{"id":' || CAST(to_json('call:' || conv_id || ':' || (turn - 1)) AS VARCHAR) || ',"result":' || CAST(to_json(text) AS VARCHAR) || '}'
FROM t WHERE NOT asks AND NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = t.conv_id AND c.turn = t.turn - 1)
UNION ALL
SELECT conv_id, 'call:' || conv_id || ':' || (turn - 1), NULL, turn, 0, 'repeated', 1, false,
  '{"id":' || CAST(to_json('call:' || conv_id || ':' || (turn - 1)) AS VARCHAR) || ',"result":' || CAST(to_json(text) AS VARCHAR) || '}'
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS place FROM t WHERE NOT asks) q
WHERE place > 1 AND EXISTS (SELECT 1 FROM c WHERE c.conv_id = q.conv_id AND c.turn = q.turn - 1)
"""
