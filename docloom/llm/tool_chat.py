"""Chat formatting with linked tool calls (operator 2), DataFrame functions only.

Calls and results are linked by a hash join on their identifier, ordered topologically, validated
against the schema of the called tool, and serialised as canonical JSON (keys sorted, no spaces).

``messages`` has conv_id, turn, kind ('call', 'result' or 'text'), role, call_id, name, arguments (a
JSON object as text), uses (identifiers of calls whose results the call needs) and text.
``schemas`` has name, param, type ('string', 'integer', 'number', 'boolean', 'array', 'object') and
required.  The result has one row per call (with its result), per text message and per result that no
call takes.  Messages stay rows of their own and are not gathered into one value, so a conversation
may have any length; (conv_id, level, turn) is the topological order.

Turns order calls whenever all calls point back to earlier turns; then level is 0.  Only conversations
in which a call uses a later one are ordered by levels: a chain of calls takes the logarithm of its length in
jobs, calls that use several others are settled level by level.  Calls on a cycle, or that use one of it, have no
level and the problem 'cycle'.

Identical rows are counted as one before anything is joined and written out again at the end, so copies of a
conversation never meet each other; all joins have at most one row per identifier on one side, and identifiers
with a large share of the rows are joined by broadcast.

Defined results: of several calls or results with one identifier the first by (conv_id, turn, fingerprint of the
row) is linked, the others, copies of the first included, carry the problem 'repeated id' or 'repeated result';
results without a call are 'orphan'; a null identifier links with nothing; null arguments count as ``{}``; text
that is not a JSON object, or repeats a key, is 'not an object' and serialised as a string; unknown tools are
'unknown tool'; parameters that the schema lacks are allowed; a null text is the empty string; a call uses what
any row with its identifier in its conversation uses; an empty table gives no rows; other columns are ignored.
Schemas are broadcast when at most ``BROADCAST_TOOLS`` tools, else joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, materialise, release, table

BROADCAST_TOOLS = 10_000
#: Copies of one row that one task writes out.
COPY_BLOCK = 1000
COLUMNS = ["conv_id", "turn", "kind", "role", "call_id", "name", "arguments", "uses", "text"]


def _type_of(value) -> F.Column:
    """JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(kind.startswith("OBJECT"), F.lit("object"))
        .when(kind.startswith("ARRAY"), F.lit("array"))
        .when(kind == "STRING", F.lit("string"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind == "BIGINT", F.lit("integer"))
        .when(kind == "VOID", F.lit("null"))
        .otherwise(F.lit("number"))
    )


def _argument_problems(params, values) -> F.Column:
    """One entry for each parameter that is missing or of another type."""

    def problem(p):
        kind = F.coalesce(_type_of(values[p["param"]]), F.lit("null"))
        return (
            F.when(F.coalesce(p["required"], F.lit(False)) & (kind == "null"), F.concat(F.lit("missing "), p["param"]))
            .when((kind == "null") | (kind == p["type"]) | ((p["type"] == "number") & (kind == "integer")), F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("type of "), p["param"]))
        )

    return F.filter(F.transform(params, problem), lambda x: x.isNotNull())


def _levels(calls: DataFrame) -> DataFrame | None:
    """(conv_id, call_id, level, cyclic) for the conversations in which a call uses a later one; None if there are none."""
    uses = calls.filter(F.size("uses") > 0).select("conv_id", "call_id", "turn", F.explode("uses").alias("dep"))
    # One row for each side of the join: the first turn that uses an identifier, the first turn that has it.
    first_use = uses.groupBy("conv_id", "dep").agg(F.min("turn").alias("turn"))
    first_turn = calls.groupBy(F.col("conv_id").alias("dep_conv"), F.col("call_id").alias("dep_call")).agg(F.min("turn").alias("dep_turn"))
    met = materialise(first_use.join(first_turn, (F.col("dep") == F.col("dep_call")) & F.col("conv_id").eqNullSafe(F.col("dep_conv"))).filter("dep_turn >= turn").select("conv_id").distinct(), "chat-forward")
    if met.isEmpty():
        return None
    forward, at = met.select(F.col("conv_id").alias("of_conv")), F.col("conv_id").eqNullSafe(F.col("of_conv"))
    ids = materialise(calls.join(forward, at, "left_semi").select(_conv_key().alias("conv_id"), "call_id").distinct(), "chat-open")
    edges = uses.join(forward, at, "left_semi").select(_conv_key().alias("conv_id"), "call_id", "dep").distinct()
    edges = edges.join(ids.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi")
    edges = materialise(edges, "chat-edges")
    levels = _topological_levels(ids, edges)
    release(met, ids, edges)
    return levels


def _topological_levels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of ids(conv_id, call_id) over edges(conv_id, call_id, dep).

    A call that uses one other call has a pointer to it; pointers are doubled until they end at a call that uses none
    or several, so a chain of any length takes the logarithm of its length.  Only calls that use several are settled
    level by level, with the chains between them as lengths.  What is never settled is on a cycle, or uses one.
    """
    key = ["conv_id", "call_id"]
    uses = edges.groupBy(*key).agg(F.count("*").alias("n_uses"), F.min("dep").alias("dep"))
    at = uses.filter("n_uses = 1").select("conv_id", "call_id", F.col("dep").alias("base"), F.lit(1).cast("long").alias("steps"))
    chains = materialise(at.withColumn("moved", F.lit(True)), "chat-chains")
    rounds, n = 0, chains.count()
    while n and (1 << rounds) <= 2 * n:
        on = chains.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("at"), F.col("base").alias("next"), F.col("steps").alias("more"))
        doubled = chains.join(on, (F.col("conv_id") == F.col("c2")) & (F.col("base") == F.col("at")), "left")
        doubled = materialise(doubled.select(*key, F.coalesce("next", "base").alias("base"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")), "chat-chains")
        release(chains)
        chains, rounds = doubled, rounds + 1
        if chains.filter("moved").isEmpty():
            break
    # A pointer that still moves after as many doublings as there are calls goes round a cycle.
    ends = chains.filter("NOT moved").select(F.col("conv_id").alias("c3"), F.col("call_id").alias("dep3"), "base", "steps")
    several = edges.join(uses.filter("n_uses > 1").select(*key), key, "left_semi")
    several = several.join(ends, (F.col("conv_id") == F.col("c3")) & (F.col("dep") == F.col("dep3")), "left")
    open_edges = materialise(several.select(*key, F.coalesce("base", "dep").alias("base"), F.coalesce("steps", F.lit(0)).alias("steps")), "chat-several")
    settled = materialise(ids.join(uses.select(*key), key, "left_anti").withColumn("level", F.lit(0).cast("long")), "chat-settled")
    while not open_edges.isEmpty():
        known = settled.select(F.col("conv_id").alias("c4"), F.col("call_id").alias("id4"), "level")
        met = open_edges.join(known, (F.col("conv_id") == F.col("c4")) & (F.col("base") == F.col("id4")), "left")
        free = met.groupBy(*key).agg(F.bool_and(F.col("level").isNotNull()).alias("free"), (F.max(F.col("level") + F.col("steps")) + 1).alias("level")).filter("free").drop("free")
        free = materialise(free, "chat-free")
        if free.isEmpty():
            release(free)
            break
        left = materialise(open_edges.join(free, key, "left_anti"), "chat-several")
        more = materialise(settled.unionByName(free), "chat-settled")
        release(open_edges, settled, free)
        open_edges, settled = left, more
    bases = settled.select(F.col("conv_id").alias("c5"), F.col("call_id").alias("id5"), F.col("level").alias("below"))
    chained = chains.filter("NOT moved").join(bases, (F.col("conv_id") == F.col("c5")) & (F.col("base") == F.col("id5"))).select(*key, (F.col("below") + F.col("steps")).alias("level"))
    levels = ids.join(settled.unionByName(chained), key, "left").select(*key, F.col("level").cast("int").alias("level"), F.col("level").isNull().alias("cyclic"))
    out = materialise(levels, "chat-levels")
    release(chains, open_edges, settled)
    return out


def _conv_key() -> F.Column:
    """conv_id as text that is never null, for joins by several columns."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _copied(rows: DataFrame) -> DataFrame:
    """Each row as often as ``times`` says; those with very many copies are dealt out in blocks first."""
    few = rows.filter(f"times BETWEEN 1 AND {COPY_BLOCK}").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    many = rows.filter(f"times > {COPY_BLOCK}").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / COPY_BLOCK))))
    size = F.least(F.lit(COPY_BLOCK), F.col("times") - F.col("block") * COPY_BLOCK)
    many = many.repartition(F.col("print"), F.col("block")).withColumn("copy", F.explode(F.sequence(F.lit(1), size)))
    return few.drop("copy", "times").unionByName(many.drop("copy", "times", "block"))


def format_tool_chat(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, level, turn, kind, call_id, linked, problems, message (canonical JSON)."""
    m = messages.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("uses", F.coalesce("uses", F.array().cast("array<string>")))
    is_call = F.col("kind") == "call"
    # Identical rows are one row with a count.
    rows = m.filter(F.col("kind").isin("call", "result")).groupBy(*COLUMNS).agg(F.count("*").alias("copies"))
    me = F.struct("conv_id", "turn", "print")
    rows = materialise(rows.withColumn("print", F.md5(F.to_json(F.struct(*COLUMNS)))), "chat-rows")
    ids = rows.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min(F.when(is_call, me)).alias("first_call"), F.min(F.when(~is_call, me)).alias("first_result"), F.count("*").alias("id_rows"))
    rows = materialise(join_spread(rows, ids, "call_id", "id_rows", rows.count()), "chat-linked")
    tools = schemas.groupBy(F.col("name").alias("tool")).agg(F.array_sort(F.collect_list(F.struct("param", "type", "required"))).alias("params"))
    small = tools.limit(BROADCAST_TOOLS + 1).count() <= BROADCAST_TOOLS
    tools = F.broadcast(tools) if small else tools
    named = F.col("call_id").isNotNull()
    levels = _levels(rows.filter(is_call & named).select("conv_id", "call_id", "turn", "uses"))

    # At most one call and one result of each identifier are first.
    first_call, first_result = me.eqNullSafe(F.col("first_call")), me.eqNullSafe(F.col("first_result"))
    answers = rows.filter(~is_call & named & first_result & F.col("first_call").isNotNull()).select(F.col("call_id").alias("link_id"), F.col("text").alias("answer"))
    calls = rows.filter(is_call).withColumn("first", named & first_call)
    firsts = calls.filter("first").join(answers, F.col("call_id") == F.col("link_id"), "left").drop("link_id")
    # Of the copies of a first call one is linked.
    others = _copied(calls.withColumn("times", F.when(F.col("first"), F.col("copies") - 1).otherwise(F.col("copies"))))
    others = others.withColumn("first", F.lit(False)).withColumn("answer", F.lit(None).cast("string"))
    calls = firsts.unionByName(others).join(tools, F.col("name") == F.col("tool"), "left")
    if levels is None:
        calls = calls.withColumn("level", F.lit(0)).withColumn("cyclic", F.lit(False))
    else:
        lv = levels.select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), "level", "cyclic")
        calls = calls.join(lv, (F.col("call_id") == F.col("l_call")) & (_conv_key() == F.col("l_conv")), "left")
    parsed = F.try_parse_json(F.coalesce("arguments", F.lit("{}")))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    values = F.from_json(F.coalesce("arguments", F.lit("{}")), "map<string, variant>")
    first = F.col("first")
    linked = first & F.col("first_result").isNotNull()
    late = linked & F.col("first_result.conv_id").eqNullSafe(F.col("conv_id")) & (F.col("first_result.turn") <= F.col("turn"))
    problems = F.concat(
        F.when(F.col("call_id").isNotNull() & ~first, F.array(F.lit("repeated id"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array().cast("array<string>")),
        F.when(~is_object, F.array(F.lit("not an object"))).when(F.col("params").isNotNull(), _argument_problems(F.col("params"), values)).otherwise(F.array().cast("array<string>")),
        F.when(late, F.array(F.lit("result before call"))).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce("cyclic", F.lit(False)), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
    )
    # Keys in sorted order; a variant prints its own keys sorted.
    arguments = F.when(is_object, F.to_json(parsed)).otherwise(_json_string(F.coalesce("arguments", F.lit(""))))
    message = F.concat(
        F.lit('{"arguments":'), arguments,
        F.lit(',"call_id":'), _json_string(F.col("call_id")),
        F.lit(',"name":'), _json_string(F.col("name")),
        F.lit(',"result":'), F.when(linked, _json_string(F.col("answer"))).otherwise(F.lit("null")),
        F.lit(',"role":'), _json_string(F.col("role")), F.lit("}"),
    )
    level = F.when(F.coalesce("cyclic", F.lit(False)), F.lit(None).cast("int")).otherwise(F.coalesce("level", F.lit(0)))
    calls = calls.select("conv_id", level.alias("level"), "turn", "kind", "call_id", linked.alias("linked"), problems.alias("problems"), message.alias("message"))

    orphan = F.col("first_call").isNull()
    times = F.when(named & ~orphan & first_result, F.col("copies") - 1).otherwise(F.col("copies"))
    results = _copied(rows.filter(~is_call).withColumn("times", times))
    results = results.withColumn("problems", F.array(F.when(orphan, F.lit("orphan")).otherwise(F.lit("repeated result"))))
    texts = m.filter(~F.col("kind").isin("call", "result") | F.col("kind").isNull()).withColumn("problems", F.array().cast("array<string>"))
    plain = F.concat(F.lit('{"content":'), _json_string(F.col("text")), F.lit(',"role":'), _json_string(F.col("role")), F.lit("}"))
    rest = [x.select("conv_id", F.lit(0).alias("level"), "turn", "kind", "call_id", F.lit(False).alias("linked"), "problems", plain.alias("message")) for x in (results, texts)]
    return calls.unionByName(rest[0]).unionByName(rest[1])


def _json_string(column) -> F.Column:
    """A JSON string, or null."""
    return F.coalesce(F.to_json(F.to_variant_object(F.array(column))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(column)))) - 2), F.lit("null"))


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """The conversations table as calls and results.

    A user turn calls the tool 'reply' with its text and turn; the assistant turn after it names the
    same identifier and is its result; a later user turn uses the result before it.  All other turns
    are texts.
    """
    name = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("text")
    return conversations.select(
        "conv_id", "turn", kind.alias("kind"), "role",
        F.when(kind == "call", name(turn)).when(kind == "result", name(turn - 1)).alias("call_id"),
        F.when(kind == "call", F.lit("reply")).alias("name"),
        F.when(kind == "call", F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("prompt")))).alias("arguments"),
        F.when((kind == "call") & (turn >= 2), F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("uses"),
        "text",
    )


REPLY_SCHEMA = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]


def op2_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(REPLY_SCHEMA, "name string, param string, type string, required boolean")
    return format_tool_chat(conversation_calls(table(spark, sf_dir, "conversations")), schemas)


ORACLE = """
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind,
         CASE role WHEN 'user' THEN 'call-' || conv_id || '-' || turn WHEN 'assistant' THEN 'call-' || conv_id || '-' || (turn - 1) END AS call_id
  FROM conversations),
 r AS (SELECT c.*, x.text AS result, x.call_id IS NOT NULL AS linked FROM m c LEFT JOIN m x ON x.kind = 'result' AND x.call_id = c.call_id WHERE c.kind = 'call')
SELECT conv_id, 0 AS level, turn, kind, call_id, linked, []::VARCHAR[] AS problems,
       '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"call_id":' || to_json(call_id) || ',"name":"reply","result":' || CASE WHEN linked THEN to_json(result) ELSE 'null' END || ',"role":"user"}' AS message
FROM r
UNION ALL
SELECT conv_id, 0, turn, kind, call_id, false, ['orphan'], '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}'
FROM m WHERE kind = 'result' AND call_id NOT IN (SELECT call_id FROM m WHERE kind = 'call')
UNION ALL
SELECT conv_id, 0, turn, kind, call_id, false, []::VARCHAR[], '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}'
FROM m WHERE kind = 'text'
"""
