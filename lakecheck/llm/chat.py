"""Chat formatting: tool-call linking, DataFrame functions only.

Messages are rows. An assistant's text may be a JSON object with ``content`` and
``tool_calls``, each call with ``id``, ``name``, ``arguments`` and, in ``after``, the
identifiers of calls whose results it needs; a tool's text is an object with
``tool_call_id`` and ``content``. Calls are hash-joined with results by conversation and
identifier, put in topological order, checked against the tools' schemas, and written as
canonical JSON: no white space, keys sorted at every depth, numbers in their shortest form.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakecheck.llm.registry import ORACLES, query, table
from lakecheck.session import materialize, scratch_path

#: Tool -> parameter -> (type, required). Types: string, integer, number, boolean, array, object.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}
CALL = "STRUCT<id: STRING, name: STRING, arguments: VARIANT, after: ARRAY<STRING>>"
KEY = ["conv_id", "call_id"]


def problem_of(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call: null, ``unknown_tool`` or ``invalid_arguments``."""
    keys = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
    out = F.when(name.isNull(), F.lit("unknown_tool"))
    for tool, parameters in schemas.items():
        wrong = keys.isNull() | (F.size(F.array_except(keys, F.array(*map(F.lit, parameters)).cast("array<string>"))) > 0)
        for parameter, (kind, required) in parameters.items():
            given = F.array_contains(keys, parameter)
            fits = F.schema_of_variant(F.try_variant_get(arguments, f"$['{parameter}']", "variant")).rlike(_TYPES[kind])
            wrong = wrong | F.when(given, ~F.coalesce(fits, F.lit(False))).otherwise(F.lit(required))
        out = out.when(name == tool, F.when(wrong, F.lit("invalid_arguments")))
    return out.otherwise(F.lit("unknown_tool"))


_STATE = "conv_id string, call_id string, target string, dist long, n_needs long, most long, level long, moved boolean"


def call_levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of the calls that have one: 0 without dependencies, else one
    more than the highest of those it comes after. Calls in or behind a cycle, or after a call
    that doesn't exist, have none.

    Levels by pointer doubling: a need is a link to a call and its distance. In a round a link
    to a settled call gives a level, and one to a call with a single link takes over that
    link, distances added, so a chain of n calls takes log2(n) rounds. A call with several links
    is settled once all of them are: those on top of each other take a round each. A distance
    beyond the conversation's calls is a cycle's. A round writes one table: what it settled and
    the links that are left. Joins are by conversation and call, so no conversation is hot.
    """
    spark = calls.sparkSession
    keys = calls.select(*KEY).distinct()
    needs = calls.select(*KEY, F.explode("after").alias("target")).distinct()
    asked = needs.groupBy(*KEY).agg(F.count("*").alias("n_needs"))
    sizes = keys.groupBy("conv_id").agg(F.count("*").alias("most"))
    known = keys.join(asked, KEY, "left").join(sizes, "conv_id")
    links = needs.join(known, KEY).select(*KEY, "target", F.lit(1).cast("long").alias("dist"), "n_needs", "most", F.lit(None).cast("long").alias("level"), F.lit(True).alias("moved"))
    free = known.where("n_needs IS NULL").select(
        *KEY, F.lit(None).cast("string").alias("target"), F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("n_needs"), "most", F.lit(0).cast("long").alias("level"), F.lit(True).alias("moved"))
    rounds = [scratch_path(spark, "levels")]
    links.unionByName(free).write.parquet(rounds[0])
    before = None
    while True:
        state = spark.read.schema(_STATE).parquet(rounds[-1])
        seen = state.agg(F.count("*").alias("all"), F.count("level").alias("settled"), F.count_if(F.col("level").isNull() & F.col("moved")).alias("moved")).first()
        left = seen["all"] - seen["settled"]
        if not left or not (seen["moved"] or seen["settled"] or left < before):
            break
        before = left
        rounds.append(scratch_path(spark, "levels"))
        _settle(state.where("level IS NULL"), _settled(spark, rounds[:-1])).write.parquet(rounds[-1])
    return _settled(spark, rounds).select(*KEY, F.col("level").cast("int").alias("level"))


def _settled(spark: SparkSession, rounds: list[str]) -> DataFrame:
    return spark.read.schema(_STATE).parquet(*rounds).where("level IS NOT NULL").select(*KEY, "level")


def _settle(links: DataFrame, settled: DataFrame) -> DataFrame:
    """One round: links that are left, and a row for each call that is settled by them."""
    nothing = F.lit(None)
    places = settled.select("conv_id", F.col("call_id").alias("target"), F.col("level").alias("_level"), nothing.cast("string").alias("_next"), nothing.cast("long").alias("_step"))
    single = F.col("n_needs") == 1
    waiting = links.select("conv_id", F.col("call_id").alias("target"), nothing.cast("long").alias("_level"), F.when(single, F.col("target")).alias("_next"), F.when(single, F.col("dist")).alias("_step"))
    # a call with several links is there once, however many are left
    places = places.unionByName(waiting.dropDuplicates(["conv_id", "target"])).withColumn("_there", F.lit(True))
    met = links.drop("level", "moved").join(places, ["conv_id", "target"], "left")
    dist = F.col("dist") + F.coalesce("_step", F.lit(0))
    met = met.select(
        *KEY, F.coalesce("_next", "target").alias("target"), dist.alias("dist"), "n_needs", "most", (F.col("dist") + F.col("_level")).alias("_value"),
        (F.col("_there").isNull() | (dist > F.col("most"))).alias("_dead"), F.col("_next").isNotNull().alias("moved"))
    call = Window.partitionBy(*KEY)
    judged = met.withColumns({
        "_lost": F.bool_or("_dead").over(call), "_all": F.count("_value").over(call) == F.col("n_needs"), "_top": F.max("_value").over(call),
        "_first": F.row_number().over(call.orderBy("target"))})
    some = judged.where("NOT _lost AND (NOT _all OR _first = 1)")
    level = F.when(F.col("_all"), F.col("_top"))
    return some.select(*KEY, F.when(~F.col("_all"), F.col("target")).alias("target"), "dist", "n_needs", "most", level.alias("level"), "moved")


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per message, per call in it, and per result that no call asked for:
    ``conv_id, turn, part, role, call_id, level, status, json``.

    ``level`` is -1 where there is none, ``part`` is 0 for the message and counts its calls from 1; by (level, turn, part) calls
    come after what they need, messages by (turn, part). ``status`` of a call is, whichever
    comes first: ``unknown_tool``, ``invalid_arguments``, ``duplicate_id`` (not the first of its
    conversation with the identifier), ``no_order`` (in or behind a cycle, or after a call that
    doesn't exist), ``no_result``, ``ok``; of a result without a call ``orphan``; else null. Of
    several results the first counts. A result with a call has no row of its own. Text that
    isn't such an object is a plain message, null the empty one; a call without an identifier
    is linked to nothing. Null conversations are one conversation, apart from that named ``''``;
    a null turn comes before all others. Very long texts and conversations are rows like others:
    no task ever holds a conversation. No rows in: no rows out. Other columns are not read.
    """
    slim = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))  # a key that is never null
    # only text that can be an object is parsed
    parsed = slim.withColumn("v", F.when(F.ltrim("text", F.lit(" \t\r\n")).startswith("{"), F.try_parse_json("text")))
    is_result = (F.col("role") == "tool") & F.try_variant_get("v", "$.tool_call_id", "string").isNotNull()
    parsed = materialize(parsed.select(
        "conv_id", "turn", "role", "text", F.coalesce(is_result, F.lit(False)).alias("is_result"),
        F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", f"ARRAY<{CALL}>")).alias("asked"),
        F.try_variant_get("v", "$.content", "string").alias("content"), F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"),
        F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("result"),
    ).withColumn("asked", F.transform("asked", lambda c: F.struct(
        c["id"].alias("id"), c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments"), c["after"].alias("after")))), "messages")
    plain = parsed.where("NOT is_result").select(
        "conv_id", "turn", F.lit(0).alias("part"), "role", F.lit(None).cast("string").alias("call_id"), F.lit(-1).alias("level"), F.lit(None).cast("string").alias("status"),
        F.to_json(F.struct(F.when(F.col("asked").isNotNull(), F.coalesce("content", F.lit(""))).otherwise(F.col("text")).alias("content"), "role")).alias("json"))
    calls = parsed.where("asked IS NOT NULL").select("conv_id", "turn", F.posexplode("asked").alias("part", "call")).select(
        "conv_id", "turn", (F.col("part") + 1).alias("part"), F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.try_parse_json("call.arguments").alias("arguments"), F.col("call.after").alias("after"))
    order = calls.select(*KEY, "after").where("call_id IS NOT NULL")
    place = F.struct("turn", "part")
    firsts = calls.where("call_id IS NOT NULL").groupBy(*KEY).agg(F.min(place).alias("first"))
    results = parsed.where("is_result").groupBy(*KEY).agg(F.min_by("result", "turn").alias("result"), F.min("turn").alias("answered"))
    linked = calls.join(firsts, KEY, "left").join(call_levels(order), KEY, "left").join(results, KEY, "left")
    status = F.coalesce(
        problem_of(F.col("name"), F.col("arguments"), schemas),
        F.when(place > F.col("first"), F.lit("duplicate_id")), F.when(F.col("call_id").isNotNull() & F.col("level").isNull(), F.lit("no_order")),
        F.when(F.col("answered").isNull(), F.lit("no_result")), F.lit("ok"))
    answer = F.when(status == "ok", F.try_parse_json("result"))
    asked = linked.select(
        "conv_id", "turn", "part", F.lit("assistant").alias("role"), "call_id", F.coalesce("level", F.lit(-1)).alias("level"), status.alias("status"),
        F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", answer.alias("result"))).alias("json"))
    orphans = parsed.where("is_result").join(firsts, KEY, "left_anti").select(
        "conv_id", "turn", F.lit(0).alias("part"), "role", "call_id", F.lit(-1).alias("level"), F.lit("orphan").alias("status"),
        F.to_json(F.struct(F.try_parse_json("result").alias("content"), "role", F.col("call_id").alias("tool_call_id"))).alias("json"))
    out = plain.unionByName(asked).unionByName(orphans)
    return out.withColumn("conv_id", F.when(F.col("conv_id") != "", F.substring("conv_id", 2, 1 << 30)))


SCHEMAS: Schemas = {
    "measure": {"length": ("integer", True), "unit": ("string", False)},
    "search": {"limit": ("integer", False), "phrase": ("string", True)},
}


def rendered_calls(conversations: DataFrame) -> DataFrame:
    """The table's conversations as tool dialogues: an assistant's turn keeps its whole text and
    calls a tool about it, after its call two turns before, and the user's next turn is the result."""
    length, turn, listed = F.length("text"), F.col("turn"), F.to_json(F.array("text"))
    whole = F.substr(listed, F.lit(2), F.length(listed) - 2)  # the text as JSON
    identifier = F.concat(F.lit("c"), turn.cast("string"))
    name = F.when(length % 13 == 0, F.lit("draw")).when(length % 2 == 0, F.lit("measure")).otherwise(F.lit("search"))
    arguments = F.when(length % 2 == 0, F.concat(F.lit('{ "unit":"chars", "length" : '), F.when(length % 7 == 0, F.lit("null")).otherwise(length.cast("string")), F.lit("}"))).otherwise(
        F.concat(F.lit('{"phrase": '), whole, F.lit(',"limit":5}')))
    call = F.concat(
        F.lit('{"content":'), whole, F.lit(',"tool_calls":[{"name":"'), name, F.lit('","arguments":'), arguments, F.lit(',"id":"'), identifier,
        F.lit('","after":['), F.when(turn >= 3, F.concat(F.lit('"c'), (turn - 2).cast("string"), F.lit('"'))).otherwise(F.lit("")), F.lit("]}]}"))
    answers = (F.col("role") == "user") & (turn >= 2)
    result = F.to_json(F.struct(F.concat(F.lit("c"), (turn - 1).cast("string")).alias("tool_call_id"), F.col("text").alias("content")))
    return conversations.select(
        "conv_id", "turn", F.when(answers, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "assistant", call).when(answers, result).otherwise(F.col("text")).alias("text"))


@query
def op6_chat(spark, sf_dir):
    return link_tool_calls(rendered_calls(table(spark, sf_dir, "conversations")), SCHEMAS)


ORACLES["op6_chat"] = """
WITH RECURSIVE calls AS (
    SELECT conv_id, turn, text, length(text) AS n,
           CASE WHEN length(text) % 13 = 0 THEN 'draw' WHEN length(text) % 2 = 0 THEN 'measure' ELSE 'search' END AS name
    FROM conversations WHERE role = 'assistant'),
chains AS (
    SELECT conv_id, turn, 0 AS level FROM calls WHERE turn < 3
    UNION ALL
    SELECT c.conv_id, c.turn, level + 1 FROM calls c JOIN chains p ON c.conv_id = p.conv_id AND c.turn = p.turn + 2 AND c.turn >= 3),
answers AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'user' AND turn >= 2),
linked AS (
    SELECT c.conv_id, c.turn, c.text, n, name, level, answer,
           CASE WHEN name = 'draw' THEN 'unknown_tool' WHEN name = 'measure' AND n % 7 = 0 THEN 'invalid_arguments'
                WHEN level IS NULL THEN 'no_order' WHEN answer IS NULL THEN 'no_result' ELSE 'ok' END AS status
    FROM calls c LEFT JOIN chains USING (conv_id, turn) LEFT JOIN answers USING (conv_id, turn))
SELECT conv_id::VARCHAR AS conv_id, turn, 0 AS part, role, NULL::VARCHAR AS call_id, -1 AS level, NULL::VARCHAR AS status,
       '{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '"}' AS json
FROM conversations WHERE NOT (role = 'user' AND turn >= 2)
UNION ALL
SELECT conv_id::VARCHAR, turn, 1, 'assistant', 'c' || turn, coalesce(level, -1)::INT, status,
       '{"arguments":{' || CASE WHEN n % 2 = 0 THEN '"length":' || CASE WHEN n % 7 = 0 THEN 'null' ELSE n::VARCHAR END || ',"unit":"chars"'
            ELSE '"limit":5,"phrase":' || to_json(text)::VARCHAR END
       || '},"id":"c' || turn || '","name":"' || name || '"' || CASE WHEN status = 'ok' THEN ',"result":' || to_json(answer)::VARCHAR ELSE '' END || '}'
FROM linked
UNION ALL
SELECT a.conv_id::VARCHAR, a.turn + 1, 0, 'tool', 'c' || a.turn, -1, 'orphan',
       '{"content":' || to_json(answer)::VARCHAR || ',"role":"tool","tool_call_id":"c' || a.turn || '"}'
FROM answers a ANTI JOIN calls USING (conv_id, turn)
"""
