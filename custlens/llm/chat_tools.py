"""Chat formatting: link tool calls with their results, order them, check their arguments, write canonical JSON.

Calls and results are two tables. They are joined on the conversation and the identifier of the call, as each
conversation may number its calls from one; a call may wait for one earlier call of its conversation (``after``), which
makes a forest, and its level there is its place in the topological order: every call comes
after the one it waits for. Levels are found by pointer doubling, so a chain of n calls takes log2(n) joins and no
conversation is ever gathered in one task. Arguments are checked against a table of parameters. Each exchange becomes
one JSON text with sorted keys, no white space and nulls written out, so equal exchanges give equal texts.
Only DataFrame functions are used.

``exchanges`` reads messages: a user turn is a call of the tool ``reply`` named ``conversation:turn``, which waits for the
one two turns before, and the assistant turn that follows it is its result. Messages whose text is a JSON object with
``tool_calls`` or ``tool_call_id`` bring calls and results of their own. ``formatted`` returns every message: beside
what ``link`` gives, system turns, other roles and null roles are rows of status ``message``, and texts that
``link`` only counts as they conflict with the smallest of their identifier are rows of status ``conflict``.

Defined cases: rows without a conversation have theirs in common; calls of one conversation with one identifier are one call, the one whose JSON text is smallest (``copies`` counts them), and
likewise for the results of one call; a call without a result is ``open``; a result without a call is ``orphan``; a call
that waits for an unknown call or for none starts a chain; calls that wait for each other in a ring are ``ring`` and have
no level; a null identifier or turn joins nothing and gives an orphan or open row with a null identifier; a null or
empty text is an argument like any other and fails a check that wants one; an unknown tool or parameter is a problem.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from custlens.llm.common import column
from custlens.session import materialize

# Parameters of the tools: tool, parameter, kind, whether it is required.
SCHEMAS = [
    ("reply", "text", "text", True),
    ("reply", "turn", "integer", True),
    ("reply", "system", "text", False),
]
# What a value of each kind looks like.
KINDS = {
    "text": r"(?s).+",
    "integer": r"-?[0-9]+",
    "number": r"-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?",
    "boolean": r"true|false",
}
_EMBEDDED = (
    "struct<tool_calls:array<struct<id:string,name:string,after:string,arguments:map<string,string>,"
    "function:struct<name:string,arguments:string>>>,"
    "tool_call_id:string,content:string>"
)


def canonical(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def sorted_map(value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def _one_each(rows: DataFrame, conv: str, key: str, text: str) -> DataFrame:
    """One row per ``conv, key`` (all rows without a key stay): that with the smallest ``text``, and how many there were.

    Partly combined before the shuffle, so a key that a third of the rows share moves one row per task.
    """
    others = [c for c in rows.columns if c not in (conv, key, text)]
    named = rows.where(F.col(key).isNotNull())
    first = F.min(F.struct(text, *others)).alias("first_")
    kept = named.groupBy(conv, key).agg(first, F.count("*").alias("copies")).select(conv, key, "first_.*", "copies")
    return kept.unionByName(rows.where(F.col(key).isNull()).withColumn("copies", F.lit(1).cast("long")))


def levels(calls: DataFrame) -> DataFrame:
    """``id, level`` of every call with an identifier; level null for those that wait in a ring.

    ``calls`` has ``id`` (no two the same) and ``after``. Each round follows twice as many steps back.
    """
    known = calls.where(F.col("id").isNotNull()).select("id", "after")
    ids = known.select(F.col("id").alias("known"))
    state = (
        known.join(ids, F.col("after") == F.col("known"), "left")
        .select("id", F.col("known").alias("to"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("level"))
    )
    state = materialize(state, "call-levels")
    total, waiting = state.agg(F.count("*"), F.count("to")).first()
    span = 1
    while waiting and span <= total:
        further = state.select(F.col("id").alias("at"), F.col("to").alias("next"), F.col("level").alias("more"))
        done = state.where(F.col("to").isNull())
        moved = state.where(F.col("to").isNotNull()).join(further, F.col("to") == F.col("at"))
        moved = moved.select("id", F.col("next").alias("to"), (F.col("level") + F.col("more")).alias("level"))
        state = materialize(done.unionByName(moved), "call-levels")
        waiting = state.agg(F.count("to")).first()[0]
        span *= 2
    return state.select("id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))


def problems(schemas: list[tuple[str, str, str, bool]], name: Column, arguments: Column) -> Column:
    """Sorted names of what is wrong with the arguments: missing, ill-typed or unknown parameters, or the tool."""
    tools = sorted({s[0] for s in schemas})
    found = F.array(F.concat(F.lit("tool:"), F.coalesce(name, F.lit(""))))
    for tool in tools:
        own = [s for s in schemas if s[0] == tool]
        wrong = []
        for _, parameter, kind, required in own:
            value = F.try_element_at(arguments, F.lit(parameter))
            fits = F.regexp_like(value, F.lit(f"^(?:{KINDS[kind]})$"))
            bad = F.when(value.isNull(), F.lit(required)).otherwise(~fits)
            wrong.append(F.when(bad, F.lit(parameter)))
        unknown = F.array_except(F.map_keys(arguments), F.array(*(F.lit(s[1]) for s in own)))
        listed = F.concat(F.filter(F.array(*wrong), lambda x: x.isNotNull()), F.coalesce(unknown, F.array()))
        found = F.when(name == tool, F.array_sort(listed)).otherwise(found)
    return found


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call and per orphan result.

    ``calls``: ``conv, turn, id, name, after, arguments``; ``results``: ``conv, turn, call_id, content``.
    """
    asked = calls.withColumn("arguments", sorted_map(F.col("arguments"))).withColumn(
        "text_", canonical(F.struct(F.col("arguments"), F.col("name")))
    )
    # Maps cannot be compared, so the rows are told apart by their text, which is read back.
    asked = _one_each(asked.select("conv", "turn", "id", "name", "after", "text_"), "conv", "id", "text_")
    asked = asked.withColumn(
        "arguments", F.from_json("text_", "arguments map<string,string>, name string")["arguments"]
    )
    asked = materialize(asked, "calls")
    given = _one_each(
        results.select("call_id", F.col("content").alias("content"), F.col("conv").alias("r_conv"), F.col("turn").alias("r_turn"))
        .withColumn("given_", F.lit(True)),
        "r_conv",
        "call_id",
        "content",
    ).withColumnRenamed("copies", "r_copies")
    # Structs are equal where both lack a conversation; without an identifier there is no struct, which joins nothing.
    scoped = lambda conv, key: F.when(F.col(key).isNotNull(), F.struct(F.col(conv), F.col(key)))
    ordered = levels(asked.select(scoped("conv", "id").alias("id"), scoped("conv", "after").alias("after")))
    placed = asked.join(ordered.withColumnRenamed("id", "level_id"), scoped("conv", "id") == F.col("level_id"), "left")
    both = placed.join(given, F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("id") == F.col("call_id")), "full_outer")
    asked_ = F.col("copies").isNotNull()
    wrong = F.when(asked_, problems(schemas, F.col("name"), F.col("arguments")))
    status = (
        F.when(~asked_, F.lit("orphan"))
        .when(F.col("id").isNotNull() & F.col("level").isNull(), F.lit("ring"))
        .when(F.col("given_").isNull(), F.lit("open"))
        .otherwise(F.lit("linked"))
    )
    text = canonical(
        F.struct(
            F.col("after"),
            F.col("arguments"),
            F.coalesce("id", "call_id").alias("id"),
            F.col("level"),
            F.col("name"),
            F.col("content").alias("result"),
            status.alias("status"),
        )
    )
    return both.select(
        F.coalesce("conv", "r_conv").alias("conv_id"),
        F.coalesce("turn", "r_turn").alias("turn"),
        F.coalesce("id", "call_id").alias("call_id"),
        "level",
        status.alias("status"),
        F.coalesce("copies", F.lit(0)).alias("n_calls"),
        F.coalesce("r_copies", F.lit(0)).alias("n_results"),
        F.array_join(wrong, ",").alias("problems"),
        text.alias("json"),
    )


def exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of the messages ``conv_id, turn, role, text``."""
    rows = messages.select(
        column(messages, "conv_id").alias("conv"),
        column(messages, "turn").try_cast("long").alias("turn"),
        column(messages, "role").alias("role"),
        column(messages, "text").alias("text"),
    )
    name = lambda turn: F.concat(F.col("conv").cast("string"), F.lit(":"), turn.cast("string"))
    turn = F.col("turn")
    embedded = F.when(F.col("text").startswith("{"), F.from_json("text", _EMBEDDED))
    rows = rows.withColumn("own", embedded)
    holds = F.col("own.tool_calls").isNotNull()
    answers = F.col("own.tool_call_id").isNotNull()
    arguments = F.create_map(F.lit("text"), F.col("text"), F.lit("turn"), turn.cast("string"))
    spoken = rows.where((F.col("role") == "user") & ~holds & ~answers).select(
        "conv", "turn", name(turn).alias("id"), F.lit("reply").alias("name"), name(turn - 2).alias("after"), arguments.alias("arguments")
    )
    written = rows.where(holds).select("conv", "turn", F.explode("own.tool_calls").alias("c"))
    # A call under ``function`` holds its arguments as an object or as the text of one.
    nested = F.from_json("c.function.arguments", "map<string,string>")
    none = F.create_map().cast("map<string,string>")
    written = written.select(
        "conv",
        "turn",
        "c.id",
        F.coalesce("c.name", "c.function.name").alias("name"),
        "c.after",
        F.coalesce("c.arguments", nested, none).alias("arguments"),
    )
    replies = rows.where((F.col("role") == "assistant") & ~holds & ~answers).select(
        "conv", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content")
    )
    returned = rows.where(answers).select(
        "conv", "turn", F.col("own.tool_call_id").alias("call_id"), F.col("own.content").alias("content")
    )
    return spoken.unionByName(written), replies.unionByName(returned)


def messages_beside(messages: DataFrame) -> DataFrame:
    """Messages that are neither call nor result, as rows like those of ``link`` with status ``message``: system turns, other
    roles and messages without a role. ``name`` is the role, ``result`` the text, ``n_results`` the number of equal messages."""
    text, role = column(messages, "text"), column(messages, "role")
    own = F.when(text.startswith("{"), F.from_json(text, _EMBEDDED))
    tool = F.coalesce(own["tool_calls"].isNotNull() | own["tool_call_id"].isNotNull(), F.lit(False))
    rows = messages.where(~tool & ~F.coalesce(role.isin("user", "assistant"), F.lit(False))).select(
        column(messages, "conv_id").alias("conv_id"),
        column(messages, "turn").try_cast("long").alias("turn"),
        role.alias("name"),
        text.alias("result"),
    )
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    call_id = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return _beside(rows.withColumn("call_id", call_id), "message", F.lit(0).cast("long"), F.col("n"))


def conflicts(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The calls and results that ``link`` counts but does not show, as rows with status ``conflict``: those that differ from the
    smallest of their identifier, one row for equal ones."""
    text = canonical(F.struct(sorted_map(F.col("arguments")).alias("arguments"), F.col("name")))
    asked = _larger(calls.select("conv", "turn", F.col("id").alias("key"), "after", text.alias("text")))
    call = F.from_json("text", "arguments map<string,string>, name string")
    asked = asked.select(
        F.col("conv").alias("conv_id"), "turn", F.col("key").alias("call_id"), "after", "n",
        call["arguments"].alias("arguments"), call["name"].alias("name"),
    )
    given = _larger(results.select("conv", "turn", F.col("call_id").alias("key"), F.col("content").alias("text")))
    given = given.select(
        F.col("conv").alias("conv_id"), "turn", F.col("key").alias("call_id"), "n", F.col("text").alias("result")
    )
    none = F.lit(0).cast("long")
    return _beside(asked, "conflict", F.col("n"), none).unionByName(_beside(given, "conflict", none, F.col("n")))


def _larger(rows: DataFrame) -> DataFrame:
    """The rows of each ``conv, key`` whose text is not the smallest (null is least), equal ones counted as ``n``."""
    extra = [c for c in rows.columns if c not in ("conv", "key", "text")]
    found = rows.where("key is not null").groupBy("conv", "key", "text").agg(
        F.min(F.struct(*extra)).alias("extra"), F.count("*").alias("n")
    )
    least = found.groupBy(F.col("conv").alias("l_conv"), F.col("key").alias("l_key")).agg(
        F.min(F.struct("text")).alias("least"), F.count("*").alias("texts")
    )
    same = F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("key") == F.col("l_key"))
    left = found.join(least.where("texts > 1"), same).where(~F.col("text").eqNullSafe(F.col("least.text")))
    return left.select("conv", "key", "text", "extra.*", "n")


def _beside(rows: DataFrame, status: str, n_calls: Column, n_results: Column) -> DataFrame:
    """Rows in the columns of ``link``; what they lack is null."""
    kinds = {"after": "string", "arguments": "map<string,string>", "name": "string", "result": "string"}
    for c, kind in kinds.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    level, state = F.lit(None).cast("long"), F.lit(status)
    text = canonical(
        F.struct("after", "arguments", F.col("call_id").alias("id"), level.alias("level"), "name", "result", state.alias("status"))
    )
    return rows.select(
        "conv_id",
        "turn",
        "call_id",
        level.alias("level"),
        state.alias("status"),
        n_calls.alias("n_calls"),
        n_results.alias("n_results"),
        F.lit(None).cast("string").alias("problems"),
        text.alias("json"),
    )


def formatted(messages: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """Every message of ``conv_id, turn, role, text`` in canonical form: linked exchanges, other messages, conflicting texts."""
    calls, results = exchanges(messages)
    return (
        link(calls, results, schemas).unionByName(messages_beside(messages)).unionByName(conflicts(calls, results))
    )


def op2_tool_calls(spark, folder):
    rows = formatted(spark.read.parquet(f"{folder}/conversations.parquet"))
    return rows.withColumn("json_sha256", F.sha2(F.col("json").cast("binary"), 256)).drop("json")


OP2_SQL = r"""
WITH calls AS (
  SELECT CAST(conv_id AS BIGINT) AS conv, CAST(turn AS BIGINT) AS turn, conv_id || ':' || turn AS id,
         conv_id || ':' || (turn - 2) AS after, min(text) AS text, count(*) AS copies
  FROM conversations WHERE role = 'user' GROUP BY ALL),
results AS (
  SELECT CAST(conv_id AS BIGINT) AS conv, CAST(turn AS BIGINT) AS turn, conv_id || ':' || (turn - 1) AS call_id,
         min(text) AS content, count(*) AS copies
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
starts AS (
  SELECT c.conv, c.turn FROM calls c LEFT JOIN calls p ON c.after = p.id WHERE p.id IS NULL),
levelled AS (
  SELECT c.*, (c.turn - (SELECT max(s.turn) FROM starts s
    WHERE s.conv = c.conv AND s.turn <= c.turn AND (c.turn - s.turn) % 2 = 0)) // 2 AS level
  FROM calls c),
linked AS (
  SELECT coalesce(c.conv, r.conv) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(id, call_id) AS call_id,
         CAST(level AS BIGINT) AS level, after, c.text, content, c.turn AS asked,
         CASE WHEN id IS NULL THEN 'orphan' WHEN call_id IS NULL THEN 'open' ELSE 'linked' END AS status,
         coalesce(c.copies, 0) AS n_calls, coalesce(r.copies, 0) AS n_results,
         CASE WHEN id IS NULL THEN NULL WHEN coalesce(c.text, '') = '' THEN 'text' ELSE '' END AS problems
  FROM levelled c FULL JOIN results r ON c.id = r.call_id)
SELECT conv_id, turn, call_id, level, status, n_calls, n_results, problems,
       sha256('{"after":' || coalesce(to_json(after), 'null') || ',"arguments":'
         || CASE WHEN asked IS NULL THEN 'null' ELSE '{"text":' || coalesce(to_json(text), 'null') || ',"turn":"' || asked
            || '"}' END
         || ',"id":' || to_json(call_id) || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":'
         || CASE WHEN asked IS NULL THEN 'null' ELSE '"reply"' END || ',"result":' || coalesce(to_json(content), 'null')
         || ',"status":"' || status || '"}') AS json_sha256
FROM linked
UNION ALL
SELECT CAST(conv_id AS BIGINT), CAST(turn AS BIGINT), conv_id || ':' || turn, NULL, 'message', 0, count(*), NULL,
       sha256('{"after":null,"arguments":null,"id":' || to_json(conv_id || ':' || turn) || ',"level":null,"name":'
         || coalesce(to_json(role), 'null') || ',"result":' || coalesce(to_json(text), 'null') || ',"status":"message"}')
FROM conversations WHERE coalesce(role, '') NOT IN ('user', 'assistant') GROUP BY conv_id, turn, role, text
UNION ALL
SELECT CAST(conv_id AS BIGINT), CAST(turn AS BIGINT),
       conv_id || ':' || (turn - CASE WHEN role = 'user' THEN 0 ELSE 1 END), NULL, 'conflict',
       CASE WHEN role = 'user' THEN n ELSE 0 END, CASE WHEN role = 'user' THEN 0 ELSE n END, NULL,
       sha256(CASE WHEN role = 'user' THEN '{"after":' || to_json(conv_id || ':' || (turn - 2)) || ',"arguments":{"text":'
           || to_json(text) || ',"turn":"' || turn || '"},"id":' || to_json(conv_id || ':' || turn)
           || ',"level":null,"name":"reply","result":null,"status":"conflict"}'
         ELSE '{"after":null,"arguments":null,"id":' || to_json(conv_id || ':' || (turn - 1))
           || ',"level":null,"name":null,"result":' || to_json(text) || ',"status":"conflict"}' END)
FROM (SELECT conv_id, turn, role, text, count(*) AS n, min(text) OVER (PARTITION BY conv_id, turn, role) AS least
      FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, turn, role, text)
WHERE text <> least
"""
