"""Operator 9, chat formatting: tool-call linking on DataFrame functions alone.

A message's text may be a JSON object: an assistant's with "tool_calls", a list of {"id", "name", "arguments"} with name
and arguments alone or under "function" and arguments as an object or as its JSON text; a tool's with "tool_call_id" and
"content". Calls and results are hash-joined by conversation and identifier; messages are ordered so that a result
follows its call; the arguments of each call are checked against the tools' schemas, which the caller or the system
messages of the conversation give (names, presence and JSON types, one level deep); each message becomes one line of
canonical JSON, so that no conversation is ever gathered whole: fixed keys first, in a fixed order, all others and those
of inner objects by name, no spaces, values of their own JSON types. Nothing that a message holds is left out.

Defined results: plain or malformed text is content as it is; null text, role or turn are null in the JSON; an
identifier that several calls share links to the first (smallest turn); a result without its call is an orphan and stays
at its own turn; a result before its call is moved behind it; repeated rows are repeated lines with the same faults; an
empty table gives an empty result; of keys of the same name the last counts; "turn" and "role" inside the JSON give way
to the columns; a call of a tool that nothing defines, or whose arguments are no object, is one fault; a call without
arguments has none of them; numbers are spelled as Spark's variants spell them; long texts are formatted whole; other
input columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm.common import cut

ARGUMENTS = "array<struct<key:string,kind:string,text:string,whole:boolean>>"
TYPES = {"string": "^(?s).*$", "integer": r"^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$"}
OBJECT = "map<string,variant>"


def at(v: Column, path: str, kind: str) -> Column:
    """The value at a path, null where it is absent or of another kind."""
    return F.try_variant_get(v, path, kind)


def parsed(text: Column) -> Column:
    """A JSON object as a variant, null for any other text; as the item of a list, nothing may follow it."""
    trimmed = F.btrim(text, F.lit("\t\r\n "))
    return F.when(trimmed.startswith("{") & trimmed.endswith("}") & (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1), F.try_parse_json(text))


def with_more(line: Column, *more: Column) -> Column:
    """A JSON object with further members; each of more is a JSON object, or null for none."""
    inner = [F.when(F.length(m) > 2, F.concat(F.lit(","), F.substr(m, F.lit(2), F.length(m) - 2))) for m in more]
    return F.concat(F.substr(line, F.lit(1), F.length(line) - 1), *[F.coalesce(m, F.lit("")) for m in inner], F.lit("}"))


def others(v: Column, *names: str) -> Column:
    """The members of an object that have none of these names, as JSON."""
    return F.to_json(F.map_filter(at(v, "$", OBJECT), lambda k, x: ~k.isin(*names)))


def json_line(**parts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"})


def last_of_each(arguments: Column) -> Column:
    """The entries of a map as JSON gives it, without those that a later entry of the same name replaces."""
    entries = F.map_entries(arguments)
    later = lambda i: F.slice(entries, i + F.lit(2), F.greatest(F.size(entries), F.lit(1)))
    return F.filter(entries, lambda e, i: ~F.exists(later(i), lambda x: x["key"] == e["key"]))


def json_type(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "STRING", "string").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def call_arguments(call: Column) -> Column:
    """The arguments of a call as a variant: an object given as JSON text is read."""
    raw = F.coalesce(at(call, "$.arguments", "variant"), at(call, "$.function.arguments", "variant"))
    return F.coalesce(F.when(json_type(raw) == "string", parsed(at(raw, "$", "string"))), raw)


def call_name(call: Column) -> Column:
    return F.coalesce(at(call, "$.name", "string"), at(call, "$.function.name", "string"))


def call_line(call: Column) -> Column:
    fixed = json_line(id=at(call, "$.id", "variant"), name=call_name(call), arguments=call_arguments(call))
    inner = others(at(call, "$.function", "variant"), "name", "arguments")
    inner = F.when(F.length(inner) > 2, F.concat(F.lit('{"function":'), inner, F.lit("}")))
    return F.when(json_type(call) == "object", with_more(fixed, others(call, "id", "name", "arguments", "function"), inner)).otherwise(F.to_json(call))


def checked_call(call: Column) -> Column:
    """name; arguments, each with its key, JSON type, text if it is a string, and whether it is a whole number; odd, where
    the arguments are there and no object."""
    given = call_arguments(call)
    one = lambda e: F.struct(
        e["key"].alias("key"), json_type(e["value"]).alias("kind"), F.when(json_type(e["value"]) == "string", at(e["value"], "$", "string")).alias("text"),
        F.coalesce(at(e["value"], "$", "double") == F.floor(at(e["value"], "$", "double")), F.lit(False)).alias("whole"),
    )
    entries = F.coalesce(F.transform(F.map_entries(at(given, "$", OBJECT)), one), F.array().cast(ARGUMENTS))
    return F.struct(call_name(call).alias("name"), entries.alias("arguments"), F.coalesce(~json_type(given).isin("object", "null") & given.isNotNull(), F.lit(False)).alias("odd"))


def tool_definitions(messages: DataFrame) -> DataFrame:
    """conv_id, name, param, type, required: the tools that the system messages of a conversation define.

    Such a text is a JSON object with "tools", a list of {"name", "parameters"}, alone or under "function"; parameters is
    a JSON schema with "properties" and "required". Of definitions of the same name the first counts (smallest turn, then
    text); a tool without parameters is one row whose param is null; type is null where the schema names none."""
    parsed = messages.filter((F.col("role") == "system") & F.ltrim("text").startswith("{"))
    tool = parsed.select("conv_id", "turn", F.explode(F.from_json("text", "struct<tools:array<string>>")["tools"]).alias("tool"))
    tool = tool.select("conv_id", "turn", F.coalesce(F.get_json_object("tool", "$.function"), F.col("tool")).alias("tool"))
    named = tool.withColumn("name", F.get_json_object("tool", "$.name")).filter("name IS NOT NULL")
    first = named.groupBy("conv_id", "name").agg(F.min(F.struct("turn", "tool"))["tool"].alias("tool"))
    own = first.select("conv_id", "name", F.from_json("tool", "struct<parameters:struct<properties:map<string,string>,required:array<string>>>")["parameters"].alias("p"))
    given = own.select("conv_id", "name", "p.required", F.explode_outer(last_of_each(F.col("p.properties"))).alias("e"))
    listed = given.select("conv_id", "name", F.col("e.key").alias("param"), F.get_json_object("e.value", "$.type").alias("type"), F.coalesce(F.array_contains("required", F.col("e.key")), F.lit(False)).alias("required"))
    # A name that is required but has no property is needed too, of any type.
    bare = own.select("conv_id", "name", "p.properties", F.explode(F.array_distinct("p.required")).alias("param")).filter(~F.coalesce(F.array_contains(F.map_keys("properties"), F.col("param")), F.lit(False)))
    return listed.unionByName(bare.select("conv_id", "name", "param", F.lit(None).cast("string").alias("type"), F.lit(True).alias("required")))


def fits(kind: Column, own: Column, text: Column, whole: Column, spelled: bool) -> Column:
    """Whether a value of a JSON type is of the type of a schema (one of several in a JSON list; any, if null or none of
    JSON's). spelled: a string that spells a number or boolean is one too."""
    one = lambda t: ~t.isin(*TYPES, "object", "array", "null") | (t == own) | ((t == "integer") & (own == "number") & whole)
    by_text = F.lit(False)
    for name, pattern in TYPES.items() if spelled else ():
        by_text = by_text | ((own == "string") & F.coalesce(text.rlike(pattern), F.lit(False)) & (kind == name))
    listed = F.from_json(F.when(kind.startswith("["), kind), "array<string>")
    return F.coalesce(F.when(listed.isNotNull(), F.exists(listed, one)).otherwise(one(kind) | by_text), F.lit(True))


def schema_faults(callers: DataFrame, schemas: DataFrame, keys: list[str], spelled: bool) -> DataFrame:
    """message, n_faults: arguments that are missing, unknown or of another type than the schema says.
    callers: message, conv_id, calls; schemas: the keys (name, or conv_id and name), param, type, required. A tool without
    a row has no schema, and its calls are one fault each, as are calls whose arguments are no object. spelled: as of fits()."""
    calls = callers.select("message", "conv_id", F.explode("calls").alias("c")).select("message", "conv_id", "c.name", "c.arguments", "c.odd")
    known = schemas.select(*keys, "param", "type", "required", F.lit(True).alias("known"))
    names = known.select(*keys).distinct()
    whole = calls.filter(~F.col("odd"))
    given = whole.join(names, keys, "left_semi").select("message", *keys, F.explode("arguments").alias("e")).select("message", *keys, F.col("e.key").alias("param"), "e.kind", "e.text", "e.whole")
    wrong = given.join(known, [*keys, "param"], "left").filter(F.col("known").isNull() | ~fits(F.col("type"), F.col("kind"), F.col("text"), F.col("whole"), spelled)).select("message")
    needed = whole.join(known.filter("required AND param IS NOT NULL"), keys).filter(~F.exists("arguments", lambda e: e["key"] == F.col("param"))).select("message")
    unknown = whole.join(names, keys, "left_anti").select("message")
    odd = calls.filter("odd").select("message")
    return wrong.unionByName(needed).unionByName(unknown).unionByName(odd).groupBy("message").agg(F.count(F.lit(1)).alias("n_faults"))


def format_chats(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Per message: conv_id, turn, order_turn, order_step, n_calls, n_faults, link, line.

    order_turn and order_step order a conversation topologically (then turn): a linked result takes the turn of its
    call if that is not earlier than its own. link: call, result, orphan or none. schemas: name, param, type, required
    of all conversations, by which a string that spells a number or boolean is one; without them, the tools that the
    system messages of the conversation define hold, and JSON types count."""
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last counts
    read = messages.select("conv_id", "turn", "role", "text", parsed(F.col("text")).alias("j"))
    calls_of = F.when(F.col("role") == "assistant", at(F.col("j"), "$.tool_calls", "array<variant>"))
    result_of = F.when(F.col("role") == "tool", at(F.col("j"), "$.tool_call_id", "string"))
    own = read.select("conv_id", "turn", "role", "text", "j", calls_of.alias("calls"), result_of.alias("call_id"))
    called = F.coalesce(F.size("calls") > 0, F.lit(False))
    turn, role, j = F.col("turn"), F.col("role"), F.col("j")
    # Messages with calls meet their faults, results the calls they answer; all others are not shuffled. What is taken from
    # the calls is written once, as several joins read it.
    message = F.sha2(F.to_json(F.struct("conv_id", "turn", "text")), 256)  # equal messages have equal faults
    lines = F.concat(F.lit('{"tool_calls":['), F.array_join(F.transform("calls", call_line), ","), F.lit("]}"))
    callers = own.filter(called).select(
        "conv_id", "turn", message.alias("message"), F.transform("calls", lambda c: at(c, "$.id", "string")).alias("ids"), F.transform("calls", checked_call).alias("calls"),
        with_more(json_line(turn=turn, role=role, content=at(j, "$.content", "variant")), lines, others(j, "turn", "role", "content", "tool_calls")).alias("line"),
    )
    callers = cut(callers, "callers")
    first = callers.select("conv_id", "turn", F.explode("ids").alias("call_id")).filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    keys, known = (["conv_id", "name"], cut(tool_definitions(messages), "tools")) if schemas is None else (["name"], schemas)
    once = callers.select("message", "conv_id", "calls").dropDuplicates(["message"])
    no_turn, none = F.lit(None).cast(messages.schema["turn"].dataType), F.lit(0).cast("long")
    out = ["conv_id", "turn", "call_id", "call_turn", "n_calls", "n_faults", "line"]
    with_calls = callers.join(schema_faults(once, known, keys, schemas is not None), "message", "left").select(
        "conv_id", "turn", F.lit(None).cast("string").alias("call_id"), no_turn.alias("call_turn"), F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_faults", none).alias("n_faults"), "line",
    )
    results = own.filter(F.col("call_id").isNotNull() & ~called).join(first, ["conv_id", "call_id"], "left")
    result = with_more(json_line(turn=turn, role=role, tool_call_id=at(j, "$.tool_call_id", "variant"), content=at(j, "$.content", "variant")), others(j, "turn", "role", "tool_call_id", "content"))
    plain = own.filter(F.col("call_id").isNull() & ~called).withColumn("call_turn", no_turn)
    zero = [none.alias("n_calls"), none.alias("n_faults")]
    every = results.select("conv_id", "turn", "call_id", "call_turn", *zero, result.alias("line")).select(out)
    every = every.unionByName(plain.select("conv_id", "turn", "call_id", "call_turn", *zero, json_line(turn=turn, role=role, content=F.col("text")).alias("line"))).unionByName(with_calls)
    late = F.col("call_turn").isNotNull() & (F.col("call_turn") >= turn)
    link = F.when(F.col("call_turn").isNotNull(), "result").when(F.col("call_id").isNotNull(), "orphan").when(F.col("n_calls") > 0, "call").otherwise("none")
    return every.select(
        "conv_id", "turn", F.when(late, F.col("call_turn")).otherwise(turn).alias("order_turn"), F.when(late, 1).otherwise(0).alias("order_step"),
        "n_calls", "n_faults", link.alias("link"), "line",
    )


def numbered(lines: DataFrame) -> DataFrame:
    """lines with position, from 1 in each conversation; for tables whose conversations fit a task."""
    return lines.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("order_turn", "order_step", "turn", "line")))


#: The one tool of the derived traffic.
TOOLS = (
    '{"tools":[{"type":"function","function":{"name":"measure","parameters":{"type":"object",'
    '"properties":{"chars":{"type":"integer"},"span":{"type":"object"},"note":{"type":"string"}},"required":["chars","span"]}}}]}'
)


def with_tool_traffic(messages: DataFrame) -> DataFrame:
    """The rows of a table of plain conversations, and calls, results and definitions derived from them by rule.

    A message of turn 0 also defines the tool ``measure``, unless conv_id mod 7 is 3. An assistant's message of n
    characters at turn t also calls it as "c<t>": by n mod 5 with chars as text (0), without span (1), with an unknown
    argument (2), or rightly, with the arguments as JSON text (3) or as an object (4; 0 to 2 are JSON text too). A
    user's message at turn t is also the result of "c<t+1>", so that it stands before its call, and is an orphan where
    no assistant answers. Rows with a null conv_id, turn or text derive nothing."""
    n, t = F.char_length("text").cast("string"), F.col("turn")
    escaped = lambda s: F.regexp_replace(F.to_json(F.struct(s.alias("s"))), r'^\{"s":|\}$', "")
    span = F.concat(F.lit('"span":{"to":'), n, F.lit(',"from":0}'))
    case = F.char_length("text") % 5
    arguments = (
        F.when(case == 0, F.concat(F.lit('{"chars":"'), n, F.lit('",'), span, F.lit("}")))
        .when(case == 1, F.concat(F.lit('{"chars":'), n, F.lit("}")))
        .when(case == 2, F.concat(F.lit('{"lang":null,"chars":'), n, F.lit(","), span, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), span, F.lit(',"chars":'), n, F.lit("}")))
    )
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), t.cast("string"), F.lit('","type":"function","function":{"name":"measure","arguments":'), F.when(case == 4, arguments).otherwise(escaped(arguments)), F.lit("}}]}"))
    result = F.concat(F.lit('{"content":{"ok":true,"n":'), n, F.lit('},"tool_call_id":"c'), (t + 1).cast("string"), F.lit('"}'))
    whole = F.col("conv_id").isNotNull() & t.isNotNull() & F.col("text").isNotNull()
    row = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    rows = F.array(
        row(F.col("role"), F.col("text")),
        F.when(whole & (t == 0) & (F.pmod("conv_id", F.lit(7)) != 3), row(F.lit("system"), F.lit(TOOLS))),
        F.when(whole & (F.col("role") == "assistant"), row(F.lit("assistant"), call)),
        F.when(whole & (F.col("role") == "user"), row(F.lit("tool"), result)),
    )
    return messages.select("conv_id", "turn", F.posexplode(rows).alias("place", "e")).filter("place = 0 OR e IS NOT NULL").select("conv_id", "turn", "e.role", "e.text")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with the tool traffic derived from them, as the tables hold none of their own."""
    return format_chats(with_tool_traffic(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP9_SQL = f"""
WITH own AS (SELECT conv_id, turn, role, text, length(text) AS n, conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL AS whole FROM conversations),
defined AS (SELECT DISTINCT conv_id FROM own WHERE whole AND turn = 0 AND conv_id % 7 <> 3),
answered AS (SELECT DISTINCT conv_id, turn FROM own WHERE whole AND role = 'assistant'),
plain AS (SELECT conv_id, turn, role, text FROM own UNION ALL SELECT conv_id, turn, 'system', '{TOOLS}' FROM own WHERE whole AND turn = 0 AND conv_id % 7 <> 3)
SELECT conv_id, turn, turn AS order_turn, 0::INTEGER AS order_step, 0::BIGINT AS n_calls, 0::BIGINT AS n_faults, 'none' AS link,
  '{{"turn":' || coalesce(turn::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"content":' || coalesce(to_json(text)::VARCHAR, 'null') || '}}' AS line
FROM plain
UNION ALL
SELECT conv_id, turn, turn, 0, 1, CASE WHEN d.conv_id IS NULL OR n % 5 < 3 THEN 1 ELSE 0 END, 'call',
  '{{"turn":' || turn || ',"role":"assistant","content":null,"tool_calls":[{{"id":"c' || turn || '","name":"measure","arguments":{{'
  || CASE n % 5 WHEN 0 THEN '"chars":"' || n || '",' WHEN 1 THEN '"chars":' || n ELSE '"chars":' || n || ',' END
  || CASE n % 5 WHEN 2 THEN '"lang":null,' ELSE '' END || CASE n % 5 WHEN 1 THEN '' ELSE '"span":{{"from":0,"to":' || n || '}}' END
  || '}},"type":"function"}}]}}'
FROM own LEFT JOIN defined d USING (conv_id) WHERE whole AND role = 'assistant'
UNION ALL
SELECT own.conv_id, own.turn, coalesce(a.turn, own.turn), CASE WHEN a.turn IS NULL THEN 0 ELSE 1 END, 0, 0, CASE WHEN a.turn IS NULL THEN 'orphan' ELSE 'result' END,
  '{{"turn":' || own.turn || ',"role":"tool","tool_call_id":"c' || (own.turn + 1) || '","content":{{"n":' || n || ',"ok":true}}}}'
FROM own LEFT JOIN answered a ON a.conv_id = own.conv_id AND a.turn = own.turn + 1 WHERE whole AND role = 'user'
"""
