"""Chat formatting with tool-call linking.

A message is a call if its text is a JSON object with "tool_calls" (id, name, arguments), a result if
it has "tool_call_id", else plain text.  Results are joined to calls by conversation and identifier;
an argument {"$ref": id} makes a call wait for that result.  Levels in dependency order come from
peeling messages that wait for nothing; what lies on a cycle or waits for one has no level.  Arguments
are validated against their tool's schema (a call of an unknown tool is not valid), and every message is
serialised as canonical JSON: keys sorted, no spaces, no escapes beyond those that JSON needs.

Cases: null texts are empty; nulls in conv_id or turn group like values; of repeated identifiers the
earliest turn is the call (null turns last, then the least references); repeated rows stay.  Malformed
JSON is plain text; so is JSON that holds NaN, a number beyond a double, or more than DEPTH levels, as
no reader could be relied on to take it.  Lone surrogates are written as escapes, in identifiers and names
too.  An empty table gives no rows; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table

#: Levels of nesting that a message may have.
DEPTH = 200
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
_OUT = "conv_id long, turn long, role string, kind string, call_id string, name string, valid boolean, refs array<string>, json string"
_LONE = re.compile("[\ud800-\udfff]")


def _plain(s: str | None) -> str | None:
    """A string that UTF-8 can hold."""
    return s if s is None else _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", s)


def canonical(value) -> str:
    return _plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _float(s: str) -> float:
    x = float(s)
    if math.isinf(x):
        raise ValueError("number beyond a double")
    return x


def _refuse(name: str):
    raise ValueError(name)


def parse(text: str):
    """The JSON value of a text; ValueError if it is malformed, holds NaN or infinity, or is nested too deep."""
    try:
        value = json.loads(text, parse_float=_float, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(DEPTH):
        level = [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return value
    raise ValueError("nested too deep")


def _equal(a, b) -> bool:
    """Equality of JSON values: true is not 1, and 1.0 is 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return a == b


def validate(value, schema: dict) -> bool:
    """type, enum, required, properties, additionalProperties and items of JSON schema."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    else:
        good = kind is None or isinstance(value, _TYPES.get(kind, object))
    if not good or ("enum" in schema and not any(_equal(value, x) for x in schema["enum"])):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or (schema.get("additionalProperties") is False and any(k not in known for k in value)):
            return False
        return all(validate(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list) and "items" in schema:
        return all(validate(v, schema["items"]) for v in value)
    return True


def _refs(value) -> list[str]:
    if isinstance(value, dict):
        if isinstance(value.get("$ref"), str):
            return [_plain(value["$ref"])]
        return [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _read(schemas: dict):
    def message(conv, turn, role, text):
        text = text or ""
        try:
            x = parse(text) if text.lstrip()[:1] == "{" else None
        except ValueError:
            x = None
        calls = x.get("tool_calls") if isinstance(x, dict) else None
        if isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
            for c in calls:
                args = c.get("arguments")
                if isinstance(args, str):
                    try:
                        args = parse(args)
                    except ValueError:
                        pass
                name = c.get("name") if isinstance(c.get("name"), str) else None
                body = {"role": role, "tool_calls": [{"arguments": args, "id": c["id"], "name": name}]}
                yield conv, turn, role, "call", _plain(c["id"]), _plain(name), name in schemas and validate(args, schemas[name]), _refs(args), canonical(body)
        elif isinstance(x, dict) and isinstance(x.get("tool_call_id"), str):
            yield conv, turn, role, "result", _plain(x["tool_call_id"]), None, None, [], canonical({"content": x.get("content"), "role": role, "tool_call_id": x["tool_call_id"]})
        else:
            yield conv, turn, role, "text", None, None, None, [], canonical({"content": text, "role": role})

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            rows = [m for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))) for m in message(*r)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=[c.split()[0] for c in _OUT.split(", ")])

    return run


def _levels(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, level) of the nodes that no cycle holds up; each step reads only the edges that are left."""
    edges = scratch.write(edges, "edges0")
    done = [nodes.join(edges.select(F.col("b").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("level"))]
    free, level = done[0], 0
    while not edges.isEmpty():
        level += 1
        left = scratch.write(edges.join(free.select(F.col("node").alias("a")), "a", "left_anti"), f"edges{level}")
        free = edges.select(F.col("b").alias("node")).distinct().join(left.select(F.col("b").alias("node")), "node", "left_anti")
        free = scratch.write(free.select("node", F.lit(level).alias("level")), f"free{level}")
        if free.isEmpty():
            break
        done.append(free)
        edges = left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def format_chats(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, turn, role, kind, call_id, name, valid, linked, level and json of every message; a call is one message."""
    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(_read(schemas or {}), _OUT)
    rows = scratch.write(rows, "rows")
    node = lambda kind, c: F.concat_ws(":", kind, F.coalesce(F.col("conv_id").cast("string"), F.lit("")), c)
    tools = rows.where("kind <> 'text'").groupBy("conv_id", "call_id", "kind").agg(F.min(F.struct(F.col("turn").isNull().alias("none"), "turn", "refs"))["refs"].alias("refs"))
    tools = scratch.write(tools.select(node(F.substring("kind", 1, 1), F.col("call_id")).alias("node"), node(F.when(F.col("kind") == "call", "r").otherwise("c"), F.col("call_id")).alias("other"), "conv_id", "kind", "refs"), "tools")
    # edges of the order: a call before its result, a result before the calls that refer to it
    edges = tools.where("kind = 'result'").select(F.col("other").alias("a"), F.col("node").alias("b"))
    edges = edges.unionByName(tools.where("kind = 'call'").select("conv_id", F.col("node").alias("b"), F.explode("refs").alias("ref")).select(node(F.lit("r"), F.col("ref")).alias("a"), "b"))
    edges = edges.join(tools.select(F.col("node").alias("a")), "a", "left_semi").distinct()
    levels = _levels(tools.select("node"), edges, scratch)
    known = tools.join(tools.select(F.col("node").alias("other"), F.lit(True).alias("linked")), "other", "left").join(levels, "node", "left").select(F.col("node").alias("_n"), "linked", "level")
    out = ["conv_id", "turn", "role", "kind", "call_id", "name", "valid", "linked", "level", "json"]
    # texts, which have no identifier, stay out of the join
    met = rows.where("kind <> 'text'").withColumn("_n", node(F.substring("kind", 1, 1), F.col("call_id"))).join(known, "_n", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    texts = rows.where("kind = 'text'").withColumns({"linked": F.lit(None).cast("boolean"), "level": F.lit(0)})
    return met.select(*out).unionByName(texts.select(*out))


_ARGUMENTS = {"query": {"type": "string"}, "size": {"type": "integer"}, "after": {"type": "object", "required": ["$ref"], "properties": {"$ref": {"type": "string"}}}}
#: Tools of the derived messages; "run" has no schema.
TOOLS = {
    "search": {"type": "object", "properties": _ARGUMENTS, "required": ["query", "size"], "additionalProperties": False},
    "write": {"type": "object", "properties": _ARGUMENTS, "required": ["query", "size", "after"], "additionalProperties": False},
}


def tool_turns(conversations: DataFrame) -> DataFrame:
    """The table's turns as an agent would have had them, all rows and whole texts: an assistant's text becomes a
    tool call that carries it, a user's answer the result of the call before it, other texts stay.

    With n code points in a text at turn t, the call "ct" goes to search, write or run (n modulo 3); its size is
    n, or wrongly a string if 7 divides n; if 5 divides n it waits for the result of the call after the next turn,
    else, unless n modulo 5 is 4, from turn 2 on for that of two turns before.
    """
    text = F.coalesce("text", F.lit(""))
    n, t = F.char_length(text), F.col("turn")
    call = lambda at: F.concat(F.lit("c"), at.cast("string"))
    ref = F.when(n % 5 == 0, call(t + 2)).when((n % 5 < 4) & (t >= 2), call(t - 2))
    after = F.when(ref.isNotNull(), F.concat(F.lit(',"after":{"$ref":"'), ref, F.lit('"}'))).otherwise("")
    size = F.when(n % 7 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "write").otherwise("run")
    quoted = F.regexp_replace(F.to_json(F.struct(text.alias("q"))), r"^\{|\}$", "")
    quoted = F.substring(quoted, F.lit(5), F.char_length(quoted))
    body = F.concat(F.lit('{"tool_calls":[{"id":"'), call(t), F.lit('","name":"'), name, F.lit('","arguments":{"query":'), quoted, F.lit(',"size":'), size, after, F.lit("}}]}"))
    result = F.concat(F.lit('{"tool_call_id":"'), call(t - 1), F.lit('","content":'), quoted, F.lit("}"))
    return conversations.select("conv_id", "turn", "role", F.when((F.col("role") == "assistant") & t.isNotNull(), body).when((F.col("role") == "user") & (t > 0), result).otherwise(text).alias("text"))


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    out = format_chats(tool_turns(table(spark, sf_dir, "conversations")), TOOLS)
    return out.select("conv_id", "turn", "kind", "call_id", "name", "linked", "valid", "level", "json")


ORACLE_OP10 = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS x, length(coalesce(text, '')) AS n,
         CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND turn > 0 THEN 'result' ELSE 'text' END AS kind FROM conversations),
k AS (
  SELECT *, CASE kind WHEN 'call' THEN 'c' || turn WHEN 'result' THEN 'c' || (turn - 1) END AS call_id,
         CASE WHEN kind = 'call' THEN CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'write' ELSE 'run' END END AS name,
         CASE WHEN kind <> 'call' THEN NULL WHEN n % 5 = 0 THEN 'c' || (turn + 2) WHEN n % 5 < 4 AND turn >= 2 THEN 'c' || (turn - 2) END AS ref FROM m),
nodes AS (SELECT DISTINCT conv_id, kind, call_id FROM k WHERE kind <> 'text'),
edges AS (
  SELECT r.conv_id, 'call' AS a_kind, r.call_id AS a, 'result' AS b_kind, r.call_id AS b FROM nodes r JOIN nodes c ON r.conv_id = c.conv_id AND r.call_id = c.call_id AND r.kind = 'result' AND c.kind = 'call'
  UNION ALL
  SELECT k.conv_id, 'result', k.ref, 'call', k.call_id FROM k JOIN nodes r ON r.conv_id = k.conv_id AND r.call_id = k.ref AND r.kind = 'result'),
walk AS (
  SELECT conv_id, kind, call_id, kind AS at_kind, call_id AS at_id, 0 AS d FROM nodes
  UNION ALL
  SELECT w.conv_id, w.kind, w.call_id, e.a_kind, e.a, w.d + 1 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.b_kind = w.at_kind AND e.b = w.at_id WHERE w.d < 64),
levels AS (SELECT conv_id, kind, call_id, CASE WHEN max(d) < 64 THEN max(d) END AS level FROM walk GROUP BY ALL)
SELECT k.conv_id, k.turn, k.kind, k.call_id, k.name,
  CASE WHEN k.kind <> 'text' THEN EXISTS (SELECT 1 FROM nodes o WHERE o.conv_id = k.conv_id AND o.call_id = k.call_id AND o.kind <> k.kind) END AS linked,
  CASE WHEN k.kind = 'call' THEN k.name <> 'run' AND n % 7 <> 0 AND (k.name = 'search' OR k.ref IS NOT NULL) END AS valid,
  CASE WHEN k.kind = 'text' THEN 0 ELSE l.level END AS level,
  CASE k.kind
    WHEN 'call' THEN '{"role":' || to_json(role)::VARCHAR || ',"tool_calls":[{"arguments":{' || CASE WHEN ref IS NULL THEN '' ELSE '"after":{"$ref":"' || ref || '"},' END || '"query":' || to_json(x)::VARCHAR || ',"size":'
      || CASE WHEN n % 7 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || '},"id":"' || k.call_id || '","name":"' || k.name || '"}]}'
    WHEN 'result' THEN '{"content":' || to_json(x)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || ',"tool_call_id":"' || k.call_id || '"}'
    ELSE '{"content":' || to_json(x)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' END AS json
FROM k LEFT JOIN levels l ON l.conv_id = k.conv_id AND l.kind = k.kind AND l.call_id = k.call_id
"""
