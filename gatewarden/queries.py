"""Registered queries of the guard engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.patterns import EMAIL, PHONE, PLACEHOLDER, SECRETS
from .functions.text import canonical_json, normalize_sse, scan_and_replace
from .operators import audit as A
from .operators import rules as R
from .operators.pipeline import executed_tools, guard_events
from .operators.streams import chunked, guard_bytes, reassemble
from .plans.policy import PROFILES, Guard, document_table, merge, rules_table
from .sources.files import detect_format, is_binary, manifests, scan_tables
from .testbed import agent_events, chat_events, nation_manifests, shared_folder, table, text_events, tool_events

TOOLS = ["click", "view", "purchase"]
HEX_TOKEN = r"[0-9a-f]{40}"
OUT = ("stream_id", "event_index", "out_seq", "type", "phase", "name", "args_text", "message", "code", "reason")

POLICIES = {
    "p1": {"version": "1", "rules": [{"allowTools": {"names": ["NATION_0", "NATION_1", "NATION_2", "ATLANTIS"]}}, {"denyTools": {"names": ["NATION_3"]}}, {"blockToolArgs": {"pattern": r"rm\s+-rf"}}]},
    "p2": {"version": "1", "rules": [{"denyTools": {"names": ["NATION_0", "NATION_7"]}}, {"blockToolArgs": {"contains": "curl"}}]},
}
BASE = {"version": "1", "mode": "block", "rules": [{"redactSecrets": {}}, {"allowTools": {"names": ["a", "b"]}}, {"maxToolArgsBytes": {"max": 10}}]}
OVER = {"version": "1", "mode": "warn", "rules": [{"allowTools": {"names": ["a"]}}, {"sanitizeErrors": {}}]}


def _tools(rules, mode):
    return lambda s, d: guard_events(tool_events(s, d), rules, mode).events.select(*OUT)


def _texts(rules, text=None):
    return lambda s, d: guard_events(text_events(s, d, text() if text else None), rules).events.select("stream_id", "text")


def _synthetic():
    """Whole texts behind every kind of built-in secret, from the id."""
    i = F.lpad(F.col("doc_id").cast("string"), 10, "0")
    return F.concat(F.lit("key sk-test-"), i, F.lit(" Bearer tok"), i, F.lit(" ghp_"), i, i, F.lit(" github_pat_"), i, i, F.lit(" AKIA"), i, F.lit("ABCDEF eyJa"), i, F.lit(".eyJb."), i, F.lit(" end\n"), F.col("text"))


def _pipeline(mode):
    return [R.allow_tools(TOOLS), R.max_tool_args_bytes(40), R.sanitize_errors()], mode


def _violations(mode):
    rules, m = _pipeline(mode)
    return lambda s, d: guard_events(tool_events(s, d), rules, m, "v1").violations.select("stream_id", "event_index", "seq", "rule", "message", "mode", "policy_version")


def summary_by_stream(s, d) -> DataFrame:
    rules, m = _pipeline("block")
    out = guard_events(tool_events(s, d), [R.deny_tools(["click"]), *rules], m).summary
    return out.select("stream_id", "violations", F.array_join("tools_touched", ",").alias("tools_touched"), "redactions", F.coalesce(F.col("counts_by_rule")["allow_tools"], F.lit(0)).alias("allow_tools"), F.coalesce(F.col("counts_by_rule")["sanitize_errors"], F.lit(0)).alias("sanitize_errors"))


def counts_by_rule(s, d) -> DataFrame:
    rules, m = _pipeline("warn")
    return guard_events(tool_events(s, d), rules, m).violations.groupBy("rule").agg(F.count("*").alias("n"))


def redact_counts(s, d) -> DataFrame:
    df = scan_and_replace(table(s, d, "documents").select("doc_id", "text"), "text", [EMAIL], counts="n_email")
    df = scan_and_replace(df, "text", [PHONE], counts="n_phone")
    return df.select("doc_id", F.col("n_email").cast("int").alias("n_email"), F.col("n_phone").cast("int").alias("n_phone"))


def redact_idempotent(s, d) -> DataFrame:
    df = scan_and_replace(table(s, d, "documents").select(_synthetic().alias("a")), "a", SECRETS).select("a")
    df = scan_and_replace(df.select("a", F.col("a").alias("b")), "b", SECRETS)
    return df.agg(F.count_if(F.col("a") != F.col("b")).alias("differing"))


def agent_loop(s, d) -> DataFrame:
    return executed_tools(guard_events(tool_events(s, d), [R.allow_tools(TOOLS)], "block").events).select("stream_id", "event_index", "name")


def _bytes(secrets, errors):
    def run(s, d):
        docs = table(s, d, "documents").select("doc_id", F.concat(F.lit('{"message": "failed at /srv", "n": 1}\n'), _synthetic()).alias("text"))
        body = reassemble(chunked(docs, "text", "doc_id", 37))
        return guard_bytes(body, secrets, errors).select("stream_id", F.decode("body", "UTF-8").alias("body"))

    return run


def sse_normalize(s, d) -> DataFrame:
    raw = F.concat(F.lit(": ping\r\nevent: x\r\n\r\ndata: "), F.regexp_replace("text", "\n", "\r\n: note\ndata:  "), F.lit("\n\ndata:end"))
    return table(s, d, "documents").select("doc_id", normalize_sse(raw).alias("body"))


def _files(s, d) -> DataFrame:
    """Whole documents as files of all formats; some hold a zero byte."""
    i = F.col("doc_id")
    docs = table(s, d, "documents").where("doc_id is not null")
    event = lambda phase, head: F.to_json(F.struct(F.lit("text").alias("type"), F.lit(phase).alias("phase"), F.concat(F.lit(head), i.cast("string"), F.lit(" "), F.col("text")).alias("text")))
    text = F.when(i % 4 == 0, F.concat(F.lit("["), event("done", "mail a@b.co sk-test-12345678 "), F.lit("]"))).when(i % 4 == 1, F.concat(F.lit('{"type":"error","message":"at /srv"}\n\n'), event("delta", "n "), F.lit("\n")))
    text = text.when(i % 4 == 2, F.concat(F.lit("data: sk-test-12345678\n"), _synthetic())).otherwise(F.when(i % 8 == 3, F.concat(F.lit("a\x00b"), "text")).otherwise(F.col("text")))
    name = F.concat(F.lit("f/"), i.cast("string"), F.when(i % 4 == 0, ".json").when(i % 4 == 1, ".jsonl").when(i % 4 == 2, ".sse").otherwise(".txt"))
    f = docs.select(name.alias("file"), text.alias("text"))
    return f.select("*", is_binary(F.encode("text", "UTF-8")).alias("zero_byte"), detect_format(F.col("file"), F.col("text")).alias("format"))


_SCAN = {"version": "1", "policyVersion": "7", "mode": "warn", "byte": {"redactSecrets": True}, "rules": [{"redactSecrets": {}}, {"redactPII": {"email": True}}, {"sanitizeErrors": {}}]}


def _scan(s, d):
    return scan_tables(_files(s, d).where("not zero_byte"), Guard.from_policy(_SCAN))


def _drift(code, strict=False):
    def run(s, d):
        f = A.drift(nation_manifests(s, d), POLICIES)
        return (A.strict(f) if strict else f.where(F.col("code") == code)).select("file", "policy", "tool", "code", "severity", "message")

    return run


def _static(s, d):
    return A.static_scan(nation_manifests(s, d), POLICIES)


def dangerous_patterns(s, d) -> DataFrame:
    strings = nation_manifests(s, d).select("file", F.inline("strings"))
    return A.dangerous(strings).select("file", "field", "line", "code", "message")


def block_args_static(s, d) -> DataFrame:
    strings = nation_manifests(s, d).select("file", F.inline("strings"))
    return A.block_args_static(strings, A.matchers(POLICIES)).select("file", "field", "line", "policy", "severity")


def policy_diff(s, d) -> DataFrame:
    t = document_table(s, {"a": BASE, "b": OVER})
    return A.policy_diff(t.where("policy = 'a'"), t.where("policy = 'b'")).select("kind", "path", "before", "after")


def policy_merge(s, d) -> DataFrame:
    return rules_table(s, {"m": merge(BASE, OVER)}).select("ordinal", "key", "params")


def manifest_strings(s, d) -> DataFrame:
    """Strings and lines of a manifest text for each region: a line a nation, some without a name."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    entry = F.concat(F.lit("  {"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit('"name": "'), "n_name", F.lit('", '))).otherwise(""), F.lit('"description": "about '), "n_name", F.lit('", "examples": ["one", {"k": "rm -rf '), "n_name", F.lit('"}]}'))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", entry.alias("e")))).alias("x"))
    text = F.concat(F.lit('{\n "version": "1",\n "tools": [\n'), F.array_join(F.transform("x", lambda x: x["e"]), ",\n"), F.lit("\n ]\n}"))
    return manifests(rows.select(F.concat("r_name", F.lit(".json")).alias("file"), text.alias("text"))).select("file", F.size("tools").alias("n_tools"), F.inline("strings"))


def _live(stream: DataFrame, guard, schema: str) -> DataFrame:
    """What a live guard makes of a table whose rows come as files, in no order."""
    from .streaming.guard import run_available

    s, tmp = stream.sparkSession, shared_folder(stream.sparkSession)
    stream.repartition(4).write.parquet(f"{tmp}/in")
    live = s.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp}/in")
    run_available(guard(live), f"{tmp}/out", f"{tmp}/state")
    return s.read.parquet(f"{tmp}/out")


def _stream_bytes(head: str, secrets: bool = True, errors: bool = False):
    """Chunks of documents as files of a stream; the last chunk of each is marked."""

    def run(s, d):
        from .streaming.guard import guard_byte_stream

        size = 997
        c = chunked(table(s, d, "documents").select("doc_id", F.concat(F.lit(head), _synthetic()).alias("text")), "text", "doc_id", size)
        # a text of whole chunks ends with an empty one
        last = F.octet_length("chunk") < size
        full = c.groupBy("stream_id").agg(F.max("chunk_index").alias("i"), F.min(F.octet_length("chunk")).alias("n")).where(f"n = {size}")
        c = c.unionByName(full.select("stream_id", (F.col("i") + 1).alias("chunk_index"), F.lit(b"").alias("chunk")))
        out = _live(c.select("*", last.alias("is_last")), lambda live: guard_byte_stream(live, secrets, errors), "stream_id long, chunk_index long, chunk binary, is_last boolean")
        return reassemble(out).select("stream_id", F.decode("body", "UTF-8").alias("body"))

    return run


def stream_tool_bytes(s, d) -> DataFrame:
    from .streaming.guard import guard_tool_stream

    e = tool_events(s, d).select("stream_id", "event_index", "type", "phase", "id", "name", "args_text")
    tmp = shared_folder(s)
    e.write.parquet(f"{tmp}/in")
    live = s.readStream.schema("stream_id long, event_index long, type string, phase string, id string, name string, args_text string").parquet(f"{tmp}/in")
    from .streaming.guard import run_available

    run_available(guard_tool_stream(live, 40), f"{tmp}/out", f"{tmp}/state")
    return s.read.parquet(f"{tmp}/out")


def canonical_json_values(s, d) -> DataFrame:
    """Numbers, keys and signs that a runtime writes in its own way, around the k of each event."""
    k = F.get_json_object("props", "$.k")
    odd = F.concat(F.lit('{ "b": '), k, F.lit('.50, "10": 1e-7, "2": 0.00001, "a": "\\ud800", "b": '), k, F.lit('e21, "n": [12345678901234567890, -0, 1.0, 1e400], "s": "\\u00e9\\u0001"}'))
    return table(s, d, "events").select("event_id", canonical_json(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"x": NaN, "k": '), k, F.lit("}"))).otherwise(odd)).alias("json"))


def _profile(name):
    return lambda s, d: Guard.from_policy(name).guard(agent_events(s, d)).events.select(*OUT)


def _double(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_i")).withColumn("out_seq", F.col("out_seq") * 2 + F.col("_i")).drop("_i")


def _custom_log(first, custom, mode):
    return lambda s, d: guard_events(tool_events(s, d), [first, R.custom(custom), R.sanitize_errors()], mode).violations.select("stream_id", "event_index", "seq", "rule", "message")


def guard_policy(mode):
    def run(s, d):
        policy = {"version": "1", "policyVersion": "3", "rules": [{"denyTools": {"names": ["view"]}}, {"maxToolArgsBytes": {"max": 40}}, {"sanitizeErrors": {}}]}
        return Guard.from_policy(policy, mode).guard(tool_events(s, d)).events.select(*OUT)

    return run


QUERIES = {
    "events_passthrough": _tools([], "warn"),
    "custom_transform": _tools([R.custom(lambda df: df.where("event_index % 2 = 0"))], "warn"),
    "custom_drop_log": _custom_log(R.allow_tools(TOOLS), lambda df: df.where("event_index % 2 = 0"), "block"),
    "custom_expand_log": _custom_log(R.deny_tools(["click"]), _double, "audit"),
    "redact_pii_email": _texts([R.redact_pii(email=True)]),
    "redact_pii_phone": _texts([R.redact_pii(phone=True)]),
    "redact_pii_both": _texts([R.redact_pii(True, True)]),
    "redact_counts": redact_counts,
    "redact_secrets_builtin": _texts([R.redact_secrets()], _synthetic),
    "redact_secrets_custom_pattern": _texts([R.redact_secrets((HEX_TOKEN,))]),
    "redact_placeholder": _texts([R.redact_secrets((HEX_TOKEN,), "<$1\\>")]),
    "redact_idempotent": redact_idempotent,
    "redact_chat": lambda s, d: guard_events(chat_events(s, d), [R.redact_pii(True, True)]).events.select("stream_id", "event_index", "type", "text"),
    **{f"allow_tools_{m}": _tools([R.allow_tools(TOOLS)], m) for m in ("block", "warn", "audit")},
    "allow_tools_empty": _tools([R.allow_tools([])], "block"),
    **{f"deny_tools_{m}": _tools([R.deny_tools(["click", "view"])], m) for m in ("block", "audit")},
    "block_args_regex": _tools([R.block_tool_args(R.Pattern(r'"k":[1-4]\d\b'))], "block"),
    "block_args_contains": _tools([R.block_tool_args(R.Contains('"k":5'))], "block"),
    "block_args_callable": _tools([R.block_tool_args(lambda c: F.get_json_object(c, "$.k").cast("int") > 50)], "block"),
    **{f"max_args_bytes_{m}": _tools([R.max_tool_args_bytes(40)], m) for m in ("block", "audit")},
    "sanitize_errors": _tools([R.sanitize_errors()], "warn"),
    "sanitize_errors_keep_code": _tools([R.sanitize_errors(strip_code=False)], "warn"),
    "sanitize_errors_custom_message": _tools([R.sanitize_errors("Failed")], "warn"),
    **{f"pipeline_{m}": _tools(*_pipeline(m)) for m in ("block", "warn", "audit")},
    "policy_guard_block": guard_policy("block"),
    **{f"violations_{m}": _violations(m) for m in ("block", "audit")},
    "summary_by_stream": summary_by_stream,
    "counts_by_rule": counts_by_rule,
    "agent_loop_executed": agent_loop,
    "byte_redact_rechunk": _bytes(True, False),
    "byte_sanitize": _bytes(False, True),
    "byte_combined": _bytes(True, True),
    "stream_byte_redact": _stream_bytes("x "),
    "stream_byte_combined": _stream_bytes('{"message": "failed at /srv", "n": 1}\n', True, True),
    "stream_tool_bytes": stream_tool_bytes,
    "sse_normalize": sse_normalize,
    "canonical_json": lambda s, d: table(s, d, "events").select("event_id", canonical_json(F.col("props")).alias("json")),
    "canonical_json_values": canonical_json_values,
    **{f"pipeline_{n.replace('-', '_')}": _profile(n) for n in PROFILES},
    "scan_binary_skip": lambda s, d: _files(s, d).select("file", "zero_byte"),
    "scan_format_detect": lambda s, d: _files(s, d).groupBy("format", "zero_byte").agg(F.count("*").alias("n")),
    "scan_report_detail": lambda s, d: _scan(s, d)[0].select("file", "rule", "message", "mode", "policy_version"),
    "scan_report_summary": lambda s, d: _scan(s, d)[1],
    "drift_allow": _drift("DRIFT_ALLOW"),
    "drift_deny": _drift("DRIFT_DENY"),
    "drift_policy_only": _drift("DRIFT_POLICY_ONLY"),
    "drift_strict": _drift(None, True),
    "dangerous_patterns": dangerous_patterns,
    "block_args_static": block_args_static,
    "static_summary": lambda s, d: A.static_summary(nation_manifests(s, d), _static(s, d)),
    "sarif_rules": lambda s, d: A.sarif_rules(s, _static(s, d)),
    "sarif_results": lambda s, d: A.sarif_results(_static(s, d)).select("result"),
    "annotations": lambda s, d: A.annotations(_static(s, d)).select("annotation"),
    "report_lines": lambda s, d: A.report_lines(_static(s, d)).select("row"),
    "policy_diff": policy_diff,
    "policy_merge_effective": policy_merge,
    "manifest_strings_lines": manifest_strings,
}
