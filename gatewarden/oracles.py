"""SQL twins of the registered queries."""

from __future__ import annotations

_C = "[A-Za-z0-9_-]"
#: The first secret pattern without lookahead: a digit at each place of the first seven, or later.
_SK = "sk-(?:proj-)?(?:" + "|".join([f"{_C}{{7,}}[0-9]{_C}*", *(f"{_C}{{{i}}}[0-9]{_C}{{{7 - i},}}" for i in range(6, -1, -1))]) + ")"
_S = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_N = _S.replace("[", "[^", 1)
SECRETS = (_SK, f"Bearer{_S}+{_N}+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "ghp_[A-Za-z0-9]{20,}", "github_pat_[A-Za-z0-9_]{20,}", "AKIA[0-9A-Z]{16}")
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = rf"\b(?:\+?1(?:[-.]|{_S})?)?(?:\([0-9]{{3}}\)|[0-9]{{3}})(?:[-.]|{_S})?[0-9]{{3}}(?:[-.]|{_S})?[0-9]{{4}}\b"
HEX = "[0-9a-f]{40}"


def _replace(x: str, patterns, by: str = "[REDACTED]") -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '{by}', 'g')"
    return x


_I = "lpad(doc_id::VARCHAR, 10, '0')"
_SYN = f"('key sk-test-' || {_I} || ' Bearer tok' || {_I} || ' ghp_' || {_I} || {_I} || ' github_pat_' || {_I} || {_I} || ' AKIA' || {_I} || 'ABCDEF eyJa' || {_I} || '.eyJb.' || {_I} || ' end' || chr(10) || text)"
_EV = """ev AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_index, 0 AS out_seq,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'tool_call' END AS type, CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'delta' END END AS phase,
  CASE WHEN event_type <> 'error' THEN event_type END AS name, CASE WHEN event_type <> 'error' THEN props END AS args_text, CASE WHEN event_type = 'error' THEN props END AS message,
  CASE WHEN event_type = 'error' THEN 'upstream' END AS code, NULL::VARCHAR AS reason FROM events)"""
_COLS = "stream_id, event_index, out_seq, type, phase, name, args_text, message, code, reason"
_BYTES = "coalesce(sum(CASE WHEN phase = 'delta' THEN octet_length(encode(args_text)) ELSE 0 END) OVER (PARTITION BY stream_id, live, name, seg ORDER BY event_index), 0)"


def _blocked(source: str, hit: str, error: str = "Policy violation") -> str:
    """Rows of ``source`` with those that hit replaced by an error and a finish."""
    return f"""SELECT {_COLS} FROM {source} WHERE NOT ({hit})
UNION ALL SELECT stream_id, event_index, 0, 'error', NULL, NULL, NULL, '{error}', NULL, NULL FROM {source} WHERE {hit}
UNION ALL SELECT stream_id, event_index, 1, 'finish', NULL, NULL, NULL, NULL, NULL, 'policy_violation' FROM {source} WHERE {hit}"""


def _tools(hit: str) -> str:
    return f"WITH {_EV} {_blocked('ev', f'coalesce({hit}, false)')}"


_PASS = f"WITH {_EV} SELECT {_COLS} FROM ev"
_ALLOWED = "('click', 'view', 'purchase')"


def _sized(live: str, source: str = "ev") -> str:
    return f"""l AS (SELECT *, {live} AS live FROM {source}), sg AS (SELECT *, count(*) FILTER (phase = 'done') OVER (PARTITION BY stream_id, live, name ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM l),
t AS (SELECT *, live AND phase = 'done' AND {_BYTES} > 40 AS big, {_BYTES} AS total FROM sg)"""


def _sanitized(source: str, code: str = "NULL", message: str = "An error occurred.") -> str:
    return f"SELECT stream_id, event_index, out_seq, type, phase, name, args_text, CASE WHEN type = 'error' THEN '{message}' ELSE message END AS message, CASE WHEN type = 'error' THEN {code} ELSE code END AS code, reason FROM ({source})"


def _pipeline(mode: str) -> str:
    live = "type = 'tool_call'" + ("" if mode == "audit" else f" AND name IN {_ALLOWED}")
    hit = "false" if mode == "audit" else f"(type = 'tool_call' AND name NOT IN {_ALLOWED}) OR coalesce(big, false)"
    return f"WITH {_EV}, {_sized(live)} {_sanitized(_blocked('t', f'coalesce({hit}, false)'))}"


def _violations(mode: str, deny: str = "") -> str:
    live = "type = 'tool_call'" + ("" if mode == "audit" else f" AND name IN {_ALLOWED}")
    return f"""WITH {_EV}, {_sized(live)},
v AS (SELECT stream_id, event_index, 1 AS o, 'allow_tools' AS rule, 'Tool "' || name || '" is not in allowlist' AS message FROM t WHERE type = 'tool_call' AND name NOT IN {_ALLOWED}
  UNION ALL SELECT stream_id, event_index, 2, 'max_tool_args_bytes', 'Tool args exceeded 40 bytes (' || total::BIGINT || ')' FROM t WHERE big
  UNION ALL SELECT stream_id, event_index, 3, 'sanitize_errors', 'Sanitized upstream error event' FROM t WHERE type = 'error' OR ('{mode}' <> 'audit' AND ((type = 'tool_call' AND name NOT IN {_ALLOWED}) OR coalesce(big, false))))
SELECT stream_id, event_index, (row_number() OVER (PARTITION BY stream_id, event_index ORDER BY o) - 1)::INTEGER AS seq, rule, message, '{mode}' AS mode, 'v1' AS policy_version FROM v"""


_BODY = f"""'{{"message": "failed at /srv", "n": 1}}' || chr(10) || {_SYN}"""
_MSG = r"""regexp_replace(%s, '"message"\s*:\s*"([^"\\]|\\.)*"', '"message":"An error occurred."', 'g')"""


def _byte(secrets: bool, errors: bool) -> str:
    x = _replace(_BODY, SECRETS) if secrets else _BODY
    return f"SELECT doc_id AS stream_id, {_MSG % x if errors else x} AS body FROM documents"


def _count(x: str, patterns) -> str:
    """How many matches the patterns have, each in what those before it leave."""
    return "(" + " + ".join(f"len(regexp_extract_all({_replace(x, patterns[:i])}, '{p}'))" for i, p in enumerate(patterns)) + ")"


def _sse(x: str) -> str:
    lines = f"list_filter(list_transform(string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10)), lambda y: regexp_replace(y, '{_S}+$', '')), lambda y: y <> '' AND NOT starts_with(ltrim(y), ':'))"
    return f"array_to_string(list_transform({lines}, lambda y: CASE WHEN starts_with(y, 'data:') THEN regexp_replace(y, '^data: ?', '') ELSE y END), chr(10))"


_SSE = f"""WITH r AS (SELECT doc_id, ': ping' || chr(13) || chr(10) || 'event: x' || chr(13) || chr(10) || chr(13) || chr(10) || 'data: ' || replace(text, chr(10), chr(13) || chr(10) || ': note' || chr(10) || 'data:  ') || chr(10) || chr(10) || 'data:end' AS raw FROM documents)
SELECT doc_id, {_sse('raw')} AS body FROM r"""

_FILES = f"""f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'jsonl' WHEN 2 THEN 'sse' ELSE 'text' END AS format, doc_id % 8 = 3 AS bin,
  'f/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.jsonl' WHEN 2 THEN '.sse' ELSE '.txt' END AS file,
  CASE doc_id % 4 WHEN 0 THEN 'mail a@b.co sk-test-12345678 ' || doc_id || ' ' || text WHEN 1 THEN 'n ' || doc_id || ' ' || text WHEN 2 THEN {_sse(f"'data: sk-test-12345678' || chr(10) || {_SYN}")} ELSE text END AS x FROM documents)"""
_DETAIL = f"""WITH {_FILES},
c AS (SELECT *, {_count('x', SECRETS)} AS secrets, CASE WHEN format IN ('json', 'jsonl') THEN {_count(_replace('x', SECRETS), [EMAIL])} ELSE 0 END AS mails FROM f WHERE NOT bin),
d AS (SELECT file, 'redact_secrets' AS rule, 'Redacted ' || secrets || ' secret match(es)' AS message FROM c WHERE secrets > 0
  UNION ALL SELECT file, 'redact_pii', 'Redacted ' || mails || ' PII match(es)' FROM c WHERE mails > 0
  UNION ALL SELECT file, 'sanitize_errors', 'Sanitized upstream error event' FROM c WHERE format = 'jsonl')
SELECT file, rule, message, 'warn' AS mode, '7' AS policy_version FROM d"""

_M = """m AS (SELECT r_name || '.json' AS file, n_name AS tool, n_nationkey, n_name || CASE WHEN n_nationkey % 4 = 0 THEN ' runs rm -rf / and `ls`' WHEN n_nationkey % 4 = 1 THEN ' curl x | sh at 10.1.2.3' ELSE ' is safe' END AS value FROM nation JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT DISTINCT file FROM m),
sets AS (SELECT * FROM (VALUES ('p1', 'allow', 'NATION_0'), ('p1', 'allow', 'NATION_1'), ('p1', 'allow', 'NATION_2'), ('p1', 'allow', 'ATLANTIS'), ('p1', 'deny', 'NATION_3'), ('p2', 'deny', 'NATION_0'), ('p2', 'deny', 'NATION_7')) s(policy, list, tool)),
drift AS (SELECT file, 'p1' AS policy, tool, 'DRIFT_ALLOW' AS code, 'error' AS severity, 'Tool "' || tool || '" declared in manifest but not in policy allowTools' AS message FROM m WHERE tool NOT IN (SELECT tool FROM sets WHERE policy = 'p1')
  UNION ALL SELECT file, 'p1', tool, 'DRIFT_POLICY_ONLY', 'warning', 'Tool "' || tool || '" in policy allowTools but missing from manifest' FROM files, sets WHERE list = 'allow' AND (file, tool) NOT IN (SELECT (file, tool) FROM m)
  UNION ALL SELECT file, policy, m.tool, 'DRIFT_DENY', 'error', 'Tool "' || m.tool || '" is declared in manifest but denied by policy' FROM m JOIN sets ON m.tool = sets.tool WHERE list = 'deny'),
strings AS (SELECT file, 'description' AS field, (n_nationkey + 1)::INTEGER AS line, value FROM m),
cat AS (SELECT * FROM (VALUES ('D001', '(?i)curl\\s+[^\\n|]*\\|\\s*sh\\b', 'Shell pipe to sh detected in tool text'), ('D002', '(?i)rm\\s+-rf\\b', 'Destructive rm -rf pattern in tool text'), ('D003', '`[^`]+`', 'Backtick command execution pattern in tool text'), ('D004', '\\$\\([^)]+\\)', 'Subshell $() pattern in tool text'), ('D005', '(?i)base64\\s+-d|atob\\s*\\(', 'Base64 decode pattern in tool text'), ('D006', '\\b(?:10\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}|192\\.168\\.|169\\.254\\.)', 'Private or link-local IP hint in tool text')) c(code, p, message)),
danger AS (SELECT file, field, line, code, message FROM strings, cat WHERE regexp_matches(value, p)),
args AS (SELECT file, field, line, policy FROM strings, (VALUES ('p1'), ('p2')) q(policy) WHERE CASE policy WHEN 'p1' THEN regexp_matches(value, 'rm\\s+-rf') ELSE contains(value, 'curl') END)""".replace("\\\\", "\\")
_ALL = """(SELECT 'drift' AS kind, code, severity, file, tool, NULL AS field, NULL AS line, message FROM drift UNION ALL SELECT 'dangerous', code, 'warning', file, NULL, field, line, message FROM danger
  UNION ALL SELECT 'blockToolArgs', 'BLOCK_ARGS_STATIC', 'error', file, NULL, field, line, 'Manifest text matches policy blockToolArgs rule' FROM args)"""
_DOCS = """r AS (SELECT * FROM (VALUES ('a', 0, 'redactSecrets', '{}'), ('a', 1, 'allowTools', '{"names": ["a", "b"]}'), ('a', 2, 'maxToolArgsBytes', '{"max": 10}'), ('b', 0, 'allowTools', '{"names": ["a"]}'), ('b', 1, 'sanitizeErrors', '{}')) r(policy, ordinal, key, params)),
t AS (SELECT policy, 'rules.' || key AS path, '{"' || key || '": ' || params || '}' AS value FROM r UNION ALL SELECT * FROM (VALUES ('a', 'mode', '"block"'), ('b', 'mode', '"warn"')) m(policy, path, value))"""
_AGENT = f"""{_EV}, ag AS (SELECT * REPLACE (CASE name WHEN 'click' THEN 'search' WHEN 'view' THEN 'bash' WHEN 'purchase' THEN 'read_file' ELSE name END AS name,
  CASE WHEN type = 'tool_call' THEN CASE WHEN event_index % 7 = 3 THEN '{{"cmd": "rm  -rf /"}}' WHEN event_index % 5 = 1 THEN '{{"key":"sk-test-12345678"}}' ELSE args_text END END AS args_text) FROM ev),
red AS (SELECT * REPLACE ({_replace('args_text', SECRETS)} AS args_text) FROM ag)"""
_SAFE = "red2 AS (SELECT * REPLACE (CASE WHEN type = 'error' THEN 'An error occurred.' ELSE message END AS message, CASE WHEN type = 'error' THEN NULL ELSE code END AS code) FROM red)"
_DRIFT = "file, policy, tool, code, severity, message"
_T = "coalesce(%s, '')"

ORACLES = {
    "events_passthrough": _PASS,
    "custom_transform": _PASS + " WHERE event_index % 2 = 0",
    "custom_drop_log": f"""WITH {_EV}, b AS (SELECT *, coalesce(type = 'tool_call' AND name NOT IN {_ALLOWED}, false) AS bad FROM ev)
SELECT stream_id, event_index, 0 AS seq, 'allow_tools' AS rule, 'Tool "' || name || '" is not in allowlist' AS message FROM b WHERE bad
UNION ALL SELECT stream_id, event_index, bad::INT, 'sanitize_errors', 'Sanitized upstream error event' FROM b WHERE event_index % 2 = 0 AND (bad OR type = 'error')""",
    "custom_expand_log": f"""WITH {_EV} SELECT stream_id, event_index, 0 AS seq, 'deny_tools' AS rule, 'Tool "click" is denied' AS message FROM ev WHERE name = 'click'
UNION ALL SELECT stream_id, event_index, unnest([0, 1]), 'sanitize_errors', 'Sanitized upstream error event' FROM ev WHERE type = 'error'""",
    "redact_pii_email": f"SELECT doc_id AS stream_id, {_replace('text', [EMAIL])} AS text FROM documents",
    "redact_pii_phone": f"SELECT doc_id AS stream_id, {_replace('text', [PHONE])} AS text FROM documents",
    "redact_pii_both": f"SELECT doc_id AS stream_id, {_replace('text', [EMAIL, PHONE])} AS text FROM documents",
    "redact_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}'))::INTEGER AS n_email, len(regexp_extract_all({_replace('text', [EMAIL])}, '{PHONE}'))::INTEGER AS n_phone FROM documents",
    "redact_secrets_builtin": f"SELECT doc_id AS stream_id, {_replace(_SYN, SECRETS)} AS text FROM documents",
    "redact_secrets_custom_pattern": f"SELECT doc_id AS stream_id, {_replace('text', [*SECRETS, HEX])} AS text FROM documents",
    "redact_placeholder": f"SELECT doc_id AS stream_id, {_replace('text', [*SECRETS, HEX], '<$1' + chr(92) * 2 + '>')} AS text FROM documents",
    "redact_idempotent": f"SELECT count(*) FILTER (a <> {_replace('a', SECRETS)}) AS differing FROM (SELECT {_replace(_SYN, SECRETS)} AS a FROM documents)",
    "redact_chat": f"SELECT conv_id AS stream_id, turn AS event_index, CASE WHEN role = 'system' THEN 'reasoning' ELSE 'text' END AS type, {_replace('text', [EMAIL, PHONE])} AS text FROM conversations",
    "allow_tools_block": _tools(f"type = 'tool_call' AND name NOT IN {_ALLOWED}"),
    "allow_tools_warn": _tools(f"type = 'tool_call' AND name NOT IN {_ALLOWED}"),
    "allow_tools_audit": _PASS,
    "allow_tools_empty": _tools("type = 'tool_call'"),
    "deny_tools_block": _tools("type = 'tool_call' AND name IN ('click', 'view')"),
    "deny_tools_audit": _PASS,
    "block_args_regex": _tools(r"""phase = 'done' AND regexp_matches(json(args_text)::VARCHAR, '"k":[1-4][0-9]\b')"""),
    "block_args_contains": _tools("""phase = 'done' AND contains(json(args_text)::VARCHAR, '"k":5')"""),
    "block_args_callable": _tools("phase = 'done' AND (args_text->>'$.k')::INTEGER > 50"),
    "max_args_bytes_block": f"""WITH {_EV}, {_sized("type = 'tool_call'")} {_blocked('t', 'coalesce(big, false)')}""",
    "max_args_bytes_audit": _PASS,
    "sanitize_errors": f"WITH {_EV} {_sanitized('SELECT * FROM ev')}",
    "sanitize_errors_keep_code": f"WITH {_EV} {_sanitized('SELECT * FROM ev', 'code')}",
    "sanitize_errors_custom_message": f"WITH {_EV} {_sanitized('SELECT * FROM ev', message='Failed')}",
    **{f"pipeline_{m}": _pipeline(m) for m in ("block", "warn", "audit")},
    "policy_guard_block": f"""WITH {_EV}, {_sized("type = 'tool_call' AND name <> 'view'")} {_sanitized(_blocked('t', "coalesce((type = 'tool_call' AND name = 'view') OR big, false)"))}""",
    **{f"violations_{m}": _violations(m) for m in ("block", "audit")},
    "summary_by_stream": f"""WITH {_EV}, {_sized("type = 'tool_call' AND name IN ('view', 'purchase')")},
c AS (SELECT *, type = 'tool_call' AND name = 'click' AS denied, type = 'tool_call' AND name NOT IN {_ALLOWED} AS other, coalesce(big, false) AS b FROM t)
SELECT stream_id, sum(denied::INT + other::INT + b::INT + (type = 'error' OR denied OR other OR b)::INT)::BIGINT AS violations,
  coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (denied OR other OR b))), ','), '') AS tools_touched, 0::BIGINT AS redactions, sum(other::INT)::BIGINT AS allow_tools, sum((type = 'error' OR denied OR other OR b)::INT)::BIGINT AS sanitize_errors
FROM c GROUP BY stream_id""",
    "counts_by_rule": f"SELECT rule, count(*) AS n FROM ({_violations('warn')}) GROUP BY rule",
    "agent_loop_executed": f"""WITH {_EV}, s AS (SELECT *, coalesce(bool_or(type = 'tool_call' AND name NOT IN {_ALLOWED}) OVER (PARTITION BY stream_id ORDER BY event_index), false) AS stopped FROM ev)
SELECT stream_id, event_index, name FROM s WHERE NOT stopped AND type = 'tool_call' AND phase = 'done'""",
    "byte_redact_rechunk": _byte(True, False),
    "byte_sanitize": _byte(False, True),
    "byte_combined": _byte(True, True),
    "stream_byte_redact": f"SELECT doc_id AS stream_id, {_replace(chr(39) + 'x ' + chr(39) + ' || ' + _SYN, SECRETS)} AS body FROM documents",
    "stream_byte_combined": _byte(True, True),
    "stream_tool_bytes": f"""WITH {_EV}, {_sized("type = 'tool_call'")} SELECT stream_id, event_index, name, total::BIGINT AS bytes, total > 40 AS exceeded FROM t WHERE type = 'tool_call' AND phase = 'done'""",
    "canonical_json_values": r"""WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN '{"2":0.00001,"10":1e-7,"b":' || CASE WHEN k = 0 THEN '0' WHEN k < 10 THEN k || 'e+21' WHEN k % 10 = 0 THEN (k // 10) || 'e+22' ELSE (k // 10) || '.' || (k % 10) || 'e+22' END
  || ',"a":"\ud800","n":[12345678901234567000,0,1,null],"s":"é\u0001"}' END AS json FROM e""",
    "pipeline_agent_gate": f"""WITH {_AGENT} {_sanitized(_blocked('ag', "coalesce(type = 'tool_call' AND name NOT IN ('search', 'read_file', 'grep'), false)"))}""",
    "pipeline_proxy_strict": f"""WITH {_AGENT}, {_SAFE} {_blocked('red2', "coalesce(type = 'tool_call' AND (name = 'bash' OR (phase = 'done' AND regexp_matches(json(args_text)::VARCHAR, 'rm[[:space:]]+-rf'))), false)")}""",
    "pipeline_audit_only": f"WITH {_AGENT}, {_SAFE} SELECT {_COLS} FROM red2",
    "scan_binary_skip": f"WITH {_FILES} SELECT file, bin AS zero_byte FROM f",
    "sse_normalize": _SSE,
    "canonical_json": "SELECT event_id, json(props)::VARCHAR AS json FROM events",
    "scan_format_detect": f"WITH {_FILES} SELECT format, bin AS zero_byte, count(*) AS n FROM f GROUP BY ALL",
    "scan_report_detail": _DETAIL,
    "scan_report_summary": f"SELECT (SELECT count(*) FROM documents WHERE doc_id % 8 <> 3) AS files, count(*) AS violations, count(*) FILTER (starts_with(rule, 'redact')) AS redactions, 'warn' AS mode FROM ({_DETAIL})",
    **{q: f"WITH {_M} SELECT {_DRIFT} FROM drift WHERE code = '{c}'" for q, c in (("drift_allow", "DRIFT_ALLOW"), ("drift_deny", "DRIFT_DENY"), ("drift_policy_only", "DRIFT_POLICY_ONLY"))},
    "drift_strict": f"WITH {_M} SELECT file, policy, tool, code, CASE WHEN code = 'DRIFT_POLICY_ONLY' THEN 'error' ELSE severity END AS severity, message FROM drift",
    "dangerous_patterns": f"WITH {_M} SELECT * FROM danger",
    "block_args_static": f"WITH {_M} SELECT *, 'error' AS severity FROM args",
    "static_summary": f"""WITH {_M} SELECT (SELECT count(*) FROM files) AS manifests, (SELECT count(*) FROM m) AS tools_declared, count(*) FILTER (kind = 'drift') AS drift, count(*) FILTER (kind = 'dangerous') AS dangerous, count(*) FILTER (kind = 'blockToolArgs') AS block_tool_args,
  count(*) FILTER (kind <> 'dangerous' AND severity = 'error') AS errors, count(*) FILTER (kind = 'dangerous' OR severity = 'error' OR code = 'DRIFT_POLICY_ONLY') AS errors_strict, 'audit' AS mode, NULL::VARCHAR AS policy_version FROM {_ALL}""",
    "sarif_rules": f"""WITH {_M}, c AS (SELECT * FROM (VALUES (0, 'DRIFT_ALLOW', 'Manifest tool not in policy allowTools', 'error'), (1, 'DRIFT_DENY', 'Denied tool declared in manifest', 'error'), (2, 'DRIFT_POLICY_ONLY', 'Policy allowTools entry missing from manifest', 'warning'), (9, 'BLOCK_ARGS_STATIC', 'Static blockToolArgs pattern in manifest text', 'warning')) x(ordinal, id, text, level)
  UNION ALL SELECT 2 + substr(code, 4)::INTEGER, code, message, 'warning' FROM cat)
SELECT ordinal, id, text, level FROM c WHERE id IN (SELECT code FROM {_ALL})""",
    "annotations": f"WITH {_M} SELECT '::' || severity || ' file=' || file || ',line=' || coalesce(line, 1) || '::' || message AS annotation FROM {_ALL}",
    "report_lines": f"WITH {_M} SELECT '[' || severity || '] ' || code || ' ' || coalesce(tool, field) || ' @ ' || file || ': ' || message AS row FROM {_ALL}",
    "sarif_results": f"""WITH {_M} SELECT '{{"ruleId":"' || code || '","level":"' || severity || '","message":{{"text":' || to_json(message)::VARCHAR || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}}'
  || CASE WHEN line > 0 THEN ',"region":{{"startLine":' || line || '}}' ELSE '' END || '}}}}]}}' AS result FROM {_ALL}""",
    "policy_diff": f"""WITH {_DOCS} SELECT CASE WHEN path NOT LIKE 'rules.%' OR (a.value IS NOT NULL AND b.value IS NOT NULL) THEN 'changed' WHEN b.value IS NULL THEN 'removed' ELSE 'added' END AS kind, path, a.value AS before, b.value AS after
FROM (SELECT * FROM t WHERE policy = 'a') a FULL JOIN (SELECT * FROM t WHERE policy = 'b') b USING (path) WHERE a.value IS DISTINCT FROM b.value""",
    "policy_merge_effective": f"""WITH {_DOCS}, m AS (SELECT key, coalesce(b.params, a.params) AS params, a.ordinal AS o, b.ordinal AS p FROM (SELECT * FROM r WHERE policy = 'a') a FULL JOIN (SELECT * FROM r WHERE policy = 'b') b USING (key))
SELECT (row_number() OVER (ORDER BY o NULLS LAST, p) - 1)::INTEGER AS ordinal, key, params FROM m""",
    "manifest_strings_lines": """WITH n AS (SELECT r_name || '.json' AS file, n_name, n_nationkey % 5 <> 0 AS named, (3 + row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey))::INTEGER AS line FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT *, (count(*) FILTER (named) OVER (PARTITION BY file))::INTEGER AS n_tools FROM n)
SELECT file, n_tools, 'description' AS field, 'about ' || n_name AS value, line FROM c UNION ALL SELECT file, n_tools, 'examples[0]', 'one', line FROM c UNION ALL SELECT file, n_tools, 'examples[1].k', 'rm -rf ' || n_name, line FROM c""",
}
