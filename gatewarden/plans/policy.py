"""Declarative policies: parsing, inheritance, validation, comparison, and compilation to rules."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from ..functions.patterns import PLACEHOLDER, compiles
from ..operators import rules as R
from ..operators.pipeline import MODES, GuardResult, guard_events
from ..operators.streams import guard_bytes

RULE_KEYS = ("redactSecrets", "redactPII", "allowTools", "denyTools", "blockToolArgs", "maxToolArgsBytes", "sanitizeErrors")
BYTE_KEYS = ("redactSecrets", "sanitizeErrors")
MAX_EXTENDS = 8
# What each code of a policy error means.
ERROR_CODES = {
    "POLICY_E001": "version missing or unsupported", "POLICY_E002": "shape of the document", "POLICY_E003": "regular expression does not compile",
    "POLICY_E004": "redactPII without email or phone", "POLICY_E005": "extends runs in a circle", "POLICY_E006": "extends is too deep",
    "POLICY_E007": "blockToolArgs needs exactly one of pattern and contains", "POLICY_E008": "list of tool names", "POLICY_E009": "tool both allowed and denied",
    "POLICY_E010": "empty allow list in block mode", "POLICY_E011": "reserved",
}
# The named profiles.
PROFILES = {
    "agent-gate": {"version": "1", "mode": "block", "rules": [{"allowTools": {"names": ["search", "read_file", "grep"]}}, {"maxToolArgsBytes": {"max": 65536}}, {"sanitizeErrors": {}}]},
    "proxy-strict": {
        "version": "1", "mode": "block", "byte": {"redactSecrets": True, "sanitizeErrors": True},
        "rules": [{"redactSecrets": {}}, {"sanitizeErrors": {}}, {"denyTools": {"names": ["bash", "shell", "exec", "run_terminal_cmd"]}}, {"blockToolArgs": {"pattern": r"rm\s+-rf|curl\s+.*\|"}}],
    },
    "audit-only": {"version": "1", "mode": "audit", "byte": {"redactSecrets": True, "sanitizeErrors": True}, "rules": [{"redactSecrets": {}}, {"sanitizeErrors": {}}]},
}


@dataclass(frozen=True)
class PolicyError:
    code: str
    path: str
    message: str

    def __str__(self):
        return f"{self.code} {self.path} {self.message}"


class InvalidPolicy(ValueError):
    def __init__(self, errors):
        self.errors = list(errors)
        super().__init__("; ".join(map(str, self.errors)))


# ---- text --------------------------------------------------------------------------------------


def _scalar(s: str):
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        return json.loads(s) if s[0] == '"' else s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    if s == "{}":
        return {}
    if s in ("true", "false"):
        return s == "true"
    if s in ("null", "~", ""):
        return None
    try:
        return int(s) if s.lstrip("-").isdigit() else float(s)
    except ValueError:
        return s


def parse_yaml(text: str):
    """Maps, lists and scalars by indentation; comments; no anchors, tags or block scalars."""
    lines = []
    for raw in text.splitlines():
        body = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if body.strip() and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def value(i: int, indent: int):
        if i >= len(lines) or lines[i][0] < indent:
            return None, i
        return (sequence if lines[i][1].startswith("- ") or lines[i][1] == "-" else mapping)(i, lines[i][0])

    def sequence(i: int, indent: int):
        out = []
        while i < len(lines) and lines[i][0] == indent and (lines[i][1].startswith("- ") or lines[i][1] == "-"):
            rest = lines[i][1][1:].strip()
            if not rest:
                item, i = value(i + 1, indent + 1)
            elif _key(rest) is not None:
                lines[i] = (indent + 2, rest)
                item, i = mapping(i, indent + 2)
            else:
                item, i = _scalar(rest), i + 1
            out.append(item)
        return out, i

    def mapping(i: int, indent: int):
        out = {}
        while i < len(lines) and lines[i][0] == indent and _key(lines[i][1]) is not None:
            key, rest = _key(lines[i][1])
            if rest:
                out[key], i = _scalar(rest), i + 1
            else:
                down = indent if i + 1 < len(lines) and lines[i + 1][0] == indent and lines[i + 1][1].startswith("-") else indent + 1
                out[key], i = value(i + 1, down)
        return out, i

    return value(0, 0)[0]


def _key(s: str):
    if s[:1] in "\"'[{":
        return None
    head, sep, rest = s.partition(":")
    return (head.strip(), rest.strip()) if sep and (not rest or rest[0] == " ") else None


def parse_policy(text: str, name: str = ""):
    if name.endswith((".yaml", ".yml")):
        return parse_yaml(text)
    if text.lstrip()[:1] in ("{", "["):
        return json.loads(text)
    first = next((x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")), "")
    return parse_yaml(text) if _key(first.strip()) else json.loads(text)


# ---- inheritance -------------------------------------------------------------------------------


def merge(base: dict, over: dict) -> dict:
    """``over`` on ``base``: a rule replaces the first of its kind in place, others follow."""
    out = {k: over.get(k, base.get(k)) for k in ("version", "policyVersion", "mode") if k in over or k in base}
    if base.get("byte") or over.get("byte"):
        out["byte"] = {**(base.get("byte") or {}), **(over.get("byte") or {})}
    merged = list(base.get("rules") or [])
    for rule in over.get("rules") or []:
        at = next((i for i, r in enumerate(merged) if set(r) == set(rule)), None)
        if at is None:
            merged.append(rule)
        else:
            merged[at] = rule
    out["rules"] = merged
    return out


def resolve(doc, folder: str = ".", seen: tuple = ()):
    """``doc`` with what it extends: a profile's name or a path relative to its file."""
    if not isinstance(doc, dict) or not isinstance(doc.get("extends"), str):
        return doc
    name = doc["extends"]
    if len(seen) >= MAX_EXTENDS:
        raise InvalidPolicy([PolicyError("POLICY_E006", "extends", f"more than {MAX_EXTENDS} levels")])
    if name in PROFILES:
        base = PROFILES[name]
    else:
        path = os.path.normpath(os.path.join(folder, name))
        if path in seen:
            raise InvalidPolicy([PolicyError("POLICY_E005", "extends", f"circular extends: {name}")])
        if not os.path.exists(path):
            raise FileNotFoundError(f"extends file not found: {name}")
        with open(path, encoding="utf-8") as f:
            base = resolve(parse_policy(f.read(), path), os.path.dirname(path), (*seen, path))
    return merge(base, {k: v for k, v in doc.items() if k != "extends"})


# ---- validation --------------------------------------------------------------------------------


def _names(value, path: str):
    if not isinstance(value, list):
        yield PolicyError("POLICY_E008", path, "a list of tool names is needed")
    elif not value:
        yield PolicyError("POLICY_E008", path, "the list is empty")
    else:
        yield from (PolicyError("POLICY_E008", f"{path}[{i}]", "a name is a string") for i, x in enumerate(value) if not isinstance(x, str))


def _rule(rule, path: str):
    if not isinstance(rule, dict) or len(rule) != 1:
        yield PolicyError("POLICY_E002", path, "a rule is an object with one key")
        return
    key, p = next(iter(rule.items()))
    at = f"{path}.{key}"
    if key not in RULE_KEYS:
        yield PolicyError("POLICY_E002", at, f"unknown rule {key}")
    elif not isinstance(p, dict):
        yield PolicyError("POLICY_E002", at, "parameters are an object")
    elif key in ("allowTools", "denyTools"):
        yield from _names(p.get("names"), at + ".names")
    elif key == "maxToolArgsBytes":
        n = p.get("max")
        if isinstance(n, bool) or not isinstance(n, (int, float)) or n != n // 1 or n <= 0:
            yield PolicyError("POLICY_E002", at + ".max", "a positive whole number is needed")
    elif key == "redactSecrets" and not isinstance(p.get("placeholder", ""), str):
        yield PolicyError("POLICY_E002", at + ".placeholder", "a string is needed")
    elif key == "redactPII" and not (p.get("email") is True or p.get("phone") is True):
        yield PolicyError("POLICY_E004", at, "email or phone must be true")
    elif key == "blockToolArgs":
        pattern = isinstance(p.get("pattern"), str)
        if pattern == isinstance(p.get("contains"), str):
            yield PolicyError("POLICY_E007", at, "exactly one of pattern and contains is needed")
        elif pattern and not compiles(p["pattern"]):
            yield PolicyError("POLICY_E003", at + ".pattern", "the regular expression does not compile")


def names_of(rule_params) -> list[str]:
    return list(rule_params.get("names", []) if isinstance(rule_params, dict) else rule_params)


def _conflicts(found: list, mode: str):
    """Of several lists of a kind the last one counts against the other kind."""
    last = {k: names_of(r[k]) for r in found for k in r if k in ("allowTools", "denyTools")}
    if both := [n for n in last.get("allowTools", ()) if n in last.get("denyTools", ())]:
        yield PolicyError("POLICY_E009", "rules", f"allowed and denied: {', '.join(both)}")
    if mode == "block" and any("allowTools" in r and not names_of(r["allowTools"]) for r in found):
        yield PolicyError("POLICY_E010", "rules.allowTools.names", "an empty list denies all tools in block mode")


def validate(doc) -> tuple[dict | None, list[PolicyError]]:
    """(document with defaults, []) or (None, errors); all errors of shape are collected, then those between rules."""
    if not isinstance(doc, dict):
        return None, [PolicyError("POLICY_E001", "", "a policy is an object")]
    e = []
    if "version" not in doc and not doc.get("extends") or doc.get("version", "1") != "1":
        e.append(PolicyError("POLICY_E001", "version", 'version must be "1"'))
    if "mode" in doc and doc["mode"] not in MODES:
        e.append(PolicyError("POLICY_E002", "mode", "block, warn or audit"))
    byte = doc.get("byte", {})
    if not isinstance(byte, dict):
        e.append(PolicyError("POLICY_E002", "byte", "an object is needed"))
    else:
        e += [PolicyError("POLICY_E002", f"byte.{k}", "a known flag, true or false") for k, v in byte.items() if k not in BYTE_KEYS or not isinstance(v, bool)]
    e += [PolicyError("POLICY_E002", k, "a string is needed") for k in ("extends", "policyVersion") if k in doc and not isinstance(doc[k], str)]
    found = doc.get("rules", [])
    if not isinstance(found, list):
        e.append(PolicyError("POLICY_E002", "rules", "a list is needed"))
    else:
        e += [x for i, r in enumerate(found) for x in _rule(r, f"rules[{i}]")]
    out = {"version": "1", "mode": "block", "rules": [], **{k: doc[k] for k in ("version", "mode", "rules", "policyVersion", "extends", "byte") if k in doc}}
    e = e or list(_conflicts(out["rules"], out["mode"]))
    return (None, e) if e else (out, [])


# ---- comparison --------------------------------------------------------------------------------


def _fields(d: dict) -> dict:
    """What a comparison looks at, by path: fields (no byte flags at all are as good as none), then whole rules; the
    last rule of a kind counts."""
    fields = {k: d[k] for k in ("mode", "policyVersion", "extends") if d.get(k) is not None}
    fields |= {"byte": d["byte"]} if d.get("byte") else {}
    return fields | {f"rules.{k}": r for r in d.get("rules") or [] for k in r}


def diff(a: dict, b: dict) -> list[dict]:
    """Differences as {kind, path, before, after}: fields, then rules gone or changed in a's order, then new ones.

    Fields are always "changed", be they new or gone; a rule stands with its key.
    """
    x, y = _fields(a), _fields(b)
    fields = ("mode", "policyVersion", "extends", "byte")
    paths = [*(k for k in fields if k in x or k in y), *(k for k in x if k not in fields), *(k for k in y if k not in fields and k not in x)]
    kind = lambda k: "changed" if k in fields or (k in x and k in y) else "removed" if k in x else "added"
    value = lambda d, f, k: d.get(k) if k in fields else f.get(k)
    return [{"kind": kind(k), "path": k, "before": value(a, x, k), "after": value(b, y, k)} for k in paths if json.dumps(x.get(k)) != json.dumps(y.get(k))]


def document_table(spark, policies: dict[str, dict]):
    """(policy, path, value, place): the compared fields of named documents, as JSON."""
    rows = [(name, k, json.dumps(v), i) for name, d in policies.items() for i, (k, v) in enumerate(_fields(d).items())]
    return spark.createDataFrame(rows, "policy string, path string, value string, place int")


def diff_text(entries) -> str:
    return "\n".join(f"{x['kind']} {x['path']}: {json.dumps(x['before'])} → {json.dumps(x['after'])}" for x in entries) or "No differences."


# ---- compilation -------------------------------------------------------------------------------


def compile_rule(key: str, p):
    if key == "redactSecrets":
        return R.redact_secrets(placeholder=p.get("placeholder", PLACEHOLDER))
    if key == "redactPII":
        return R.redact_pii(p.get("email") is True, p.get("phone") is True)
    if key in ("allowTools", "denyTools"):
        return (R.allow_tools if key == "allowTools" else R.deny_tools)(names_of(p))
    if key == "blockToolArgs":
        if "pattern" not in p and not p.get("contains"):
            raise ValueError("blockToolArgs: contains is empty")
        return R.block_tool_args(R.Pattern(p["pattern"]) if "pattern" in p else R.Contains(p["contains"]))
    if key == "maxToolArgsBytes":
        return R.max_tool_args_bytes(int(p["max"]))
    return R.sanitize_errors()


@dataclass
class Guard:
    """A compiled policy, for event tables and for byte streams."""

    document: dict
    mode: str
    policy_version: str | None = None
    rules: list = field(default_factory=list)

    @classmethod
    def from_policy(cls, policy, mode: str | None = None) -> Guard:
        """From a document, a profile's name or a file; GUARD_MODE beats ``mode``, which beats the document."""
        folder = "."
        if isinstance(policy, str):
            if policy in PROFILES:
                policy = PROFILES[policy]
            else:
                folder = os.path.dirname(policy)
                with open(policy, encoding="utf-8") as f:
                    policy = parse_policy(f.read(), policy)
        doc, errors = validate(resolve(policy, folder))
        if errors:
            raise InvalidPolicy(errors)
        env = os.environ.get("GUARD_MODE")
        mode = env if env in MODES else mode or doc["mode"]
        return cls(doc, mode, doc.get("policyVersion"), [compile_rule(k, v) for r in doc["rules"] for k, v in r.items()])

    def guard(self, events) -> GuardResult:
        return guard_events(events, self.rules, self.mode, self.policy_version)

    def guard_bytes(self, bodies):
        byte = self.document.get("byte") or {}
        return guard_bytes(bodies, byte.get("redactSecrets") is True, byte.get("sanitizeErrors") is True)


def rules_table(spark, policies: dict[str, dict]):
    """(policy, ordinal, key, params): the rules of named documents."""
    rows = [(name, i, k, json.dumps(v)) for name, d in policies.items() for i, r in enumerate(d.get("rules") or []) for k, v in r.items()]
    return spark.createDataFrame(rows, "policy string, ordinal int, key string, params string")
