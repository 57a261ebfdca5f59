import json

import pytest

from gatewarden.plans import policy as P


def codes(doc):
    return [e.code for e in P.validate(doc)[1]]


@pytest.mark.parametrize(
    "doc, want",
    [
        (None, ["POLICY_E001"]), ({}, ["POLICY_E001"]), ({"version": "2"}, ["POLICY_E001"]), ({"version": "1", "mode": "x"}, ["POLICY_E002"]),
        ({"version": "1", "rules": [{"blockToolArgs": {"pattern": "("}}]}, ["POLICY_E003"]), ({"version": "1", "rules": [{"redactPII": {}}]}, ["POLICY_E004"]),
        ({"version": "1", "rules": [{"blockToolArgs": {}}]}, ["POLICY_E007"]), ({"version": "1", "rules": [{"allowTools": {"names": []}}]}, ["POLICY_E008"]),
        ({"version": "1", "rules": [{"allowTools": {"names": ["a"]}}, {"denyTools": {"names": ["a"]}}]}, ["POLICY_E009"]), ({"version": "1", "rules": [{"x": {}}]}, ["POLICY_E002"]),
        ({"version": "1", "rules": [{"maxToolArgsBytes": {"max": 0}}], "byte": {"z": 1}}, ["POLICY_E002", "POLICY_E002"]), *[(p, []) for p in P.PROFILES.values()],
    ],
)
def test_codes(doc, want):
    assert codes(doc) == want


def test_yaml():
    text = "version: '1'\nmode: warn # note\nrules:\n  - allowTools:\n      names: [search, \"read\"]\n  - maxToolArgsBytes:\n      max: 10\n  - sanitizeErrors: {}\n"
    assert P.parse_policy(text) == {"version": "1", "mode": "warn", "rules": [{"allowTools": {"names": ["search", "read"]}}, {"maxToolArgsBytes": {"max": 10}}, {"sanitizeErrors": {}}]}


def test_extends(tmp_path):
    for name, base in (("a", "b.json"), ("b", "a.json")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"extends": base}))
    with pytest.raises(P.InvalidPolicy, match="E005"):
        P.Guard.from_policy(str(tmp_path / "a.json"))
    for i in range(12):
        (tmp_path / f"{i}.json").write_text(json.dumps({"extends": f"{i + 1}.json"}))
    with pytest.raises(P.InvalidPolicy, match="E006"):
        P.Guard.from_policy(str(tmp_path / "0.json"))
    with pytest.raises(FileNotFoundError):
        P.resolve({"extends": "none.json"})
    doc = P.resolve({"extends": "agent-gate", "policyVersion": "9", "rules": [{"allowTools": {"names": ["x"]}}]})
    assert [next(iter(r)) for r in doc["rules"]] == ["allowTools", "maxToolArgsBytes", "sanitizeErrors"] and doc["rules"][0]["allowTools"]["names"] == ["x"]


def test_mode(monkeypatch):
    assert P.Guard.from_policy("agent-gate").mode == "block" and P.Guard.from_policy("agent-gate", "warn").mode == "warn"
    monkeypatch.setenv("GUARD_MODE", "audit")
    assert P.Guard.from_policy("agent-gate", "warn").mode == "audit"
    monkeypatch.setenv("GUARD_MODE", "nonsense")
    assert P.Guard.from_policy("agent-gate").mode == "block"


def test_diff():
    a, b = {"mode": "block", "rules": [{"redactSecrets": {}}, {"denyTools": {"names": ["a"]}}]}, {"mode": "warn", "rules": [{"denyTools": {"names": ["b"]}}, {"sanitizeErrors": {}}]}
    assert [(x["kind"], x["path"]) for x in P.diff(a, b)] == [("changed", "mode"), ("removed", "rules.redactSecrets"), ("changed", "rules.denyTools"), ("added", "rules.sanitizeErrors")]
    assert P.diff_text(P.diff(a, a)) == "No differences."
