"""Command line: exit codes and output."""

import io
import json

import pytest

from gatewarden import cli


@pytest.fixture
def run(spark, capsys):
    def go(*args):
        code = cli.run([str(a) for a in args])
        return code, capsys.readouterr().out.strip()

    return go


def test_scan(run, tmp_path, monkeypatch):
    root = tmp_path / "dist"
    root.mkdir()
    (root / "a.txt").write_text("key sk-test-1234567890")
    code, out = run("scan", "--policy", "proxy-strict", "--json", root)
    assert code == 1 and json.loads(out)["summary"]["violations"] == 1
    (root / "a.txt").write_text("nothing")
    assert run("scan", "--policy", "proxy-strict", root)[0] == 0
    assert run("scan", "--policy", "proxy-strict", tmp_path / "none")[0] == 2
    for text, fmt in (("key sk-test-1234567890", "text"), ('{"type":"text","phase":"done","text":"sk-test-1234567890"}', "jsonl")):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
        code, out = run("scan", "--policy", "proxy-strict", "--stdin-format", fmt, "--json", "-")
        assert code == 1 and json.loads(out)["summary"] == {"files": 1, "violations": 1, "redactions": 1, "mode": "block"}


def test_audit(run, tmp_path):
    (tmp_path / "tools").mkdir()
    f = tmp_path / "tools" / "manifest.json"
    f.write_text('{"version": "1",\n "tools": [{"name": "bash", "description": "rm -rf /"}]}')
    code, out = run("audit", "static", "--root", tmp_path, "--policy", "proxy-strict")
    assert code == 1 and out.startswith("Static audit: 1 manifest(s), 1 tool(s)\n[error] DRIFT_DENY bash @") and "[warning] D002 description" in out
    code, out = run("audit", "static", "--root", tmp_path, "--policy", "proxy-strict", "--quiet")
    assert code == 1 and out.count("\n") == 1 and "warning" not in out
    code, out = run("audit", "drift", "--manifest", f, "--policy", "audit-only", "--format", "json")
    assert code == 0 and json.loads(out)["summary"]["mode"] == "audit"
    assert run("audit", "validate-manifest", "--manifest", f) == (0, "valid")
    f.write_text('{"tools": [{"name": ""}]}')
    code, out = run("audit", "validate-manifest", "--root", tmp_path)
    assert code == 1 and "tools[0].name" in out and "version" in out
    assert run("audit", "static", "--root", tmp_path / "none")[0] == 2


def test_policies(run, tmp_path):
    assert run("profiles", "list")[1].split() == ["agent-gate", "proxy-strict", "audit-only"] == run("profiles")[1].split()
    assert json.loads(run("profiles", "show", "audit-only")[1])["mode"] == "audit" and run("profiles", "show", "x")[0] == 2
    assert json.loads(run("doctor", "--json", "agent-gate")[1])["rules"] == 3
    p = tmp_path / "p.json"
    p.write_text('{"extends": "agent-gate", "mode": "warn"}')
    assert json.loads(run("resolve", "--json", p)[1])["mode"] == "warn" and run("validate", p) == (0, "valid")
    assert run("diff", p, "agent-gate", "--check")[0] == 1 and run("diff", p, p, "--check") == (0, "No differences.")
    p.write_text('{"version": "1", "rules": [{"allowTools": ["a"]}]}')
    assert run("validate", p)[0] == 1 and run("validate", tmp_path / "none.json")[0] == 2
