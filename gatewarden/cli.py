"""Command line: validate, resolve, diff, profiles, scan, doctor and audit.

Exit codes: 0 clean, 1 findings, 2 usage or unreadable input, 3 (audit) internal error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .plans import policy as P


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gatewarden").getOrCreate()


def _document(path: str) -> dict:
    if path in P.PROFILES:
        return P.PROFILES[path]
    with open(path, encoding="utf-8") as f:
        return P.resolve(P.parse_policy(f.read(), path), os.path.dirname(path))


def _audit(a) -> int:
    from .operators import audit as A
    from .sources import files as S

    spark = _session()
    paths = list(a.policy or [])
    if a.policy_dir:
        paths += sorted(os.path.join(a.policy_dir, f) for f in os.listdir(a.policy_dir) if f.endswith((".json", ".yaml", ".yml")))
    if not S.exists(spark, a.manifest or a.root):
        raise FileNotFoundError(a.manifest or a.root)
    docs = {p: _document(p) for p in paths}
    files = S.manifest_files(spark, a.root, a.include or (), a.exclude or (), a.manifest)
    if a.what == "validate-manifest":
        bad = S.manifest_errors(files).orderBy("file", "path").collect()
        print("\n".join(f"{r['file']}: {r['path']}: {r['message']}" if r["path"] else f"{r['file']}: {r['message']}" for r in bad) or "valid")
        return int(bool(bad))
    # the findings are read by people: they are made once and kept
    m = S.manifests(files).persist()
    found = A.static_scan(m, docs)
    if a.what == "drift":
        found = found.where("kind = 'drift'")
    found = (A.strict(found) if a.strict else found).persist()
    version = next((d.get("policyVersion") for d in docs.values()), None)
    s = A.static_summary(m, found, a.mode or "audit", version).first()
    if a.format == "sarif":
        print(json.dumps(A.sarif(spark, found), indent=1))
    elif a.format == "json":
        rows = A.report_lines(found)
        print(json.dumps({"summary": s.asDict(), "findings": [r["row"] for r in rows.orderBy(*rows.columns[:-1]).collect()]}))
    else:
        rows = A.annotations(found) if a.format == "github" else A.report_lines(found, a.quiet)
        lines = [r[-1] for r in rows.orderBy(*rows.columns[:-1]).collect()]
        head = [] if a.quiet or a.format == "github" else [f"Static audit: {s['manifests']} manifest(s), {s['tools_declared']} tool(s)"]
        print("\n".join(head + (lines or ([] if a.quiet else ["No findings."]))))
    found.unpersist()
    m.unpersist()
    return int((s["errors_strict"] if a.strict else s["errors"]) > 0)


def _scan(a) -> int:
    from .sources.files import exists, report_text, scan_files

    spark, guard = _session(), P.Guard.from_policy(a.policy, a.mode)
    for path in a.paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)
    detail, summary = scan_files(spark, a.paths, guard, a.format or (a.stdin_format if "-" in a.paths else None))
    detail = detail.persist()
    n = summary.first()
    if a.json:
        print(json.dumps({"summary": n.asDict(), "violations": [r.asDict() for r in detail.collect()]}))
    else:
        print("\n".join(report_text(detail, summary, guard)))
    detail.unpersist()
    return int(n["violations"] > 0)


def _doctor(a) -> int:
    import pyspark

    found = {"python": sys.version.split()[0], "pyspark": pyspark.__version__}
    if a.policy:
        guard = P.Guard.from_policy(a.policy)
        found |= {"policy": a.policy, "mode": guard.mode, "rules": len(guard.rules)}
    print(json.dumps(found) if a.json else ", ".join(f"{k} {v}" for k, v in found.items()))
    return 0


def _profiles(a) -> int:
    if a.words[:1] == ["show"] and len(a.words) == 2:
        print(json.dumps(P.PROFILES[a.words[1]], indent=1))
    elif a.words in ([], ["list"]):
        print("\n".join(P.PROFILES))
    elif len(a.words) == 1:
        print(json.dumps(P.PROFILES[a.words[0]], indent=1))
    else:
        raise ValueError("profiles list, or profiles show NAME")
    return 0


def run(argv=None) -> int:
    p = argparse.ArgumentParser(prog="gatewarden")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("validate").add_argument("policy")
    r = sub.add_parser("resolve")
    r.add_argument("policy")
    r.add_argument("--json", action="store_true")
    d = sub.add_parser("diff")
    d.add_argument("a")
    d.add_argument("b")
    d.add_argument("--check", action="store_true")
    d.add_argument("--json", action="store_true")
    sub.add_parser("profiles").add_argument("words", nargs="*")
    s = sub.add_parser("scan")
    s.add_argument("--policy", required=True)
    s.add_argument("--mode")
    s.add_argument("--format")
    s.add_argument("--stdin-format", choices=("json", "jsonl", "sse", "text"), default="text")
    s.add_argument("--json", action="store_true")
    s.add_argument("paths", nargs="+")
    o = sub.add_parser("doctor")
    o.add_argument("policy", nargs="?")
    o.add_argument("--json", action="store_true")
    u = sub.add_parser("audit")
    u.add_argument("what", choices=("validate-manifest", "drift", "static"))
    u.add_argument("--root", default=".")
    u.add_argument("--manifest")
    u.add_argument("--policy", action="append")
    u.add_argument("--policy-dir")
    u.add_argument("--include", action="append")
    u.add_argument("--exclude", action="append")
    u.add_argument("--mode")
    u.add_argument("--strict", action="store_true")
    u.add_argument("--quiet", action="store_true")
    u.add_argument("--format", choices=("text", "github", "sarif", "json"), default="text")
    a = p.parse_args(argv)
    try:
        if a.command == "validate":
            errors = P.validate(_document(a.policy))[1]
            print("\n".join(map(str, errors)) or "valid")
            return int(bool(errors))
        if a.command == "resolve":
            doc = _document(a.policy)
            print(json.dumps(doc) if a.json else json.dumps(doc, indent=1))
            return 0
        if a.command == "diff":
            entries = P.diff(_document(a.a), _document(a.b))
            print(json.dumps(entries) if a.json else P.diff_text(entries))
            return int(a.check and bool(entries))
        return {"profiles": _profiles, "doctor": _doctor, "scan": _scan, "audit": _audit}[a.command](a)
    except (OSError, KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(e, file=sys.stderr)
        return 3 if a.command == "audit" else 2


if __name__ == "__main__":
    sys.exit(run())
