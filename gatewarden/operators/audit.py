"""Static audit: tool manifests against policies, dangerous strings, reports and SARIF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import DANGEROUS, jvm

#: Order of findings in reports.
KINDS = ("drift", "dangerous", "blockToolArgs")
FINDING = ("kind", "code", "severity", "file", "tool", "field", "line", "message", "policy", "place")
# Rule catalogue of SARIF output: id, short description, default level.
CATALOG = (
    ("DRIFT_ALLOW", "Manifest tool not in policy allowTools", "error"),
    ("DRIFT_DENY", "Denied tool declared in manifest", "error"),
    ("DRIFT_POLICY_ONLY", "Policy allowTools entry missing from manifest", "warning"),
    *((code, message, "warning") for code, _, _, message in DANGEROUS),
    ("BLOCK_ARGS_STATIC", "Static blockToolArgs pattern in manifest text", "warning"),
)


def _finding(kind: str, code, severity: str, message: Column, **cols: Column) -> Column:
    none = {"line": "int", "place": "long"}
    given = {"kind": F.lit(kind), "code": F.lit(code), "severity": F.lit(severity), "message": message, "file": F.col("file"), **cols}
    return F.struct(*[(given[c] if c in given else F.lit(None)).cast(none.get(c, "string")).alias(c) for c in FINDING])


NONE = "array<struct<" + ",".join(f"{c}:{ {'line': 'int', 'place': 'bigint'}.get(c, 'string') }" for c in FINDING) + ">>"


def _all(arrays) -> Column:
    return F.concat(F.array().cast(NONE), *arrays)


def tool_sets(docs: dict[str, dict]) -> dict[str, tuple[list[str], list[str]]]:
    """Allowed and denied tools of each policy that has either list; repeated rules count together."""
    out = {}
    for policy, doc in docs.items():
        lists = {k: list(dict.fromkeys(n for r in doc.get("rules") or [] if k in r for n in (r[k]["names"] if isinstance(r[k], dict) else r[k]))) for k in ("allowTools", "denyTools")}
        if any(k in r for r in doc.get("rules") or [] for k in lists):
            out[policy] = lists["allowTools"], lists["denyTools"]
    return out


def matchers(docs: dict[str, dict]) -> list[tuple]:
    """(policy, pattern or None, contains or None) of every blockToolArgs rule."""
    return [(name, r["blockToolArgs"].get("pattern"), r["blockToolArgs"].get("contains")) for name, d in docs.items() for r in d.get("rules") or [] if "blockToolArgs" in r]


def _drift(docs: dict[str, dict]) -> Column:
    """Findings of one manifest (file, tools) under all policies: lists of policies are literals of the plan."""
    tools, out = F.col("tools"), []
    names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    for policy, (allow, deny) in tool_sets(docs).items():
        told = lambda which, code, severity, message, places: F.transform(which, lambda t: _finding("drift", code, severity, F.concat(F.lit('Tool "'), t, F.lit(message)), tool=t, policy=F.lit(policy), place=F.array_position(places, t) - 1))  # noqa: B023, E731
        if allow:
            out.append(told(F.array_except(tools, names([*allow, *deny])), "DRIFT_ALLOW", "error", '" declared in manifest but not in policy allowTools', tools))
            out.append(told(F.array_except(names(allow), tools), "DRIFT_POLICY_ONLY", "warning", '" in policy allowTools but missing from manifest', names(allow)))
        if deny:
            out.append(told(F.array_intersect(tools, names(deny)), "DRIFT_DENY", "error", '" is declared in manifest but denied by policy', tools))
    return _all(out)


def _dangerous(s) -> Column:
    return F.array_compact(F.array(*[F.when(s["value"].rlike(jvm(p, i)), _finding("dangerous", code, "warning", F.lit(m), field=s["field"], line=s["line"])) for code, p, i, m in DANGEROUS]))


def _block_args(s, found) -> Column:
    by: dict[str, Column] = {}
    for policy, pattern, contains in found:
        m = s["value"].rlike(jvm(pattern)) if pattern is not None else s["value"].contains(contains) if contains else F.lit(False)
        by[policy] = by[policy] | m if policy in by else m
    note = lambda p: _finding("blockToolArgs", "BLOCK_ARGS_STATIC", "error", F.lit("Manifest text matches policy blockToolArgs rule"), field=s["field"], line=s["line"], policy=F.lit(p))
    return F.array_compact(F.array(*[F.when(m, note(p)) for p, m in by.items()])) if by else F.array().cast(NONE)


def drift(manifests: DataFrame, docs: dict[str, dict]) -> DataFrame:
    """Declared tools that no list of a policy names, that it denies, and allowed ones that are missing."""
    return manifests.where("error is null").select(F.inline(_drift(docs)))


def dangerous(strings: DataFrame) -> DataFrame:
    """(file, field, value, line) against the catalogue: one finding for each pattern that matches."""
    return strings.select(F.inline(_dangerous({c: F.col(c) for c in ("value", "field", "line")})))


def block_args_static(strings: DataFrame, found) -> DataFrame:
    """Strings that a policy's blockToolArgs would match: one finding a string and policy."""
    return strings.select(F.inline(_block_args({c: F.col(c) for c in ("value", "field", "line")}, found)))


def static_scan(manifests: DataFrame, docs: dict[str, dict]) -> DataFrame:
    """All findings of manifests (file, tools, strings, error) under the policies, in one pass over the manifests."""
    broken = F.array(_finding("dangerous", "MANIFEST_PARSE_ERROR", "error", F.col("error"), field=F.lit("(manifest)")))
    found = matchers(docs)
    strings = [F.flatten(F.transform("strings", lambda s: _dangerous(s))), F.flatten(F.transform("strings", lambda s: _block_args(s, found)))]
    return manifests.select(F.inline(F.when(F.col("error").isNotNull(), broken).otherwise(_all([_drift(docs), *strings]))))


def strict(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", F.when(F.col("code") == "DRIFT_POLICY_ONLY", "error").otherwise(F.col("severity")))


def static_summary(manifests: DataFrame, findings: DataFrame, mode: str = "audit", policy_version: str | None = None) -> DataFrame:
    """One row; two aggregates of one row each meet."""
    counts = findings.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in zip(KINDS, ("drift", "dangerous", "block_tool_args"))], F.count_if(_error(False)).alias("errors"), F.count_if(_error(True)).alias("errors_strict"))
    tools = manifests.agg(F.count("*").alias("manifests"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("tools"))), F.lit(0)).cast("long").alias("tools_declared"))
    return tools.join(counts).select("*", F.lit(mode).alias("mode"), F.lit(policy_version).cast("string").alias("policy_version"))


def _error(strict_: bool) -> Column:
    """What makes an audit fail; strict audits also fail by dangerous strings and unused allowances."""
    base = ((F.col("kind") != "dangerous") & (F.col("severity") == "error")) | (F.col("code") == "MANIFEST_PARSE_ERROR")
    return base | (F.col("kind") == "dangerous") | (F.col("code") == "DRIFT_POLICY_ONLY") if strict_ else base


def _ordered(findings: DataFrame) -> list[Column]:
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    return [rank.alias("rank"), F.col("file"), F.col("policy"), F.col("code"), F.col("place"), F.col("field"), F.col("line")]


def report_lines(findings: DataFrame, quiet: bool = False) -> DataFrame:
    """(rank, file, ..., row): the text of each finding, of errors only if ``quiet``; order by the columns before it."""
    findings = findings.where("severity = 'error'") if quiet else findings
    what = F.when(F.col("kind") == "drift", F.col("tool")).otherwise(F.col("field"))
    return findings.select(*_ordered(findings), F.format_string("[%s] %s %s @ %s: %s", "severity", "code", what, "file", "message").alias("row"))


def annotations(findings: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    return findings.select(*_ordered(findings), F.format_string("::%s file=%s,line=%d::%s", level, "file", F.coalesce("line", F.lit(1)), "message").alias("annotation"))


def sarif_results(findings: DataFrame) -> DataFrame:
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("code").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"))
    return findings.select(*_ordered(findings), F.to_json(result).alias("result"))


def sarif_rules(spark, findings: DataFrame) -> DataFrame:
    """Catalogue entries that results use, in the catalogue's order."""
    catalog = spark.createDataFrame([(i, *c) for i, c in enumerate(CATALOG)], "ordinal int, id string, text string, level string")
    return catalog.join(findings.select(F.col("code").alias("id")).distinct(), "id", "left_semi").select("ordinal", "id", "text", "level")


def sarif(spark, findings: DataFrame, version: str = "1.0.0") -> dict:
    """A SARIF 2.1.0 document; findings of an audit are read by people and fit the driver."""
    import json

    rules = [{"id": r["id"], "shortDescription": {"text": r["text"]}, "defaultConfiguration": {"level": r["level"]}} for r in sarif_rules(spark, findings).orderBy("ordinal").collect()]
    rows = sarif_results(findings)
    results = [json.loads(r["result"]) for r in rows.orderBy(*rows.columns[:-1]).collect()]
    driver = {"name": "gatewarden", "version": version, "rules": rules}
    return {"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}


def policy_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, path, before, after, place) of two document tables (path, value, place): fields and rules that differ."""
    x, y = a.select("path", F.col("value").alias("before"), F.col("place").alias("pa")), b.select("path", F.col("value").alias("after"), F.col("place").alias("pb"))
    j = x.join(y, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    rule = F.col("path").startswith("rules.")
    kind = F.when(rule & F.col("after").isNull(), "removed").when(rule & F.col("before").isNull(), "added").otherwise("changed")
    return j.select(kind.alias("kind"), "path", "before", "after", F.coalesce("pa", F.col("pb") + 100_000).alias("place"))
