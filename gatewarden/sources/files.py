"""Sources: event files, SSE and text files, and tool manifests, all files in one plan."""

from __future__ import annotations

import json
import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json, normalize_sse
from ..operators.pipeline import as_events, guard_events
from ..operators.streams import byte_violations, guard_bytes
from ..plans.policy import Guard, parse_yaml

SKIP_DIRS = ("node_modules", ".git", "dist", "coverage", ".pnpm-store")
EVENT_JSON = "struct<type:string,phase:string,text:string,id:string,name:string,args:string,argsText:string,message:string,code:string,reason:string>"


def read_files(spark: SparkSession, paths, skip=SKIP_DIRS) -> DataFrame:
    """(file, rel, content) of all files below ``paths``; rel is the path below its root.

    Names of ``skip`` below a root are left out, as are missing paths; "-" is standard input.
    """
    out = None
    for p in [paths] if isinstance(paths, str) else paths:
        if p == "-":
            part = spark.createDataFrame([("-", "-", bytearray(sys.stdin.buffer.read()))], "file string, rel string, content binary")
        elif not exists(spark, p):
            continue
        else:
            root = _qualified(spark, p)
            rel = F.when(F.col("path") == root, F.element_at(F.split("path", "/"), -1)).otherwise(F.substring("path", len(root) + (not root.endswith("/")) + 1, 1 << 20))
            part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select(F.col("path").alias("file"), rel.alias("rel"), "content")
            part = part.where(~F.exists(F.split("rel", "/"), lambda x: x.isin(*skip)) | (F.col("file") == root)) if skip else part
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "file string, rel string, content binary") if out is None else out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return path == "-" or fs.exists(p)


def _qualified(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    return fs.makeQualified(p).toString()


def is_binary(content: Column) -> Column:
    """A zero byte among the first 512."""
    return F.instr(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), "\x00") > 0


def detect_format(file: Column, text: Column, given: str | None = None) -> Column:
    """jsonl, json (a .json file that begins like JSON), sse or text."""
    if given:
        return F.lit(given)
    low, head = F.lower(file), F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    return F.when(low.endswith(".jsonl"), "jsonl").when(low.endswith(".json") & (head.startswith("[") | head.startswith("{")), "json").when(low.endswith(".sse"), "sse").otherwise("text")


def parse_events(files: DataFrame) -> DataFrame:
    """Guard events of (file, text, format) rows in json (an array or {"events": [...]}) or jsonl."""
    raw = "array<string>"
    array = F.when(F.ltrim("text").startswith("["), F.from_json("text", raw)).otherwise(F.from_json(F.get_json_object("text", "$.events"), raw))
    ok = F.when((F.col("format") == "json") & array.isNull(), F.raise_error(F.lit("JSON must be GuardEvent[] or { events: [] }"))).otherwise(array)
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(F.regexp_replace(x, "\r", ""))), lambda x: x != "")
    e = files.where("format in ('json', 'jsonl')").select("file", F.posexplode(F.when(F.col("format") == "json", ok).otherwise(lines)).alias("event_index", "raw"))
    e = e.select(F.col("file").alias("stream_id"), "event_index", F.from_json("raw", EVENT_JSON).alias("e"), F.get_json_object("raw", "$.args").alias("_a"))
    e = e.select("stream_id", "event_index", "e.*")
    return as_events(e.select("stream_id", "event_index", *[F.col(c) for c in ("type", "phase", "text", "id", "name", "args", "message", "code", "reason")], F.col("argsText").alias("args_text")))


def scan_files(spark: SparkSession, paths, guard: Guard, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(detail, summary) of a policy over files: event files by its rules, others by its byte options."""
    files = read_files(spark, paths).where(~is_binary(F.col("content")))
    files = files.select("file", F.decode("content", "UTF-8").alias("text"), "content")
    files = files.select("*", detect_format(F.col("file"), F.col("text"), fmt).alias("format"))
    return scan_tables(files, guard)


def scan_tables(files: DataFrame, guard: Guard) -> tuple[DataFrame, DataFrame]:
    """The same over rows (file, text, format)."""
    events = guard_events(parse_events(files), guard.rules, guard.mode, guard.policy_version).violations
    body = F.when(F.col("format") == "sse", normalize_sse(F.col("text"))).otherwise(F.col("text"))
    byte = guard.guard_bytes(files.where("format not in ('json', 'jsonl')").select(F.col("file").alias("stream_id"), F.encode(body, "UTF-8").alias("body")))
    found = events.select("stream_id", "rule", "message").unionByName(byte_violations(byte).select("stream_id", "rule", "message"))
    detail = found.select(F.col("stream_id").alias("file"), "rule", "message", F.lit(guard.mode).alias("mode"), F.lit(guard.policy_version).cast("string").alias("policy_version"))
    total = detail.agg(F.count("*").alias("violations"), F.count_if(F.col("rule").startswith("redact")).alias("redactions"))
    return detail, files.agg(F.count("*").alias("files")).join(total).select("files", "violations", "redactions", F.lit(guard.mode).alias("mode"))


def report_text(detail: DataFrame, summary: DataFrame, guard: Guard) -> list[str]:
    """Lines of a scan report, for a terminal."""
    s = summary.first()
    out = [f"scan: {s['files']} files, {s['violations']} violations, {s['redactions']} redactions"]
    if guard.policy_version:
        out.append(f"policy: {guard.policy_version} (mode {guard.mode})")
    return out + [r[0] for r in detail.select(F.format_string("  %s: %s — %s", "file", "rule", "message").alias("x")).orderBy("x").collect()]


# ---- manifests ---------------------------------------------------------------------------------

MANIFEST = "file string, tools array<string>, strings array<struct<field:string,value:string,line:int>>, error string"
_SCANNED = ("description", "examples", "args")


def manifest_path(rel: Column) -> Column:
    """Paths that name a tool manifest."""
    named = (rel == "tools/manifest.json") | rel.endswith("/tools/manifest.json") | rel.endswith("agent.tools.yaml") | rel.endswith("agent.tools.yml")
    return named | rel.rlike(r"/tools/[^/]+\.(json|yaml|yml)$") | (rel.rlike(r"(?i)tools.*\.json$") & rel.contains("tools"))


def _strings(value, path: str):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _strings(v, f"{path}[{i}]")
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _strings(v, f"{path}.{k}")


def _entries(x) -> list:
    return [t for t in x if isinstance(t, (dict, list))] if isinstance(x, list) else []


def _name(t) -> str | None:
    if not isinstance(t, dict):
        return None
    name = t.get("name")
    if name is None and isinstance(t.get("function"), dict):
        name = t["function"].get("name")
    return name if isinstance(name, str) and name else None


def _read(text: str, file: str):
    return parse_yaml(text) if file.lower().endswith((".yaml", ".yml")) else json.loads(text)


def parse_manifest(file: str, text: str) -> tuple:
    """(file, tools, strings with lines, error); the strings of entries without a name count too."""
    try:
        doc = _read(text, file)
        if not isinstance(doc, (dict, list)):
            raise ValueError(f"Invalid manifest document: {file}")
    except Exception as e:  # whatever a parser says becomes a finding
        return file, [], [], str(e) or "Failed to parse manifest"
    doc = doc if isinstance(doc, dict) else {}
    entries = _entries(doc.get("tools"))
    if not any(map(_name, entries)):
        components, paths = doc.get("components"), doc.get("paths")
        more = [components.get("x-tools")] if isinstance(components, dict) else []
        more += [op.get("x-tools") for item in paths.values() if isinstance(item, dict) for op in item.values() if isinstance(op, dict)] if isinstance(paths, dict) else []
        # there a tool's name is its own, not that of a function
        entries += [t if not isinstance(t, dict) else {k: v for k, v in t.items() if k != "function"} for x in more for t in _entries(x)]
    found, at = [], 0
    for t in entries:
        if not isinstance(t, dict):
            continue
        schema = t.get("inputSchema")
        for k, v in [*((k, t.get(k)) for k in _SCANNED), ("inputSchema.default", schema.get("default") if isinstance(schema, dict) else None)]:
            for field, s in _strings(v, k):
                i = text.find(s, at)  # lines are sought forward only
                found.append((field, s, text.count("\n", 0, i) + 1 if i >= 0 else None))
                at = i + len(s) if i >= 0 else at
    return file, [n for n in map(_name, entries) if n], found, None


def validate_manifest(doc) -> list[tuple[str, str]]:
    """(path, message) of what keeps a document from being a version 1 manifest."""
    if not isinstance(doc, (dict, list)):
        return [("", "Manifest must be a JSON object")]
    doc = doc if isinstance(doc, dict) else {}
    e = [] if doc.get("version") == "1" else [("version", 'Expected version "1"')]
    tools = doc.get("tools")
    if not isinstance(tools, list):
        return [*e, ("tools", "tools must be an array")]
    e += [] if tools else [("tools", "tools must not be empty")]
    for i, t in enumerate(tools):
        if not isinstance(t, (dict, list)):
            e.append((f"tools[{i}]", "tool entry must be an object"))
        elif not (isinstance(t, dict) and isinstance(t.get("name"), str) and t["name"]):
            e.append((f"tools[{i}].name", "name must be a non-empty string"))
    return e


def manifest_errors(files: DataFrame) -> DataFrame:
    """(file, path, message): what is wrong with the manifests of (file, text) rows."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"]):
                try:
                    rows += [(file, *e) for e in validate_manifest(_read(text, file))]
                except Exception as e:  # whatever a parser says
                    rows.append((file, "", str(e)))
            yield pd.DataFrame(rows, columns=["file", "path", "message"])

    return files.select("file", "text").mapInPandas(run, "file string, path string, message string")


def manifests(files: DataFrame) -> DataFrame:
    """Manifests of (file, text) rows."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [parse_manifest(f, t) for f, t in zip(pdf["file"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["file", "tools", "strings", "error"])

    return files.select("file", "text").mapInPandas(run, MANIFEST)


#: Fixed value: what a walk leaves out besides what it is told to.
DEFAULT_EXCLUDE = ("test/fixtures/policies/invalid",)


def manifest_files(spark: SparkSession, root: str, include=(), exclude=(), manifest: str | None = None) -> DataFrame:
    """(file, text) of the manifests below ``root`` by whole path prefixes, or of the one file that is named."""
    if manifest:
        return read_files(spark, manifest).select("file", F.decode("content", "UTF-8").alias("text"))
    files = read_files(spark, root).where(manifest_path(F.col("rel")))
    for kept, names in ((True, tuple(include)), (False, (*DEFAULT_EXCLUDE, *exclude))):
        if names:
            hit = F.lit(False)
            for n in (n.removesuffix("/") for n in names):
                hit = hit | (F.col("rel") == n) | F.col("rel").startswith(n + "/")
            files = files.where(hit if kept else ~hit)
    return files.select("file", F.decode("content", "UTF-8").alias("text"))
