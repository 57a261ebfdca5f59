"""Byte guard: whole streams of binary chunks, redacted and sanitised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import BYTE_MESSAGE, PLACEHOLDER, SAFE_ERROR, SECRETS, literal
from ..functions.text import scan_and_replace


def chunked(df: DataFrame, text: str, stream: str, size: int) -> DataFrame:
    """(stream_id, chunk_index, chunk): texts as streams of ``size`` bytes a chunk."""
    b = df.select(F.col(stream).alias("stream_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("b"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / size)).cast("int")
    return b.select("stream_id", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("stream_id", F.col("i").cast("long").alias("chunk_index"), F.substring("b", F.col("i") * size + 1, F.lit(size)).alias("chunk"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """(stream_id, body): the bytes of each stream in the order of its chunks."""
    # bytes as Latin-1 join in one step, whatever they are
    parts = chunks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.decode("chunk", "ISO-8859-1").alias("c")))).alias("p"))
    return parts.select("stream_id", F.encode(F.array_join(F.transform("p", lambda x: x["c"]), ""), "ISO-8859-1").alias("body"))


def guard_bytes(bodies: DataFrame, secrets: bool = True, errors: bool = False, patterns=(), placeholder: str = PLACEHOLDER, message: str = SAFE_ERROR) -> DataFrame:
    """(stream_id, body, redactions, sanitized): secrets first, then error messages; other bytes stay as they are.

    Bytes are read as Latin-1, one character each, so that text that is not UTF-8 survives.
    """
    df = bodies.select("stream_id", F.decode("body", "ISO-8859-1").alias("_t"), F.lit(0).alias("redactions"))
    if secrets:
        df = scan_and_replace(df, "_t", (*SECRETS, *patterns), placeholder, counts="redactions")
    df = df.select("*", (F.regexp_count("_t", F.lit(BYTE_MESSAGE)) if errors else F.lit(0)).alias("sanitized"))
    if errors:
        df = df.withColumn("_t", F.regexp_replace("_t", BYTE_MESSAGE, literal(f'"message":"{message}"')))
    return df.select("stream_id", F.encode("_t", "ISO-8859-1").alias("body"), "redactions", "sanitized")


def pipe(*transforms):
    """Left-to-right composition of functions on (stream_id, body, ...) tables; none is the identity."""

    def run(df: DataFrame) -> DataFrame:
        for t in transforms:
            df = t(df)
        return df

    return run


def byte_violations(guarded: DataFrame, mode: str = "warn", policy_version: str | None = None) -> DataFrame:
    """At most one row a stream and rule."""
    note = lambda n, rule, m: F.when(F.col(n) > 0, F.struct(F.lit(rule).alias("rule"), m.alias("message")))
    both = F.array(note("redactions", "redact_secrets", F.format_string("Redacted %d secret match(es)", F.col("redactions").cast("int"))), note("sanitized", "sanitize_errors", F.lit("Sanitized error payload in byte stream")))
    v = guarded.select("stream_id", F.explode_outer(F.array_compact(both)).alias("v")).where("v is not null")
    return v.select("stream_id", "v.*", F.lit(mode).alias("mode"), F.lit(policy_version).cast("string").alias("policy_version"))
