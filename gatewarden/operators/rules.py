"""Rules over guard events.

A rule is a function of a DataFrame in pipeline form: the event columns, ``blocked`` (a tool policy has
replaced the event by an error and a finish), ``err`` (that error's message) and ``found``, the
violations so far.  Blocked events are only met by ``sanitize_errors``; they become two rows at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import EMAIL, PHONE, PLACEHOLDER, SAFE_ERROR, SECRETS, jvm
from ..functions.text import canonical_json, scan_and_replace

EVENT = ("type", "phase", "text", "id", "name", "args", "args_text", "message", "code", "reason", "extra")
FOUND = "array<struct<rule:string,message:string,tool:string,event:struct<" + ",".join(f"{c}:string" for c in EVENT) + ">>>"
Rule = Callable[[DataFrame, str], DataFrame]


def event_struct() -> Column:
    return F.struct(*[F.col(c).cast("string").alias(c) for c in EVENT])


def violation(rule: str, message: Column, event: bool = True) -> Column:
    ev = event_struct() if event else F.lit(None).cast("struct<" + ",".join(f"{c}:string" for c in EVENT) + ">")
    tool = F.when((F.col("type") == "tool_call") & (F.col("name") != ""), F.col("name")) if event else F.lit(None).cast("string")
    return F.array(F.struct(F.lit(rule).alias("rule"), message.alias("message"), tool.alias("tool"), ev.alias("event")))


def record(df: DataFrame, when: Column, rule: str, message: Column, event: bool = True) -> Column:
    return F.when(when, F.concat("found", violation(rule, message, event))).otherwise(F.col("found"))


def _redact(patterns, rule: str, label: str, placeholder: str) -> Rule:
    """Text of text and reasoning, args_text of tool calls, args of finished ones; one violation a field."""

    def run(df: DataFrame, mode: str) -> DataFrame:
        live = ~F.col("blocked")
        tool = F.col("type") == "tool_call"
        fields = (("text", live & F.col("type").isin("text", "reasoning")), ("args_text", live & tool), ("args", live & tool & (F.col("phase") == "done")))
        df = df.select("*", event_struct().alias("_before"))
        for field, when in fields:
            when = F.coalesce(when, F.lit(False)) & F.col(field).isNotNull()
            df = df.select("*", F.col(field).alias("_new"))
            df = scan_and_replace(df, "_new", patterns, placeholder, when)
            kept = F.col("_new")
            if field == "args":  # a replacement that breaks the JSON is not taken; the violation stays
                kept = F.when(F.try_parse_json("_new").isNotNull(), F.col("_new")).otherwise(F.col("args"))
            name = F.when(tool & (F.col("name") != ""), F.col("name"))
            note = F.struct(F.lit(rule).alias("rule"), F.format_string(f"Redacted %d {label} match(es)", F.col("_n").cast("int")).alias("message"), name.alias("tool"), F.col("_before").alias("event"))
            df = df.withColumns({"found": F.when(F.col("_n") > 0, F.concat("found", F.array(note))).otherwise(F.col("found")), field: F.when(F.col("_n") > 0, kept).otherwise(F.col(field))}).drop("_new", "_n")
        return df.drop("_before")

    return run


def redact_secrets(patterns=(), placeholder: str = PLACEHOLDER) -> Rule:
    return _redact((*SECRETS, *patterns), "redact_secrets", "secret", placeholder)


def redact_pii(email: bool = False, phone: bool = False) -> Rule:
    patterns = [p for p, on in ((EMAIL, email), (PHONE, phone)) if on]
    return _redact(patterns, "redact_pii", "PII", PLACEHOLDER) if patterns else identity


def identity(df: DataFrame, mode: str) -> DataFrame:
    return df


def _policy(df: DataFrame, mode: str, when: Column, rule: str, message: Column) -> DataFrame:
    when = F.coalesce(when & ~F.col("blocked") & (F.col("type") == "tool_call"), F.lit(False))
    df = df.select("*", when.alias("_hit"))
    out = {"found": record(df, F.col("_hit"), rule, message)}
    if mode != "audit":
        out |= {"blocked": F.col("blocked") | F.col("_hit"), "err": F.when(F.col("_hit"), "Policy violation").otherwise(F.col("err"))}
    return df.withColumns(out).drop("_hit")


def allow_tools(names) -> Rule:
    names = list(dict.fromkeys(names))
    return lambda df, mode: _policy(df, mode, (F.col("name") != "") & (~F.col("name").isin(*names) if names else F.lit(True)), "allow_tools", F.format_string('Tool "%s" is not in allowlist', "name"))


def deny_tools(names) -> Rule:
    names = list(dict.fromkeys(names))
    return lambda df, mode: _policy(df, mode, (F.col("name") != "") & F.col("name").isin(*names), "deny_tools", F.format_string('Tool "%s" is denied', "name")) if names else df


@dataclass(frozen=True)
class Pattern:
    """A matcher by regular expression."""

    regex: str

    def __call__(self, args: Column) -> Column:
        return args.rlike(jvm(self.regex))


@dataclass(frozen=True)
class Contains:
    """A matcher by substring."""

    part: str

    def __call__(self, args: Column) -> Column:
        return args.contains(self.part)


def block_tool_args(matcher: Callable[[Column], Column]) -> Rule:
    """Finished calls whose compact arguments match; a matcher maps their JSON column to a boolean column."""

    def run(df: DataFrame, mode: str) -> DataFrame:
        # only finished calls without args pay for the parser
        text = F.when((F.col("type") == "tool_call") & (F.col("phase") == "done"), F.coalesce("args", "args_text"))
        df = df.select("*", canonical_json(text).alias("_args"))
        return _policy(df, mode, (F.col("phase") == "done") & F.col("_args").isNotNull() & matcher(F.col("_args")), "block_tool_args", F.lit("Tool args matched block policy")).drop("_args")

    return run


def max_tool_args_bytes(most: int) -> Rule:
    """Bytes of a tool's deltas since its last finished call, checked when it finishes."""

    def run(df: DataFrame, mode: str) -> DataFrame:
        live = F.coalesce((F.col("type") == "tool_call") & ~F.col("blocked"), F.lit(False))
        key = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("__name:"), F.coalesce("name", F.lit(""))))
        df = df.select("*", live.alias("_live"), F.when(live, key).alias("_key"))
        # other events are dealt by their own index: none of them needs the rest
        part = ["stream_id", "_live", "_key", F.when(~F.col("_live"), F.col("event_index"))]
        w = Window.partitionBy(*part).orderBy("event_index", "out_seq")
        done = F.col("phase") == "done"
        df = df.select("*", F.coalesce(F.count_if(done).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_seg"))
        size = F.when(F.col("phase") == "delta", F.coalesce(F.octet_length("args_text"), F.lit(0))).otherwise(0)
        total = F.sum(size).over(Window.partitionBy(*part, "_seg").orderBy("event_index", "out_seq").rowsBetween(Window.unboundedPreceding, 0))
        df = df.select("*", total.alias("_total"))
        df = _policy(df, mode, done & (F.col("_total") > most), "max_tool_args_bytes", F.format_string(f"Tool args exceeded {most} bytes (%d)", "_total"))
        return df.drop("_live", "_key", "_seg", "_total")

    return run


def sanitize_errors(message: str = SAFE_ERROR, strip_code: bool = True) -> Rule:
    def run(df: DataFrame, mode: str) -> DataFrame:
        real = F.coalesce((F.col("type") == "error") & ~F.col("blocked"), F.lit(False))
        df = df.select("*", real.alias("_real"))
        hit = F.col("_real") | F.col("blocked")
        error = F.struct(*[F.lit({"type": "error"}.get(c)).cast("string").alias(c) if c != "message" else F.col("err").alias(c) for c in EVENT])
        ev = F.when(F.col("blocked"), error).otherwise(event_struct())
        note = F.struct(F.lit("sanitize_errors").alias("rule"), F.lit("Sanitized upstream error event").alias("message"), F.lit(None).cast("string").alias("tool"), ev.alias("event"))
        out = {"found": F.when(hit, F.concat("found", F.array(note))).otherwise(F.col("found")), "err": F.when(F.col("blocked"), F.lit(message)).otherwise(F.col("err")), "message": F.when(F.col("_real"), F.lit(message)).otherwise(F.col("message")), "extra": F.when(F.col("_real"), F.lit(None)).otherwise(F.col("extra"))}
        if strip_code:
            out["code"] = F.when(F.col("_real"), F.lit(None)).otherwise(F.col("code"))
        return df.withColumns(out).drop("_real")

    return run


def custom(transform: Callable[[DataFrame], DataFrame]) -> Rule:
    """A user's DataFrame transform of events: it may rewrite, drop (filter) or expand (explode, with out_seq)."""

    def run(df: DataFrame, mode: str) -> DataFrame:
        return transform(df)

    run.eager = True
    return run
