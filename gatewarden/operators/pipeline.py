"""Event guard: an ordered list of rules over event streams, with violations and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import EVENT, FOUND

MODES = ("block", "warn", "audit")
REDACTIONS = ("redact_secrets", "redact_pii")


@dataclass
class GuardResult:
    """Lazy results: rewritten events, the violation log, and a summary of every stream."""

    events: DataFrame
    violations: DataFrame
    summary: DataFrame


def as_events(df: DataFrame, stream: str = "stream_id", order=("event_index",)) -> DataFrame:
    """Missing event columns as nulls, and event_index by ``order`` if there is none."""
    from pyspark.sql import Window

    if "event_index" not in df.columns:
        df = df.withColumn("event_index", F.row_number().over(Window.partitionBy(stream).orderBy(*order)) - 1)
    have = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EVENT]
    return df.select(F.col(stream).alias("stream_id"), F.col("event_index").cast("long").alias("event_index"), *have)


def _expand(df: DataFrame) -> DataFrame:
    """Blocked events as an error and a finish."""
    row = lambda seq, t, m, r: F.struct(F.lit(seq).alias("out_seq"), *[(F.lit(t) if c == "type" else m if c == "message" else F.lit(r) if c == "reason" else F.lit(None)).cast("string").alias(c) for c in EVENT])
    two = F.array(row(0, "error", F.col("err"), None), row(1, "finish", F.lit(None), "policy_violation"))
    one = F.array(F.struct(F.col("out_seq"), *[F.col(c) for c in EVENT]))
    return df.select("stream_id", "event_index", "found", F.explode_outer(F.when(F.col("blocked"), two).otherwise(one)).alias("e")).select("stream_id", "event_index", "e.*", F.when(F.col("e.out_seq") == 0, F.col("found")).otherwise(F.array().cast(FOUND)).alias("found"))


def _opened(df: DataFrame) -> DataFrame:
    return df.select("*", F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("err"))


def guard_events(df: DataFrame, rules, mode: str = "warn", policy_version: str | None = None) -> GuardResult:
    """Rules in order over events in the form of ``as_events``; without rules the events pass as they are.

    What the rules before a custom one have found is logged before that runs: it may drop or multiply events, not
    their violations.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    state = _opened(df.select("stream_id", "event_index", F.lit(0).alias("out_seq"), *EVENT, F.array().cast(FOUND).alias("found")))
    logs = []
    for rule in rules:
        if getattr(rule, "eager", False):
            state = _expand(state)
            logs.append(_log(state, len(logs)))
            kept = rule(state.withColumn("found", F.array().cast(FOUND)), mode)
            state = _opened(kept.select("stream_id", "event_index", "out_seq", *EVENT, "found"))
        else:
            state = rule(state, mode)
    # the expansion reads found and blocked, which long chains build: it is the last step of one plan
    events = _expand(state).select("stream_id", "event_index", "out_seq", *EVENT)
    found = violations([*logs, _log(state, len(logs))], mode, policy_version)
    return GuardResult(events, found, summarize(df.select("stream_id"), found, mode, policy_version))


def _log(state: DataFrame, part: int) -> DataFrame:
    return state.select("stream_id", "event_index", "out_seq", F.lit(part).alias("part"), F.posexplode_outer("found").alias("seq", "v")).where("v is not null")


def violations(logs: list[DataFrame], mode: str, policy_version: str | None) -> DataFrame:
    """The violation log; seq counts an event's violations in the order they were found."""
    from pyspark.sql import Window

    v = logs[0]
    for more in logs[1:]:
        v = v.unionByName(more)
    if len(logs) > 1:
        v = v.withColumn("seq", F.row_number().over(Window.partitionBy("stream_id", "event_index").orderBy("part", "out_seq", "seq")) - 1)
    return v.select("stream_id", "event_index", "seq", "v.rule", "v.message", F.lit(mode).alias("mode"), F.lit(policy_version).cast("string").alias("policy_version"), "v.tool", "v.event")


def summarize(streams: DataFrame, found: DataFrame, mode: str, policy_version: str | None) -> DataFrame:
    """One row a stream: violations by rule, tools touched, redactions; streams without violations too."""
    by_rule = found.groupBy("stream_id", "rule").agg(F.count("*").alias("n"), F.collect_set("tool").alias("tools"))
    per = by_rule.groupBy("stream_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("counts_by_rule"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("tools_touched"),
        F.sum("n").alias("violations"),
        F.coalesce(F.sum(F.when(F.col("rule").isin(*REDACTIONS), F.col("n"))), F.lit(0)).alias("redactions"),
    )
    out = streams.distinct().join(per, "stream_id", "left")
    return out.select(
        "stream_id", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("counts_by_rule", F.create_map().cast("map<string,bigint>")).alias("counts_by_rule"),
        F.coalesce("tools_touched", F.array().cast("array<string>")).alias("tools_touched"), F.coalesce("redactions", F.lit(0)).alias("redactions"), F.lit(policy_version).cast("string").alias("policy_version"), F.lit(mode).alias("mode"))


def executed_tools(events: DataFrame) -> DataFrame:
    """Finished tool calls before a stream's first policy violation: what an agent loop would run."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("event_index", "out_seq").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.max(F.coalesce((F.col("type") == "finish") & (F.col("reason") == "policy_violation"), F.lit(False))).over(w)
    return events.select("*", stop.alias("stopped")).where("type = 'tool_call' and phase = 'done' and not stopped").drop("stopped")
