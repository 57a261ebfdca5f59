"""Token counts of flat, unindexed token files by a vectorised separator scan.

A file is a plain run of little-endian ids in which an end id closes each document; nothing tells where documents
begin.  Any part of a file can be read alone, so files are cut into blocks that tasks search for end ids at once, a
large file in as many tasks as it has blocks.  What a block does not know, the number of documents before it and
where the one that is open at its beginning started, comes from a prefix scan over blocks in two levels: within
chunks of blocks, and over the chunks of a file.

Cases: empty files give no documents; ids after the last end id form a document that is not closed; bytes at the
end that are no whole id are ignored; ids that do not fit the width of a file are an error when it is written; an
empty table gives no rows.  In the query null texts are empty (their document holds the end id alone), null ids are
kept, repeated rows are documents of their own; only doc_id and text are read.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, partitions, table
from .substring_dedup import small_batches

#: Ids in a block, blocks in a chunk; the end id is a special token, which no text can hold; bytes of an id.
BLOCK_TOKENS, CHUNK, END_ID, WIDTH = 1 << 18, 1024, 49407, 2


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_files(docs: DataFrame, scratch: Scratch, tokenizer_path: str | None = None, end_id: int = END_ID, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The token stream of every partition of ``docs`` as a flat file in the shared folder: (file, n_bytes), and, to
    name what a scan finds, (file, ordinal, doc_id).

    Each attempt of a task writes a file of its own; only those of attempts that ended are in the tables.
    """
    folder = f"{scratch.root}/files"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import tokenizer

        tok, end = tokenizer(tokenizer_path, plain=True), np.array([end_id], "<u4").tobytes()
        filesystem, path = _filesystem(folder)
        filesystem.create_dir(path, recursive=True)
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex[:8]}.bin"
        names, types = ["file", "n_bytes", "ordinal", "doc_id"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        rows = lambda x: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*x) if x else [[]] * 4, types)], names=names)
        n_bytes = n_doc = 0
        with filesystem.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                docs_of = batch.column("doc_id").to_pylist()
                ids = np.frombuffer(b"".join(x + end for x in tok.encode(batch.column("text").to_pylist())), "<u4")
                if len(ids) and int(ids.max()) >= 1 << (8 * width):
                    raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
                out.write(ids.astype(f"<u{width}").tobytes())
                yield rows([(f"{folder}/{name}", None, n_doc + i, d) for i, d in enumerate(docs_of)])
                n_bytes, n_doc = n_bytes + width * len(ids), n_doc + len(docs_of)
        yield rows([(f"{folder}/{name}", n_bytes, None, None)])

    found = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, n_bytes long, ordinal long, doc_id long"), "written")
    return found.where("n_bytes is not null").select("file", "n_bytes"), found.where("ordinal is not null").select("file", "ordinal", "doc_id")


def _ends(block: int, end_id: int, width: int):
    def run(batches):
        import pyarrow as pa

        opened: dict = {}
        for batch in batches:
            sizes, found = [], []
            for file, at in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    filesystem, path = _filesystem(file)
                    opened = {file: filesystem.open_input_file(path)}
                data = opened[file].read_at(block * width, at * block * width)
                ids = np.frombuffer(data, f"<u{width}", len(data) // width)
                found.append(np.flatnonzero(ids == end_id) + 1)
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), batch.column("final"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["file", "block", "final", "n", "ends"])

    return run


def scan(files: DataFrame, scratch: Scratch, end_id: int = END_ID, width: int = WIDTH, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in ``files`` (file, n_bytes); n_tokens counts the end id."""
    last = F.floor((F.col("n_bytes") / width - 1) / block).cast("long")
    cut = files.where(f"n_bytes >= {width}").select("file", last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    cut = cut.select("file", "block", (F.col("block") == F.col("_last")).alias("final")).repartition(partitions(files.sparkSession), "file", "block")
    found = scratch.write(cut.mapInArrow(_ends(block, end_id, width), "file string, block long, final boolean, n long, ends array<int>"), "ends")

    # up to a block: documents that end before it, and where the last of them does
    stop = F.when(F.size("ends") > 0, F.col("block") * block + F.element_at("ends", -1))
    blocks = found.select("file", "block", F.floor(F.col("block") / CHUNK).alias("chunk"), F.size("ends").cast("long").alias("k"), stop.alias("stop"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner, outer = before(Window.partitionBy("file", "chunk").orderBy("block")), before(Window.partitionBy("file").orderBy("chunk"))
    chunks = blocks.groupBy("file", "chunk").agg(F.sum("k").alias("k"), F.max("stop").alias("stop"))
    chunks = chunks.select("file", "chunk", F.coalesce(F.sum("k").over(outer), F.lit(0)).alias("docs_c"), F.coalesce(F.max("stop").over(outer), F.lit(0)).alias("open_c"))
    blocks = blocks.select("file", "chunk", "block", F.coalesce(F.sum("k").over(inner), F.lit(0)).alias("docs_b"), F.max("stop").over(inner).alias("open_b")).join(chunks, ["file", "chunk"])
    at = blocks.select("file", "block", (F.col("docs_c") + F.col("docs_b")).alias("docs"), F.coalesce("open_b", "open_c").alias("open"))

    b = found.join(at, ["file", "block"])
    left_open = F.col("final") & (F.coalesce(F.element_at(F.col("ends"), F.when(F.size("ends") > 0, -1)), F.lit(0)) < F.col("n"))
    b = b.select("file", "block", "docs", "open", F.size("ends").alias("k"), F.when(left_open, F.array_append("ends", F.col("n").cast("int"))).otherwise(F.col("ends")).alias("ends"))
    rows = b.select("file", "block", "docs", "k", "open", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("block") * block + F.get("ends", F.col("i") - 1))
    return rows.select("file", (F.col("docs") + F.col("i")).cast("long").alias("ordinal"), start.cast("long").alias("start"), (F.col("block") * block + F.col("end") - start).cast("long").alias("n_tokens"), (F.col("i") < F.col("k")).alias("closed"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, found again in flat token files of all documents."""
    scratch = Scratch(spark, "tokens")
    with small_batches(spark):
        files, names = write_files(table(spark, sf_dir, "documents"), scratch)
        found = scratch.write(scan(files, scratch), "found")
    return found.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens", "closed")
