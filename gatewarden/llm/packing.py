"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

One pass over the texts encodes them, cuts each partition's stream of a source into blocks of BLOCK
tokens, and notes the pieces of documents in them.  A source's counter gains its weight's share of every window
and pays for each block it sends; the next block goes out once the counter has reached half of it.  In
closed form: block i of a source is due at (i + 1/2) / weight, and windows take the blocks in the order they are
due, so deficits carry over windows and partitions alike.  Weights are targets of the mixture; without any, those
are the sources' shares of all tokens, which is the only mixture that no queue runs dry of.  A queue that runs
dry leaves its share to the others by their weights, as all documents are packed once; sources without a weight
come after all others.  ``deficit`` tells what a source is owed at each of its blocks.  The short last blocks of
the queues are laid into windows of their own, as many as surely fit.

Cases: null and empty texts are the end id alone; a null source is a queue of its own; repeated rows
are packed each; null ids are kept; an empty table gives no rows; only doc_id, source and text are read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, table
from .substring_dedup import small_batches

WINDOW, BLOCK, END_ID = 4096, 512, 2
#: Ranges of due times in which blocks are ranked.
RANGES = 1 << 13

_PIECE = "pid int, source string, block long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, at long"


def _pieces(path: str | None, block: int, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import tokenizer

        pid, tok, fill = TaskContext.get().partitionId(), tokenizer(path), {}
        end = end_id.to_bytes(4, "little")
        types = [pa.int32(), pa.string()] + [pa.int64()] * 7
        names = [c.split()[0] for c in _PIECE.split(", ")]
        for batch in batches:
            rows = []
            ids = tok.encode(batch.column("text").to_pylist())
            for doc_id, source, b in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), ids):
                b += end
                n, q, i = len(b) // 4, fill.get(source, 0), 0
                fill[source] = q + n
                while i < n:
                    m = min(n - i, block - (q + i) % block)
                    rows.append((pid, source, (q + i) // block, doc_id, i, m, zlib.crc32(b[4 * i : 4 * (i + m)]), n, (q + i) % block))
                    i += m
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, block: int = BLOCK, end_id: int = END_ID, weights: dict | None = None) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, deficit. ``block`` divides ``window``.

    ``weights``: target weight of each source by name.  ``deficit``: tokens that a piece's source is owed by its share
    of all that went out up to its block; null in short blocks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    with small_batches(spark):
        pieces = scratch.write(docs.mapInArrow(_pieces(tokenizer_path, block, end_id), _PIECE), "pieces")
    blocks = pieces.groupBy("pid", "source", "block").agg(F.sum("length").alias("n"))
    # number of a full block in its source's queue: queues of partitions follow each other
    per = blocks.where(f"n = {block}").groupBy("pid", "source").agg(F.count("*").alias("full"))
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    per = per.select(F.col("pid").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("full").over(before), F.lit(0)).alias("base"), F.sum("full").over(whole).alias("of"))
    full = blocks.where(f"n = {block}").join(per, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    full = full.select("pid", "source", "block", (F.col("base") + F.col("block")).alias("queued"), "of")
    natural = (F.col("queued") + 0.5) / F.col("of")
    if weights:
        known = [(s, float(w)) for s, w in weights.items() if w > 0]
        weight = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(w)) for s, w in known], F.lit(None))
        full = full.select("*", weight.isNull().alias("last"), F.coalesce((F.col("queued") + 0.5) / weight, natural).alias("due"), F.coalesce(weight / sum(w for _, w in known), F.lit(0.0)).alias("share"))
        # due times may crowd: ranges are cut by a sample of them
        full = scratch.write(full.repartitionByRange(spark.sparkContext.defaultParallelism, "last", "due").select("*", F.spark_partition_id().cast("long").alias("range")), "full")
        n_full = full.count()
    else:
        full = scratch.write(full.select("*", F.lit(False).alias("last"), natural.alias("due"), F.floor(natural * RANGES).alias("range")), "full")
        n_full = full.count()
        full = full.select("*", (F.col("of") / max(n_full, 1)).alias("share"))
    rank = _ranks(full, F.lit(1), ["last", "due", F.col("source").asc_nulls_last(), "pid", "block"])
    per_window = window // block
    placed = rank.select("pid", "source", "block", F.floor(F.col("rank") / per_window).alias("sequence_id"), (F.pmod(F.col("rank"), F.lit(per_window)) * block).alias("base"), ((F.col("share") * (F.col("rank") + 1) - F.col("queued") - 1) * block).alias("deficit"))
    first_short = -(-n_full // per_window)
    # short blocks: one that starts before the last (block - 1) tokens of a window surely fits
    short = blocks.where(f"n < {block}").select("pid", "source", "block", "n", F.pmod(F.xxhash64("pid", "source"), F.lit(RANGES)).alias("range"))
    short = _ranks(short, F.col("n"), ["pid", F.col("source").asc_nulls_last()])
    room = window - block + 1
    short = short.select("*", F.floor(F.col("rank") / room).alias("w"))
    start = F.sum("n").over(Window.partitionBy("w").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    short = short.select("pid", "source", "block", (F.col("w") + first_short).alias("sequence_id"), F.coalesce(start, F.lit(0)).alias("base"), F.lit(None).cast("double").alias("deficit"))
    where = placed.unionByName(short).select(F.col("pid").alias("p"), F.col("source").alias("s"), F.col("block").alias("b"), "sequence_id", "base", "deficit")
    out = pieces.join(where, (F.col("pid") == F.col("p")) & (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.col("base") + F.col("at")).cast("long").alias("offset"), "deficit")


def window_mixture(pieces: DataFrame) -> DataFrame:
    """(sequence_id, source, tokens, deficit): what each window holds of each of its sources, and what the source is
    owed after it."""
    return pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("tokens"), F.max_by("deficit", "offset").alias("deficit"))


def _ranks(rows: DataFrame, weight, order: list) -> DataFrame:
    """Running sum of ``weight`` before each row in the order of (range, order): sums of ranges first."""
    rows = rows.select("*", weight.alias("_w"))
    base = rows.groupBy("range").agg(F.sum("_w").alias("_n"))
    base = base.select(F.col("range").alias("_r"), F.coalesce(F.sum("_n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.sum("_w").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("*", F.coalesce(inner, F.lit(0)).alias("_in"))
    return rows.join(base, rows["range"] == base["_r"]).select("*", (F.col("_base") + F.col("_in")).cast("long").alias("rank")).drop("_r", "_base", "_in", "_w", "range")


def op8_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("source")
