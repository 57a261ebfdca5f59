"""Mixing sources to target weights with a low-discrepancy schedule (built-in functions only).

Slots 0, 1, 2, ... are van der Corput points; a point falls into the source whose interval of the
cumulative target weights holds it.  The rank of a slot among its source's slots names the block of
equally many words that it takes from the source's shuffled documents; after the last block the source
starts again.  The last slot of a source takes only what its target leaves.

Cases: null texts have size 0 and are never taken (taken = 0); a null source is a source of its own,
ordered last; repeated rows are documents of their own; where no text has a word, all targets are 0;
empty tables give no rows; only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_RE, Scratch, table

#: Most words a slot takes, bits of a van der Corput point, cells by which points find their interval.
BLOCK_WORDS, POINT_BITS, CELLS = 256, 48, 4096
#: Shuffled documents of a source lie in this many ranges of their hash; slots are ranked in chunks.
RANGES, CHUNK = 1 << 14, 1 << 14


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(sizes: DataFrame, weights=(5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size and target; targets above ``most`` times the size are cut and reshared by weight.

    Sources are sorted by cap over weight: those that are cut come first, and a running sum tells for each
    what level the rest would get.  One row per source goes through one task.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        (F.sum("source_size").over(all_rows) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("left"),
        F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
    )
    s = s.select("*", (F.col("left") / F.col("w_left")).alias("level"))
    s = s.select("*", (F.col("level") * F.col("w") > F.col("cap")).alias("cut"))
    level = F.min(F.when(~F.col("cut"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("v")))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["v"]
    return s.select("source", "source_size", F.when(F.col("cut"), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))).alias("target"))


def _offsets(rows: DataFrame, size: str) -> DataFrame:
    """Start of each row in its source's shuffled order: sums of hash ranges first, then within a range."""
    h = F.xxhash64(F.col("doc_id"), F.lit(17))
    # rows that agree in all of this are the same text: which of them comes first makes no difference
    rows = rows.where(F.col(size) > 0).select("*", h.alias("_h"), F.shiftrightunsigned(h, 64 - RANGES.bit_length() + 1).alias("_r"))
    in_range = Window.partitionBy("source", "_r").orderBy("_h", "doc_id", size, "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "_r").agg(F.sum(size).alias("_n")).select("source", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = rows.select("*", F.coalesce(F.sum(size).over(in_range), F.lit(0)).alias("_in"))
    same = rows["source"].eqNullSafe(base["source"]) & (rows["_r"] == base["_r"])
    return rows.join(base, same).select(rows["doc_id"], rows["source"], rows[size], "text_hash", (F.col("_base") + F.col("_in")).alias("start"))


def _point(slot: Column) -> Column:
    """Van der Corput point of a slot in [0, 1): its bits reversed."""
    bits = F.rpad(F.reverse(F.bin(slot)), POINT_BITS, "0")
    return F.conv(bits, 2, 10).cast("double") / F.lit(float(1 << POINT_BITS))


def schedule(spark, plan: DataFrame, block: Column, n_slots: int) -> DataFrame:
    """(slot, source, rank) of n_slots slots; ``plan`` has a row per source with lo and hi of its interval."""
    cells = plan.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u")).select("*", F.floor(F.col("u") * CELLS).alias("cell"))
    hit = slots.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    hit = hit.select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    base = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    base = base.select("source", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    hit = hit.select("*", (F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1).alias("rank"))
    same = hit["source"].eqNullSafe(base["source"]) & (hit["chunk"] == base["chunk"])
    return hit.join(base, same).select("slot", hit["source"], (F.col("base") + F.col("rank")).alias("rank"))


def mix_rows(sizes: DataFrame, weights=(5, 2, 1), budget: float = 1.5, most: float = 2.0):
    """(pieces, plan): pieces (slot, source, rank, doc_id, text_hash, size, doc_start, start, length) of the mix, and the sources' targets."""
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mix")
    plan = targets(sizes, weights, budget, most)
    up = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    plan = plan.select("*", total.alias("total"), F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_sources"))
    # texts without any word leave nothing to share: no interval holds a point then
    part = lambda rows: F.coalesce(F.try_divide(F.sum("target").over(rows), F.col("total")), F.lit(0.0))
    plan = plan.select("*", part(up.rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), part(up.rowsBetween(Window.unboundedPreceding, -1)).alias("lo"))
    # small corpora take smaller blocks, so that every source still gets many slots
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("total") / F.col("n_sources") / 64))).cast("long")
    plan = scratch.write(plan.select("*", block.alias("block"), F.round("target").cast("long").alias("quota")), "plan")
    found = plan.agg(F.max("total"), F.max("block")).first()
    total_words, block_words = float(found[0] or 0), int(found[1] or 1)
    n_slots = int(total_words / block_words) + 1 if total_words > 0 else 0
    hits = schedule(spark, plan.select("source", "lo", "hi"), block, n_slots)
    known = plan.where("quota > 0").select(F.col("source").alias("_s"), "quota", "source_size")
    hits = hits.join(known, hits["source"].eqNullSafe(F.col("_s"))).drop("_s")
    # blocks of a source: all of block_words but the last; where the points left a source short, slots are added at the end
    n_blocks = F.ceil(F.col("source_size") / F.lit(block_words))
    starts = F.floor(F.col("rank") / n_blocks) * F.col("source_size") + F.pmod(F.col("rank"), n_blocks) * F.lit(block_words)
    full = F.floor(F.col("quota") / F.col("source_size")) * n_blocks + F.ceil(F.pmod(F.col("quota"), F.col("source_size")) / F.lit(block_words))
    drawn = hits.groupBy("source").agg(F.count("*").alias("_n"))
    short = known.join(drawn, drawn["source"].eqNullSafe(known["_s"]), "left").select(F.col("_s").alias("source"), "quota", "source_size", F.coalesce("_n", F.lit(0)).alias("_n"), full.alias("_full"))
    short = short.where("_n < _full").select(F.lit(None).cast("long").alias("slot"), "source", F.explode(F.sequence(F.col("_n"), F.col("_full") - 1)).alias("rank"), "quota", "source_size")
    taken = hits.unionByName(short).select("slot", "source", "rank", "quota", "source_size", starts.cast("long").alias("from"), F.pmod(F.col("rank"), n_blocks).cast("long").alias("b"), F.least(F.lit(block_words), F.col("source_size") - F.pmod(F.col("rank"), n_blocks) * F.lit(block_words)).alias("words"))
    taken = taken.where("from < quota").select("slot", F.col("source").alias("_s"), "rank", F.col("b").alias("_b"), F.least(F.col("words"), F.col("quota") - F.col("from")).cast("long").alias("take"))
    cut = _offsets(sizes, "size").select("doc_id", "source", "size", "text_hash", "start", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("b"))
    cut = cut.select("doc_id", "source", "size", "text_hash", F.col("start").alias("doc_start"), "b", F.greatest("start", F.col("b") * block_words).alias("p0"), F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block_words).alias("p1"))
    joined = taken.join(cut, (taken["_b"] == cut["b"]) & taken["_s"].eqNullSafe(cut["source"]))
    end = F.least(F.col("p1"), F.col("b") * block_words + F.col("take"))
    pieces = joined.where(F.col("p0") < end).select("slot", "source", "rank", "doc_id", "text_hash", "size", "doc_start", (F.col("p0") - F.col("doc_start")).alias("start"), (end - F.col("p0")).alias("length"))
    return pieces, plan


def mixed(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per document: size, text_hash, source_size, target of its source, and the words that the mix takes of it."""
    scratch = Scratch(docs.sparkSession, "mixed")
    sizes = scratch.write(sized(docs), "sizes")
    pieces, plan = mix_rows(sizes, weights, budget, most)
    # a document's place among its source's words tells repeated rows apart
    key = ["doc_id", "source", "size", "text_hash"]
    rest = sizes.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    whole = _offsets(sizes, "size").select(*key, F.col("start").alias("doc_start"), F.lit(0).cast("long").alias("taken"))
    took = pieces.select(*key, "doc_start", F.col("length").alias("taken")).unionByName(whole).groupBy(*key, "doc_start").agg(F.sum("taken").alias("taken")).drop("doc_start")
    known = plan.select(F.col("source").alias("_s"), "source_size", "target")
    out = took.unionByName(rest)
    return out.join(known, out["source"].eqNullSafe(F.col("_s"))).select(*key, "source_size", "target", "taken")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
