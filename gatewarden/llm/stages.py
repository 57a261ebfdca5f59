"""The operators as stages of a corpus pipeline: documents in, documents out (packed pieces at the end)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing, ngram_join, packing, quality as rules, substring_dedup
from .shared import Scratch, salted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps.

    Rows are judged one by one, repeated ones and null ids too; null and empty texts have too few words and go.
    """
    led = rules.ledger(docs, keep=COLUMNS)
    return rules.kept(led, "v1").select(*COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id, of several texts with this id that of the least hash.

    A row is known by its id and its text's hash: rows that share both are one document, and a text whose id occurs
    with another text stays or goes by itself.  Null ids come last in a group; null and empty texts belong to none
    and stay, one for each id.
    """
    docs = docs.select(*COLUMNS)
    found = ngram_join.near_groups(docs).where("group is not null")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("group").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = salted(found, first, "group", "text_hash").where(row != F.col("first")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    named = docs.select("*", F.xxhash64("text").alias("_h"))
    kept = named.join(gone, named["doc_id"].eqNullSafe(gone["_d"]) & (named["_h"] == gone["_t"]), "left_anti")
    return kept.dropDuplicates(["doc_id", "_h"]).select(*COLUMNS)


def passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which no word is left go.

    Passages are bytes: a code point of which a byte goes is dropped as a whole.  Null texts stay null, empty ones
    empty; repeated rows of at least a passage's length go as repeats of each other; null ids are kept.
    """
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark, "stage-passages")
    with substring_dedup.small_batches(spark):
        _, cuts = substring_dedup.repeated_spans(docs, scratch, with_text=True)
        named = docs.select("*", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
        out = named.join(cuts.select("sha", "kept"), "sha", "left")
        # a null text stays null; cut texts are trimmed of nothing, so their words are as they were
        text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.col("kept"))
        out = out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length("kept").cast("long")).alias("n_chars"), F.col("kept").alias("_k"))
        return scratch.write(out.where("_k is null or _k rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(*COLUMNS), "documents")


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes of them: whole turns, and once the first words of the part beyond them.

    Rows that share id, source and text are one document, of which the mix takes what it takes of all of them;
    n_chars is that of the copy.  Null and empty texts are never taken; a null source is a source of its own.
    """
    docs = docs.select(*COLUMNS)
    key = ["doc_id", "source", "text_hash"]
    took = mixing.mixed(docs).groupBy(*key, "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows")).where("taken > 0")
    took = Scratch(spark, "stage-mix").write(took.select(*[F.col(c).alias(f"_{c}") for c in key], "size", "taken", "rows"), "took")
    named = docs.where("text is not null").select("*", F.xxhash64("text").alias("text_hash"))
    meet = lambda t: named.join(t, named["doc_id"].eqNullSafe(t["_doc_id"]) & named["source"].eqNullSafe(t["_source"]) & (named["text_hash"] == t["_text_hash"]))
    # only rows that repeat are brought together
    out = meet(took.where("rows = 1")).unionByName(meet(took.where("rows > 1")).dropDuplicates(key)).select("doc_id", "text", "lang", "source", "size", "taken")
    turns = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") - turns * F.col("size")).cast("int")
    # the first ``rest`` words, each with the space before it
    out = out.select("*", turns.alias("turns"), F.when(rest > 0, F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), rest), "")).alias("head"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("turns"))).alias("turn"))
    out = out.select("doc_id", "lang", "source", F.when(F.col("turn") < F.col("turns"), F.col("text")).otherwise(F.col("head")).alias("text")).where("text is not null")
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; null texts are their end id alone, rows that repeat are packed each."""
    return packing.pack(docs)
