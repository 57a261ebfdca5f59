"""SpotSigs fingerprints (built-in functions only).

Every common word of a text, and its beginning, is an anchor; it and the next two content words after it form a
signature, kept as a 64-bit hash.  A fingerprint is the set of all signatures of a text, whatever its length; the
fingerprint column names the set: how many there are, and 128 bits of hash over all of them.

Likeness is the exact Jaccard similarity of whole sets.  Sets are held by length: a pair whose lengths alone keep it
below a threshold (``length_class`` more than one apart) is never compared by ``near_pairs``; and a pair of equal
names, or with an empty side, is decided without comparing.

Cases: null texts are empty; a text without words has an empty set, and is alike only to another such (1.0);
repeated rows and null ids are rows of their own (null ids first, in the order of a hash of the text); the last row
is followed by the first; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: Consecutive ids in one range when each text is given the next one; ranges in a group of ranges.
RANGE, GROUP = 256, 4096
#: Least similarity of near copies.
NEAR = 0.8
#: Common words of four languages.
ANCHORS = tuple(
    dict.fromkeys(
        (
            "the of and to in is that it was for on are with as be at by this from an or not "
            "de la le et les des en un du une que est pour qui dans par au sur pas avec "
            "der die und den von zu das mit sich auf ist im dem nicht ein eine als "
            "el los del se las por con no su al lo y a"
        ).split()
    )
)


def signatures(text: Column) -> list[tuple[str, Column]]:
    """Steps from a text to its distinct signature hashes, each a column that the next one reads."""
    anchor = lambda w: w.isin(*ANCHORS)
    at = lambda c, i: F.get(F.col(c), i)
    chain = lambda s, r: F.xxhash64(s["w"], at("_c", s["i"] - r), at("_c", s["i"] - r + 1))
    first = F.when(F.size("_w") > 0, F.array(F.xxhash64(F.lit("^"), at("_c", F.lit(0)), at("_c", F.lit(1))))).otherwise(F.array().cast("array<bigint>"))
    return [
        ("_w", F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")),
        ("_c", F.filter("_w", lambda w: ~anchor(w))),
        ("_a", F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: anchor(s["w"]))),
        ("_s", F.sort_array(F.array_union(first, F.transform("_a", chain)))),
    ]


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with a struct ``out``: n signatures, their sorted hashes, and the name of the set."""
    kept = list(df.columns)
    for name, c in signatures(F.col(text)):
        df = df.select("*", c.alias(name))
    part = lambda *x: F.lower(F.lpad(F.hex(F.xxhash64(*x)), 16, "0"))
    name = F.concat(F.lower(F.hex(F.size("_s"))), F.lit(":"), part("_s"), part(F.lit("name"), "_s"))
    return df.select(*kept, F.struct(F.size("_s").alias("n"), F.col("_s").alias("all"), name.alias("name")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; only sets that names and lengths leave open are compared."""
    shared = F.size(F.array_intersect(a["all"], b["all"]))
    return F.when(a["name"] == b["name"], 1.0).when((a["n"] == 0) | (b["n"] == 0), 0.0).otherwise(shared / (a["n"] + b["n"] - shared))


def length_class(n: Column, least: float = NEAR) -> Column:
    """Sets whose similarity can reach ``least`` lie in the same class of lengths or in neighbouring ones."""
    return F.when(n > 0, F.floor(F.ln(n) / F.lit(-math.log(least)) + F.lit(1e-9))).otherwise(F.lit(-2))


def near_pairs(pairs: DataFrame, a: str, b: str, least: float = NEAR) -> DataFrame:
    """``pairs`` whose fingerprints ``a`` and ``b`` are alike by ``least`` or more, with their likeness.

    Pairs go by length classes first, then by the exact bound that lengths set; only what is left is compared.
    """
    x, y = F.col(a), F.col(b)
    close = pairs.where((F.abs(length_class(x["n"], least) - length_class(y["n"], least)) <= 1) & (F.least(x["n"], y["n"]) >= F.lit(least) * F.greatest(x["n"], y["n"]) - 1e-9))
    return close.select("*", likeness(x, y).alias("likeness")).where(F.col("likeness") >= least)


def with_next(rows: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Each row with a struct ``next`` of the following row's columns, in the order of ``key``; the last is given the first.

    Ranges of ids are ordered apart; the first row of each range is handed to the range before it.
    """
    # rows without an id come before all others, in many ranges too
    rng = F.when(F.col(key).isNull(), F.lit(-(1 << 62)) + F.shiftrightunsigned(F.xxhash64(*columns), 50)).otherwise(F.floor(F.col(key) / RANGE))
    order = [F.col(key).asc_nulls_first(), *[c for c in columns if c != key]]
    w = Window.partitionBy("_r").orderBy(*order[:2])
    rows = rows.select("*", rng.alias("_r"))
    heads = rows.groupBy("_r").agg(F.min(F.struct(F.col(key).isNotNull().alias("k"), *columns)).alias("_h"))
    ranges = heads.select("_r", F.floor(F.col("_r") / GROUP).alias("_g"))
    by_group = Window.partitionBy("_g").orderBy("_r")
    first = ranges.groupBy("_g").agg(F.min("_r").alias("_f"))
    everything = Window.orderBy("_g")
    first = first.select("_g", F.coalesce(F.lead("_f").over(everything), F.min("_f").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_f"))
    after = ranges.join(first, "_g").select("_r", F.coalesce(F.lead("_r").over(by_group), F.col("_f")).alias("_n"))
    heads = after.join(heads.select(F.col("_r").alias("_n"), "_h"), "_n").select(F.col("_r").alias("_q"), "_h")
    rows = rows.select("*", F.lead(F.struct(*columns)).over(w).alias("_l"))
    last = F.struct(*[F.col("_h")[c].alias(c) for c in columns])
    return rows.join(heads, rows["_r"] == heads["_q"]).select("*", F.when(F.col("_l").isNotNull(), F.col("_l")).otherwise(last).alias("next")).drop("_r", "_q", "_h", "_l")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))


def compared(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # texts travel alone: whole signature sets are made where they are compared
    d = with_next(d, ["doc_id", "text"])
    n = F.char_length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring(F.col("next")["text"], F.lit(1), q))
    d = d.select("doc_id", "text", F.col("next")["text"].alias("next_text"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    for text, fp in (("text", "fp"), ("next_text", "next_fp"), ("edited", "edited_fp")):
        d = fingerprinted(d, text, fp)
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp")["name"].alias("fingerprint"), F.col("edited_fp")["name"].alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
