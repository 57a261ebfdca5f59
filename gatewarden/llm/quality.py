"""Quality rules as a bitmask ledger (built-in functions only).

Every rule is evaluated once per document; its measurement and failure bit are stored, in a table that ``stored``
writes.  Policies are versioned masks over these bits, applied later without touching a text; ablations are bitwise
counts over the same table.

Cases: a null or empty text has no words and fails TOO_FEW_WORDS; repeated rows and null ids are
judged row by row; an empty table gives an empty ledger; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_RE, Scratch, table

#: Bit numbers; a bit never changes its meaning, new rules take new bits.
TOO_FEW_WORDS, REPEATED_WORDS, SYMBOLS, DUPLICATE_LINES, WORD_LENGTH = range(5)
RULES = {
    "too_few_words": TOO_FEW_WORDS,
    "repeated_words": REPEATED_WORDS,
    "symbols": SYMBOLS,
    "duplicate_lines": DUPLICATE_LINES,
    "word_length": WORD_LENGTH,
}
BASE = (TOO_FEW_WORDS, REPEATED_WORDS)
#: Versioned policies: the bits that reject a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, SYMBOLS, DUPLICATE_LINES, WORD_LENGTH),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(bits) -> int:
    return sum(1 << b for b in set(bits))


def _measured(docs: DataFrame) -> DataFrame:
    """One pass over the words: each array is a column of its own, so that none is computed twice."""
    n5 = F.greatest(F.size("_h") - 4, F.lit(0))
    at = lambda c, i: F.get(F.col(c), i)
    d = docs.select("*", F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE_RE), "").alias("_w"))
    d = d.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    d = d.select("*", F.transform(F.slice("_h", F.lit(1), n5), lambda h, i: F.xxhash64(h, *[at("_h", i + k) for k in range(1, 5)])).alias("_g"))
    d = d.select("*", (F.size(F.array_distinct("_g")) < F.size("_g")).alias("_again"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select("*", F.when(F.col("_again"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("_s"))
    twice = lambda x, j: F.coalesce(F.when(j > 0, at("_s", j - 1)["h"]) == x["h"], F.lit(False)) | F.coalesce(at("_s", j + 1)["h"] == x["h"], F.lit(False))
    d = d.select("*", F.sort_array(F.transform(F.filter("_s", twice), lambda x: x["i"])).alias("_p"))
    covered = F.transform("_p", lambda p, j: F.least(F.lit(5), F.coalesce(at("_p", j + 1) - p, F.lit(5))))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("*", lines.alias("_l"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        add(F.transform("_w", lambda w: F.char_length(w))).alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        add(covered).alias("n_repeat_words"),
    )


def rule_failures() -> dict[int, Column]:
    """Failure conditions by bit, over the measurements; integer arithmetic, so they are exact."""
    n = F.col("n_words")
    return {
        TOO_FEW_WORDS: n < 10,
        REPEATED_WORDS: 100 * F.col("n_repeat_words") > 20 * n,
        SYMBOLS: 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
        DUPLICATE_LINES: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        WORD_LENGTH: (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def ledger(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Measurements and ``failed_bits`` of every document."""
    measured = _measured(docs.select(*dict.fromkeys([*keep, "text"])))
    bits = F.lit(0).cast("long")
    for bit, failed in rule_failures().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.select(*keep, *MEASURES, bits.alias("failed_bits"))


def passes(policy="v1", bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES.get(policy, policy)))) == 0


def kept(led: DataFrame, policy="v1") -> DataFrame:
    """Rows of a ledger that a policy keeps.

    The optimizer would push the condition below the steps of the ledger and repeat each in the next;
    a column that is not deterministic keeps it above them.
    """
    barrier = led.select("*", F.spark_partition_id().alias("_barrier"))
    return barrier.where(passes(policy) & (F.col("_barrier") >= 0)).drop("_barrier")


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents it fails, fails alone, and that would be kept without it."""
    m = mask(POLICIES[policy])
    failed = F.col("failed_bits").bitwiseAND(F.lit(m))
    sums = [F.count_if(failed.bitwiseAND(F.lit(1 << b)) != 0).alias(f"f{b}") for b in POLICIES[policy]]
    sums += [F.count_if(failed == F.lit(1 << b)).alias(f"a{b}") for b in POLICIES[policy]]
    one = led.agg(F.count("*").alias("n_docs"), F.count_if(failed == 0).alias("kept"), *sums)
    names = {b: k for k, b in RULES.items()}
    rows = F.array(*[F.struct(F.lit(names[b]).alias("rule"), F.col(f"f{b}").alias("n_failed"), F.col(f"a{b}").alias("n_failed_alone"), (F.col("kept") + F.col(f"a{b}")).alias("kept_without")) for b in POLICIES[policy]])
    return one.select("n_docs", "kept", F.inline(rows))


def stored(docs: DataFrame, scratch: Scratch, keep=("doc_id",)) -> DataFrame:
    """The ledger of ``docs`` as a table in the shared folder: what policies and ablations read."""
    return scratch.write(ledger(docs, keep), "ledger")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    led = stored(table(spark, sf_dir, "documents"), Scratch(spark, "quality"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failed_bits", F.lit("v1").alias("policy_version"))


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """Per rule of policy v1: documents it fails, fails alone, and that would be kept without it."""
    return ablations(stored(table(spark, sf_dir, "documents"), Scratch(spark, "quality")))


ORACLE_OP9 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
d AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM d) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * word_chars)::BIGINT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept,
       failed_bits, 'v1' AS policy_version
FROM b
"""
ORACLE_ABLATIONS = f"""
SELECT count(*) AS n_docs, count(*) FILTER (failed_bits = 0) AS kept, rule, count(*) FILTER ((failed_bits & bit) <> 0) AS n_failed,
       count(*) FILTER (failed_bits = bit) AS n_failed_alone, count(*) FILTER (failed_bits IN (0, bit)) AS kept_without
FROM ({ORACLE_OP9}) q, (VALUES ('too_few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16)) r(rule, bit)
GROUP BY rule
"""
