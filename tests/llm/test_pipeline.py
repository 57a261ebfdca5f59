"""Each stage against brute force on what it was given."""

import os
import re
import sys

from gatewarden.llm import stages
from gatewarden.llm.shared import Scratch, table

sys.path.insert(0, os.path.dirname(__file__))
from test_dedup import brute_kept, brute_links  # noqa: E402
from test_documents import brute_targets  # noqa: E402

COLUMNS = list(stages.COLUMNS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, data, check_same):
    scratch = Scratch(spark, "pipeline-test")
    docs = table(spark, data, "documents")

    kept = scratch.write(stages.quality(spark, docs, data), "1")
    assert kept.columns == COLUMNS
    from gatewarden.llm.quality import ORACLE_OP9

    check_same(kept.select("doc_id"), f"SELECT doc_id FROM ({ORACLE_OP9}) WHERE kept")

    once = scratch.write(stages.near_duplicates(spark, kept, data), "2")
    given = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    assert sorted(r[0] for r in once.select("doc_id").collect()) == sorted(d for d, _, c in brute_links(given) if d == c)

    cut = scratch.write(stages.passages(spark, once, data), "3")
    given = [tuple(r) for r in once.select("doc_id", "text").collect()]
    want = {d: kept.decode("utf-8", "ignore") for d, _, _, kept in brute_kept(given)}
    assert cut.columns == COLUMNS and {r["doc_id"]: r["text"] for r in cut.collect()} == {d: t for d, t in want.items() if words(t)}

    mixed = scratch.write(stages.mix(spark, cut, data), "4")
    sizes, took = {}, {}
    for r in cut.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for r in mixed.collect():
        took[r["source"]] = took.get(r["source"], 0) + len(words(r["text"]))
    target = brute_targets(sizes)
    assert mixed.columns == COLUMNS and all(abs(took.get(s, 0) - target[s]) <= 0.5 + 1e-6 for s in sizes)

    packed = scratch.write(stages.pack(spark, mixed, data), "5")
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_empty_and_odd(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "a", 5, "x"), (1, good, "en", "a", 5, "x"), (2, None, None, None, None, None), (None, good + " more", "en", None, 7, "y"), (3, "", "en", "b", 0, "z")]
    df = spark.createDataFrame(rows, schema)
    for part, n in ((df, None), (df.where("false"), 0)):
        out = part
        for name in ("quality", "near_duplicates", "passages", "mix", "pack"):
            out = Scratch(spark, name).write(getattr(stages, name)(spark, out, data), name)
        assert n is None or out.count() == n
