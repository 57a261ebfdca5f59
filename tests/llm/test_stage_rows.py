"""Stages know rows by id and text: repeated ids, missing ids and repeated rows."""

import pytest

from gatewarden.llm import mixing, stages
from gatewarden.llm.shared import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A = " ".join(f"word{i}" for i in range(100))
NEAR = A.replace("word50", "other")
B = " ".join(f"thing{i}" for i in range(60))
C = " ".join(f"part{i}" for i in range(50))


def run(spark, stage, rows):
    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA).repartition(3)
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in Scratch(spark, "rows").write(stage(spark, df, ""), "x").collect()), key=str)


def test_near_duplicates_by_id_and_text(spark):
    # an id with an unrelated second text, copies without an id, repeated rows, a group without any id
    rows = [(1, A, "s"), (2, A, "s"), (2, B, "s"), (2, B, "s"), (None, NEAR, "s"), (None, A, "s"), (None, C, "s"), (None, C, "s"), (9, None, "s"), (8, "", "s")]
    assert run(spark, stages.near_duplicates, rows) == sorted([(1, A, "s"), (2, B, "s"), (None, C, "s"), (9, None, "s"), (8, "", "s")], key=str)


def test_mix_keeps_rows_apart(spark):
    # same id, source and size, other texts; the weights take 1.5 times of the one source
    c, d = " ".join(f"c{i}" for i in range(40)), " ".join(f"d{i}" for i in range(40))
    rows = [(1, c, "s"), (1, d, "s"), (1, d, "s"), (None, c, "s"), (2, None, "s")]
    out = run(spark, stages.mix, rows)
    n = lambda i, x: sum(len(t.split()) for j, t, _ in out if j == i and t[0] == x)
    took = {(r["doc_id"], r["text_hash"]): 0 for r in []}
    for r in mixing.mixed(spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")).collect():
        took[r["doc_id"], r["text_hash"]] = took.get((r["doc_id"], r["text_hash"]), 0) + r["taken"]
    assert sum(len(t.split()) for _, t, _ in out) == 240 == sum(took.values())
    assert sorted([n(1, "c"), n(1, "d"), n(None, "c"), 0]) == sorted(took.values())


@pytest.mark.parametrize("texts", [[None, ""], [" \n", None]])
def test_mix_of_texts_without_words(spark, texts):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {(r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mixed(df).collect()} == {(0, 0, 0.0, 0)}
    assert run(spark, stages.mix, [(i, t, "s") for i, t in enumerate(texts)]) == []
