"""Texts without an id link to their near copies as any others do."""

import random

from gatewarden.llm import ngram_join as N

SCHEMA = "doc_id long, text string"
BASE = [f"w{i}" for i in range(100)]


def changed(*at):
    w = list(BASE)
    for i in at:
        w[i] = f"e{i}"
    return " ".join(w)


def test_null_id_as_bridge(spark):
    # each is within 0.8 of the text between them, but not of the other
    rows = [(1, changed(1, 10)), (None, changed()), (3, changed(90, 97)), (4, "quite another text that has nothing in common")]
    got = {r[0]: r[2] for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, None: 1, 3: 1, 4: 4}


def test_null_id_as_pivot(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST", 4)
    monkeypatch.setattr(N, "TILE", 8)
    r = random.Random(4)
    rows = [(None, changed())] + [(i, changed(r.randrange(100), r.randrange(100))) for i in range(1, 40)]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == 40 and {x[2] for x in got} == {1}


def test_null_ids_alone(spark):
    rows = [(None, changed()), (None, changed(5)), (None, None), (7, "")]
    got = sorted((str(x[0]), x[1], str(x[2])) for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("7", 0, "7"), ("None", 0, "None"), ("None", 96, "None"), ("None", 96, "None")]
