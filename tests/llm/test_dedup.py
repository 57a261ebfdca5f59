import collections
import hashlib
import random

import numpy as np
import pytest

from gatewarden.llm import ngram_join as N
from gatewarden.llm import substring_dedup as S

SCHEMA = "doc_id long, text string"


def docs_of(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    return df, [tuple(r) for r in df.collect()]


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in held[g] if j > i).items():
            if 100 * n >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def test_links_equal_brute_force(spark, data):
    df, rows = docs_of(spark, data)
    assert sorted(tuple(r) for r in N.near_duplicates(df).collect()) == brute_links(rows)


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST", 4)
    monkeypatch.setattr(N, "LOCAL", 8)
    monkeypatch.setattr(N, "TILE", 8)
    r = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"a common line that all of these share {i} " + " ".join(f"x{r.randrange(10**6)}" for _ in range(4))) for i in range(30)]
    got = sorted(tuple(x) for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == brute_links(rows)


def test_links_of_odd_rows(spark):
    rows = [(1, "a b c"), (2, "A b  c"), (3, None), (4, ""), (4, ""), (None, "q w e r t y"), (6, "q w e r t y"), (7, "a b c d"), (8, "one two three four five six"), (8, "other words in this row here now"), (9, "x " * 30000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", component_id string")
    got = sorted(((r[0] or 0), r[1], r[2]) for r in N.near_duplicates(df).collect())
    assert got == sorted([(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (4, 0, 4), (0, 2, 6), (6, 2, 6), (7, 1, 7), (8, 2, 8), (8, 3, 8), (9, 1, 9)])
    assert N.near_duplicates(df.where("false")).count() == 0


def brute_kept(rows):
    """(id, bytes, which of them go) of each row."""
    texts, seen = [(t or "").encode() for _, t in rows], collections.Counter()
    for b in texts:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for (d, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        yield d, b, gone, np.frombuffer(b, np.uint8)[~gone].tobytes()


def brute_cuts(rows):
    return sorted((d or 0, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()) for d, b, gone, kept in brute_kept(rows))


def cuts(df):
    return sorted((r[0] or 0, *tuple(r)[1:]) for r in S.dedup_passages(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_passages_equal_brute_force(spark, data):
    df, rows = docs_of(spark, data)
    assert cuts(df) == brute_cuts(rows)


@pytest.mark.parametrize("small", [False, True])
def test_passage_that_many_share(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(S, "GROUP", 8)
        monkeypatch.setattr(S, "LOCAL", 4)
    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    shared = words(70)
    rows = [(i, f"{words(r.randint(5, 60))} {shared} {words(r.randint(5, 60))}") for i in range(90)] + [(1000 + i, words(30)) for i in range(10)]
    rows += [(2000, None), (2001, ""), (2002, "x" * 1000), (2002, "x" * 1000), (None, words(100)), (2003, rows[5][1]), (2004, rows[5][1]), (2005, "é" * 300), (2006, "ab " * 150), (2007, rows[7][1][13:900]), (2008, "x" * 199), (2009, "y" * 200)]
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA + ", n_bytes int").repartition(3)
    assert cuts(df) == brute_cuts(rows)
    assert S.dedup_passages(df.where("false")).count() == 0


def test_components(spark):
    from gatewarden.llm.graph import components
    from gatewarden.llm.shared import Scratch

    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, x) for x in range(301, 330)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == want
