"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles (as 63-bit hashes).  Tokens are ordered by how
many documents hold them, rare first; two documents over the threshold share at least l tokens of
their prefixes once these are l - 1 tokens longer than the plain prefix.  Each document picks its l by
the candidates that its plain prefix would cost, and a pair needs the smaller l of the two in common.

Plan: one pass over the texts deals postings of the low-hash tokens to radix buckets; tokens that only
one document holds end there and merely fill prefixes.  Equal sets are one node from the start, so
groups of copies never pair up.  Posting lists up to LIST nodes give pairs; nodes of longer lists are
held against pivots, components are built, and what is left between different components is compared in
tiles of bounded size, by the nodes' differences from their pivot.  All comparisons count shared
shingles of whole texts.  Nodes go by 64 bits of their set: with n nodes, two share a name with a
probability of about n * n / 2**65.

Cases: null and empty texts have no shingles and no links; fewer than five words are one shingle;
repeated rows and texts share a class and stay rows of their own; null ids are kept; an empty table
gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import _BYTE, MIX_A, POWERS, Scratch, mix, partitions, salted, table, text_bytes

WORDS = 5
#: Similarity as a fraction NUM / DEN.
NUM, DEN = 4, 5
#: Share of the hash space whose tokens are posted (prefixes need a fifth), as 63-bit bound.
POSTED = int(0.3 * (1 << 63))
#: Posting lists of more nodes are not paired off; local lists of more are sent apart.
LIST, LOCAL = 24, 64
#: Candidates that a plain prefix may cost before one or two more matches are asked for.
COSTS = (64, 1024)
#: Nodes on a side of a tile.
TILE = 128
CHUNK_BYTES, FLUSH = 1 << 20, 2_000_000
#: Pairs verified at a time, bytes of sets that a task keeps, bytes of a batch that goes to Python: texts may be long.
PAIRS, KEPT_BYTES, BATCH_BYTES = 32, 32 << 20, 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of rows of at most ``most`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, A-Z lower-cased, and for each row where its words begin."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = POWERS.upto(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=p[1:])
    h = mix((p[stop] - p[start]) * down[start] + (stop - start).astype(np.uint64))
    return h, np.searchsorted(start, offsets)


def shingle_sets(column) -> list[np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each row of an Arrow column."""
    data, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    for i, j in chunks(offsets):
        w, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        g = np.full(max(len(w) - WORDS + 1, 0), WORDS, np.uint64)
        for k in range(WORDS):
            g = (g ^ w[k : k + len(g)]) * MIX_A
            g ^= g >> np.uint64(29)
        g = mix(g) >> np.uint64(1)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= WORDS:
                s = np.sort(g[a : b - WORDS + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            else:
                h = np.array([b - a], np.uint64)
                for x in w[a:b]:
                    h = mix((h ^ x) * MIX_A)
                out.append(h >> np.uint64(1) if b > a else np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    with np.errstate(over="ignore"):
        a, b = np.add.reduce(mix(s)), np.add.reduce(mix(s ^ MIX_A))
    n = np.uint64(len(s))
    return tuple(int(x) for x in mix(np.array([a + n, b ^ n], np.uint64)).view(np.int64))


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


_DEALT = "bucket int, kind int, doc_id long, text_hash long, n int, n_in int, k1 long, k2 long, blob binary"
#: Kinds of rows: documents, postings, long local lists, their sizes.
DOC, POST, LONG, SIZE = range(4)


def _deal(n_buckets: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("n_in", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("blob", pa.binary())])
        emit = lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
        toks, keys, held, seen = [], [], 0, set()
        # documents go wherever there is room, copies too: only postings need each other
        place = itertools.count(TaskContext.get().partitionId() * 7919)

        def flush():
            t, k = np.concatenate(toks), np.concatenate(keys)
            o = np.lexsort((k, t))
            t, k = t[o], k[o]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            t, k = t[fresh], k[fresh]
            at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            size = np.diff(np.r_[at, len(t)])
            bucket_of = lambda x: (x >> np.uint64(20)) % np.uint64(n_buckets)
            rows, long = [], size > LOCAL
            for a, m in zip(at[long], size[long]):
                rows.append((int(bucket_of(t[a])), LONG, None, None, int(m), None, int(t[a]), None, k[a : a + m].tobytes()))
            plain = ~np.repeat(long, size)
            for kind, tt, vv in ((POST, t[plain], k[plain]), (SIZE, t[at[long]], size[long].astype(np.uint64))):
                b = bucket_of(tt)
                o = np.argsort(b, kind="stable")
                cut = np.searchsorted(b[o], np.arange(n_buckets + 1, dtype=np.uint64))
                for i in np.flatnonzero(np.diff(cut)):
                    part = o[cut[i] : cut[i + 1]]
                    rows.append((int(i), kind, None, None, len(part), None, None, None, tt[part].tobytes() + vv[part].tobytes()))
            for i in range(0, len(rows), 512):
                yield emit(rows[i : i + 512])

        for batch in batches:
            ids, hashes, rows = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), []
            for doc_id, h, s in zip(ids, hashes, shingle_sets(batch.column("text"))):
                k1, k2 = set_key(s)
                n_in = int(np.searchsorted(s, np.uint64(POSTED)))
                rows.append((next(place) % (1 << 30), DOC, doc_id, h, len(s), n_in, k1, k2, None))
                if len(s) and k1 not in seen:
                    seen.add(k1)
                    s = s[: max(n_in, prefix_size(len(s)))]
                    toks.append(s)
                    keys.append(np.full(len(s), np.int64(k1)).view(np.uint64))
                    held += len(s)
            if rows:
                yield emit(rows)
            if held > FLUSH:
                yield from flush()
                toks, keys, held, seen = [], [], 0, set()
        if held:
            yield from flush()

    return run


def _count(batches):
    """Postings of tokens that at least two nodes hold, with the number of nodes; other rows as they are."""
    import pyarrow as pa

    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("n_in", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("tok", pa.int64()), ("df", pa.int64())])
    none = lambda m, t: pa.nulls(m, t)

    def rows(kind, m, **cols):
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)) if f.name == "kind" else pa.array(cols[f.name]).cast(f.type) if f.name in cols else none(m, f.type) for f in schema], schema=schema)

    toks, vals, sized = [], [], []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        docs = batch.filter(pa.array(kinds == DOC))
        if docs.num_rows:
            yield rows(DOC, docs.num_rows, **{c: docs.column(c) for c in ("doc_id", "text_hash", "n", "n_in", "k1", "k2")})
        for i in np.flatnonzero(kinds != DOC):
            blob = batch.column("blob")[int(i)].as_buffer()
            if kinds[i] == LONG:
                k = np.frombuffer(blob, np.int64)
                yield rows(LONG, len(k), k1=k, tok=np.full(len(k), batch.column("k1")[int(i)].as_py()))
            else:
                x = np.frombuffer(blob, np.uint64).reshape(2, -1)
                toks.append(x[0].copy())
                vals.append(x[1].copy())
                sized.append(np.full(x.shape[1], kinds[i] == SIZE))
    if not toks:
        return
    t, v, z = np.concatenate(toks), np.concatenate(vals), np.concatenate(sized)
    del toks, vals, sized
    o = np.lexsort((v, z, t))
    t, v, z = t[o], v[o], z[o]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1]) | z[1:]
    t, v, z = t[fresh], v[fresh], z[fresh]
    at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    df = np.add.reduceat(np.where(z, v, np.uint64(1)), at).astype(np.int64)
    df = np.repeat(df, np.diff(np.r_[at, len(t)]))
    keep = ~z & (df > 1)
    for i in range(0, int(keep.sum()), 100_000):
        sel = np.flatnonzero(keep)[i : i + 100_000]
        yield rows(POST, len(sel), k1=v[sel].view(np.int64), tok=t[sel].view(np.int64), df=df[sel])
    first = np.flatnonzero(z)
    first = first[np.r_[True, t[first][1:] != t[first][:-1]]] if len(first) else first
    if len(first):
        yield rows(SIZE, len(first), tok=t[first].view(np.int64), df=df[first])


def _verify(batches):
    """Shared and all shingles of pairs of texts; sets of texts that come again are kept for a while."""
    import pyarrow as pa

    kept: dict[int, np.ndarray] = {}
    held = 0
    for batch in (b.slice(i, PAIRS) for b in batches for i in range(0, b.num_rows, PAIRS)):
        n = batch.num_rows
        got = {}
        for side in "ab":
            names = batch.column(f"k_{side}").to_pylist()
            new = {x: i for i, x in enumerate(names) if x not in kept}
            sets = shingle_sets(batch.column(f"t_{side}").take(pa.array(list(new.values()), pa.int64()))) if new else []
            kept.update(zip(new, sets))
            held += sum(x.nbytes for x in sets)
            got[side] = names
        both = np.empty(n, np.int64)
        union = np.empty(n, np.int64)
        star, apart = batch.column("star").to_pylist(), []
        for i, (x, y) in enumerate(zip(got["a"], got["b"])):
            x, y = kept[x], kept[y]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both[i] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x) if len(y) else 0
            union[i] = len(x) + len(y) - both[i]
            apart.append(np.setxor1d(x, y, assume_unique=True).tobytes() if star[i] else None)
        yield pa.RecordBatch.from_arrays([batch.column("k_a"), batch.column("k_b"), pa.array(both), pa.array(union), pa.array(apart, pa.binary())], names=["a", "b", "both", "all", "apart"])
        if held > KEPT_BYTES:
            kept, held = {}, 0


def _prefixes(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tok, key, n, l, alone, common): the repeated tokens of each node's prefix and the matches that it asks for."""
    per = posts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((F.col("tok") >= POSTED).alias("far"), "df", "tok"))).alias("toks"))
    d = per.join(nodes, "key")
    n, plain = F.col("n"), F.expr(f"n - (({NUM} * n + {DEN - 1}) div {DEN}) + 1")
    d = d.select("key", "n", "n_in", "toks", plain.alias("p"), F.size(F.filter("toks", lambda x: ~x["far"])).alias("rep"))
    enough = F.col("n_in") >= F.col("p")
    need = F.when(enough, F.greatest(F.lit(0), F.col("p") - (F.col("n_in") - F.col("rep")))).otherwise(F.size("toks"))
    d = d.select("*", need.cast("int").alias("need")).where("need > 0")
    cost = F.aggregate(F.slice("toks", F.lit(1), F.col("need")), F.lit(0).cast("long"), lambda a, x: a + x["df"] - 1)
    d = d.select("*", cost.alias("cost"))
    want = F.when(F.col("cost") <= COSTS[0], 1).when(F.col("cost") <= COSTS[1], 2).otherwise(3)
    l = F.when(enough, F.least(want, F.lit(1) + F.col("rep") - F.col("need"), F.expr(f"cast(({NUM} * n + {DEN - 1}) div {DEN} as int)"))).otherwise(1)  # noqa: E741
    d = d.select("*", l.cast("int").alias("l"))
    # how central a node is: texts that others were made from have no tokens of their own and common ones besides
    alone = F.greatest(F.lit(0), F.col("n_in") - F.col("rep")) / F.greatest(F.col("n_in"), F.lit(1))
    common = F.aggregate("toks", F.lit(0).cast("long"), lambda a, x: a + x["df"]) / F.size("toks")
    return d.select("key", n, "l", alone.alias("alone"), common.alias("common"), F.explode(F.transform(F.slice("toks", F.lit(1), F.col("need") + F.col("l") - 1), lambda x: x["tok"])).alias("tok"))


def jaccard_links(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(docs, links): each row's text hash, shingle count and class (k1, k2), and verified links between the names (k1) of classes.

    Links are complete up to connectivity: classes that other links already connect may lack one.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    n_buckets = 4 * partitions(docs.sparkSession)
    dealt = docs.mapInArrow(_deal(n_buckets), _DEALT).repartition(partitions(docs.sparkSession), "bucket")
    base = scratch.write(dealt.mapInArrow(_count, "kind int, doc_id long, text_hash long, n int, n_in int, k1 long, k2 long, tok long, df long"), "base")
    docs = docs.select("doc_id", "text")
    rows = base.where(f"kind = {DOC}").select("doc_id", "text_hash", "n", "n_in", "k1", "k2")
    classes = scratch.write(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("n_in").alias("n_in")), "classes")
    nodes = classes.groupBy(F.col("k1").alias("key")).agg(F.max("n").alias("n"), F.max("n_in").alias("n_in"))
    long = base.where(f"kind = {LONG}").select("tok", F.col("k1").alias("key")).join(base.where(f"kind = {SIZE}").select("tok", "df"), "tok")
    posts = base.where(f"kind = {POST}").select("tok", F.col("k1").alias("key"), "df").unionByName(long.select("tok", "key", "df").distinct())
    pre = scratch.write(_prefixes(posts, nodes), "prefixes")
    sizes = scratch.write(pre.groupBy("tok").agg(F.count("*").alias("m"), F.min(F.struct("alone", -F.col("common"), "key"))["key"].alias("p1"), F.max(F.struct("common", "key"))["key"].alias("p2"), F.min("key").alias("p3")).where("m > 1"), "sizes")

    short = pre.join(sizes.where(f"m <= {LIST}").select("tok"), "tok").groupBy("tok").agg(F.sort_array(F.collect_list(F.struct("key", "n", "l"))).alias("x"))
    pair = lambda a, b: F.struct(a["key"].alias("a"), b["key"].alias("b"), a["n"].alias("n_a"), b["n"].alias("n_b"), F.least(a["l"], b["l"]).alias("l"))
    fits = lambda a, b: DEN * F.least(a["n"], b["n"]) >= NUM * F.greatest(a["n"], b["n"])
    every = F.flatten(F.transform("x", lambda a, i: F.transform(F.filter(F.slice("x", i + 2, F.size("x")), lambda b: fits(a, b)), lambda b: pair(a, b))))
    near = short.select(F.inline(every)).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("l").alias("l")).where("c >= l").select("a", "b", F.lit(False).alias("star"))

    # each member of a long list against two pivots: its most central node and another
    in_long = pre.join(sizes.where(f"m > {LIST}"), "tok").select("key", "p1", "p2").distinct()
    stars = in_long.select("key", F.explode(F.array(F.struct(F.col("p1").alias("p"), F.lit(True).alias("star")), F.struct(F.col("p2").alias("p"), F.lit(False).alias("star")))).alias("x")).where("x.p <> key")
    stars = stars.select(F.least("x.p", "key").alias("a"), F.greatest("x.p", "key").alias("b"), "x.star")
    first = scratch.write(near.unionByName(stars).groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")

    wanted = pre.join(sizes.select("tok"), "tok", "left_semi").select("key").distinct()
    reps = classes.join(wanted, classes["k1"] == wanted["key"], "left_semi").select("k1", "k2", "rep")
    texts = docs.join(reps, docs["doc_id"] == reps["rep"]).select(F.col("k1").alias("key"), "k2", "text")
    # a repeated doc_id may bring several texts: those of another class go
    texts = texts.mapInArrow(_own, "key long, text string")
    # classes without any id are found by their key
    unnamed = docs.where("doc_id is null").mapInArrow(_keyed, "key long, k2 long, text string")
    unnamed = unnamed.join(reps.where("rep is null").select(F.col("k1").alias("key"), "k2"), ["key", "k2"], "left_semi").select("key", "text")
    texts = scratch.write(texts.unionByName(unnamed).dropDuplicates(["key"]), "texts")
    b = texts.select(F.col("key").alias("k_b"), F.col("text").alias("t_b"))
    a = texts.select(F.col("key").alias("k_a"), F.col("text").alias("t_a"))
    full = first.join(b, first["b"] == b["k_b"]).join(a, F.col("a") == a["k_a"]).select("k_a", "k_b", "star", "t_a", "t_b")
    held = scratch.write(full.mapInArrow(_verify, "a long, b long, both long, all long, apart binary"), "verified")
    links = held.where(f"{DEN} * both >= {NUM} * all").select("a", "b")
    comp = components(links, scratch, "first").select(F.col("node").alias("key"), "component")

    # long lists: what is left between components of a pivot's members, in tiles of bounded size
    apart = held.where("apart is not null").select("a", "b", "apart")
    apart = apart.select(F.col("a").alias("pivot"), F.col("b").alias("key"), "apart").unionByName(apart.select(F.col("b").alias("pivot"), F.col("a").alias("key"), "apart"))
    members = in_long.select(F.col("p1").alias("pivot"), "key").distinct()
    members = members.join(apart, ["pivot", "key"], "left").where("apart is not null or pivot = key").join(comp, "key", "left").join(nodes.select("key", "n"), "key")
    members = scratch.write(members.select("pivot", "key", "n", F.coalesce("component", "key").alias("component"), F.coalesce("apart", F.lit(b"")).alias("apart")), "members")
    parts = members.groupBy("pivot", "component").agg(F.count("*").alias("m")).groupBy("pivot").agg(F.count("*").alias("parts"), F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("main")).where("parts > 1")
    parts = parts.select("pivot", F.col("main.component").alias("main"), F.ceil(F.col("all") / TILE).cast("int").alias("n_all"), F.ceil((F.col("all") - F.col("main.m")) / TILE).cast("int").alias("n_left"))
    # salted: rows dealt by pivot alone would also serve the tiles' groups, all of a pivot's in one task
    rows_ = salted(members, parts, "pivot", "key")
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tiles = rows_.where("component <> main").select("pivot", place("n_left").alias("i"), upto("n_all").alias("j"), F.lit(0).alias("side"), "key", "n", "component", "apart")
    tiles = tiles.unionByName(rows_.select("pivot", upto("n_left").alias("i"), place("n_all").alias("j"), F.lit(1).alias("side"), "key", "n", "component", "apart"))
    more = scratch.write(tiles.groupBy("pivot", "i", "j").applyInArrow(_tile, "a long, b long"), "rest")
    return rows, links.unionByName(more).distinct()


def _tile(tile):
    """Links between nodes of different components in a tile, as many as connect these components.

    Sets are given by their difference from the pivot's; two sets differ by the difference of these.
    """
    import pyarrow as pa

    side, key, n, comp = (tile.column(c).to_numpy() for c in ("side", "key", "n", "component"))
    apart = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("apart")]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out, root = [], {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    if len(left) and len(right):
        toks = np.concatenate([apart[i] for i in left])
        who = np.repeat(np.arange(len(left)), [len(apart[i]) for i in left])
        o = np.argsort(toks, kind="stable")
        toks, who = toks[o], who[o]
        size = np.array([len(apart[i]) for i in left])
        for r in right:
            y = apart[r]
            lo, hi = np.searchsorted(toks, y), np.searchsorted(toks, y, "right")
            m = hi - lo
            at = np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            differ = size + len(y) - 2 * np.bincount(who[at], minlength=len(left))
            both = (n[left].astype(np.int64) + int(n[r]) - differ) // 2
            fit = DEN * both >= NUM * (n[left] + int(n[r]) - both)
            for i in left[fit & (comp[left] != comp[r])]:
                a, b = find(int(comp[i])), find(int(comp[r]))
                if a != b:
                    root[a] = b
                    out.append((int(key[i]), int(key[r])))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _own(batches):
    """Texts whose set has the class's key."""
    import pyarrow as pa

    for batch in batches:
        keys = [set_key(s) for s in shingle_sets(batch.column("text"))]
        keep = [k == w for k, w in zip(keys, zip(batch.column("key").to_pylist(), batch.column("k2").to_pylist()))]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["key", "text"])


def _keyed(batches):
    """Texts with the key of their class."""
    import pyarrow as pa

    for batch in batches:
        keys = [set_key(s) for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), batch.column("text")], names=["key", "k2", "text"])


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    return near_groups(docs, scratch).select("doc_id", "n_shingles", "component_id")


def near_groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The same with text_hash, which with the id tells rows apart, and group, a
    name of the component for texts with shingles, which tells components apart where no row has an id."""
    scratch = scratch or Scratch(docs.sparkSession, "ngram")
    spark = docs.sparkSession
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        rows, links = jaccard_links(docs, scratch)
        comp = components(links.select("a", "b"), scratch, "last")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # components are sets of classes; each goes by the smallest id that any of its rows has, rows without shingles by their own
    sets = rows.where("n > 0").groupBy("k1").agg(F.min("doc_id").alias("low")).join(comp.select(F.col("node").alias("k1"), "component"), "k1", "left")
    sets = scratch.write(sets.select("k1", "low", F.coalesce("component", "k1").alias("component")), "sets")
    least = sets.groupBy("component").agg(F.min("low").alias("component_id"))
    named = salted(sets, least, "component", "k1").select(F.col("k1").alias("_k"), "component_id", F.col("component").alias("group"))
    out = rows.join(named, (rows["k1"] == named["_k"]) & (rows["n"] > 0), "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "group")
    return scratch.write(out, "out")


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
