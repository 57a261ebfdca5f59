"""Exact removal of repeated passages by depth-limited radix passes over suffixes.

A window of THRESHOLD bytes is repeated if it starts anywhere else as well.  Suffixes are ordered only as
far as that: equal groups after the last pass are the repeated windows.  Pass one sorts by the first
DIGIT bytes, and only where these are least by hash among a window's DIGIT-grams: every window holds
such an anchor, and its copies hold the same one.  Groups of one end there.  Anchors whose whole
surroundings (all windows around them) occur again are settled; the others are ordered to full depth.
Groups of more than GROUP members are first split by longer and longer shared middles, so that no
task gets a passage that very many documents share.

Windows are compared by 64-bit hashes of their bytes: n windows that get so far hold a false match
with a probability of about n * n / 2**65.

Cases: null texts are empty; texts under THRESHOLD bytes lose nothing; equal texts of THRESHOLD bytes
or more are removed entirely, all of them; repeated rows and null ids stay rows of their own; an empty
table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import chunks
from .shared import MIX_A, Scratch, mix, partitions, prefix_hash, range_hash, table, text_bytes

THRESHOLD, DIGIT = 200, 80
SPAN = THRESHOLD - DIGIT
#: Distinct surroundings of an anchor that one map task sends on, members of a group that one task orders.
LOCAL, GROUP = 64, 256
#: Widths of the blocks of window starts into which large groups are split.
SPLITS = (30, 6, 1)
CHUNK, FLUSH = 1 << 20, 1_000_000
#: Windows that a task orders at a time (whole groups), members hashed at a time, bytes of a batch that goes to Python.
LOT, MEMBERS, BATCH_BYTES = 1_000_000, 2048, 8 << 20
DOC, POST = 0, 1
#: Verdicts on an anchor of a text: settled, in a group that one task orders, in a larger group; PARTNER is
#: added to a settled one that goes on for the sake of the others in its group.
SETTLED, COLD, HOT, PARTNER = 0, 1, 2, 4


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) of every w neighbours."""
    s = 1
    while 2 * s <= w:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: len(x) - (w - s)], x[w - s :]) if s < w else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in data, hashes of their DIGIT bytes, the prefix hash) of all anchors of the rows."""
    p = prefix_hash(data)
    n = len(data)
    if n < THRESHOLD:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), p
    at = np.arange(n - DIGIT + 1)
    g = range_hash(p, at, at + DIGIT) | np.uint64(1)
    low = _slide(g, SPAN + 1, np.minimum)
    inside = np.zeros(n + 1, np.int32)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= THRESHOLD:
            inside[a] += 1
            inside[b - THRESHOLD + 1] -= 1
    low[np.cumsum(inside)[: len(low)] == 0] = 0
    pad = np.zeros(SPAN, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), SPAN + 1, np.maximum)
    found = np.flatnonzero(high[: len(g)] == g)
    return found, g[found], p


def _first(n_buckets: int):
    """Rows of documents, and postings (anchor, surroundings, text, position) by radix bucket."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        # documents and lots of marked anchors go wherever there is room: none of them needs another
        aside_to = itertools.count(TaskContext.get().partitionId() * 7919)
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("key", pa.int64()), ("blob", pa.binary())])
        emit = lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
        held, size, seen = [], 0, set()

        def flush():
            h, c, k, pos = (np.concatenate(x) for x in zip(*held))
            o = np.lexsort((c, h))
            h, c, k, pos = h[o], c[o], k[o], pos[o]
            start = np.r_[True, h[1:] != h[:-1]]
            # anchors with many surroundings in this task alone: marked, so that no task gets them all
            at = np.flatnonzero(start)
            kinds = np.add.reduceat(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])].astype(np.int64), at)
            hot = np.repeat(kinds > LOCAL, np.diff(np.r_[at, len(h)]))
            aside = np.flatnonzero(hot)
            for i in range(0, len(aside), 4096):
                sel = aside[i : i + 4096]
                yield emit([(next(aside_to) % (1 << 30), POST, None, HOT, None, None, b"".join(v[sel].tobytes() for v in (h, c, k, pos)))])
            once = at[kinds > LOCAL]
            plain = np.flatnonzero(~hot)
            # one posting tells the others of a marked anchor: its position is -1
            h, c, k, pos = (np.r_[v[plain], w] for v, w in ((h, h[once]), (c, c[once]), (k, k[once]), (pos, np.full(len(once), -1, np.int64))))
            b = h % np.uint64(n_buckets)
            o = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[o], np.arange(n_buckets + 1, dtype=np.uint64))
            rows = [(int(i), POST, None, COLD, None, None, b"".join(v[o[cut[i] : cut[i + 1]]].tobytes() for v in (h, c, k, pos))) for i in np.flatnonzero(np.diff(cut))]
            for i in range(0, len(rows), 512):
                yield emit(rows[i : i + 512])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = text_bytes(batch.column("text"))
            rows = []
            for i, j in chunks(offsets, CHUNK):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                shas = [hashlib.sha256(part[a:b]).digest() for a, b in zip(at[:-1], at[1:])]
                keys = np.array([int.from_bytes(s[:8], "little", signed=True) for s in shas], np.int64)
                rows += [(next(aside_to) % (1 << 30), DOC, d, int(b - a), s, k, None) for d, a, b, s, k in zip(ids[i:j], at[:-1], at[1:], shas, keys.tolist())]
                pos, h, p = anchors(part, at)
                row = np.searchsorted(at, pos, "right") - 1
                fresh = np.array([k not in seen and not seen.add(k) for k in keys.tolist()], bool)
                keep = fresh[row] if len(row) else np.zeros(0, bool)
                pos, h, row = pos[keep], h[keep], row[keep]
                left, right = np.maximum(at[row], pos - SPAN), np.minimum(at[row + 1], pos + THRESHOLD)
                around = range_hash(p, left, right) ^ mix((pos - left).astype(np.uint64) + MIX_A)
                held.append((h, around, keys[row].view(np.uint64), pos - at[row]))
                size += len(pos)
            if rows:
                yield emit(rows)
            if size > FLUSH:
                yield from flush()
                held, size, seen = [], 0, set()
        if size:
            yield from flush()

    return run


def _second(batches):
    """Documents as they are; positions of anchors that occur again, with a verdict on each."""
    import pyarrow as pa

    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("key", pa.int64()), ("pos", pa.int64()), ("verdict", pa.int32())])

    def found(k, pos, verdict):
        for i in range(0, len(k), 100_000):
            m = len(k[i : i + 100_000])
            cols = {"kind": pa.array(np.full(m, POST, np.int32)), "key": pa.array(k[i : i + m].view(np.int64)), "pos": pa.array(pos[i : i + m]), "verdict": pa.array(verdict[i : i + m].astype(np.int32))}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(m, f.type)) for f in schema], schema=schema)

    parts = []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        docs = batch.filter(pa.array(kinds == DOC))
        if docs.num_rows:
            m = docs.num_rows
            yield pa.RecordBatch.from_arrays([docs.column(f.name) if f.name in ("kind", "doc_id", "n_bytes", "sha", "key") else pa.nulls(m, f.type) for f in schema], schema=schema)
        for i in np.flatnonzero(kinds != DOC):
            x = np.frombuffer(batch.column("blob")[int(i)].as_buffer(), np.uint64).reshape(4, -1)
            if batch.column("n_bytes")[int(i)].as_py() == HOT:
                yield from found(x[2].copy(), x[3].view(np.int64).copy(), np.full(x.shape[1], HOT))
            else:
                parts.append(x.copy())
    if not parts:
        return
    h, c, k, pos = np.concatenate(parts, axis=1)
    del parts
    pos = pos.view(np.int64)
    o = np.lexsort((pos, k, c, h))
    h, c, k, pos = h[o], c[o], k[o], pos[o]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (pos[1:] != pos[:-1]) | (c[1:] != c[:-1])]
    h, c, k, pos = h[fresh], c[fresh], k[fresh], pos[fresh]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[at, len(h)])
    marked = np.repeat(np.add.reduceat((pos < 0).astype(np.int64), at) > 0, size)
    around = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    of = np.cumsum(around) - 1
    same = np.bincount(of[pos >= 0], minlength=of[-1] + 1)[of] > 1
    kinds = np.repeat(np.add.reduceat(around.astype(np.int64), at), size)
    open_ = np.where(marked | (kinds > GROUP), HOT, COLD)
    lead = np.zeros(len(h), bool)
    lead[np.flatnonzero(around & (pos >= 0))] = True
    after = np.flatnonzero(around & (pos < 0))
    lead[after[after + 1 < len(h)] + 1] |= ~around[after[after + 1 < len(h)] + 1]
    settled = np.where(lead & ((kinds > 1) | marked), PARTNER | open_, SETTLED)
    verdict = np.where(same, settled, open_)
    keep = (pos >= 0) & (np.repeat(size, size) > 1)
    yield from found(k[keep], pos[keep], verdict[keep])


_WORK = "core long, around long, key long, pos long, far int, near int, ctx binary"


def _surroundings(batches):
    """Bytes around the anchors that are not settled: windows start between far and near bytes before the anchor."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for key, text, marks in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("marks").to_pylist()):
            b = (text.as_py() or "").encode()
            for m in marks or ():
                if m["verdict"] == SETTLED:
                    continue
                p = m["pos"]
                left = max(0, p - SPAN)
                ctx = b[left : p + THRESHOLD]
                far, near = p - left, max(0, THRESHOLD - (len(b) - p))
                if far >= near:
                    rows.append(_work(ctx, far, far, near, SPAN, 0, key, p) + (m["verdict"] & ~PARTNER,))
        names = ["core", "around", "key", "pos", "far", "near", "ctx", "verdict"]
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary(), pa.int32()]
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096]), types)], names=names)


def _digest(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)


def _work(ctx: bytes, origin: int, far: int, near: int, high: int, low: int, key: int, pos: int) -> tuple:
    """Windows that start far to near bytes before the anchor, which lies at origin in ctx, by the bytes that
    all windows of the whole block from high to low have, and by the union of their own."""
    union = ctx[origin - far : origin - near + THRESHOLD]
    core = ctx[origin - low : origin - high + THRESHOLD]
    return _digest(core + low.to_bytes(4, "little")), _digest(union + far.to_bytes(4, "little") + near.to_bytes(4, "little")), key, pos, far, near, union


def _split(width: int):
    def run(batches):
        import pyarrow as pa

        names = ["core", "around", "key", "pos", "far", "near", "ctx"]
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                # blocks lie on a fixed grid, so that equal windows of different members fall into equal blocks
                for low in range(r["near"] // width * width, r["far"] + 1, width):
                    high = low + width - 1
                    rows.append(_work(r["ctx"], r["far"], min(r["far"], high), max(r["near"], low), high, low, r["key"], r["pos"]))
            for i in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 8192]), types)], names=names)

    return run


def _windows(batches):
    """Per member: the span of its bytes that repeated windows among its surroundings cover."""
    import pyarrow as pa

    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    ctx, off = text_bytes(t.column("ctx"))
    core, key, pos, far, near = (t.column(c).to_numpy() for c in ("core", "key", "pos", "far", "near"))
    n = np.maximum(far - near + 1, 0)
    # groups share a core, so they may be taken in lots
    lots = 1 + int(n.sum()) // LOT
    lot = (core.view(np.uint64) >> np.uint64(7)) % np.uint64(lots)
    for q in range(lots):
        rows = np.flatnonzero(lot == q)
        if not len(rows):
            continue
        hashes, owner, start = [], [], []
        for a in range(0, len(rows), MEMBERS):
            some = rows[a : a + MEMBERS]
            cut = np.concatenate([np.arange(off[i], off[i + 1]) for i in some])
            base = np.r_[0, np.cumsum(off[some + 1] - off[some])]
            p = prefix_hash(ctx[cut])
            who = np.repeat(np.arange(len(some)), n[some])
            step = np.arange(len(who)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            s = base[who] + step
            hashes.append(range_hash(p, s, s + THRESHOLD))
            owner.append(some[who])
            start.append(pos[some][who] - far[some][who] + step)
        h, who, s = np.concatenate(hashes), np.concatenate(owner), np.concatenate(start)
        k = key[who]
        o = np.lexsort((s, k, h))
        h, who, s, k = h[o], who[o], s[o], k[o]
        new = np.r_[True, h[1:] != h[:-1]]
        # the same window of a text may come by two anchors: it counts once
        place = new | np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
        of = np.cumsum(new) - 1
        again = np.bincount(of, weights=place)[of] > 1
        if not again.any():
            continue
        who, s = who[again], s[again]
        o = np.lexsort((s, who))
        who, s = who[o], s[o]
        at = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        last = np.r_[at[1:], len(who)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(key[who[at]]), pa.array(s[at]), pa.array(s[last] + THRESHOLD)], names=["key", "start", "stop"])


def _cut(with_text: bool):
    """Remaining bytes of the texts: spans are joined first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for sha, text, marks, spans in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "marks", "spans"))):
                b = (text or "").encode()
                n = len(b)
                iv = [(max(0, m["pos"] - SPAN), min(n, m["pos"] + THRESHOLD)) for m in marks or () if m["verdict"] in (SETTLED, PARTNER | COLD, PARTNER | HOT)]
                iv += [(x["start"], x["stop"]) for x in spans or ()]
                kept, at, runs, gone = [], 0, 0, 0
                for a, z in sorted(iv):
                    if a > at or not runs:
                        kept.append(b[at:a])
                        runs += 1
                        gone += z - a
                    elif z > at:
                        gone += z - at
                    at = max(at, z)
                kept = b"".join([*kept, b[at:]])
                out.append((sha, gone, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["sha", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): doc_id, n_bytes and sha of each row; what is left of each text that repeated windows touch."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    p = partitions(spark)
    dealt = docs.mapInArrow(_first(4 * p), "bucket int, kind int, doc_id long, n_bytes long, sha binary, key long, blob binary").repartition(p, "bucket")
    base = scratch.write(dealt.mapInArrow(_second, "kind int, doc_id long, n_bytes long, sha binary, key long, pos long, verdict int"), "base")
    rows = base.where(f"kind = {DOC}").select("doc_id", "n_bytes", "sha", "key")
    marks = base.where(f"kind = {POST}").groupBy("key").agg(F.collect_list(F.struct("pos", "verdict")).alias("marks"))
    once = rows.where(f"n_bytes >= {THRESHOLD}").groupBy("sha").agg(F.count("*").alias("copies"), F.first("key").alias("key"), F.min("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"))
    once = scratch.write(once, "once")
    # one text of each class that has marked anchors; classes of copies go entirely and only serve as partners
    wanted = once.join(marks, "key").select("sha", "key", "copies", F.col("doc_id").alias("id"), "marks")
    wanted = scratch.write(wanted, "wanted")
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["id"])).where(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == F.col("sha"))
    texts = scratch.write(texts.select("sha", "key", "copies", "text", "marks"), "texts")
    work = scratch.write(texts.where(F.exists("marks", lambda m: m["verdict"] != SETTLED)).select("key", "text", "marks").mapInArrow(_surroundings, _WORK + ", verdict int"), "work")
    by_core = lambda w: w.repartition(p, "core").mapInArrow(_windows, "key long, start long, stop long")
    scratch.write(by_core(work.where(f"verdict = {COLD}").drop("verdict")), "spans/part=0")
    hot = work.where(f"verdict = {HOT}").drop("verdict").dropDuplicates(["key", "pos"])
    for k, width in enumerate((SPAN + 1, *SPLITS)):
        if k:
            hot = scratch.write(hot.mapInArrow(_split(width), _WORK), f"hot{k}")
            if hot.isEmpty():
                break
        # a block whose union comes again is settled as a whole; one member of each union goes on
        unions = hot.groupBy("around").agg(F.count("*").alias("same"), F.first(F.struct("core", "key", "pos", "far", "near", "ctx")).alias("x"))
        unions = scratch.write(unions.select("around", "same", "x.*"), f"unions{k}")
        again = hot.join(unions.where("same > 1").select("around"), "around", "left_semi")
        scratch.write(again.select("key", (F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("near") + THRESHOLD).alias("stop")), f"spans/part={2 * k + 1}")
        if width == 1:
            break
        kinds = unions.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
        left = unions.join(kinds, "core").select("core", "around", "key", "pos", "far", "near", "ctx", "kinds")
        scratch.write(by_core(left.where(f"kinds <= {GROUP}").drop("kinds")), f"spans/part={2 * k + 2}")
        hot = left.where(f"kinds > {GROUP}").drop("kinds")
    spans = scratch.read("spans").groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cuts = texts.where("copies = 1").join(spans, "key", "left").where(F.col("spans").isNotNull() | F.exists("marks", lambda m: (m["verdict"] == SETTLED) | (m["verdict"] >= PARTNER)))
    cuts = scratch.write(cuts.select("sha", "text", "marks", "spans").mapInArrow(_cut(with_text), "sha binary, n_removed long, n_spans long, kept_sha256 string, kept string").dropDuplicates(["sha"]), "cuts")
    empty = hashlib.sha256(b"").hexdigest()
    gone = once.where("copies > 1").select("sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), F.lit("").alias("kept"))
    return rows, cuts.unionByName(gone)


def dedup_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    with small_batches(spark):
        rows, cuts = repeated_spans(docs, scratch)
        out = rows.join(cuts, "sha", "left").select(
            "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
            F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"))
        return scratch.write(out, "out")


class small_batches:
    """Arrow batches of few rows and bytes while eager steps run: texts may be long."""

    def __init__(self, spark, rows: int = 512):
        self.spark, self.limits = spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k) for k in self.limits}
        for k, v in self.limits.items():
            self.spark.conf.set(k, str(v))

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.set(k, v)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents"))
