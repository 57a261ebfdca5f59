"""Toxicity scores from a lexicon trie, Levenshtein automata and the words around each hit.

The lexicon and a small logistic model are fitted on a bounded sample of labelled rows.  Terms are whole words or
stems; one trie holds both.  The Levenshtein automata of all terms, intersected with the trie, are one automaton
whose states are sets of (trie node, edits so far); it is made deterministic as words are read, and kept.  Every
term may be met with as many edits as its length allows (``edits_for``), fewer where the clean texts of the sample
hold words that near it; an edited hit weighs less, the shorter its term.  A document's features weigh its hits by
the window around them: hits within quotation marks count apart from plain ones.

Training reads texts on the executors only: word counts, sketches and features come to the driver.

Cases: null and empty texts score as texts without hits; repeated rows score alike, and count once in training;
null ids are never held out; without usable labels the base lexicon and default weights hold; an empty table gives
no rows; only doc_id and text are read, and labels only for training.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table
from .substring_dedup import small_batches

#: Most labelled rows of either kind that training reads, chosen by a hash of their ids.
MOST_TOXIC, MOST_CLEAN = 2000, 4000
#: Lengths of stems; words of context on each side.
STEMS, AROUND = range(4, 9), 6
#: Words whose verdicts and states whose steps a worker keeps.
KEPT_WORDS, KEPT_STATES = 500_000, 100_000
#: How many times more often toxic texts must hold a term than clean ones.
LIFT = 12
#: Share of the clean texts that may hold words some edits away from a term which is met with that many.
STRAY = 0.001
#: A lexicon to start from; training adds to it.
BASE = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting")
QUOTES = re.compile("[\"“”„«»]")
_TRIM = ".,;:!?()[]{}<>|/\\*#$%&~^_+=-\"'“”„«»‘’…"
#: Signs that join words into one.
_JOINT = re.compile(r"[-./_,;:!?&+*#|\\\"'“”„«»‘’…()\[\]{}<>=~^]+")
#: Digits and signs that stand for letters in disguised words.
_LEET = str.maketrans("013457@$", "oleastas")


def edits_for(length: int) -> int:
    """Edits with which a term may be met."""
    return 0 if length < 4 else 1 if length < 8 else 2


class Lexicon:
    """Terms with the edits allowed for each, as a trie, and the automaton that meets words with all of them at once."""

    WORD, STEM = 1, 2

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.term, self.word, self.stem = [""], [-1], [-1]
        for allowed, terms in ((self.word, words), (self.stem, stems)):
            for t, k in terms.items():
                node = 0
                for c in t:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.term.append(self.term[node] + c)
                        self.word.append(-1)
                        self.stem.append(-1)
                    node = self.next[node][c]
                allowed[node] = max(allowed[node], k)
        # edits that some term below a node still allows
        self.room = [max(w, s) for w, s in zip(self.word, self.stem)]
        for node in range(len(self.next) - 1, -1, -1):
            self.room[node] = max([self.room[node], *(self.room[x] for x in self.next[node].values())])
        self.reset()

    def reset(self):
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.words: list[tuple | None] = []
        self.stems: list[tuple | None] = []
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """Number of the state with these nodes, each with the least edits, and all that leaving out letters of terms adds."""
        todo = [n for n, e in edits.items() if e <= self.room[n]]
        edits = {n: edits[n] for n in todo}
        while todo:
            node = todo.pop()
            e = edits[node] + 1
            for child in self.next[node].values():
                if e <= self.room[child] and e < edits.get(child, 99):
                    edits[child] = e
                    todo.append(child)
        key = tuple(sorted(edits.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            for kept, allowed in ((self.words, self.word), (self.stems, self.stem)):
                kept.append(min(((e, -len(self.term[n]), self.term[n]) for n, e in key if e <= allowed[n]), default=None))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        edits: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost < edits.get(child, 99):
                    edits[child] = cost
            if e + 1 < edits.get(node, 99):
                edits[node] = e + 1
        new = self.steps[state][c] = self._state(edits)
        return new

    def meet(self, w: str) -> tuple[int, str, int] | None:
        """(edits, term, kind) of the term that ``w`` is, or the stem it begins with, in the fewest edits; of words
        and stems with as many the word; None if there is none."""
        if len(self.sets) > KEPT_STATES:
            self.reset()
        state, stem = self.start, None
        for c in w:
            new = self.steps[state].get(c)
            state = self._step(state, c) if new is None else new
            found = self.stems[state]
            if found is not None and (stem is None or found < stem):
                stem = found
            if not self.sets[state]:
                break
        else:
            word = self.words[state]
            if word is not None and (stem is None or word[0] <= stem[0]):
                return word[0], word[2], self.WORD
        return stem and (stem[0], stem[2], self.STEM)


class Scanner:
    """Features of texts. What a word meets is kept: (slot of its feature, weight, term, edits)."""

    SLOTS = {Lexicon.WORD: 0, Lexicon.STEM: 1}

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        self.lexicon, self.seen, self.bad = Lexicon(words, stems), set(), {}

    def _one(self, t: str):
        found = self.lexicon.meet(t)
        if not found or found[0]:
            # a disguise counts as an edit, and not in numbers or dates
            plain = t.translate(_LEET)
            if plain != t and any(c.isalpha() for c in t):
                other = self.lexicon.meet(plain)
                if other and (not found or other[0] < found[0]):
                    found = (other[0] or 1, *other[1:])
        if not found:
            return None
        edits, term, kind = found
        return (self.SLOTS[kind], 1.0, term, 0) if not edits else (2, max(0.1, 1 - edits / len(term)), term, edits)

    def verdict(self, w: str):
        parts = [t for t in _JOINT.split(w) if t]
        if len(parts) > 1:
            if all(len(t) <= 2 for t in parts):
                parts = ["".join(parts)]
            else:
                return min((v for v in map(self._one, [*parts, w.strip(_TRIM)]) if v), key=lambda v: (v[3], v[0], v[2]), default=None)
        return self._one(w.strip(_TRIM) if len(parts) != 1 else parts[0])

    def hits(self, text: str | None) -> tuple[list[str], list[int]]:
        """Words of a text, and the places of those that meet a term."""
        words = (text or "").lower().split()
        distinct = set(words)
        for w in distinct - self.seen:
            v = self.verdict(w)
            if v:
                self.bad[w] = v
        self.seen |= distinct
        if len(self.seen) > KEPT_WORDS:
            self.seen = set(self.bad)
        return words, [] if distinct.isdisjoint(self.bad) else [i for i, w in enumerate(words) if w in self.bad]

    def features(self, text: str | None) -> list[float]:
        words, hits = self.hits(text)
        if not hits:
            return [0.0] * 6
        bad, counts, quoted, crowd = self.bad, [0.0] * 3, 0.0, 0.0
        near = Counter()
        for i, j in zip(hits, hits[1:]):
            if j - i <= AROUND:
                near[i] += 1
                near[j] += 1
        for i in hits:
            before = sum(len(QUOTES.findall(w)) for w in words[max(0, i - AROUND) : i])
            own = len(QUOTES.findall(words[i]))
            after = sum(len(QUOTES.findall(w)) for w in words[i + 1 : i + 1 + AROUND])
            slot, weight, _, _ = bad[words[i]]
            if own >= 2 or ((before % 2 or own) and (after or own)):
                quoted += weight
            else:
                counts[slot] += weight
                crowd += weight * (near[i] > 0)
        return [*map(math.log1p, (*counts, quoted, crowd)), math.log1p(100 * sum(counts) / len(words))]


def sketch(text: str | None) -> list[int]:
    """The eight least hashes of a text's word pairs."""
    words = (text or "").lower().split()
    return sorted({zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])})[:8]


def originals(sketches: list[list[int]]) -> list[int]:
    """Places of texts that are no near copies of earlier ones: copies of one text would vouch for its every word.

    Texts that share three of their eight hashes count as copies.
    """
    held, kept = {}, []
    for i, least in enumerate(sketches):
        common = Counter(j for h in least for j in held.get(h, ()))
        if not common or max(common.values()) < 3:
            kept.append(i)
            for h in least:
                held.setdefault(h, []).append(i)
    return kept


def word_counts(texts) -> Counter:
    """(word or None, stem or None): in how many of the texts."""
    out = Counter()
    for text in texts:
        ws = {t for w in (text or "").lower().split() for t in (w.strip(_TRIM), *_JOINT.split(w)) if t}
        out.update((w, None) for w in ws if len(w) >= 3)
        out.update({(None, w[:k]) for w in ws for k in STEMS if len(w) > k})
    return out


def choose_terms(words: dict[str, int], stems: dict[str, int]) -> tuple[list[str], list[str]]:
    """Of words and stems with the number of toxic texts that hold them: the widest stems first, each but those that
    one whole word stands behind; then the words that no stem covers."""
    kept: list[str] = []
    for s in sorted(stems, key=lambda s: (-stems[s], len(s), s)):
        inner = max((n for w, n in words.items() if w.startswith(s)), default=0)
        if inner < 0.7 * stems[s] and not any(s.startswith(k) or k.startswith(s) for k in kept):
            kept.append(s)
    return sorted(w for w in words if not any(w.startswith(k) for k in kept)), sorted(kept)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression with an intercept, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


#: Weights without labels: intercept, words, stems, near words, quoted, crowded, density.
DEFAULT = np.array([-4.0, 3.0, 2.0, 1.5, 0.2, 1.0, 0.8])


def held_out():
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _rows(df: DataFrame, schema: str, make) -> DataFrame:
    """``df`` (doc_id, toxic, text) through ``make``, which maps lists of ids, labels and texts to rows of ``schema``."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))

    def run(batches):
        import pyarrow as pa

        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
        for batch in batches:
            rows = list(make(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=list(names))

    return df.select("doc_id", "toxic", "text").mapInArrow(run, schema)


def _counted(ids, toxic, texts):
    for y in (0, 1):
        for (word, stem), n in word_counts(t for t, z in zip(texts, toxic) if z == y).items():
            yield word, stem, y, n


def _strays(words: dict[str, int], stems: dict[str, int]):
    """Per term and number of edits: in how many texts of either kind words that near it occur."""

    def make(ids, toxic, texts):
        scan, out = Scanner(words, stems), Counter()
        for y, text in zip(toxic, texts):
            found, hits = scan.hits(text)
            out.update({(scan.bad[found[i]][2], scan.bad[found[i]][3], y) for i in hits if scan.bad[found[i]][3]})
        for (term, edits, y), n in out.items():
            yield term, edits, y, n

    return make


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN):
    """(words, stems, weights) from the labelled rows that are not held out, a bounded sample of them; terms with the
    edits allowed for each."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(~held_out()).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = None
    for kind, most in ((1, most_toxic), (0, most_clean)):
        some = known.where(f"toxic = {kind}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.unionByName(some)
    ids = scratch.write(ids, "ids")
    base = {w: edits_for(len(w)) for w in BASE}
    with small_batches(spark):
        sample = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
        rows = sorted(tuple(r) for r in _rows(sample, "doc_id long, toxic int, least array<long>", lambda i, y, t: zip(i, y, map(sketch, t))).collect())
        if sum(r[1] for r in rows) < 10 or sum(1 - r[1] for r in rows) < 10:
            return base, {}, DEFAULT
        own = [rows[i] for i in originals([r[2] for r in rows])]
        n1, n0 = (max(1, sum(r[1] == y for r in own)) for y in (1, 0))
        chosen = spark.createDataFrame([(r[0],) for r in own], "doc_id long")
        held = _rows(sample.join(F.broadcast(chosen), "doc_id", "left_semi"), "word string, stem string, toxic int, n long", _counted)
        of = lambda y: F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0))
        held = held.groupBy("word", "stem").agg(of(1).alias("n1"), of(0).alias("n0"))
        least = max(5, n1 // 80)
        more = (F.col("n1") * n0 >= LIFT * n1 * (F.col("n0") + 0.5)) & (F.col("n1") >= F.when(F.col("word").isNotNull(), least).otherwise(2 * least))
        found = held.where(more).collect()
        words, stems = choose_terms({r["word"]: r["n1"] for r in found if r["word"]}, {r["stem"]: r["n1"] for r in found if r["stem"]})
        words, stems = {w: edits_for(len(w)) for w in sorted({*words, *BASE})}, {w: edits_for(len(w)) for w in stems}
        # edits that clean texts hold by chance are not allowed
        clean = sum(1 - r[1] for r in rows)
        strays = _rows(sample, "term string, edits int, toxic int, n long", _strays(words, stems)).groupBy("term", "edits").agg(of(1).alias("n1"), of(0).alias("n0"))
        for r in strays.where(F.col("n0") > max(1.0, STRAY * clean)).where(F.col("n1") * clean < LIFT * (len(rows) - clean) * F.col("n0")).collect():
            for terms in (words, stems):
                if r["term"] in terms:
                    terms[r["term"]] = min(terms[r["term"]], r["edits"] - 1)

        def features(ids, toxic, texts):
            scan = Scanner(words, stems)
            return zip(ids, toxic, map(scan.features, texts))

        rows = sorted(tuple(r) for r in _rows(sample, "doc_id long, toxic int, x array<double>", features).collect())
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows], np.int64)
    w = fit(x, y)
    # disguised and quoted hits are rare in training: they take a part of the plain words' weight
    if x[:, 2].astype(bool).sum() < 50:
        w[3] = 0.6 * max(w[1], 0)
    if x[:, 3].astype(bool).sum() < 50:
        w[4] = 0.1 * max(w[1], 0)
    return words, stems, w


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(words: dict[str, int], stems: dict[str, int]) -> Scanner:
    """The scanner of this process: tasks that follow each other in a worker share what it keeps."""
    key = tuple(words.items()), tuple(stems.items())
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(words, stems)
    return _SCANNERS[key]


def score(docs: DataFrame, model) -> DataFrame:
    words, stems, weights = model

    def run(batches):
        import pyarrow as pa

        scan = _scanner(words, stems)
        for batch in batches:
            x = np.array([scan.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 6)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
