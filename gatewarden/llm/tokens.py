"""Token ids of texts, word by word: the tokenizer never joins over white space, so words may be kept."""

from __future__ import annotations

import os
from itertools import chain, filterfalse

import numpy as np

#: Distinct words whose ids a worker keeps in either of two generations; words in use move to the younger.
KEPT_WORDS = 600_000
#: str.split() cuts at these too, the tokenizer does not; texts that hold one are encoded whole.
_ODD = "\x1c\x1d\x1e\x1f"
_WORKERS: dict[tuple, WordTokenizer] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path: str | None = None, plain: bool = False) -> WordTokenizer:
    """The tokenizer of this process: tasks that follow each other in a worker share what it keeps."""
    key = path or default_path(), plain
    if key not in _WORKERS:
        _WORKERS[key] = WordTokenizer(*key)
    return _WORKERS[key]


class WordTokenizer:
    """Little-endian 32-bit ids of texts under a ``tokenizers`` file whose pre-tokenizer drops white space and
    separates letters from other signs, and whose normalizer lowers letters one by one."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # plain: the strings of special tokens are ordinary text, so that no text yields their ids
        self.plain = plain
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        self.tokenizer.encode_special_tokens = self.plain
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words; those of letters only are one run each, which ends with a token that ends a word, so many go together."""
        runs = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        found = dict(zip(rest, self._whole(rest))) if rest else {}
        lots = [runs[i : i + 1000] for i in range(0, len(runs), 1000)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(lot) for lot in lots], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stop = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            raw, a = ids.tobytes(), 0
            if len(stop) != len(lot):  # letters that the tokenizer sees otherwise
                found.update(zip(lot, self._whole(lot)))
                continue
            for w, z in zip(lot, stop):
                found[w] = raw[a:z]
                a = z
        return [found[w] for w in words]

    def _learn(self, new: set[str]) -> None:
        for w in new & self.older.keys():
            self.kept[w] = self.older[w]
        # a comma or full stop after a letter is a token of its own; a capital makes no difference, but for
        # two letters whose lower case depends on more than the letter or is more than one
        forms, kept = [], self.kept
        for w in new - kept.keys():
            stem, tail = (w[:-1], w[-1]) if w[-1] in ",." and w[-2:-1].isalpha() else (w, "")
            if "\u03a3" in w or "\u0130" in w:
                stem, tail = w, ""
            else:
                stem = stem.lower()
            forms.append((w, stem, tail))
        stems = list({f[1] for f in forms} | {",", "."})
        ids = dict(zip(stems, self._words(stems)))
        ids[""] = b""
        for w, stem, tail in forms:
            kept[w] = ids[stem] + ids[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.kept) > KEPT_WORDS:
            self.older, self.kept = self.kept, {}
        odd = [i for i, t in enumerate(texts) if t and any(c in t for c in _ODD)]
        words = [[] if not t else t.split() for t in texts]
        for i in odd:
            words[i] = []
        new = set(filterfalse(self.kept.__contains__, chain.from_iterable(words)))
        if new:
            self._learn(new)
        get = self.kept.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]) if odd else []):
            out[i] = ids
        return out
