"""Live guard: per-stream state in Structured Streaming.

Rows of a stream may arrive in any micro-batch and any order: a chunk waits until all before it are there.  The byte
guard holds back the end of a stream that may be the beginning of a secret or of an error's message, at most HELD
characters of it, and passes both stages one after the other as the batch guard does.  Redaction of events and tool
lists need no state; the argument-size rule counts bytes per tool.  A finish event or ``is_last`` chunk ends a
stream.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import BYTE_MESSAGE, PLACEHOLDER, SAFE_ERROR, SECRETS, python
from ..operators.streams import byte_violations

# The beginnings of secrets.
PREFIXES = ("sk-proj-", "sk-", "Bearer ", "github_pat_", "ghp_", "eyJ", "AKIA")
#: Most characters that are held back; a token that already is a secret goes out as one then and its rest is dropped,
#: others are let go but for the last LOOKBACK characters.
HELD, LOOKBACK = 1 << 16, 128

_PY = [re.compile(python(p)) for p in SECRETS]
_SPACE, _SOLID = python(r"\s"), python(r"\S")
#: Unfinished tokens by what they begin with, and what may go on behind a finished one.
_OPEN = re.compile(rf"(?:sk-[A-Za-z0-9_-]*|Bearer{_SPACE}+{_SOLID}*|Bearer|eyJ[A-Za-z0-9_.-]*|ghp_[A-Za-z0-9]*|github_pat_[A-Za-z0-9_]*|AKIA[0-9A-Z]*)\Z")
_MORE = {0: r"[A-Za-z0-9_-]*", 1: f"{_SOLID}*", 2: r"[A-Za-z0-9_-]*", 3: r"[A-Za-z0-9]*", 4: r"[A-Za-z0-9_]*"}
_MESSAGE = re.compile(python(BYTE_MESSAGE))
_OPEN_MESSAGE = re.compile(rf'"message"{_SPACE}*(?::{_SPACE}*(?:"(?:[^"\\]|\\.)*\\?)?)?\Z', re.S)


def _tail(text: str, opened: re.Pattern, beginnings) -> int:
    m = opened.search(text)
    n = len(text) - m.start() if m else 0
    for p in beginnings:
        for k in range(min(len(p) - 1, len(text)), n, -1):
            if text.endswith(p[:k]):
                n = k
                break
    return n


def _between(text: str, cut: int, patterns) -> int:
    """The last place up to ``cut`` that is not within a match: one may end in what is held back."""
    while (before := min((m.start() for p in patterns for m in p.finditer(text) if m.start() < cut < m.end()), default=cut)) < cut:
        cut = before
    return cut


def held_back(text: str) -> int:
    """Characters at the end that may belong to a secret which is not complete."""
    return _tail(text, _OPEN, PREFIXES)


def redact(text: str, placeholder: str = PLACEHOLDER) -> tuple[str, int]:
    n = 0
    for p in _PY:
        text, k = p.subn(lambda _: placeholder, text)
        n += k
    return text, n


@dataclass
class Stage:
    """A live transform: ``kept`` is not out yet, ``inside`` names the secret whose rest is being dropped (-1: none)."""

    kept: str = ""
    inside: int = -1

    def secrets(self, chunk: str, last: bool) -> tuple[str, int]:
        text = self.kept + chunk
        if self.inside >= 0:
            text = text[re.match(_MORE[self.inside], text).end() :]
            if not text and not last:
                return "", 0
            self.inside = -1
        cut = len(text) if last else len(text) - held_back(text)
        cut = _between(text, cut, _PY)
        out, n = redact(text[:cut])
        self.kept = text[cut:]
        if len(self.kept) > HELD:
            known = next((i for i, p in enumerate(_PY) if i in _MORE and p.fullmatch(self.kept)), None)
            if known is None:
                more, k = redact(self.kept[:-LOOKBACK])
                self.kept = self.kept[-LOOKBACK:]
            else:
                more, k, self.kept, self.inside = PLACEHOLDER, 1, "", known
            out, n = out + more, n + k
        return out, n

    def errors(self, chunk: str, last: bool) -> tuple[str, int]:
        text = self.kept + chunk
        cut = len(text) if last else len(text) - _tail(text, _OPEN_MESSAGE, ('"message"',))
        if len(text) - cut > HELD:
            cut = len(text) - LOOKBACK
        cut = _between(text, cut, (_MESSAGE,))
        out, n = _MESSAGE.subn(f'"message":"{SAFE_ERROR}"', text[:cut])
        self.kept = text[cut:]
        return out, n


@dataclass
class Live:
    """A stream's state: both stages, and the chunks that wait for the one numbered ``next``."""

    secrets: bool = True
    errors: bool = False
    first: Stage = field(default_factory=Stage)
    second: Stage = field(default_factory=Stage)
    next: int = 0
    waiting: dict[int, tuple[bytes, bool]] = field(default_factory=dict)

    def feed(self, text: str, last: bool) -> tuple[str, int, int]:
        n = m = 0
        if self.secrets:
            text, n = self.first.secrets(text, last)
        if self.errors:
            text, m = self.second.errors(text, last)
        return text, n, m

    def take(self, index: int, chunk: bytes, last: bool):
        """(index, bytes, redactions, sanitized, ended) of the chunks that this one makes ready; copies of a chunk count once."""
        if index >= self.next:
            self.waiting.setdefault(index, (chunk, last))
        while self.next in self.waiting:
            chunk, last = self.waiting.pop(self.next)
            text, n, m = self.feed(chunk.decode("latin-1"), last)
            if text or n or m:
                yield self.next, text.encode("latin-1"), n, m, last
            self.next = self.next + 1
            if last:
                return


_STATE = "kept string, inside int, kept_errors string, next long, at array<long>, chunks array<binary>, lasts array<boolean>"


def guard_byte_stream(chunks: DataFrame, secrets: bool = True, errors: bool = False, idle_ms: int | None = None) -> DataFrame:
    """(stream_id, chunk_index, chunk, redactions, sanitized) of a streaming (stream_id, chunk_index, chunk, is_last) table.

    Chunks of a stream count from 0.  Nothing empty goes out.  The state is bounded by HELD, and by the chunks that
    wait for one that is late.  With ``idle_ms`` a stream from which nothing has come for so long is ended, and what
    waits goes out in its order; this is for triggers that go on, as one that ends with the input would never end.
    """

    def run(key, batches, state):
        import pandas as pd

        live = Live(secrets, errors)
        if state.exists:
            kept, inside, kept_errors, live.next, at, waiting, lasts = state.get
            live.first, live.second = Stage(kept, inside), Stage(kept_errors)
            live.waiting = {i: (bytes(c), bool(z)) for i, c, z in zip(at, waiting, lasts)}
        out, ended = [], False
        if state.hasTimedOut:
            text = b"".join(live.waiting[i][0] for i in sorted(live.waiting)).decode("latin-1")
            text, n, m = live.feed(text, True)
            out, ended = [(live.next, text.encode("latin-1"), n, m, True)] if text or n or m else [], True
        else:
            for rows in batches:
                for row in sorted(zip(rows["chunk_index"], rows["chunk"], rows["is_last"]), key=lambda r: r[0]):
                    out.extend(live.take(int(row[0]), bytes(row[1]), bool(row[2])))
                    ended = ended or bool(row[2]) and live.next > int(row[0])
            ended = ended or any(x[4] for x in out)
        if ended:
            state.remove()
        else:
            at = sorted(live.waiting)
            state.update((live.first.kept, live.first.inside, live.second.kept, live.next, at, [live.waiting[i][0] for i in at], [live.waiting[i][1] for i in at]))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *x[:4]) for x in out], columns=["stream_id", "chunk_index", "chunk", "redactions", "sanitized"])

    kind = dict(chunks.dtypes)["stream_id"]
    return chunks.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, chunk_index long, chunk binary, redactions int, sanitized int", _STATE, "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def stream_violations(guarded: DataFrame, mode: str = "warn", policy_version: str | None = None) -> DataFrame:
    """The live violation log: at most one row a chunk and rule, for a sink of its own (see ``split_outputs``)."""
    return byte_violations(guarded, mode, policy_version)


def guard_tool_stream(events: DataFrame, most: int) -> DataFrame:
    """Finished tool calls of a streaming event table with the bytes of their deltas and whether these exceed ``most``."""

    def run(key, batches, state):
        import pandas as pd

        counts = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("event_index")
        out = []
        for i, phase, tool, name, text in zip(rows["event_index"], rows["phase"], rows["id"], rows["name"], rows["args_text"]):
            k = tool or f"__name:{name or ''}"
            if phase == "delta":
                counts[k] = counts.get(k, 0) + len((text or "").encode())
            elif phase == "done":
                n = counts.pop(k, 0)
                out.append((key[0], int(i), name, n, n > most))
        state.update((list(counts), list(counts.values())))
        yield pd.DataFrame(out, columns=["stream_id", "event_index", "name", "bytes", "exceeded"])

    kind = dict(events.dtypes)["stream_id"]
    calls = events.where("type = 'tool_call'").select("stream_id", "event_index", "phase", "id", "name", "args_text")
    return calls.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, event_index long, name string, bytes long, exceeded boolean", "keys array<string>, sizes array<long>", "append", "NoTimeout")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, appended to Parquet files."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def split_outputs(batch: DataFrame, on_events, on_violations) -> None:
    """For foreachBatch: rows tagged by ``kind`` to two sinks."""
    batch = batch.persist()
    on_events(batch.where(F.col("kind") == "event"))
    on_violations(batch.where(F.col("kind") == "violation"))
    batch.unpersist()
