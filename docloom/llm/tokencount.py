"""Token counts by prefix dynamic programming.

The vocabulary is a byte-level BPE in merge order.  For a piece of text (a
pre-token) the table ``count[i]`` holds the exact number of tokens of its first
``i`` bytes.  ``count[i] = count[i - len(t)] + 1`` for the one token ``t`` that
ends the encoding of that prefix: it ends there, and it and the last token of
the rest encode to themselves when put together.  A text's table is the tables
of its pre-tokens put end to end, so truncation and budget questions are
lookups, with no text encoded again.

Defined results: null counts as the empty text, with 0 tokens; repeated rows
count alike; texts of any length are counted whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.runtime import add_columns

#: Fixed value: the public pattern that splits text before byte-level BPE merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The contractions of that pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@dataclass(frozen=True)
class Settings:
    limit: int = 512
    #: Pre-tokens whose counts a worker remembers; the memory is emptied when full.
    remembered: int = 600_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of all prefixes under one byte-level BPE vocabulary."""

    def __init__(self, spec: bytes, s: Settings = Settings()):
        model = json.loads(spec)
        letters = _byte_alphabet()
        decode = lambda t: bytes(letters[c] for c in t)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.rank = {(decode(a), decode(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.longest = max(map(len, self.tokens))
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        self._at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._find = regex.compile(PATTERN).findall
        self._iter = regex.compile(PATTERN).finditer
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._s = s
        counter = self

        class Remembered(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= s.remembered:
                    self.clear()
                n = self[piece] = counter.table(piece.encode())[-1]
                return n

        self._known = Remembered()

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain BPE: the lowest-ranked neighbouring pair merges first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _side_by_side(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are when encoded together."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= self._s.remembered:
                self._fits.clear()
            known = self._fits[key] = self.encode(left + right) == ([left, right] if left else [right])
        return known

    def table(self, piece: bytes) -> list[int]:
        """Token counts of all byte prefixes of one pre-token: len(piece) + 1 numbers."""
        count, last = [0], [b""]
        tokens, fits = self.tokens, self._side_by_side
        for i in range(1, len(piece) + 1):
            for k in range(max(0, i - self.longest), i):
                t = piece[k:i]
                if t in tokens and fits(last[k], t):
                    count.append(count[k] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError("no token ends here")
        return count

    def _segments(self, text: str) -> list[str]:
        return self._at_special.split(text) if self._at_special and any(x in text for x in self.special) else [text]

    def count(self, text: str) -> int:
        """Tokens of the whole text; a special string in it is one token."""
        parts = self._segments(text)
        known = self._known
        return len(parts) - 1 + sum(sum(map(known.__getitem__, self._find(x))) for x in parts)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the first 0, 1, ... len(text) code points, each counted as a text of its own.

        A special string counts as its plain characters until it is complete.
        """
        out = np.zeros(len(text) + 1, np.int64)
        at, total = 0, 0
        marks = [*self._at_special.finditer(text)] if self._at_special else []
        for m in [*marks, None]:
            end = m.start() if m else len(text)
            # The special string's own characters continue the segment until it is complete.
            stop = m.end() if m else end
            part = self._plain_counts(text[at:stop])
            out[at : stop + 1] = total + part
            if m:
                total += int(part[end - at]) + 1
                out[stop] = total
            at = stop
        return out

    def _plain_counts(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        total, space_at, space_total = 0, -1, 0
        for m in self._iter(text):
            a, b = m.span()
            piece = m.group()
            if text[a].isspace() and (a == 0 or not text[a - 1].isspace()):
                space_at, space_total = a, total
            counts = self.table(piece.encode())
            step = np.cumsum([0] + [len(c.encode()) for c in piece])
            out[a + 1 : b + 1] = total + np.array(counts)[step[1:]]
            if piece in CONTRACTIONS:
                for k in range(1, len(piece)):
                    out[a + k] = total + sum(self._known[x] for x in self._find(piece[:k]))
            if space_at >= 0 and text[a].isspace():
                # Prefixes that end within white space take the run so far as one pre-token.
                end = a
                while end < b and text[end].isspace():
                    end += 1
                run = text[space_at:end]
                whole = np.array(self.table(run.encode()))[np.cumsum([0] + [len(c.encode()) for c in run])]
                out[a + 1 : end + 1] = space_total + whole[a + 1 - space_at :]
                if end < b:
                    space_at = -1
            else:
                space_at = -1
            total += counts[-1]
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


_COUNTERS: dict[int, PrefixCounter] = {}


def counter_of(spec: bytes, s: Settings = Settings()) -> PrefixCounter:
    """One counter per worker and vocabulary."""
    key = hash((spec, s))
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(spec, s)
    return _COUNTERS[key]


def _spec(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, s: Settings = Settings()) -> DataFrame:
    """Docs with ``n_bytes``, ``n_tokens`` and ``over_limit`` added.

    ``vocabulary`` is the path of a byte-level BPE file on the driver; its
    content travels to the executors (a file of a few MB at most).
    """
    shared = docs.sparkSession.sparkContext.broadcast(_spec(vocabulary))

    def compute(col: pa.Array) -> list[pa.Array]:
        counter = counter_of(shared.value, s)
        col = pc.fill_null(col, "")
        n = pa.array([counter.count(x) for x in col.to_pylist()], pa.int64())
        return [pc.binary_length(col).cast(pa.int64()), n, pc.greater(n, s.limit)]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return add_columns(docs, text_col, fields, compute, keep)


def fit_to_budget(docs: DataFrame, vocabulary: str, budget: int, text_col: str = "text", keep: list[str] | None = None, s: Settings = Settings()) -> DataFrame:
    """Docs with ``prefix_chars``: code points of the longest prefix within the budget (null: 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(_spec(vocabulary))

    def compute(col: pa.Array) -> list[pa.Array]:
        counter = counter_of(shared.value, s)
        return [pa.array([counter.longest_within(x or "", budget) for x in col.to_pylist()], pa.int64())]

    return add_columns(docs, text_col, [T.StructField("prefix_chars", T.LongType())], compute, keep)


def run(docs: DataFrame, vocabulary: str, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(docs, vocabulary, keep=["doc_id"], s=s)
