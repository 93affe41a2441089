"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words; a window's set is its
word shingles.  Shingles are ordered by rarity in the corpus, counted over all
documents.  A window can only be contained whole in a document that has its
rarest shingle, so that one (the necessary prefix of full containment) is the
join token.  A shared token fixes where the window would lie; the positional
bound is that it starts there and the length bound that it fits in the
document.  What is left is verified word for word.

The item side is a query set.  It is dealt into blocks of about
``block_bytes`` of text by a hash of the item (a longer item is a block of its
own).  The driver builds one block at a time, a few flat arrays, and broadcasts
it, a block's size being the bound; the shingle counts stay a table, of which
the driver reads one block's part at a time.  A task holds one block at a time
and takes the next from its executor's disk.

Defined results: null and empty texts have no words and no hits; an item
without words, with null text or with null id has no windows; an item of fewer
words than a window is one window; repeated item ids count once; repeated
document rows get the same result each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import text as tx
from docloom.llm.runtime import add_columns, cut, keep_rows, workers

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


@dataclass(frozen=True)
class Settings:
    window: int = 8
    shingle: int = 3
    min_items: int = 2
    #: Text of the benchmark in one broadcast block.
    block_bytes: int = 4 << 20


@dataclass
class Words:
    """The words of a run of rows: spans in ``data``, hashes, and the row's first word at ``first[row]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, offs: np.ndarray) -> "Words":
        data, begin = tx.separated(tx.lower_ascii(buf), offs)
        start, end = tx.runs(_WORD[data])
        return cls(data, start, end, tx.Rolling(data).span(start, end), np.searchsorted(start, begin))

    def shingles(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, also across rows (the bounds are checked later)."""
        return tx.gram_hashes(self.code, n)

    def window(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * np.uint64(tx.BASE) + self.code[at + k]
        return tx.mix(h)

    def spelled(self, at: int, n: int) -> bytes:
        raw = self.data
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist()))


@dataclass
class Block:
    """The different windows of some items, as flat arrays."""

    items: list[str]
    #: Windows spelled out one after another; window w is ``spelled[begin[w]:begin[w + 1]]``.
    spelled: bytes
    begin: np.ndarray
    #: Items that have window w: ``owner[owned[w]:owned[w + 1]]``.
    owner: np.ndarray
    owned: np.ndarray
    length: np.ndarray
    code: np.ndarray
    #: Shingle sizes that occur.
    sizes: tuple[int, ...]
    sieve: np.ndarray
    #: Of each shingle its window, place in it and hash; of the tokens alone, and by hash, after order().
    window: np.ndarray
    at: np.ndarray
    token: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str]], s: Settings) -> "Block":
        item_no: dict[str, int] = {}
        known: dict[bytes, int] = {}
        owners: dict[tuple[int, int], None] = {}
        length, code, sh_w, sh_p, sh_h = [], [], [], [], []
        for a, b, buf, offs in tx.slices(pa.array([t for _, t in rows], pa.string())):
            w = Words.of(buf, offs)
            for r in range(b - a):
                lo, hi = int(w.first[r]), int(w.first[r + 1])
                n = min(s.window, hi - lo)
                if not n:
                    continue
                no = item_no.setdefault(rows[a + r][0], len(item_no))
                for at in range(lo, hi - n + 1):
                    win = known.setdefault(w.spelled(at, n), len(known))
                    if win == len(length):
                        length.append(n)
                        code.append(w.window(np.array([at]), n)[0])
                        h = tx.gram_hashes(w.code[at : at + n], min(s.shingle, n))
                        sh_w.append(np.full(len(h), win))
                        sh_p.append(np.arange(len(h)))
                        sh_h.append(h)
                    owners[win, no] = None
        pairs = np.array(sorted(owners), np.int64).reshape(-1, 2)
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        token = flat(sh_h, np.uint64)
        return cls(
            list(item_no),
            b"".join(known),
            np.cumsum([0, *map(len, known)]),
            pairs[:, 1],
            np.searchsorted(pairs[:, 0], np.arange(len(known) + 1)),
            np.array(length, np.int64),
            np.array(code, np.uint64),
            tuple(sorted({min(s.shingle, n) for n in length})),
            _sieve(token),
            flat(sh_w, np.int64),
            flat(sh_p, np.int64),
            token,
        )

    def order(self, shingle: np.ndarray, n: np.ndarray) -> "Block":
        """Choose each window's rarest shingle as its join token; ``shingle`` is sorted, ``n`` its count in the corpus."""
        often = np.zeros(len(self.token), np.int64)
        if len(shingle):
            found = np.minimum(np.searchsorted(shingle, self.token), len(shingle) - 1)
            often = np.where(shingle[found] == self.token, n[found], 0)
        by = np.lexsort((self.at, self.token, often, self.window))
        rarest = by[np.unique(self.window[by], return_index=True)[1]]
        rarest = rarest[np.argsort(self.token[rarest], kind="stable")]
        self.token, self.window, self.at = self.token[rarest], self.window[rarest], self.at[rarest]
        self.sieve = _sieve(self.token)
        return self

    def names(self, window: int) -> list[str]:
        return [self.items[i] for i in self.owner[self.owned[window] : self.owned[window + 1]].tolist()]

    def spells(self, window: int) -> bytes:
        return self.spelled[self.begin[window] : self.begin[window + 1]]


_SIEVE_BITS = 20


def _sieve(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _SIEVE_BITS, bool)
    out[(hashes >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
    return out


def _through(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(sieve[(hashes >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])


def _occurrences(block: Block, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in the run of rows."""
    found_w, found_at = [], []
    for k in block.sizes:
        h = w.shingles(k)
        at = _through(block.sieve, h)
        lo = np.searchsorted(block.token, h[at], "left")
        n = np.searchsorted(block.token, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            continue
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        win = block.window[entry]
        row = np.searchsorted(w.first, np.repeat(at, n), "right") - 1
        start = np.repeat(at, n) - block.at[entry]
        size = block.length[win]
        # Positional and length bounds; a window of another shingle size has another token.
        ok = (np.minimum(size, k) == k) & (start >= w.first[row]) & (start + size <= w.first[row + 1])
        win, start, size = win[ok], start[ok], size[ok]
        for n_words in np.unique(size):
            pick = size == n_words
            a, b = start[pick], win[pick]
            same = w.window(a, int(n_words)) == block.code[b]
            a, b = a[same], b[same]
            real = [w.spelled(x, int(n_words)) == block.spells(y) for x, y in zip(a.tolist(), b.tolist())]
            real = np.array(real, bool)
            found_at.append(a[real])
            found_w.append(b[real])
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_w), np.concatenate(found_at)


_EMPTY = hashlib.sha256(b"").hexdigest()

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def _items(bench: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """(i, t, b): the items and the block of each; and how many blocks there are."""
    rows = bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / s.block_bytes))
    return rows.withColumn("b", F.pmod(F.xxhash64("i"), n).cast("int")), n


def _block(items: DataFrame, k: int, s: Settings) -> Block:
    return Block.of([(r.i, r.t) for r in items.where(F.col("b") == k).orderBy("i", "t").collect()], s)


def _one_by_one(shared: list[Broadcast]) -> Iterator[tuple[int, Block]]:
    """The blocks in turn; of several a process holds one, and reads the next from its executor's disk."""
    for k, b in enumerate(shared):
        yield k, b.value
        if len(shared) > 1:
            del b._value


def _marker(docs: DataFrame, bench: DataFrame, text_col: str, s: Settings) -> Callable[[pa.Array], list[pa.Array]]:
    """A function from a batch's texts to the columns of FIELDS."""
    spark = docs.sparkSession
    workers(spark)
    cast = spark.sparkContext.broadcast
    items, n_blocks = _items(bench, s)
    if n_blocks > 1:
        items = cut(items.repartition(n_blocks, "b"))
    plain = [cast(_block(items, k, s)) for k in range(n_blocks)]

    def count(batches):
        for batch in batches:
            for number, block in _one_by_one(plain):
                got = [np.zeros(0, np.uint64)]
                known = np.unique(block.token)
                for _, _, buf, offs in tx.slices(batch.column(0)):
                    w = Words.of(buf, offs)
                    for k in block.sizes:
                        h = w.shingles(k)
                        h = h[_through(block.sieve, h)]
                        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                        got.append(h[known[at] == h] if len(known) else h[:0])
                h, n = np.unique(np.concatenate(got), return_counts=True)
                columns = [pa.array(np.full(len(h), number, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["b", "shingle", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    # At most as many rows as the benchmark has shingles; they stay a table.
    seen = cut(texts.mapInArrow(count, "b int, shingle long, n long").groupBy("b", "shingle").agg(F.sum("n").alias("n")))
    ordered = []
    for k in range(n_blocks):
        mine = seen.where(F.col("b") == k).select("shingle", "n").toPandas()
        shingle = mine["shingle"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(shingle)
        ordered.append(cast(_block(items, k, s).order(shingle[by], mine["n"].to_numpy(np.int64)[by])))
    for b in plain:
        b.unpersist()

    def compute(col: pa.Array) -> list[pa.Array]:
        n = len(col)
        words, hit, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [set() for _ in range(n)]
        spans: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
        for _, block in _one_by_one(ordered):
            for a, b, buf, offs in tx.slices(col):
                w = Words.of(buf, offs)
                win, at = _occurrences(block, w)
                spans.setdefault((a, b), (w.first, []))[1].append((at, at + block.length[win]))
                row = np.searchsorted(w.first, at, "right") - 1
                for r, x in set(zip(row.tolist(), win.tolist())):
                    items[a + r].update(block.names(x))
        for (a, b), (first, found) in spans.items():
            words[a:b] = np.diff(first)
            edge = np.zeros(int(first[-1]) + 1, np.int64)
            for start, end in found:
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
            cover = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
            hit[a:b] = cover[first[1:]] - cover[first[:-1]]
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else _EMPTY for x in items]
        n_items = np.array([len(x) for x in items], np.int64)
        return [pa.array(words), pa.array(hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(n_items >= s.min_items)]

    return compute


def mark(docs: DataFrame, bench: DataFrame, text_col: str = "text", keep: list[str] | None = None, s: Settings = Settings()) -> DataFrame:
    """Docs with n_words, n_hit, n_items, items_sha256 and contaminated added."""
    return add_columns(docs, text_col, FIELDS, _marker(docs, bench, text_col, s), keep)


def keep_clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of docs that aren't contaminated."""
    marks = _marker(docs, bench, text_col, s)
    return keep_rows(docs, text_col, lambda col: ~marks(col)[-1].to_numpy(zero_copy_only=False))


def run(docs: DataFrame, bench: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id and the marks."""
    return mark(docs, bench, keep=["doc_id"], s=s)
