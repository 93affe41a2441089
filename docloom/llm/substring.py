"""Suffix-array dedup of repeated byte strings of a fixed length.

A window is ``length`` bytes of one document.  A window is repeated if the same
bytes start anywhere else.  With ``keep_first`` the first window of the corpus
(by id, text hash and position) is no repeat; without, it is.

Windows meet by content-defined anchors: a window's anchor is the position in
it whose ``gram`` bytes have the least hash (the leftmost of equals), so equal
windows have equal anchor grams at equal places.  The windows of one anchor
are consecutive and span a segment.  Segments of equal anchor form a group;
segments equal as a whole are settled by counting, and one of them stands for
all.  What is left, segments that agree around the anchor but differ at an
end, is settled by a suffix array of the group: ranks by prefix doubling up to
``length`` bytes, then, in suffix order, each window's previous and next
smaller position.  Its longest previous factor has ``length`` bytes or more
exactly if one of those shares its rank.

A group with more than ``group`` segments is not brought together.  Its
windows are halved by their distance from the anchor; each half has a longer
common core, whose hash is the next round's key, down to single windows,
which counting settles.

Defined results: null is the empty text; documents shorter than the length
lose nothing; matches never cross documents; rows that repeat both id and text
count as different places (without ``keep_first``) and get the same result;
a null id comes first; repeats are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import text as tx
from docloom.llm.runtime import add_columns, cut, join_counted, shuffle_width, workers

_NO_ID = -(1 << 63)
_CHUNK = 1 << 20
#: Bits of a place: anchor position, then the farthest and the nearest window start before it.
_BITS = 12


@dataclass(frozen=True)
class Settings:
    length: int = 400
    gram: int = 100
    #: Most segments of a group that are brought together in one task.
    group: int = 512
    keep_first: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.length < 1 << _BITS:
            raise ValueError(f"length must be at least gram and below {1 << _BITS}")

    @property
    def span(self) -> int:
        """Anchor positions in a window."""
        return self.length - self.gram + 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _pieces(buf: np.ndarray, offs: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Runs of rows of at most _CHUNK bytes; a longer row comes in overlapping pieces. Also the piece's place in its row."""
    if len(buf) <= _CHUNK:
        yield buf, offs, 0
        return
    for at in range(0, len(buf), _CHUNK - s.length + 1):
        part = buf[at : at + _CHUNK]
        if len(part) >= s.length:
            yield part, np.array([0, len(part)]), at


def segments(buf: np.ndarray, offs: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, anchor hash, segment hash) of a run of rows; positions in the row."""
    out = []
    for part, edge, shift in _pieces(buf, offs, s):
        wins = np.maximum(0, np.diff(edge) - s.length + 1)
        total = int(wins.sum())
        if not total:
            continue
        roll = tx.Rolling(part)
        at = np.arange(len(part) - s.gram + 1)
        grams = roll.span(at, at + s.gram)
        low = np.uint64(_CHUNK - 1)
        best = sliding_min((grams & ~low) | at.astype(np.uint64), s.span)
        start = np.repeat(edge[:-1] - (np.cumsum(wins) - wins), wins) + np.arange(total)
        row = np.repeat(np.arange(len(wins)), wins)
        anchor = (best[start] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
        last = np.concatenate((first[1:], [total])) - 1
        x, lo, hi, row = anchor[first], start[first], start[last], row[first]
        whole = tx.mix(roll.span(lo, hi + s.length) + (x - lo).astype(np.uint64))
        base = edge[row] - shift
        out.append((row, x - base, lo - base, hi - base, grams[x], whole))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(6))


def _doc_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("__d", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID))).withColumn("__t", F.xxhash64(F.col(f"`{text_col}`")))


def anchors(docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """(key, whole, d, t, place) of each segment of docs with __d and __t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in tx.slices(batch.column(2), _CHUNK):
                row, x, lo, hi, key, whole = segments(buf, offs, s)
                take = pa.array(row + a)
                place = (x << (2 * _BITS)) | ((x - lo) << _BITS) | (x - hi)
                cols = [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "whole", "d", "t", "place"])

    workers(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    return docs.select("__d", "__t", text).where(F.octet_length(text) >= s.length).mapInArrow(run, "key long, whole long, d long, t long, place long")


_SEG = ["d", "t", "place"]


def _interval(length: int) -> list[Column]:
    """The bytes that a segment's windows cover."""
    x = F.shiftright("place", 2 * _BITS)
    far = F.shiftright("place", _BITS).bitwiseAND((1 << _BITS) - 1)
    near = F.col("place").bitwiseAND((1 << _BITS) - 1)
    return [(x - far).alias("a"), (x - near + length).alias("b")]


def _settle(rows: DataFrame, s: Settings, extra: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """One round over segments (key, whole, d, t, place): intervals settled by counting, and what stands for the rest.

    The rest has ``open``, whether its own windows are still to be judged, and
    ``members``, the different segments in its group.
    """
    least = F.min(F.struct(*_SEG, *extra)).alias("rep")
    kinds = cut(rows.groupBy("key", "whole").agg(F.count("*").alias("n"), least))
    many = kinds.where("n > 1").select("key", "whole", "n", F.struct(*[F.col(f"rep.{c}") for c in _SEG]).alias("rep"))
    # A key may hold a large share of the segments, and a segment a large share of its key's.
    same = join_counted(rows.select("key", "whole", *_SEG), many, ["key", "whole"], "n")
    if s.keep_first:
        same = same.where(F.struct(*_SEG) != F.col("rep"))
    groups = cut(kinds.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    judge = F.lit(True) if s.keep_first else F.col("n") == 1
    if "open" in extra:  # settled segments only stand to be met
        judge = judge & F.col("rep.open")
    body = [F.col("rep.body")] if "body" in extra else []
    left = join_counted(kinds, groups, ["key"], "members").select("key", *[F.col(f"rep.{c}").alias(c) for c in _SEG], judge.alias("open"), "members", *body)
    return same.select("d", "t", *_interval(s.length)), left


def _contexts(docs: DataFrame, text_col: str, left: DataFrame, s: Settings) -> DataFrame:
    """``left`` with the bytes of each segment."""
    wanted = left.groupBy("d", "t").agg(F.collect_list(F.struct("key", "place", "open", "members")).alias("list"))
    text = F.col(f"`{text_col}`").cast("binary").alias("text")
    joined = docs.select(F.col("__d").alias("d"), F.col("__t").alias("t"), text).join(wanted, ["d", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer()
                items = batch.column(3)[i].values
                place = items.field("place").to_numpy()
                x, far, near = place >> (2 * _BITS), (place >> _BITS) & ((1 << _BITS) - 1), place & ((1 << _BITS) - 1)
                raw = memoryview(text)
                bodies = [raw[a:b].tobytes() for a, b in zip((x - far).tolist(), (x - near + s.length).tolist())]
                n = len(place)
                cols = [items.field("key"), pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py()))]
                cols += [items.field("place"), items.field("open"), items.field("members"), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "d", "t", "place", "open", "members", "body"])

    return joined.mapInArrow(run, "key long, d long, t long, place long, open boolean, members long, body binary")


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position's ``length`` bytes among all, in their order, by prefix doubling."""
    n = len(data) - length + 1
    rank, done = data.astype(np.int64), 1
    while done < length:
        step = min(done, length - done)
        # The order of done + step bytes: the first done, then those from step on.
        pair = rank[: len(rank) - step] * (1 << 32) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        done += step
    return rank[:n]


def repeats(starts: np.ndarray, rank: np.ndarray, place: np.ndarray, keep_first: bool) -> np.ndarray:
    """Which windows are repeats, by previous and next smaller positions in suffix order.

    ``place`` orders the windows; equal places are one window, seen twice.
    """
    order = np.lexsort((place, rank[starts]))
    r, p = rank[starts][order], place[order]
    same = np.concatenate(([False], (r[1:] == r[:-1]) & (p[1:] != p[:-1])))
    # Within one rank positions ascend: the previous smaller position is the neighbour before.
    earlier = np.zeros(len(order), bool)
    run_first = np.concatenate(([True], r[1:] != r[:-1]))
    first_place = p[np.maximum.accumulate(np.where(run_first, np.arange(len(r)), 0))]
    earlier = p != first_place
    out = np.zeros(len(order), bool)
    if keep_first:
        out[order] = earlier
    else:
        run = np.cumsum(run_first) - 1
        many = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
        many[run[same]] = True
        out[order] = many[run]
    return out


def _judge(keys: np.ndarray, d: np.ndarray, t: np.ndarray, place: np.ndarray, open_: np.ndarray, bodies: list[bytes], s: Settings) -> tuple[np.ndarray, ...]:
    """Intervals (d, t, a, b) of repeated windows of the open segments of some whole groups."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(x) for x in bodies])
    begin = np.cumsum(size) - size
    wins = size - s.length + 1
    seg = np.repeat(np.arange(len(size)), wins)
    starts = np.repeat(begin - (np.cumsum(wins) - wins), wins) + np.arange(int(wins.sum()))
    rank = ranks(data, s.length)
    x, far = place >> (2 * _BITS), (place >> _BITS) & ((1 << _BITS) - 1)
    in_doc = (x - far)[seg] + starts - begin[seg]
    # Positions in the corpus order: by id, text hash and place in the text.
    docs = np.unique(np.stack((d, t), axis=1), axis=0, return_inverse=True)[1].ravel()
    hit = repeats(starts, rank, docs[seg] * (1 << 40) + in_doc, s.keep_first) & open_[seg]
    at = np.flatnonzero(hit)
    if not len(at):
        return d[:0], t[:0], place[:0], place[:0]
    cut_ = np.flatnonzero((np.diff(at) != 1) | (np.diff(seg[at]) != 0))
    a, b = at[np.concatenate(([0], cut_ + 1))], at[np.concatenate((cut_, [len(at) - 1]))]
    return d[seg[a]], t[seg[a]], in_doc[a], in_doc[b] + s.length


def _local(rows: DataFrame, s: Settings) -> DataFrame:
    """Intervals from groups that fit one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(tables).combine_chunks()
            col = lambda c: t.column(c).to_numpy()
            out = _judge(col("key"), col("d"), col("t"), col("place"), col("open"), t.column("body").to_pylist(), s)
            return pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=["d", "t", "a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                # A group is whole before it is judged; small groups are judged together.
                if held and size >= 256 and held[-1].column(0)[-1].as_py() != key[a]:
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += b - a
        if held:
            yield flush(held)

    width = shuffle_width(rows.sparkSession)
    cols = rows.select("key", "d", "t", "place", "open", "body")
    return cols.repartition(width, "key").sortWithinPartitions("key").mapInArrow(run, "d long, t long, a long, b long")


def _halve(rows: DataFrame, width: int, s: Settings) -> DataFrame:
    """Segments cut to windows whose distance to the anchor is in one run of ``width``; the key takes in their common core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, d, t, place, open_, body in zip(*(batch.column(i).to_pylist() for i in range(6))):
                x, far, near = place >> (2 * _BITS), (place >> _BITS) & ((1 << _BITS) - 1), place & ((1 << _BITS) - 1)
                at = x - far
                for c in range(near // width, far // width + 1):
                    lo, hi = max(near, c * width), min(far, (c + 1) * width - 1)
                    part = body[x - hi - at : x - lo + s.length - at]
                    # All windows at distances c * width and on for width hold these bytes.
                    core = body[max(0, x - c * width - at) : x - ((c + 1) * width - 1) + s.length - at]
                    row = (_digest(core, key, c, max(0, c * width - (x - at))), _digest(part, lo, hi, 1), d, t, (x << (2 * _BITS)) | (hi << _BITS) | lo, open_, part)
                    for column, v in zip(out, row):
                        column.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, types)], names=["key", "whole", "d", "t", "place", "open", "body"])

    schema = "key long, whole long, d long, t long, place long, open boolean, body binary"
    return rows.select("key", "d", "t", "place", "open", "body").mapInArrow(run, schema)


def _digest(body: bytes, *salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(body + repr(salt).encode(), digest_size=8).digest(), "big", signed=True)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(d, t, spans): for each document with repeated windows the byte intervals they cover, unmerged."""
    keyed = _doc_keys(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col)
    found = anchors(keyed, text_col, s)
    # Checkpointed, so that both sides of the join are plain exchanges and Spark can split a hot key.
    often = cut(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    settled, left = _settle(cut(found.join(often, "key")), s)
    out = settled
    rows = cut(_contexts(keyed, text_col, left, s))
    width = 1 << (s.span - 1).bit_length()
    while not rows.isEmpty():
        out = out.unionByName(_local(rows.where(F.col("members") <= s.group), s))
        width //= 2
        big = rows.where(F.col("members") > s.group)
        if big.isEmpty():
            break
        parts = cut(_halve(big, width, s))
        # Of equal parts the open ones are all settled by counting; one stands for them.
        settled, left = _settle(parts, s, ["open", "body"])
        out = out.unionByName(settled)
        if width == 1:
            break  # the key is the whole window: counting has settled all
        rows = cut(left)
    return out.groupBy("d", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, maximal intervals of a union."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.concatenate(([True], a[1:] > b[:-1])) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return a[first], b[np.concatenate((first[1:], [len(a)])) - 1] if len(a) else b


FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
]


def _marked(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    spans = repeated_bytes(docs, id_col, text_col, s).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("spans").alias("__spans"))
    return _doc_keys(docs, id_col, text_col).join(spans, ["__d", "__t"], "left")


def _cut_out(text: bytes, spans: pa.Scalar) -> tuple[bytes, int, int]:
    """The kept bytes, how many went, and in how many runs."""
    if not spans.is_valid:
        return text, 0, 0
    a, b = merged(spans.values.field("a").to_numpy(), spans.values.field("b").to_numpy())
    edge = [0, *np.stack((a, b), axis=1).ravel().tolist(), len(text)]
    kept = b"".join(text[x:y] for x, y in zip(edge[::2], edge[1::2]))
    return kept, len(text) - len(kept), len(a)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(keep_first=True)) -> DataFrame:
    """Docs without repeated windows; by default the first of each stays. Bytes that a cut leaves inside a character go as well."""
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cols.index(text_col)
        for batch in batches:
            texts = [x if x is None else _cut_out(x.encode(), y)[0].decode("utf-8", "ignore") for x, y in zip(batch.column(at).to_pylist(), batch.column(len(cols)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(cols)]], names=cols)

    return _marked(docs, id_col, text_col, s).select(*[F.col(f"`{c}`") for c in cols], "__spans").mapInArrow(run, docs.schema)


def run(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    marked = _marked(docs.select("doc_id", "text"), "doc_id", "text", s).select("doc_id", "text", "__spans")
    schema = T.StructType([docs.schema["doc_id"], *FIELDS])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.binary())
            rows = []
            for text, spans in zip(texts, batch.column(2)):
                raw = text.as_py()
                kept, gone, n = _cut_out(raw, spans)
                rows.append((len(raw), gone, n, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[f.name for f in schema.fields])

    workers(docs.sparkSession)
    return marked.mapInArrow(digest, schema)
