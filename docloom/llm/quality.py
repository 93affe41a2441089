"""Quality classifier: supervised subword embeddings.

Words (runs without ASCII white space), word bigrams and character n-grams are
hashed into one table of learned vectors (a word followed by itself is one
shared bigram, so that repetition generalises).  A document is the average of its
feature vectors; a softmax layer turns that into class probabilities.  Vectors
and softmax weights are learned together by stochastic gradient descent in
numpy, over a bounded sample of the labelled rows (``Settings.max_train_docs``).

Scoring is linear up to the softmax, so each bucket's vector is folded with
the output layer into one number; a document's logit is the mean of these
numbers over its features, computed for whole Arrow batches at once.

Defined results: null and empty texts have no features and get the score of
the bias alone; a null id is not held out; repeated rows score alike; with no
usable label, or labels of one class only, the class prior is the score (0.5
without labels).  Ties at the threshold count as predicted 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import text as tx
from docloom.llm.runtime import add_columns, cut, keep_rows

#: Bytes that are not ASCII white space.
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32, 0]] = False


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dim: int = 12
    char_grams: tuple[int, ...] = (3, 5)
    epochs: int = 8
    batch: int = 16
    rate: float = 0.3
    seed: int = 7
    #: Bound on the labelled documents that training reads, by hash of the id.
    max_train_docs: int = 3000
    #: Bound on their features, in the same order; 4 bytes each on the driver.
    max_train_features: int = 40_000_000
    #: Fold of crc32(id as text) modulo folds that training never sees.
    folds: int = 5
    threshold: float = 0.3

    def __post_init__(self) -> None:
        if not 1 <= self.buckets <= 1 << 16 or self.buckets & (self.buckets - 1):
            raise ValueError("buckets must be a power of two up to 65536")


def _characters(data: np.ndarray) -> np.ndarray:
    """Each UTF-8 character's bytes as one number."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.concatenate((lead, [len(data)])))
    out = data[lead].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] = (out[more] << np.uint32(8)) | data[lead[more] + k]
    return out


def features(buf: np.ndarray, offs: np.ndarray, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays by kind of feature, over a run of rows."""
    data, begin = tx.separated(buf, offs)
    n = len(offs) - 1
    mask = np.uint64(s.buckets - 1)
    out = []
    row_of = np.repeat(np.arange(n), np.diff(begin))
    starts, ends = tx.runs(_SOLID[data])
    words = tx.Rolling(data).span(starts, ends)
    word_row = row_of[starts]
    out.append((word_row, (words & mask).astype(np.int64)))
    if len(words) > 1:
        pair = tx.mix(words[:-1] * np.uint64(tx.BASE) + words[1:])
        pair[words[:-1] == words[1:]] = 1  # any word followed by itself is one and the same bigram
        same = word_row[:-1] == word_row[1:]
        out.append((word_row[:-1][same], (pair[same] & mask).astype(np.int64)))
    chars, row_of = _characters(data), row_of[(data & 0xC0) != 0x80]
    for k in s.char_grams:
        m = len(chars) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k * 2654435761 & 0xFFFFFFFF, np.uint32)
        for i in range(k):
            h = h * np.uint32(0x01000193) + chars[i : i + m]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        inside = row_of[:m] == row_of[k - 1 : k - 1 + m]
        inside &= chars[k - 1 : k - 1 + m] != 0  # the gap is no part of a row
        at = np.flatnonzero(inside)
        out.append((row_of[at], (h[at] & np.uint32(s.buckets - 1)).astype(np.int64)))
    return out


def _counts(col: pa.Array, s: Settings) -> pa.Array:
    """Per row: a list of its features, each the bucket in the upper and its count in the lower 16 bits; a larger count takes several."""
    rows: list = []
    for _, _, buf, offs in tx.slices(col):
        n = len(offs) - 1
        parts = features(buf, offs, s)
        key = np.concatenate([r * s.buckets + b for r, b in parts])
        key, cnt = np.unique(key, return_counts=True)
        if len(cnt) and cnt.max() > 0xFFFF:
            times = -(-cnt // 0xFFFF)
            key, last = np.repeat(key, times), np.cumsum(times) - 1
            cnt, rest = np.full(len(key), 0xFFFF), cnt - (times - 1) * 0xFFFF
            cnt[last] = rest
        cut = np.searchsorted(key, np.arange(n + 1) * s.buckets)
        packed = (((key % s.buckets) << 16) | cnt).astype(np.uint32).view(np.int32)
        rows += [packed[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return pa.array(rows, pa.list_(pa.int32()))


@dataclass
class Model:
    """``table``: each bucket's part of the logit; ``bias``: the rest of it."""

    table: np.ndarray
    bias: float
    settings: Settings

    def score_batch(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        for a, b, buf, offs in tx.slices(col):
            total, count = np.zeros(b - a), np.zeros(b - a)
            for row, bucket in features(buf, offs, self.settings):
                total += np.bincount(row, self.table[bucket], b - a)
                count += np.bincount(row, minlength=b - a)
            out[a:b] = total / np.maximum(count, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -30, 30)))


def train(examples: list[tuple[np.ndarray, int]], s: Settings = Settings()) -> Model:
    """Fit by stochastic gradient descent. An example: packed features, and the label 0 or 1."""
    labels = np.array([y for _, y in examples], np.int64)
    if not len(labels) or labels.min() == labels.max():
        prior = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
        return Model(np.zeros(s.buckets, np.float32), float(np.log(prior / (1 - prior))), s)
    rng = np.random.default_rng(s.seed)
    vec = rng.uniform(-1, 1, (s.buckets, s.dim)).astype(np.float32) / s.dim
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)

    def unpacked(i: int) -> tuple[np.ndarray, np.ndarray]:
        x = examples[i][0].view(np.uint32)
        b, c = x >> np.uint32(16), (x & np.uint32(0xFFFF)).astype(np.float32)
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
        if len(first) < len(b):  # a count in several parts
            b, c = b[first], np.add.reduceat(c, first)
        return b, c / max(1.0, float(c.sum()))

    steps, done = s.epochs * ((len(labels) + s.batch - 1) // s.batch), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), s.batch):
            pick = order[at : at + s.batch]
            rate = s.rate * (1 - done / steps)
            done += 1
            held = [unpacked(i) for i in pick]
            docs = np.stack([c @ vec[b] for b, c in held])
            logit = docs @ out.T + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = p
            err[np.arange(len(pick)), labels[pick]] -= 1
            back = err @ out
            out -= rate * (err.T @ docs)
            bias -= rate * err.mean(0)
            for k, (b, c) in enumerate(held):
                if len(b):  # normalised step: the document's mean moves by at most the rate
                    vec[b] -= np.float32(rate / float(c @ c) / max(1.0, float((out**2).sum()))) * c[:, None] * back[k]
    w = out[1] - out[0]
    return Model((vec @ w).astype(np.float32), float(bias[1] - bias[0]), s)


def fold_of(id_col: str, folds: int) -> "F.Column":
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", s: Settings = Settings()
) -> Model:
    """Train on the labelled rows outside fold 0, at most ``max_train_docs`` of them."""
    ids = (
        labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y"))
        .where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (fold_of("__id", s.folds) != 0))
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(s.max_train_docs)
    )
    # Bounded by max_train_docs, so this side is broadcast.
    picked = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__doc")).join(F.broadcast(ids), "__id")
    fields = [T.StructField("__f", T.ArrayType(T.IntegerType()))]
    rows = cut(add_columns(picked, "__doc", fields, lambda col: [_counts(col, s)], keep=["__id", "__y"]))
    # Two numbers for each of at most max_train_docs documents: as many of them as the bound on features lets in.
    sizes = rows.groupBy("__id").agg(F.max(F.size("__f")).alias("n")).orderBy(F.xxhash64("__id"), "__id").collect()
    room = np.cumsum([r.n for r in sizes]) <= s.max_train_features
    if not room.all():
        rows = rows.where(F.col("__id").isin([r["__id"] for r, ok in zip(sizes, room) if ok]))
    found = rows.toArrow()
    order = sorted(range(found.num_rows), key=found.column("__id").to_pylist().__getitem__)
    y, feats = found.column("__y").to_pylist(), found.column("__f").combine_chunks()
    if isinstance(feats, pa.ChunkedArray):
        feats = pa.concat_arrays(feats.chunks) if feats.num_chunks else pa.array([], pa.list_(pa.int32()))
    seen, examples = set(), []
    ids_list = found.column("__id").to_pylist()
    for i in order:
        if ids_list[i] not in seen:  # a repeated id counts once
            seen.add(ids_list[i])
            examples.append((feats[i].values.to_numpy(zero_copy_only=False) if feats[i].is_valid else np.zeros(0, np.int32), y[i]))
    return train(examples, s)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Docs with ``score`` (double) and ``predicted`` (int) added."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    s = model.settings

    def compute(col: pa.Array) -> list[pa.Array]:
        table, bias = shared.value
        p = Model(table, bias, s).score_batch(col)
        return [pa.array(p, pa.float64()), pa.array((p >= s.threshold).astype(np.int32), pa.int32())]

    return add_columns(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute, keep)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted to be good."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    s = model.settings
    return keep_rows(docs, text_col, lambda col: Model(*shared.value, s).score_batch(col) >= s.threshold)


def run(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, s=s), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", s.folds) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
