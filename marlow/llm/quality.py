"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of them. Every passage is encoded from shape
and repetition measures and hashed word counts, through one tanh layer; gated attention (a tanh branch
times a sigmoid branch) weighs the passages; the weighted sum is the document, and a logistic unit
scores it. Only document labels are used. The model is fitted by Adam on at most ``train_docs``
labelled documents, the first by a hash of their identifier, with all their passages (128 bytes of
measures for 64 words, on the driver); scoring reads every passage, a chunk of text at a time.

Edge cases: a null, empty or blank text is a bag without passages and gets the score of the zero
representation; labels that are null or of no known document are ignored, the smallest counts where a
document has several; without two classes among the labels every score is the share of label 1 (one
half without any); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import chunks, span_hashes, words

PASSAGE = 64
SHAPES, BUCKETS = 16, 16
WIDTH, GATE = 24, 12


def held_out(id_column: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether the CRC-32 of the identifier as text leaves ``fold`` modulo ``folds``."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def passages(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, row offsets into them)."""
    starts, ends, rows = words(raw, at)
    n = np.diff(rows)
    bags = -(-n // PASSAGE)
    out_rows = np.append(0, np.cumsum(bags))
    total = int(out_rows[-1])
    if not total:
        return np.zeros((0, SHAPES + BUCKETS)), out_rows
    owner = np.repeat(np.arange(len(n)), bags)
    first = rows[owner] + (np.arange(total) - out_rows[owner]) * PASSAGE
    count = np.diff(np.append(first, len(starts))).astype(float)
    key = span_hashes(raw, starts, ends)
    size = (ends - starts).astype(float)

    def per_word(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(float), first) / count

    byte_from = starts[first]
    span = np.diff(np.append(byte_from, len(raw))).astype(float)

    def per_byte(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(float), byte_from) / span

    same = np.append(False, key[1:] == key[:-1])
    same2 = np.append([False, False], key[2:] == key[:-2])[: len(key)]
    last, head = raw[ends - 1], raw[starts]
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    symbol = ~letter & ~((raw >= 48) & (raw <= 57)) & (raw > 32)
    plain_end = (last == 46) | (last == 44)
    odd_end = ~letter[ends - 1] & ~plain_end & ~((last >= 48) & (last <= 57))
    passage = np.repeat(np.arange(total), count.astype(np.int64))
    order = np.lexsort((key, passage))
    fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (passage[order][1:] != passage[order][:-1]))
    distinct = np.bincount(passage[order][fresh], minlength=total) / count
    upper = (raw >= 65) & (raw <= 90)
    wide = np.append(False, (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) if len(raw) else np.zeros(0, bool)
    shape = [
        per_word(size) / 10, per_word(size * size) / 100, per_byte(upper | wide) * 4, per_byte((raw >= 48) & (raw <= 57)) * 10, per_byte(symbol) * 10,
        per_byte(raw == 124) * 20, per_word(same), per_word(same2), distinct, per_word(plain_end) * 4, per_word(odd_end) * 4, per_byte(raw == 10) * 20,
        per_byte(raw >= 128) * 2, per_word(size <= 2), per_word((head >= 65) & (head <= 90)), np.minimum(count, PASSAGE) / PASSAGE,
    ]
    bucket = (key >> np.uint64(60)).astype(np.int64)
    hashed = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / count[:, None]
    return np.column_stack([*shape, hashed]), out_rows


class Attention:
    """The network; ``weights`` is one flat vector, so that it is trained and shipped as such."""

    parts = {"encode": (SHAPES + BUCKETS, WIDTH), "encode_bias": (WIDTH,), "look": (WIDTH, GATE), "gate": (WIDTH, GATE), "weigh": (GATE,), "out": (WIDTH,), "bias": (1,)}

    def __init__(self, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> None:
        self.weights, self.mean, self.spread, at = weights, mean, spread, 0
        for name, shape in self.parts.items():
            n = int(np.prod(shape))
            setattr(self, name, weights[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.parts.values())

    def forward(self, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores of the bags, then what ``backward`` needs."""
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(x @ self.encode + self.encode_bias)
        look, gate = np.tanh(h @ self.look), 1 / (1 + np.exp(-(h @ self.gate)))
        e = (look * gate) @ self.weigh
        n = np.diff(rows)
        full, owner = np.flatnonzero(n), np.repeat(np.arange(len(n)), n)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, rows[full]), n[full])) if len(full) else e
        bag = np.zeros((len(n), WIDTH))
        if len(full):
            a /= np.repeat(np.add.reduceat(a, rows[full]), n[full])
            bag[full] = np.add.reduceat(a[:, None] * h, rows[full], axis=0)
        z = np.clip(bag @ self.out + self.bias, -30, 30)
        return 1 / (1 + np.exp(-z)), x, h, look, gate, a, bag, owner

    def backward(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient of the mean log loss."""
        p, x, h, look, gate, a, bag, owner = self.forward(x, rows)
        dz = (p - y) / len(y)
        dbag = dz[:, None] * self.out
        own = dbag[owner]
        da = (own * h).sum(1)
        mean = np.bincount(owner, a * da, minlength=len(y))
        de = a * (da - mean[owner])
        dl, dg = de[:, None] * self.weigh * gate * (1 - look**2), de[:, None] * self.weigh * look * gate * (1 - gate)
        dh = a[:, None] * own + dl @ self.look.T + dg @ self.gate.T
        du = dh * (1 - h**2)
        return np.concatenate([(x.T @ du).ravel(), du.sum(0), (h.T @ dl).ravel(), (h.T @ dg).ravel(), (de[:, None] * look * gate).sum(0), bag.T @ dz, [dz.sum()]])


def fit(bags: list[np.ndarray], y: np.ndarray, steps: int = 400, batch: int = 256, seed: int = 7) -> Attention:
    """Adam on random batches of bags, in a fixed order."""
    share = float(y.mean()) if len(y) else 0.5
    wide = np.concatenate(bags) if bags else np.zeros((0, SHAPES + BUCKETS))
    mean, spread = (wide.mean(0), wide.std(0) + 1e-3) if len(wide) else (np.zeros(SHAPES + BUCKETS), np.ones(SHAPES + BUCKETS))
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.2, Attention.size())
    if share in (0.0, 1.0) or not len(y):
        w[:] = 0
        w[-1] = 0.0 if not len(y) else np.log((share + 1e-6) / (1 - share + 1e-6))
        return Attention(w, mean, spread)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(y), min(batch, len(y)))
        own = [bags[i] for i in pick]
        net = Attention(w, mean, spread)
        g = net.backward(np.concatenate(own), np.append(0, np.cumsum([len(b) for b in own])), y[pick]) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.02 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Attention(w, mean, spread)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, raw, at in chunks(batch.column(0)):
            x, rows = passages(raw, at)
            for i in range(len(at) - 1):
                bag = x[rows[i] : rows[i + 1]].astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first + i, 1), batch.column(2).slice(first + i, 1), pa.array([bag])], ["at", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = 4000) -> Attention:
    """Fit on a bounded sample of the labelled documents that are not held out; of rows with one identifier, the least text."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    own = own.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    own = own.withColumn("at", F.xxhash64(F.col("id").cast("string"))).orderBy("at", "id").limit(train_docs)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own), "id").groupBy("id", "at", "label").agg(F.min("text").alias("text"))
    rows = sorted(found.select("text", "at", "label").mapInArrow(_bags, "at long, label int, bag binary").collect(), key=lambda r: (r["at"], r["bag"]))
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, SHAPES + BUCKETS).astype(float) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], float))


def _score(net: Attention) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in chunks(batch.column(1)):
                score = net.forward(*passages(raw, at))[0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(score)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, net: Attention, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = docs.mapInArrow(_score(net), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _keep(net: Attention, text_at: int, cut: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.forward(*passages(raw, at))[0] for _, _, raw, at in chunks(batch.column(text_at))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= cut))

    return run


def keep_good(docs: DataFrame, net: Attention, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with all columns, in one pass."""
    return docs.mapInArrow(_keep(net, docs.columns.index(text_col), cut), docs.schema)
