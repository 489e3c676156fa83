"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end a document. Words fall into ``CLASSES`` classes: the end, the
commonest words alone, bands of equal mass of the frequent words, and one for all others. The
probability of a token is that of its class, a softmax over hashed features of the context (the word
before, the pair before, and the word before that skipped over), times its share in its class, from
counts over the whole training corpus.

The feature weights are a table of fixed size. In each round the tasks step down the gradient over
their own documents, one minibatch after another, and what they changed is averaged bucket by bucket,
weighted by how often each met the bucket, through a two-level sum in Spark. Counts of frequent words
are broadcast, at most ``HEAD`` of them; the rarer words of each document meet their counts in a join.

Edge cases: a null or empty text is the end alone; without training documents all counts are 0 and the
classes equally likely; rows with the same identifier are scored separately; a null identifier counts
as training; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bounded import frequent
from .store import materialise
from .textnum import chunks, lower_ascii, mix, span_hashes, words

HEAD = 1 << 18
HELD_WORDS = 1 << 22  # of chunks, before a task passes its counts on
CLASSES, ALONE = 32, 10
BUCKETS = 1 << 15
BATCH, RATE = 8192, 0.15
BLOCK = 256
END, BEFORE = np.uint64(0xE17D), np.uint64(0xB0F)


def scored_only(id_column: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether the CRC-32 of the identifier as text leaves ``fold`` modulo ``folds``."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with an END after each row, row offsets into them)."""
    starts, ends, rows = words(raw, at)
    return np.insert(span_hashes(lower_ascii(raw), starts, ends), rows[1:], END), rows + np.arange(len(rows))


def features(code: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Three buckets for every token."""
    def back(k: int) -> np.ndarray:
        out = np.append(np.full(k, BEFORE), code)[: len(code)]
        for j in range(k):
            first = rows[:-1] + j
            out[first[first < rows[1:]]] = BEFORE
        return out

    one, two = back(1), back(2)
    keys = mix(one, 51), mix(one + mix(two, 52), 53), mix(two, 54)
    return np.stack([(k >> np.uint64(64 - 15)).astype(np.int64) for k in keys])


class Model:
    """Counts of the frequent words, their classes, and the feature weights."""

    def __init__(self, key: np.ndarray, n: np.ndarray, total: int, distinct: int, ends: int) -> None:
        order = np.argsort(key)
        self.key, self.n, self.total, self.distinct, self.ends = key[order], n[order], total, distinct, ends
        by_n = np.lexsort((self.key, -self.n))
        kind = np.empty(len(self.n), np.int64)
        alone = by_n[:ALONE]
        kind[alone] = 1 + np.arange(len(alone))
        rest = by_n[ALONE:]
        mass = np.cumsum(self.n[rest])
        bands = CLASSES - ALONE - 2
        kind[rest] = 1 + ALONE + np.minimum((mass - 1) * bands // max(1, int(mass[-1]) if len(mass) else 1), bands - 1)
        self.kind = kind
        share = np.zeros(CLASSES)
        np.add.at(share, kind, self.n + 0.5)
        self.inside = np.log10((self.n + 0.5) / share[kind]) if len(kind) else np.zeros(0)
        rest_n, rest_v = total - ends - int(self.n.sum()), distinct - (ends > 0) - len(self.n)
        self.rest_scale = np.log10(rest_n + 0.5 * (rest_v + 1))
        prior = share + 1
        prior[0], prior[-1] = ends + 1, rest_n + 1
        self.bias = np.log(prior / prior.sum()).astype(np.float32)
        self.weights = np.zeros((BUCKETS, CLASSES), np.float32)

    def find(self, code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the frequent words, whether there, class) of every token."""
        place = np.searchsorted(self.key, code)
        place[place == len(self.key)] = 0
        known = self.key[place] == code if len(self.key) else np.zeros(len(code), bool)
        kind = np.full(len(code), CLASSES - 1)
        kind[known] = self.kind[place[known]]
        last = rows[1:] - 1
        known[last], kind[last] = False, 0
        return place, known, kind

    def odds(self, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Class probabilities given buckets of shape (3, tokens)."""
        z = self.bias + weights[at[0]] + weights[at[1]] + weights[at[2]]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[np.ndarray] = []
        for _, _, raw, at in chunks(batch.column(0), 1 << 20):
            starts, ends, _ = words(raw, at)
            held.append(span_hashes(lower_ascii(raw), starts, ends))
            if sum(map(len, held)) > HELD_WORDS:
                yield _summed(held)
                held = []
        if held:
            yield _summed(held)


def _summed(held: list[np.ndarray]) -> pa.RecordBatch:
    key, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def _learn(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        w, seen = own.weights.copy(), np.zeros(BUCKETS, np.float32)
        size = np.full(BUCKETS, 1e-2, np.float32)
        for batch in batches:
            for _, _, raw, at in chunks(batch.column(0), 1 << 20):
                code, rows = tokens(raw, at)
                _, _, kind = own.find(code, rows)
                at3 = features(code, rows)
                for k in range(0, len(code), BATCH):
                    now, y = at3[:, k : k + BATCH], kind[k : k + BATCH]
                    g = own.odds(w, now)
                    g[np.arange(len(y)), y] -= 1
                    flat = now.ravel()
                    order = np.argsort(flat, kind="stable")
                    hit, first = np.unique(flat[order], return_index=True)
                    n = np.diff(np.append(first, len(flat))).astype(np.float32)
                    step = np.add.reduceat(g[order % len(y)], first, axis=0) / np.sqrt(n)[:, None]
                    size[hit] += np.square(step).mean(1)
                    w[hit] -= RATE * step / np.sqrt(size[hit])[:, None]
                    seen[hit] += n
        change = np.column_stack([seen, (w - own.weights) * seen[:, None]]).astype("<f4")
        some = [b for b in range(BUCKETS // BLOCK) if change[b * BLOCK : (b + 1) * BLOCK, 0].any()]
        salt = TaskContext.get().partitionId() % 16
        yield _blocks({b: change[b * BLOCK : (b + 1) * BLOCK] for b in some}, salt)

    return run


def _blocks(parts: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in parts.values()], pa.binary())], ["block", "salt", "change"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What blocks of the weight table add up to; at most the table itself is held."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got = np.frombuffer(x, "<f4").reshape(BLOCK, CLASSES + 1).astype(np.float64)
            total[b] = total[b] + got if b in total else got
    yield _blocks(total, 0)


def train(docs: DataFrame, rounds: int = 2) -> Model:
    """``docs``: id, text, all of them training documents."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "token-counts")
    ends = docs.select("id").count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(counts, HEAD).toArrow()
    model = Model(np.asarray(top.column("key").to_numpy()).view(np.uint64), np.asarray(top.column("n").to_numpy()), n + ends, v + (ends > 0), ends)
    schema = "block int, salt int, change binary"
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        own = docs.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(rounds)) == r).select("text")
        part = own.mapInArrow(_learn(shared), schema).repartition("block", "salt").mapInArrow(_sum, schema)
        for row in part.repartition("block").mapInArrow(_sum, schema).collect():
            got = np.frombuffer(row["change"], "<f4").reshape(BLOCK, CLASSES + 1)
            at = slice(row["block"] * BLOCK, (row["block"] + 1) * BLOCK)
            model.weights[at] += np.where(got[:, :1] > 0, got[:, 1:] / np.maximum(got[:, :1], 1), 0).astype(np.float32)
        shared.unpersist()
    model.counts = counts
    return model


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row_id = model.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, end, raw, at in chunks(batch.column(1), 1 << 20):
                code, rows = tokens(raw, at)
                place, known, kind = own.find(code, rows)
                at3 = features(code, rows)
                score = np.empty(len(code))
                for k in range(0, len(code), BATCH):
                    y = kind[k : k + BATCH]
                    score[k : k + BATCH] = np.log10(np.maximum(own.odds(own.weights, at3[:, k : k + BATCH])[np.arange(len(y)), y], 1e-30))
                score[known] += own.inside[place[known]]
                rare = ~known
                rare[rows[1:] - 1] = False
                score[rare] -= own.rest_scale
                base = np.zeros(len(code))
                base[known] = np.log10(own.n[place[known]] + 0.5)
                base[rows[1:] - 1] = np.log10(own.ends + 0.5)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(rows))
                owner = doc[rare]
                order = np.lexsort((code[rare], owner))
                k, o = code[rare][order], owner[order]
                fresh = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))) if len(k) else np.zeros(0, np.int64)
                times = np.diff(np.append(fresh, len(k)))
                offsets = pa.array(np.searchsorted(o[fresh], np.arange(len(at))).astype(np.int32))
                seen = np.add.reduceat(known.astype(np.int64), rows[:-1]) + (own.ends > 0)
                pairs = pa.StructArray.from_arrays([pa.array(k[fresh].view(np.int64)), pa.array(times.astype(np.int32))], ["key", "times"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_id + np.arange(end - first)), batch.column(0).slice(first, end - first), pa.array(np.diff(rows)), pa.array(seen), pa.array(np.add.reduceat(base, rows[:-1])), pa.array(np.add.reduceat(score, rows[:-1])), pa.ListArray.from_arrays(offsets, pairs)],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"],
                )
                row_id += end - first

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``: id, text. One row each: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    counts, model.counts = model.counts, None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"row long, doc_id {docs.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base double, score double, rare array<struct<key:bigint,times:int>>"
    rows = materialise(docs.mapInArrow(_score(shared), schema), "scored")
    model.counts = counts
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times").join(counts, "key", "left")
    worth = F.log10(F.coalesce("n", F.lit(0)) + 0.5) * F.col("times")
    rare = rare.groupBy("row").agg(F.sum(worth).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    scale = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * scale).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def score_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """Train on the documents of the other folds and score all of them."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = score(docs, train(docs.filter(~scored_only(F.col("id"))), rounds))
    return out.select("doc_id", scored_only(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
