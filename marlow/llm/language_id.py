"""Language identification: unigram pieces, summed over all segmentations.

A text's letters, in lower case, are cut into runs; a run with a space before it is a unit, spelt in
pieces of a fixed public vocabulary. Each language has a probability for every piece. A unit's probability
is the sum over all its segmentations, by the forward algorithm, and a text's the product over its units.
The piece probabilities are fitted by expectation-maximisation on about ``train_docs`` training texts of
each language, or all where there are fewer: those whose hash of identifier and text falls under the
language's rate, equal texts once, whole texts always. A task counts the expected pieces of each language
by the forward-backward algorithm, distinct units of a stretch of text at a time, and sends one sum for
each language and piece it met. Scoring reads every text in place; nothing is shuffled. The model
(pieces x languages) is broadcast; ``LANGUAGES`` bounds it, and more learned values are an error.

Work is done in stretches of ``STRETCH`` bytes of text, so memory does not depend on a text's length. A
run of letters above ``UNIT`` bytes is scored as several units of that size, in order.

Edge cases: a null text and a text without a letter get ``und`` with score 0, as all texts do where
nothing was learned. Null languages, and rows held out, teach nothing; a null identifier is not held out.
Repeated rows weigh in a language's share as often as they occur; equal scores go to the language first in order; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out
from .store import discard, materialise
from .textnum import mix, span_hashes, utf8, words

STRETCH = 1 << 20
#: The longest unit and the longest piece, in bytes. A unit's least probability, FLOOR / 256 a byte, is above 10**-283.
UNIT, PIECE = 64, 16
#: The share of a language's probability that its single bytes divide evenly.
FLOOR = 0.01
#: What is added to every expected count.
PRIOR = 0.1
LANGUAGES = 1024
#: Units whose probabilities a worker remembers; others are computed again in each stretch.
REMEMBERED = 1 << 19
UNKNOWN = "und"
LETTER = r"\p{L}"


def vocabulary(spark: SparkSession, path: str) -> list[bytes]:
    """The pieces of at most ``PIECE`` bytes in a file of base64 pieces and ranks, and all single bytes."""
    listed = {base64.b64decode(r["value"].split(" ")[0]) for r in spark.read.text(f"file://{path}" if path.startswith("/") else path).collect() if r["value"]}
    return sorted({p for p in listed if p and len(p) <= PIECE} | {bytes([b]) for b in range(256)}, key=lambda p: (len(p), p))


class Pieces:
    """Numbers of the vocabulary's pieces, found by their bytes; ``size`` stands for none."""

    BITS = 18

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = len(pieces)
        self.single = np.full(256, self.size, np.int32)
        self.lengths = sorted({len(p) for p in pieces} - {1})
        bits = max(self.BITS, self.size.bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.size, np.int32)
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.single[p[0]] = i
        for n in self.lengths:
            own = np.array([i for i, p in enumerate(pieces) if len(p) == n])
            raw = np.frombuffer(b"".join(pieces[i] for i in own) + bytes(2 * PIECE), np.uint8)
            keys = self.spans(raw, np.arange(len(own)) * n, n)
            for i, key, slot in zip(own.tolist(), keys, (keys >> self.shift).tolist(), strict=True):
                while self.numbers[slot] != self.size:
                    slot = (slot + 1) % len(self.numbers)
                self.keys[slot], self.numbers[slot] = key, i

    @staticmethod
    def spans(raw: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """A number for each span of n bytes, different for different spans of up to eight; ``raw`` goes on for 16 bytes more."""
        padded = np.zeros((len(raw) + 15) // 8 * 8, np.uint8)
        padded[: len(raw)] = raw
        eights = np.lib.stride_tricks.as_strided(padded.view(np.uint64)[:1], (len(raw),), (1,))
        first = lambda k: np.uint64((1 << 8 * min(k, 8)) - 1)
        out = mix(eights[starts] & first(n), n)
        return out if n <= 8 else mix(out ^ (eights[starts + 8] & first(n - 8)), n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key."""
        out = np.full(len(keys), self.size, np.int32)
        todo, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(todo):
            number = self.numbers[slot]
            hit = self.keys[slot] == keys[todo]
            out[todo[hit]] = number[hit]
            on = np.flatnonzero(~hit & (number != self.size))
            todo, slot = todo[on], (slot[on] + 1) % len(self.numbers)
        return out


class Units:
    """Distinct units in order of falling size, their bytes side by side with one place after each.

    Place ``base + t`` of a unit stands between its first t bytes and the rest.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> None:
        size = ends - starts
        self.size = size
        total = np.cumsum(size + 1)
        self.base = total - size - 1
        self.places = int(total[-1]) if len(total) else 0
        step = np.arange(self.places) - np.repeat(self.base, size + 1)
        left = np.repeat(size, size + 1) - step
        own = np.append(raw, np.zeros(1, np.uint8))[np.repeat(starts, size + 1) + step]
        self.found = self._matches(np.append(own, np.zeros(2 * PIECE, np.uint8)), left, pieces)

    def _matches(self, own: np.ndarray, left: np.ndarray, pieces: Pieces) -> np.ndarray:
        """``[length - 1, place]``: the piece of that length that starts there and ends within its unit."""
        out = np.full((PIECE, self.places), pieces.size, np.int32)
        places = np.flatnonzero(left)
        out[0, places] = pieces.single[own[places]]
        for n in pieces.lengths:
            places = places[left[places] >= n]
            if len(places):
                out[n - 1, places] = pieces.find(Pieces.spans(own, places, n))
        return out

    def longer(self, t: int) -> int:
        """How many units have t bytes at least."""
        return int(np.searchsorted(-self.size, -t, "right"))

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """``[unit, column]``: the summed probability of all ways to spell each unit, for every column of ``weights``."""
        out = np.zeros((self.places, weights.shape[1]))
        out[self.base] = 1
        none = len(weights) - 1
        for t in range(1, int(self.size.max(initial=0)) + 1):
            b = self.base[: self.longer(t)] + t
            for length in range(1, min(t, PIECE) + 1):
                piece = self.found[length - 1, b - length]
                hit = np.flatnonzero(piece != none)
                if len(hit):
                    out[b[hit]] += out[b[hit] - length] * weights[piece[hit]]
        return out[self.base + self.size]

    def expected(self, weights: np.ndarray, language: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected counts ``[piece, language]``, where each unit is spelt by its language and counts ``times``."""
        none, n_languages, flat = len(weights) - 1, weights.shape[1], weights.ravel()
        longest = int(self.size.max(initial=0))
        ahead = np.zeros(self.places)
        ahead[self.base] = 1
        for t in range(1, longest + 1):
            n = self.longer(t)
            b, own = self.base[:n] + t, language[:n]
            for length in range(1, min(t, PIECE) + 1):
                piece = self.found[length - 1, b - length]
                hit = np.flatnonzero(piece != none)
                ahead[b[hit]] += ahead[b[hit] - length] * flat[piece[hit].astype(np.int64) * n_languages + own[hit]]
        behind = np.zeros(self.places)
        behind[self.base + self.size] = times / ahead[self.base + self.size]
        counts = np.zeros(len(flat))
        for t in range(longest - 1, -1, -1):
            for length in range(1, min(longest - t, PIECE) + 1):
                b = self.base[: self.longer(t + length)] + t
                piece = self.found[length - 1, b]
                hit = np.flatnonzero(piece != none)
                b, at = b[hit], piece[hit].astype(np.int64) * n_languages + language[hit]
                through = flat[at] * behind[b + length]
                behind[b] += through
                np.add.at(counts, at, through * ahead[b])
        return counts.reshape(weights.shape)


def stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, rows) of the units of about ``STRETCH`` bytes of text at a time, cut before a space."""
    raw, at = utf8(column)
    row, offset = 0, 0
    while offset < len(raw):
        end = min(len(raw), offset + STRETCH)
        if end < len(raw):
            spaces = np.flatnonzero(raw[offset + 1 : end] == 32)
            end = offset + 1 + int(spaces[-1]) if len(spaces) else end
        own = raw[offset:end]
        starts, ends, _ = words(own, np.array([0, len(own)]))
        spaced = (starts > 0) & (own[np.maximum(starts - 1, 0)] == 32)
        starts = starts - spaced
        parts = -(-(ends - starts) // UNIT)
        if (parts > 1).any():
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            last = np.repeat(ends, parts)
            starts = np.repeat(starts, parts) + nth * UNIT
            ends = np.minimum(starts + UNIT, last)
        rows = np.searchsorted(at, starts + offset, "right") - 1
        yield own, starts, ends, rows
        offset = end


def spaced_letters(text: Column) -> Column:
    """The runs of letters and marks in lower case, each after a space."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


class Model:
    """``weights[piece, language]``, a row of zeros last, and the logarithm of each language's share of texts."""

    def __init__(self, pieces: Pieces, languages: list[str], counts: np.ndarray, shares: np.ndarray) -> None:
        self.pieces, self.languages, self.shares = pieces, languages, shares
        single = np.zeros(pieces.size)
        single[pieces.single] = 1 / 256
        fitted = (counts + PRIOR) / (counts + PRIOR).sum(0)
        self.weights = np.vstack([(1 - FLOOR) * fitted + FLOOR * single[:, None], np.zeros(len(languages))])
        self.known, self.logs = np.zeros(0, np.uint64), np.zeros((0, len(languages)))

    def units(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The log probability ``[unit, language]`` of distinct units in order of their keys."""
        at = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        fresh = np.flatnonzero(self.known[at] != keys) if len(self.known) else np.arange(len(keys))
        out = np.empty((len(keys), len(self.languages)))
        out[:] = self.logs[at] if len(self.known) else 0
        order = fresh[np.argsort(starts[fresh] - ends[fresh], kind="stable")]
        out[order] = np.log(Units(raw, starts[order], ends[order], self.pieces).forward(self.weights))
        fresh = fresh[: REMEMBERED - len(self.known)]
        if len(fresh):
            place = np.searchsorted(self.known, keys[fresh])
            self.known, self.logs = np.insert(self.known, place, keys[fresh]), np.insert(self.logs, place, out[fresh], axis=0)
        return out

    def totals(self, column: pa.Array) -> np.ndarray:
        """The log probability ``[row, language]`` of every text of a column."""
        out = np.zeros((len(column), len(self.languages)))
        for raw, starts, ends, rows in stretches(column):
            keys, first, which = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
            own = self.units(raw, starts[first], ends[first], keys)[which]
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(rows, own[:, k], len(out))
        return out

    def expect(self, column: pa.Array, language: np.ndarray) -> np.ndarray:
        """Expected counts ``[piece, language]`` of texts whose languages are known by number."""
        out = np.zeros((self.pieces.size + 1, len(self.languages)))
        for raw, starts, ends, rows in stretches(column):
            own = language[rows]
            _, first, times = np.unique(span_hashes(raw, starts, ends) ^ mix(own.astype(np.uint64)), return_index=True, return_counts=True)
            order = np.argsort(starts[first] - ends[first], kind="stable")
            first, times = first[order], times[order]
            out += Units(raw, starts[first], ends[first], self.pieces).expected(self.weights, own[first], times)
        return out[:-1]


def train(docs: DataFrame, path: str, rounds: int = 3, train_docs: int = 8192, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> Model | None:
    """The model of rows that are not held out and have a language; None where there are none.

    Languages, and their shares of texts, are those of all such rows. The first round starts from equal probabilities for all pieces; each later one from the last's.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col), folds, fold))
    shares = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(shares) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn; the model is broadcast")
    if not shares:
        return None
    n_texts = {r["lang"]: r["n"] for r in shares}
    languages = sorted(n_texts)
    texts = np.array([n_texts[x] for x in languages], float)
    pieces = Pieces(vocabulary(spark, path))
    model = Model(pieces, languages, np.zeros((pieces.size, len(languages))), np.log(texts / texts.sum()))
    rates = F.create_map(*(F.lit(x) for lang, n in n_texts.items() for x in (lang, int(min(1, train_docs / n) * (1 << 32)))))
    drawn = known.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 32)) < F.element_at(rates, F.col(lang_col)))
    rows = drawn.groupBy(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("same")).agg(F.first(text_col).alias("text"))
    rows = materialise(rows.select("lang", spaced_letters(F.coalesce("text", F.lit(""))).alias("text")), "language-texts")
    for _ in range(rounds):
        model = Model(pieces, languages, _counts(rows, model), model.shares)
    discard(rows)
    return model


def _counts(rows: DataFrame, model: Model) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, 0
        for batch in batches:
            language = batch.column("lang").cast(pa.string()).dictionary_encode()
            to = np.array([own.languages.index(x) for x in language.dictionary.to_pylist()], np.int64)
            total = total + own.expect(batch.column("text"), to[language.indices.to_numpy(zero_copy_only=False)])
        if not np.isscalar(total):
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "language", "n"])

    # whole multiples of 2**-20 add up alike in any order
    part = rows.mapInArrow(count, "piece int, language int, n double").select("piece", "language", F.round(F.col("n") * (1 << 20)).cast("long").alias("n"))
    out = np.zeros((model.pieces.size, len(model.languages)))
    for r in part.groupBy("piece", "language").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["piece"], r["language"]] = r["n"] / (1 << 20)
    shared.unpersist()
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score``, the predicted language's probability given the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), folds, fold).alias("held_out"), F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)).alias("spoken"), spaced_letters(F.coalesce(text_col, F.lit(""))).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            odds = own.totals(batch.column("text")) + own.shares
            best = np.argmax(odds, axis=1)
            share = 1 / np.exp(odds - odds.max(1, keepdims=True)).sum(1)
            spoken = batch.column("spoken").to_numpy(zero_copy_only=False)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[np.where(spoken, best, -1)], pa.string()), pa.array(np.where(spoken, share, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(tell, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
