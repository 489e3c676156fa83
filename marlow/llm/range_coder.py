"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are cut into lanes that are coded in step, one id of every lane at a time, against one
model, so each operation of the coder is a numpy operation over all lanes. The model predicts by the
last two ids of the lane (order 2), by the last (order 1) and by how often each id has come (order 0).
Which of the first two predictions holds, or neither, is one coded choice; its odds mix the counts
seen at the confidence of either order. An id that neither predicts is coded by its order-0 share. All
arithmetic is on integers, so the decoder repeats it exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR1"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, alphabet, words, crc of ids, crc of payload
LANES, LANE_IDS = 8192, 64
_U = np.uint64
MASK, TOP, BOTTOM = _U((1 << 48) - 1), _U(1 << 32), _U(1 << 24)
W16, W32 = _U(16), _U(32)
TOTAL = 1 << 22  # of the order-0 shares
EVERY = 4  # steps between two sums of the order-0 counts
GAIN = 24  # of an order-0 count by one occurrence
SLOTS2 = 1 << 16
SURE = 7  # the highest confidence


class Model:
    """What encoder and decoder share."""

    def __init__(self, lanes: int, alphabet: int) -> None:
        self.alphabet = alphabet
        self.count = np.ones(alphabet, np.int64)
        self.id1, self.sure1 = np.zeros(alphabet, np.int32), np.zeros(alphabet, np.uint8)
        self.id2, self.sure2 = np.zeros(SLOTS2, np.int32), np.zeros(SLOTS2, np.uint8)
        self.odds1, self.odds2 = (np.tile(np.array([1, 1, 2], np.int64), (2 * (SURE + 1), 1)) for _ in range(2))
        self.last1, self.last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.steps = 0
        self.weigh()

    def weigh(self) -> None:
        ends = np.cumsum(self.count)
        self.cum = np.zeros(self.alphabet + 1, np.int64)
        self.cum[1:] = ends * (TOTAL - self.alphabet) // ends[-1] + np.arange(1, self.alphabet + 1)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order-2 id, order-1 id, counts of order 2 right, order 1 right, neither)."""
        self.slot = ((self.last2 * 0x9E3779B1 + self.last1 * 0x85EBCA6B) >> 7) & (SLOTS2 - 1)
        self.two, self.one = self.id2[self.slot], self.id1[self.last1]
        self.at2, self.at1 = self.sure2[self.slot], self.sure1[self.last1]
        self.agree = (self.two == self.one).astype(np.uint8)
        self.in2, self.in1 = (2 * at + self.agree for at in (self.at2, self.at1))
        odds = self.odds2[self.in2] + self.odds1[self.in1]
        odds[self.agree == 1, 1] = 0  # order 1 adds nothing where it says the same
        return self.two, self.one, odds

    def learn(self, ids: np.ndarray, choice: np.ndarray) -> None:
        for odds, at in ((self.odds2, self.in2), (self.odds1, self.in1)):
            odds += 2 * np.bincount(3 * at.astype(np.int64) + choice, minlength=odds.size).reshape(odds.shape)
        if self.steps % 32 == 31:
            self.odds1, self.odds2 = (np.maximum(x >> (x.sum(1, keepdims=True) > 1 << 16), 1) for x in (self.odds1, self.odds2))
        for table, sure, slot, at, said in ((self.id2, self.sure2, self.slot, self.at2, self.two), (self.id1, self.sure1, self.last1, self.at1, self.one)):
            right = said == ids
            sure[slot] = np.where(right, np.minimum(at + 1, SURE), at >> 1)
            new = ~right & (at < 2)
            table[slot[new]] = ids[new]
        self.count += GAIN * np.bincount(ids, minlength=self.alphabet)
        self.last2, self.last1 = self.last1, ids
        self.steps += 1
        if self.steps % EVERY == 0 or self.steps < EVERY:
            self.weigh()


class _Encoder:
    def __init__(self, lanes: int) -> None:
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, MASK, _U)
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def code(self, pick: np.ndarray | slice, low: np.ndarray, width: np.ndarray, total: np.ndarray | int) -> None:
        unit = self.range[pick] // np.asarray(total).astype(_U)
        at, span = (self.low[pick] + low.astype(_U) * unit) & MASK, width.astype(_U) * unit
        where = np.arange(len(self.low))[pick]
        todo = np.arange(len(where))
        while len(todo):
            a, r = at[todo], span[todo]
            same = (a ^ ((a + r) & MASK)) < TOP
            small = ~same & (r < BOTTOM)
            r = np.where(small, (_U(0) - a) & (BOTTOM - _U(1)), r)
            out = same | small
            todo, a, r = todo[out], a[out], r[out]
            self.lanes.append(where[todo])
            self.words.append((a >> W32).astype(np.uint16))
            at[todo], span[todo] = (a << W16) & MASK, (r << W16) & MASK
        self.low[pick], self.range[pick] = at, span

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        for shift in (32, 16, 0):
            self.lanes.append(np.arange(len(self.low)))
            self.words.append((self.low >> _U(shift)).astype(np.uint16))
        lane, word = np.concatenate(self.lanes), np.concatenate(self.words)
        return np.bincount(lane, minlength=len(self.low)), word[np.argsort(lane, kind="stable")]


class _Decoder:
    def __init__(self, n: np.ndarray, words: np.ndarray) -> None:
        lanes = len(n)
        self.words = np.append(words, np.zeros(4, np.uint16)).astype(_U)
        self.at = np.cumsum(n) - n
        self.low, self.range, self.value = np.zeros(lanes, _U), np.full(lanes, MASK, _U), np.zeros(lanes, _U)
        for _ in range(3):
            self.value = (self.value << W16) | self.words[self.at]
            self.at += 1

    def ask(self, pick: np.ndarray | slice, total: np.ndarray | int) -> np.ndarray:
        self.unit = self.range[pick] // np.asarray(total).astype(_U)
        return np.minimum(((self.value[pick] - self.low[pick]) & MASK) // self.unit, np.asarray(total).astype(_U) - _U(1)).astype(np.int64)

    def take(self, pick: np.ndarray | slice, low: np.ndarray, width: np.ndarray) -> None:
        at, span, value = (self.low[pick] + low.astype(_U) * self.unit) & MASK, width.astype(_U) * self.unit, self.value[pick]
        where = np.arange(len(self.low))[pick]
        todo = np.arange(len(where))
        while len(todo):
            a, r = at[todo], span[todo]
            same = (a ^ ((a + r) & MASK)) < TOP
            small = ~same & (r < BOTTOM)
            r = np.where(small, (_U(0) - a) & (BOTTOM - _U(1)), r)
            out = same | small
            todo, a, r = todo[out], a[out], r[out]
            lane = where[todo]
            value[todo] = ((value[todo] << W16) & MASK) | self.words[self.at[lane]]
            self.at[lane] += 1
            at[todo], span[todo] = (a << W16) & MASK, (r << W16) & MASK
        self.low[pick], self.range[pick], self.value[pick] = at, span, value


def encode_block(ids: np.ndarray) -> bytes:
    """A self-contained block of non-negative ids below 2**20."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() >= 1 << 20):
        raise ValueError("ids must be in [0, 2**20)")
    lanes = min(LANES, max(1, n // LANE_IDS))
    steps = -(-n // lanes)
    alphabet = int(ids.max()) + 1 if n else 1
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, coder = Model(lanes, alphabet), _Encoder(lanes)
    for now in grid:
        two, one, odds = model.predict()
        choice = np.where(now == two, 0, np.where(now == one, 1, 2))
        ends = np.cumsum(odds, 1)
        k = np.arange(lanes)
        coder.code(slice(None), ends[k, choice] - odds[k, choice], odds[k, choice], ends[:, 2])
        miss = np.flatnonzero(choice == 2)
        if len(miss):
            x = now[miss]
            coder.code(miss, model.cum[x], model.cum[x + 1] - model.cum[x], TOTAL)
        model.learn(now, choice)
    sizes, words = coder.finish()
    payload = zlib.compress(sizes.astype("<u4").tobytes(), 1)
    payload = struct.pack("<I", len(payload)) + payload + words.astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, n, lanes, alphabet, len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload)) + payload


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError where a checksum does not hold."""
    magic, n, lanes, alphabet, count, crc, crc_payload = _HEAD.unpack_from(block)
    payload = block[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(payload) != crc_payload:
        raise ValueError("not a whole block")
    (packed,) = struct.unpack_from("<I", payload)
    sizes = np.frombuffer(zlib.decompress(payload[4 : 4 + packed]), "<u4").astype(np.int64)
    coder = _Decoder(sizes, np.frombuffer(payload, "<u2", count, 4 + packed))
    steps = -(-n // lanes)
    model, grid = Model(lanes, alphabet), np.empty((steps, lanes), np.int64)
    every = np.arange(lanes)
    for t in range(steps):
        two, one, odds = model.predict()
        ends = np.cumsum(odds, 1)
        v = coder.ask(slice(None), ends[:, 2])
        choice = (v >= ends[:, 0]).astype(np.int64) + (v >= ends[:, 1])
        coder.take(slice(None), ends[every, choice] - odds[every, choice], odds[every, choice])
        now = np.where(choice == 0, two, one).astype(np.int64)
        miss = np.flatnonzero(choice == 2)
        if len(miss):
            x = np.searchsorted(model.cum, coder.ask(miss, TOTAL), "right") - 1
            coder.take(miss, model.cum[x], model.cum[x + 1] - model.cum[x])
            now[miss] = x
        model.learn(now, choice)
        grid[t] = now
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids do not match their checksum")
    return ids
