"""Benchmark decontamination: q-gram lemma filtering with banded verification.

Texts and items are compared in a plain form: ASCII letters in lower case, every run of other ASCII
characters one space. An item of n characters may be met with k = ``budget`` * n edits. By the q-gram
lemma a region within k edits shares at least n - q + 1 - k * q of the item's q-grams, all of them on
k + 1 neighbouring diagonals; so hits are counted in diagonal bands of k + 1, two neighbours together,
and only bands that reach the bound are aligned, by dynamic programming over the band's diagonals.

The benchmark is the bounded side: its items go out in blocks of at most ``block_chars`` characters
(or one item), each block against all documents; documents are never shuffled.

Edge cases: a null or empty text is clean; items of fewer than ``least`` plain characters (30, a
parameter), null ones included, are too short to name a leak and are ignored; without items every
document is clean; every row answers for itself, whatever its identifier, in any number of blocks; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ROW, rows
from .textnum import chunks, rolling, utf8

Q, BUDGET, LEAST = 10, 0.08, 30
POSTINGS = 1 << 21  # looked at together
_BITS = 22
_CODE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.uint64)
_PLAIN = np.array([c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def plain(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of every row and its offsets."""
    out = _PLAIN[raw]
    keep = out != 32
    if len(keep):
        keep[1:] |= out[:-1] != 32
        inner = at[:-1][at[:-1] < len(raw)]
        keep[inner] = out[inner] != 32  # no space at the start of a row
    kept = np.append(0, np.cumsum(keep))
    return out[keep], kept[at]


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int) -> int:
    """The least edits between the item and a stretch of the text, on diagonals low to high."""
    width = high - low + 1
    step = np.arange(width)
    row = np.zeros(width, np.int64)
    row[(low + step < 0) | (low + step > len(text))] = len(item)
    padded = np.concatenate([np.zeros(width, np.uint8), text, np.zeros(width + len(item), np.uint8)])
    for i in range(len(item)):
        place = i + low + step  # the text position that diagonal d pairs with item position i
        there = padded[np.clip(place + width, 0, len(padded) - 1)]
        new = row + ((there != item[i]) | (place < 0) | (place >= len(text)))
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


class Items:
    """A block of benchmark items and its q-grams."""

    def __init__(self, ids: list, texts: list[str | None], q: int = Q, budget: float = BUDGET, least: int = LEAST) -> None:
        raw, at = plain(*utf8(pa.array(texts, pa.string())))
        self.q, self.ids, self.text, self.edits, self.need = q, [], [], [], []
        for name, a, b in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = raw[a:b]
            own = own[:-1] if len(own) and own[-1] == 32 else own
            if len(own) < max(least, q):
                continue
            k = min(int(budget * len(own)), (len(own) - q) // q)
            self.ids.append(name)
            self.text.append(own)
            self.edits.append(k)
            self.need.append(len(own) - q + 1 - k * q)
        grams = [rolling(_CODE[t], q) for t in self.text]
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, first = np.unique(gram[order], return_index=True)
        self.at = np.append(first, len(order))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.edits, self.need = np.array(self.edits, np.int64), np.array(self.need, np.int64)
        self.longest = max((len(t) for t in self.text), default=0)

    def find(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, edits) of every item that a row holds, by row and item."""
        text, rows = plain(raw, at)
        grams = rolling(_CODE[text], self.q)
        hit = np.flatnonzero(self.maybe[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        slot = np.searchsorted(self.gram, grams[hit])
        slot[slot == len(self.gram)] = 0
        good = self.gram[slot] == grams[hit] if len(self.gram) else np.zeros(len(hit), bool)
        hit, slot = hit[good], slot[good]
        row = np.searchsorted(rows, hit, "right") - 1
        good = hit + self.q <= rows[row + 1]
        hit, slot, row = hit[good], slot[good], row[good]
        n = self.at[slot + 1] - self.at[slot]
        total = np.append(0, np.cumsum(n))
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a number for each row, item and band; each item's last band stays empty, so that neighbours are one item's
        n_items, n_bands = max(1, len(self.ids)), int(np.diff(rows).max(initial=0)) + self.longest + 2
        if (len(rows) * n_items * n_bands) >> 63:
            raise OverflowError("more rows, items and bands than a long can number; take smaller blocks")
        lo = 0
        while lo < len(hit):  # a slice of the postings at a time, whatever the items share
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + POSTINGS, "right")) - 1)
            m = n[lo:hi]
            k = np.repeat(np.arange(lo, hi), m)
            posting = np.repeat(self.at[slot[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(len(k))
            item = self.item[posting]
            diagonal = hit[k] - rows[row[k]] - self.place[posting] + self.longest
            band = diagonal // (self.edits[item] + 1)
            bands, times = np.unique((row[k] * n_items + item) * n_bands + band, return_counts=True)
            key, owner = np.unique(np.concatenate([key, bands]), return_inverse=True)
            count = np.bincount(owner, np.concatenate([count, times]), minlength=len(key)).astype(np.int64)
            lo = hi
        both = count + np.where(np.append(key[1:] == key[:-1] + 1, False), np.append(count[1:], 0), 0)
        out: dict[tuple[int, int], int] = {}
        reached = key[both >= self.need[key // n_bands % n_items]] if len(key) else key
        for x in reached.tolist():
            own, b = divmod(x, n_bands)
            r, i = divmod(own, n_items)
            if out.get((r, i)) == 0:
                continue
            edits = int(self.edits[i])
            low = b * (edits + 1) - self.longest - edits
            high = (b + 2) * (edits + 1) - 1 - self.longest + edits
            own = text[rows[r] : rows[r + 1]]
            a, z = max(0, low), max(0, high + len(self.text[i]) + 1)
            region = own[a:z]
            found = 0 if region.tobytes().find(self.text[i].tobytes()) >= 0 else banded(self.text[i], region, low - a, high - a)
            if found <= edits:
                out[r, i] = min(found, out.get((r, i), found))
        return sorted((r, i, e) for (r, i), e in out.items())


def _search(items, names: list[str]) -> Callable:
    """Rows (names, text) to rows (names, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            for first, end, raw, at in chunks(batch.column(len(names)), 1 << 20):
                found = own.find(raw, at)
                of = np.array([r for r, _, _ in found], np.int64)
                offsets = pa.array(np.searchsorted(of, np.arange(end - first + 1)).astype(np.int32))
                hits = pa.StructArray.from_arrays([pa.array([own.ids[i] for _, i, _ in found], items_type(own)), pa.array([e for _, _, e in found], pa.int32())], ["item_id", "edits"])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, end - first) for k in range(len(names))), pa.ListArray.from_arrays(offsets, hits)], [*names, "hits"])

    return run


def items_type(own: Items) -> pa.DataType:
    return pa.string() if any(isinstance(i, str) for i in own.ids) else pa.int64()


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int, least: int = LEAST) -> Iterator[Items]:
    """The benchmark in blocks of a bounded size."""
    rows_of = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    chars = rows_of.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // block_chars))
    for part in range(parts):
        own = rows_of.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).toLocalIterator()
        ids, texts, size = [], [], 0
        for r in own:
            if ids and size + len(r["text"] or "") > 2 * block_chars:
                yield Items(ids, texts, least=least)
                ids, texts, size = [], [], 0
            ids.append(r["id"])
            texts.append(r["text"])
            size += len(r["text"] or "")
        if ids:
            yield Items(ids, texts, least=least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1 << 22, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, hits (array of item_id and edits)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = "string" if benchmark.schema[item_col].dataType.simpleString() == "string" else "bigint"
    hits_type = f"array<struct<item_id:{item_type},edits:int>>"
    shared = [docs.sparkSession.sparkContext.broadcast(own) for own in blocks(benchmark, item_col, item_text_col, block_chars, least)]
    if not shared:
        return docs.select("doc_id", F.expr(f"cast(array() as {hits_type})").alias("hits"))
    if len(shared) == 1:
        return docs.mapInArrow(_search(shared[0], ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hits {hits_type}")
    docs = rows(docs)
    own = docs.select(*ROW, "text")
    found = reduce(DataFrame.unionByName, [own.mapInArrow(_search(b, ROW), f"{ROW[0]} long, {ROW[1]} long, hits {hits_type}").filter(F.size("hits") > 0) for b in shared])
    each = found.groupBy(*ROW).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return docs.select(*ROW, "doc_id").join(each, ROW, "left").select("doc_id", F.coalesce("hits", F.expr(f"cast(array() as {hits_type})")).alias("hits"))


def _keep(items, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for first, _, raw, at in chunks(batch.column(text_at), 1 << 20):
                clean[[first + r for r, _, _ in own.find(raw, at)]] = False
            yield batch.filter(pa.array(clean))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1 << 22, least: int = LEAST) -> DataFrame:
    """The documents that hold no item, with all columns; one pass for each block of items."""
    for own in blocks(benchmark, item_col, item_text_col, block_chars, least):
        docs = docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(own), docs.columns.index(text_col)), docs.schema)
    return docs
