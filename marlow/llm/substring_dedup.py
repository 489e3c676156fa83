"""Substring dedup: compaction of the de Bruijn graph of word windows, joined in Spark.

A window is ``window`` consecutive words of one document; a word goes if a window that covers it
starts anywhere else too. Windows are the edges of a de Bruijn graph over words, but no edge is ever
written out alone: consecutive windows whose smallest ``seed``-word hash is the same occurrence form
one *path* (about 14 windows on average), and equal windows always lie in paths with an equal seed.

1. One pass writes a row per path: seed hash, hash of all its words, coordinates.
2. Seeds that occur once end there. Where all paths of a seed have the same words the graph does not
   branch: the whole path is repeated.
3. At branching seeds, each distinct path is spelt out once, from its smallest source coordinate, into
   single windows, and windows found in two distinct paths are repeated. Paths whose words occur more
   than once are repeated whole.
4. The repeated coordinates are joined to their documents, which drop the covered words.

A window's identity is the pair of two independent 64-bit hashes (seed and words) with its offset; both
are of mixed hashes of whole words.
Hot passages meet in aggregates with map-side combination; seeds and paths that many edges share are
broadcast, a bounded number of them, so no group is gathered and none fills a task.

Edge cases: a null or empty text has no words and keeps the empty text; a document shorter than a
window loses nothing; every row is a document of its own, told apart by its place and not by its
identifier, which may repeat or be null; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ROW, discard, materialise, rows
from .textnum import chunks, mix, powers, rolling, span_hashes, words

HOT = 1 << 12  # keys that are broadcast, at most
_AT = 28  # low bits that hold a position; the rest of a packed value orders by hash
_AT_ROW = f"{ROW[0]} long, {ROW[1]} long"
_PATHS = f"{_AT_ROW}, seed long, body long, lo int, hi int"


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def paths(raw: np.ndarray, at: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, seed hash, word hash, first and last window start, in words of the row) of every path."""
    starts, ends, rows = words(raw, at)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(starts) - window + 1
    if n <= 0:
        return none
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(rows))
    codes = span_hashes(raw, starts, ends)
    seeds = rolling(codes, seed, salt=1)
    packed = (seeds >> np.uint64(_AT) << np.uint64(_AT)) | np.arange(len(seeds), dtype=np.uint64)
    width, low = 1, packed
    span = window - seed + 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64((1 << _AT) - 1)).astype(np.int64)  # the seed of each window start
    whole = np.flatnonzero(row_of[:n] == row_of[window - 1 :])
    if not len(whole):
        return none
    new = np.ones(len(whole), bool)
    new[1:] = (place[whole[1:]] != place[whole[:-1]]) | (row_of[whole[1:]] != row_of[whole[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1
    lo, hi = whole[first], whole[last]
    sums = _sums(mix(codes, 2))
    body = (sums[hi + window] - sums[lo]) * powers(len(codes) + 1, inverse=True)[lo]
    anchor = place[lo]
    shape = ((anchor - lo) << 20 | (hi - lo)).astype(np.uint64)
    row = row_of[lo]
    return row, seeds[anchor].view(np.int64), mix(body + shape, 3).view(np.int64), lo - rows[row], hi - rows[row]


def _of(batch: pa.RecordBatch, first: int, end: int, pick: np.ndarray) -> list[pa.Array]:
    """The names of picked rows of a chunk."""
    return [batch.column(k).slice(first, end - first).take(pa.array(pick)) for k in range(2)]


def _to_paths(window: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in chunks(batch.column(2)):
                row, key, body, lo, hi = paths(raw, at, window, seed)
                if len(row):
                    yield pa.RecordBatch.from_arrays([*_of(batch, first, end, row), pa.array(key), pa.array(body), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], [*ROW, "seed", "body", "lo", "hi"])

    return run


def _spell(window: int) -> Callable:
    """Rows (ROW, text, paths) to a row for each window of each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for first, end, raw, at in chunks(batch.column(2)):
                starts, ends, rows = words(raw, at)
                sums = _sums(mix(span_hashes(raw, starts, ends), 4))
                part = lists.slice(first, end - first)
                flat = part.flatten()
                row = np.repeat(np.arange(end - first), np.asarray(part.value_lengths().fill_null(0)))
                lo, hi, key, many = (np.asarray(flat.field(k)) for k in ("lo", "hi", "seed", "many"))
                n = hi - lo + 1
                k = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                s = lo[k] + step
                g = rows[row[k]] + s
                h = (sums[g + window] - sums[g]) * powers(len(sums), inverse=True)[g]
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(mix(h, 5).view(np.int64)), pa.array(many[k]), *_of(batch, first, end, row[k]), pa.array(s.astype(np.int32))], ["seed", "body", "many", *ROW, "lo"])

    return run


def _drop(window: int) -> Callable:
    """Rows (doc_id, text, spans) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0), batch.column(2)
            texts, total, gone, kept = batch.column(1), [], [], []
            for i in range(batch.num_rows):
                own = (texts[i].as_py() or "").encode().split()  # bytes split at [\x20\x09-\x0D]
                total.append(len(own))
                if spans[i].is_valid and len(spans[i]):
                    edge = np.zeros(len(own) + 1, np.int32)
                    got = spans[i].values
                    np.add.at(edge, np.asarray(got.field("lo")), 1)
                    np.add.at(edge, np.asarray(got.field("hi")) + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    own = [w for w, x in zip(own, stay.tolist(), strict=True) if x]
                gone.append(total[-1] - len(own))
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _met(edges: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """``edges`` joined to their keys; ``keys`` have n, how many edges each has, of ``total``.

    A key of more than one in ``HOT`` of all edges would fill a task. There are at most ``HOT`` of those,
    so they are broadcast and meet the edges where these lie; the others meet by shuffle.
    """
    hot = (F.col("n") * HOT > total).alias("hot")
    often, seldom = keys.filter(hot), keys.filter(~hot)
    here = edges.join(F.broadcast(often.drop("n")), on)
    rest = edges.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom.drop("n").hint("merge"), on)
    return here.unionByName(rest)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed: int = 8) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text."""
    docs = rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    edges = materialise(docs.select(*ROW, "text").mapInArrow(_to_paths(window, seed), _PATHS), "paths")
    seeds = edges.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("a"), F.max("body").alias("b")).filter("n > 1").select("seed", "n", (F.col("a") != F.col("b")).alias("branching"))
    seeds = materialise(seeds, "seeds")
    shared = materialise(_met(edges, seeds, ["seed"], edges.count()), "shared-paths")
    discard(edges)

    straight = shared.filter("not branching").select(*ROW, "lo", "hi")
    branching = shared.filter("branching")
    bodies = materialise(branching.groupBy("seed", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "lo", "hi")).alias("at")), "distinct-paths")
    whole = _met(branching, bodies.filter("n > 1").select("seed", "body", "n"), ["seed", "body"], shared.count()).select(*ROW, "lo", "hi")

    spelt = bodies.select("at.*", F.struct("at.lo", "at.hi", "seed", (F.col("n") > 1).alias("many")).alias("p")).groupBy(*ROW).agg(F.collect_list("p").alias("paths"))
    single = materialise(docs.join(spelt, ROW).select(*ROW, "text", "paths").mapInArrow(_spell(window), f"seed long, body long, many boolean, {_AT_ROW}, lo int"), "windows")
    common = single.groupBy("seed", "body").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed", "body")
    parted = single.filter("not many").join(common, ["seed", "body"]).select(*ROW, "lo", F.col("lo").alias("hi"))

    spans = straight.unionByName(whole).unionByName(parted).groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = materialise(spans, "repeated-spans")
    for used in (seeds, shared, bodies, single):
        discard(used)
    return docs.join(spans, ROW, "left").select("doc_id", "text", "spans").mapInArrow(_drop(window), f"doc_id {id_type}, n_words long, n_removed long, kept_text string")
