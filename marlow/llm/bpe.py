"""BPE encoding and decoding by a distinct-word table.

Words are the tokenizer's own pre-tokens, found for whole columns at once on arrays of code points.
The distinct words of all texts are counted in Spark; those frequent enough to fit a table of
``table_words`` entries of ``TABLE_BYTES`` at most, whatever the corpus size, are encoded once, and the
table of word and ids is broadcast. Each position then takes its word's ids from the table, where the
bytes agree and not only their hash. A word beyond the table's bound, rare or long, is encoded where it
stands, once per chunk of text. Decoding joins ids with the
vocabulary's pieces, of which there are as many as the vocabulary has.

Edge cases: a null or empty text has no ids and decodes to the empty text; the special token's string
in a text is that token; rows that repeat count and answer separately; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bounded import frequent
from .store import materialise
from .textnum import chunks, differ, span_hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
HELD_WORDS = 1 << 20  # of chunks, before a task passes its distinct words on
TABLE_BYTES = 64  # of a word in the table, so the table has a bound in bytes too
#: The endings that the byte-level pre-tokenizer splits off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, as the library's own pre-tokenizer has it."""
    from tokenizers import pre_tokenizers

    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
    out = np.full(0x110000, SPACE, np.uint8)
    probes = ((OTHER, "!"), (NUMBER, "1"), (LETTER, "x"))
    for low in range(0, 0x110000, 256):
        block = [c for c in range(low, low + 256) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, block))
        whole = next((kind for kind, probe in probes if block and len(splitter.pre_tokenize_str(probe + text)) == 1), None)
        if whole is not None:
            out[block] = whole
            continue
        for kind, probe in probes:
            begun = {start for _, (start, _) in splitter.pre_tokenize_str("".join(probe + c for c in text))}
            out[[c for i, c in enumerate(block) if 2 * i + 1 not in begun]] = kind  # it runs on from the probe
    return out


def split_words(raw: np.ndarray, at: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of every word, row offsets into them, which special token or -1)."""
    n = len(raw)
    head = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    m = len(points)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    marks: list[tuple[int, int]] = []
    blob = raw.tobytes() if any(raw.tobytes().find(s) >= 0 for s in special) else b""
    for k, token in enumerate(special):
        found = blob.find(token)
        while found >= 0:
            stop = found + len(token)
            if not edge[found + 1 : stop].any():  # it doesn't run on into another row
                edge[found] = edge[stop] = True
                marks.append((found, k))
                found = blob.find(token, stop)
            else:
                found = blob.find(token, found + 1)
    if not m:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64), np.zeros(0, np.int8)
    edges = np.append(edge[head], True)
    kind = classes()[points]
    prev = np.append(kind[:1], kind[:-1])
    run = edges[:-1] | (kind != prev)
    blank = points == 32
    attached = np.append([False], blank[:-1]) & ~edges[:-1] & (kind != SPACE)  # a single space before goes with it
    start = run & ~(attached & run)
    ends_run = np.append(run[1:], True)
    start |= (kind == SPACE) & ends_run & ~edges[1:]  # the last of a run of white space, with text after it
    quote = np.flatnonzero(run & ~attached & (points == 39) & ends_run & ~edges[1:])
    for ending in ENDINGS:
        own = quote[quote + len(ending) < m]
        for k, c in enumerate(ending):
            own = own[(points[own + 1 + k] == ord(c)) & ~edges[own + 1 + k]]
        start[own + 1] = False
        after = own + 1 + len(ending)
        start[after[after < m]] = True
    start |= edges[:-1]
    if marks:
        for found, k in marks:
            a, b = np.searchsorted(head, [found, found + len(special[k])])
            start[a + 1 : b] = False
    first = head[start]
    which = np.full(len(first), -1, np.int8)
    for found, k in marks:
        which[np.searchsorted(first, found)] = k
    return first, np.searchsorted(first, at), which


class Vocabulary:
    """The tokenizer of a file, its special tokens and the bytes of every piece."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without prefix space or normalizer is needed")
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.special_ids = [x["id"] for x in spec["added_tokens"]]
        # Byte-level vocabularies write a byte as itself where it prints, else as the next code point from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        back = {chr(v): k for k, v in letters.items()}
        size = self.tokenizer.get_vocab_size()
        self.pieces = [b""] * size
        for token, i in self.tokenizer.get_vocab().items():
            self.pieces[i] = bytes(back[c] for c in token) if i not in self.special_ids else token.encode()

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def gather(pieces: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked spans of ``pieces`` one after another, and each one's end."""
    n = (at[1:] - at[:-1])[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pieces[np.repeat(at[:-1][pick] - (ends - n), n) + np.arange(total)], ends


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = vocabulary(path).special

        def merged(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            keys, counts, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
            data = np.concatenate([h[3] for h in held])
            _, place, owner = np.unique(keys, return_index=True, return_inverse=True)
            n = np.bincount(owner, counts, minlength=len(place)).astype(np.int64)
            ends = np.cumsum(sizes)
            out, stops = _spans(data, (ends - sizes)[place], ends[place])
            offsets = pa.py_buffer(np.append(0, stops).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(place), [None, offsets, pa.py_buffer(out.tobytes())]), pa.array(n)], ["word", "n"])

        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            for _, _, raw, at in chunks(batch.column(0), 1 << 20):
                first, _, which = split_words(raw, at, special)
                ends = np.append(first[1:], len(raw))[: len(first)]
                plain = which < 0
                first, ends = first[plain], ends[plain]
                key, place, n = np.unique(span_hashes(raw, first, ends), return_index=True, return_counts=True)
                held.append((key, n, (ends - first)[place], _spans(raw, first[place], ends[place])[0]))
                if sum(len(h[0]) for h in held) > HELD_WORDS:
                    yield merged(held)
                    held = []
            if held:
                yield merged(held)

    return run


def _spans(raw: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = ends - first
    stops = np.cumsum(n)
    return raw[np.repeat(first - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)], stops


def _encode_table(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.encode(batch.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "ids"])

    return run


class Table:
    """Frequent words by hash, with their ids; small enough to broadcast because it has a bound."""

    def __init__(self, words: pa.ChunkedArray, ids: pa.ChunkedArray) -> None:
        lists, own = ids.to_pylist(), words.to_pylist()
        self.raw = np.frombuffer(b"".join(own), np.uint8)
        ends = np.cumsum([len(w) for w in own]).astype(np.int64)
        starts = np.append(0, ends)[: len(ends)].astype(np.int64)
        key = span_hashes(self.raw, starts, ends)
        order = np.argsort(key)
        self.key, self.starts, self.ends = key[order], starts[order], ends[order]
        self.at = np.append(0, np.cumsum([len(lists[i]) for i in order])).astype(np.int64)
        self.ids = np.array([x for i in order for x in lists[i]], np.int32)


def encode_chunk(own: Vocabulary, table: Table, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets into them)."""
    first, rows, which = split_words(raw, at, own.special)
    ends = np.append(first[1:], len(raw))[: len(first)]
    key, place, word = np.unique(span_hashes(raw, first, ends), return_index=True, return_inverse=True)
    found = np.searchsorted(table.key, key)
    found[found == len(table.key)] = 0
    known = np.flatnonzero(table.key[found] == key) if len(table.key) else np.zeros(0, np.int64)
    known = known[~differ(raw, first[place[known]], ends[place[known]], table.raw, table.starts[found[known]], table.ends[found[known]])]
    # Words of one hash are one word only where their bytes say so; any other stands for itself.
    odd = np.flatnonzero(differ(raw, first, ends, raw, first[place[word]], ends[place[word]]))
    if len(odd):
        word[odd] = len(place) + np.arange(len(odd))
        place, found = np.append(place, odd), np.append(found, np.zeros(len(odd), found.dtype))
    rest = np.setdiff1d(np.arange(len(place)), known, assume_unique=True)
    blob = raw.tobytes()
    extra = [[own.special_ids[which[place[i]]]] if which[place[i]] >= 0 else None for i in rest.tolist()]
    todo = [j for j, x in enumerate(extra) if x is None]
    for j, ids in zip(todo, own.encode([blob[first[place[rest[j]]] : ends[place[rest[j]]]] for j in todo]), strict=True):
        extra[j] = ids
    ids = np.concatenate([table.ids, np.array([x for e in extra for x in e], np.int32)])
    spans = np.concatenate([table.at, len(table.ids) + np.cumsum([len(e) for e in extra]).astype(np.int64)])
    entry = found
    entry[rest] = len(table.at) - 1 + np.arange(len(rest))
    out, stops = gather(ids, spans, entry[word])
    return out, np.append(0, stops)[rows]


def _encode(path: str, table) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = vocabulary(path), table.value
        for batch in batches:
            for first, end, raw, at in chunks(batch.column(1), 1 << 20):
                ids, rows = encode_chunk(own, known, raw, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return run


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        pieces = np.frombuffer(b"".join(own.pieces), np.uint8)
        at = np.append(0, np.cumsum([len(p) for p in own.pieces])).astype(np.int64)
        for batch in batches:
            lists = batch.column(1)
            n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            rows = np.append(0, np.cumsum(n))
            flat = np.asarray(lists.flatten())
            k = 0
            while k < len(n):
                end = max(k + 1, int(np.searchsorted(rows, rows[k] + (1 << 18), "right")) - 1)
                data, stops = gather(pieces, at, flat[rows[k] : rows[end]])
                cut = np.append(0, stops)[rows[k : end + 1] - rows[k]]
                blob = data.tobytes()
                texts = [blob[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, end - k), lists.slice(k, end - k), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                k = end

    return run


def word_table(docs: DataFrame, path: str, text_col: str = "text", table_words: int = 1 << 19) -> Table:
    """Count the distinct words of all texts and encode each frequent one once."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "distinct-words")
    found = frequent(counts.filter(F.octet_length("word") <= TABLE_BYTES), table_words).select("word").mapInArrow(_encode_table(path), "word binary, ids array<int>").toArrow()
    return Table(found.column("word"), found.column("ids"))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = 1 << 19) -> DataFrame:
    """One row per document: doc_id, ids. ``path`` is the tokenizer file, at the same place on every machine."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, "text", table_words))
    return docs.mapInArrow(_encode(path, table), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def bpe_both(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = 1 << 19) -> DataFrame:
    """doc_id, ids and the text that the ids stand for, in one pass: chunks are decoded by the worker that encoded them.

    The rows of ``bpe_decode`` of ``bpe_encode``, with one Python worker a task and not two.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, "text", table_words))
    encode, decode = _encode(path, table), _decode(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decode(encode(batches))

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
