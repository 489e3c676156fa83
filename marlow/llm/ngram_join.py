"""N-gram Jaccard join: universe-partition pigeonhole with exact verification.

A document's set holds the hashes of its distinct word shingles. The universe of shingles is dealt by
hash into ``m`` segments, ``m`` fixed for each size band. Two sets of similarity 0.8 or more differ in
at most D shingles, so at least m - D of their segments are equal: with the same order on segments,
the first D + 1 of either must share one. The order is the cost-based allocation: segments of many
shingles, which few sets share, come first, empty ones last, and a set indexes only its first
``size // 4 + 1``. Sets of 4 to 8 shingles, where D is at most 1, are one segment, indexed with its
one-deletion neighbourhood instead.

Equal sets are one node throughout. Sets that meet in a segment are not paired: they are dealt to
blocks of about ``block`` sets that share their least neighbour. A task holds one block's index, counts
every intersection exactly, and returns a spanning forest of the links. One set of each component then
meets those of others in blocks of their own, round by round, and where sets of different components
still share a segment, the smaller block's visit the larger one. So every link between components is
found, and none is looked for within one. Components come from the forests, in Spark.

A set is named by a 64-bit hash of its content; shingles are 64-bit hashes of mixed word hashes.

Edge cases: a null, empty or blank text has an empty set and links with nothing; fewer words than a
shingle make one shingle of all of them; every row is a document of its own, told apart by its place
and not by its identifier, so rows that repeat are copies and rows of one identifier may hold
different texts; a null identifier links like any other and is never the smallest, so only a component
of such rows has a null one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import ROW, discard, materialise, rows
from .textnum import chunks, lower_ascii, mix, rolling, span_hashes, words

TINY = 8  # up to so many shingles, and from LEAST on, one-deletion neighbourhoods find all links
LEAST = 4  # smaller sets link only with equal ones


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each row, offsets of the rows in them)."""
    raw = lower_ascii(raw)
    starts, ends, rows = words(raw, at)
    codes = span_hashes(raw, starts, ends)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(rows))
    tokens, owner = rolling(codes, width, salt=11), row_of[: max(0, len(codes) - width + 1)]
    if len(tokens):
        inside = owner == row_of[width - 1 :]
        tokens, owner = tokens[inside], owner[inside]
    for r in np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < width)):
        own = codes[rows[r] : rows[r + 1]]
        tokens, owner = np.append(tokens, rolling(own, len(own), salt=20 + len(own))), np.append(owner, r)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(len(at)))


def names(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens, 31), out=sums[1:])
    return mix((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(np.uint64), 32)


def segments_of(band: np.ndarray) -> np.ndarray:
    """How many segments a band's universe has; sizes in band b are from 2**b to 2**(b+1)."""
    return (1.2 * 2.0 ** (band - 1)).astype(np.int64) + 5


def signatures(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every indexed segment."""
    size = np.diff(at)
    rows, keys = [], []
    tiny = np.flatnonzero((size >= LEAST) & (size <= TINY))
    for r in tiny:
        own = mix(tokens[at[r] : at[r + 1]], 41)
        total = own.sum(dtype=np.uint64)
        rows.append(np.full(len(own) + 1, r))
        keys.append(mix(np.append(total - own, total), 42))
    band = np.zeros(len(size), np.int64)
    large = np.flatnonzero(size >= TINY)
    band[large] = np.floor(np.log2(size[large])).astype(np.int64)
    above = large[size[large] * 5 >= 4 * (2 << band[large])]  # a partner may be in the next band
    set_row, set_band = np.concatenate([large, above]), np.concatenate([band[large], band[above] + 1])
    if len(set_row):
        m, n = segments_of(set_band), size[set_row]
        base = np.cumsum(m) - m
        k = np.repeat(np.arange(len(n)), n)
        token = tokens[np.repeat(at[:-1][set_row] - (np.cumsum(n) - n), n) + np.arange(len(k))]
        seg = (mix(token, 43) + set_band[k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % m[k].astype(np.uint64)
        slot = base[k] + seg.astype(np.int64)
        total = int(m.sum())
        filled, sums = np.bincount(slot, minlength=total), np.zeros(total, np.uint64)
        np.add.at(sums, slot, mix(token, 44))
        owner = np.repeat(np.arange(len(m)), m)
        number = np.arange(total) - base[owner]
        key = mix(mix(sums, 45) + (set_band[owner] << 40 | number).astype(np.uint64), 46)
        order = np.lexsort((key, -np.minimum(filled, 4), owner))
        first = order[number < (n // 4 + 1)[owner]]  # owners stay in place, so the rank is the number
        rows.append(set_row[owner[first]])
        keys.append(key[first])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def _index(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, end, raw, at in chunks(batch.column(3)):
                tokens, sets = shingle_sets(raw, at, width)
                size, name = np.diff(sets), names(tokens, sets).view(np.int64)
                row, key = signatures(tokens, sets)
                again = np.array([x in seen or seen.add(x) is not None for x in name.tolist()], bool)
                keep = ~again[row]  # equal sets of one task are indexed once
                row, key = row[keep], key[keep]
                offsets = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, end - first) for k in range(3)), pa.array(size), pa.array(name), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))], [*ROW, "doc_id", "n_shingles", "name", "keys"]
                )

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, name), sorted, to (key, name, least name of the key) where a key has two names or more."""
    last_key = last_name = leader = None
    alone = False
    for batch in batches:
        key, name = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(key):
            continue
        prev_key, prev_name = np.append(key[:1], key[:-1]), np.append(name[:1], name[:-1])
        starts = key != prev_key
        same = ~starts & (name == prev_name)
        starts[0], same[0] = last_key != key[0], last_key == key[0] and last_name == name[0]
        key, name, starts = key[~same], name[~same], starts[~same]
        last_key, last_name = (key[-1], name[-1]) if len(key) else (last_key, last_name)
        if not len(key):
            continue
        run = np.cumsum(starts)
        leads = np.append([leader if leader is not None else name[0]], name[starts])[run]
        after = np.append([not starts[0] and alone], starts[:-1]) & ~starts  # second of its run
        leader, alone = leads[-1], bool(starts[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(key[~starts], key[after])), pa.array(np.append(name[~starts], leads[after])), pa.array(np.append(leads[~starts], leads[after]))], ["key", "name", "leader"])


class _Block:
    """The index of one block's sets."""

    def __init__(self, name: np.ndarray, copies: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> None:
        self.name, self.copies, self.size, self.links = name, copies, np.diff(at), np.zeros(len(name), np.int64)
        owner = np.repeat(np.arange(len(name)), self.size)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.known, first = np.unique(tokens[order], return_index=True)
        self.at = np.append(first, len(order))
        self.parent = list(range(len(name)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def pass_by(self, name: np.ndarray, copies: np.ndarray, tokens: np.ndarray, at: np.ndarray, own: bool, percent: int, budget: int = 1 << 21) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, links) rows: forest edges (links null is 0) and each visitor's number of links (b is a)."""
        found = np.searchsorted(self.known, tokens)
        found[found == len(self.known)] = 0
        hit = self.known[found] == tokens if len(self.known) else np.zeros(len(tokens), bool)
        cost = np.where(hit, self.at[found + 1] - self.at[found], 0) if len(self.known) else np.zeros(len(tokens), np.int64)
        total = np.append(0, np.cumsum(cost))[at]
        v, width = 0, len(self.name)
        while v < len(name):
            end = min(len(name), max(v + 1, int(np.searchsorted(total, total[v] + budget, "right")) - 1), v + max(1, budget // width))
            span = slice(at[v], at[end])
            pick = np.flatnonzero(hit[span]) + at[v]
            n = cost[pick]
            place = np.repeat(self.at[found[pick]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            visitor = np.repeat(np.searchsorted(at, pick, "right") - 1 - v, n)
            both = np.bincount(visitor * width + self.owner[place], minlength=(end - v) * width).reshape(end - v, width)
            linked = 100 * both >= percent * (np.diff(at)[v:end, None] + self.size[None] - both)
            linked &= (np.diff(at)[v:end, None] > 0) & (self.size[None] > 0)
            if own:
                linked &= np.arange(v, end)[:, None] < np.arange(width)[None]
            self.links += copies[v:end] @ linked
            mine = linked @ self.copies
            some = np.flatnonzero(mine)
            i, j = np.nonzero(linked)
            if len(i):
                lead = linked.argmax(1)
                pairs = np.unique(np.concatenate([lead[i] * width + j, (np.arange(v, end)[i] * width + j) if own else np.zeros(0, np.int64)]))
                joined = []
                for x, y in zip((pairs // width).tolist(), (pairs % width).tolist(), strict=True):
                    p, q = self.root(x), self.root(y)
                    if p != q:
                        self.parent[q] = p
                        joined.append((x, y))
                if joined:
                    x, y = np.array(joined).T
                    yield self.name[x], self.name[y], np.zeros(len(x), np.int64)
                if not own:
                    yield name[v:end][some], self.name[lead[some]], np.zeros(len(some), np.int64)
                yield name[v:end][some], name[v:end][some], mine[some]
            v = end

    def close(self) -> tuple[np.ndarray, ...]:
        some = np.flatnonzero(self.links)
        return self.name[some], self.name[some], self.links[some]


def _verify(width: int, percent: int) -> Callable:
    """Rows (block, visiting, name, copies, text), sorted by the first two, to (a, b, links)."""

    def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in rows], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, members, block = None, [], None

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal block, members
            name, copies = (np.concatenate([m[k] for m in members]) for k in (0, 1))
            tokens, sizes = np.concatenate([m[2] for m in members]), np.concatenate([m[3] for m in members])
            at = np.append(0, np.cumsum(sizes))
            block, members = _Block(name, copies, tokens, at), []
            yield from map(out, block.pass_by(name, copies, tokens, at, True, percent))

        for batch in batches:
            place, visiting, name, copies = (np.asarray(batch.column(k)) for k in range(4))
            for first, end, raw, at in chunks(batch.column(4)):
                tokens, sets = shingle_sets(raw, at, width)
                cut = np.flatnonzero((np.diff(place[first:end]) != 0) | (np.diff(visiting[first:end]) != 0)) + 1
                for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, end - first).tolist(), strict=True):
                    where = place[first + lo]
                    if where != at_block:
                        if members:
                            yield from build()
                        if block is not None:
                            yield out(block.close())
                        at_block, block = where, None
                    own = tokens[sets[lo] : sets[hi]]
                    part = (name[first + lo : first + hi], copies[first + lo : first + hi], own)
                    if visiting[first + lo]:
                        if members:
                            yield from build()
                        yield from map(out, block.pass_by(*part, sets[lo : hi + 1] - sets[lo], False, percent))
                    else:
                        members.append((*part, np.diff(sets[lo : hi + 1])))
        if members:
            yield from build()
        if block is not None:
            yield out(block.close())

    return run


def _verified(work: DataFrame, width: int, percent: int) -> DataFrame:
    """``work``: block, visiting, name, copies, text. Rows (a, b, links) of every block."""
    dealt = work.select("block", "visiting", "name", "copies", "text").repartition("block").sortWithinPartitions("block", "visiting", "name")
    return materialise(dealt.mapInArrow(_verify(width, percent), "a long, b long, links long"), "links")


def _blocks(names: DataFrame, block: int) -> DataFrame:
    """(name, block): the names of a cluster dealt to blocks of about ``block``. ``names``: name, cluster."""
    sizes = names.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return names.join(sizes, "cluster").select("name", F.xxhash64("cluster", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / block))).alias("block"))


def _visits(places: DataFrame, keyed: DataFrame) -> DataFrame:
    """(name, block) of the visits: of two blocks that meet under a key, the names of the smaller go to the larger.

    ``places``: name, block; ``keyed``: key, name, and ``root`` where names of one root need not meet.
    """
    weighed = places.join(places.groupBy("block").agg(F.count(F.lit(1)).alias("weight")), "block")
    at = keyed.join(weighed, "name").groupBy("key", F.struct("weight", "block").alias("place")).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    at = materialise(at, "met-blocks")
    apart = (F.col("low") != F.col("other_low")) | (F.col("low") != F.col("high")) | (F.col("other_low") != F.col("other_high"))
    other = at.withColumnsRenamed({"place": "larger", "low": "other_low", "high": "other_high"})
    pairs = at.join(other, "key").filter("place < larger").filter(apart).select("place.block", F.col("larger.block").alias("there")).distinct()
    return places.join(pairs, "block").select("name", F.col("there").alias("block"))


def _rooted(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, root): every name with the least name that the edges lead to, its own where there is none."""
    roots = connected_components(edges).withColumnRenamed("node", "name")
    return materialise(names.select("name").join(roots, "name", "left").select("name", F.coalesce("root", "name").alias("root")), "roots")


def _linked(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 256, count_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """``docs``: ROW, doc_id, text. (nodes: ROW, doc_id, n_shingles, name; sets: name, least row of the component, n_links)."""
    if percent < 80:
        raise ValueError("the index finds links of 80 percent or more")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = f"{ROW[0]} long, {ROW[1]} long, doc_id {id_type}, n_shingles long, name long"
    indexed = materialise(docs.mapInArrow(_index(width), f"{own}, keys array<long>"), "shingle-index")
    nodes = materialise(indexed.drop("keys"), "shingle-sets")
    keyed = indexed.select(F.explode("keys").alias("key"), "name").repartition("key").sortWithinPartitions("key", "name")
    met = materialise(keyed.mapInArrow(_meetings, "key long, name long, leader long"), "meetings")
    discard(indexed)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *ROW)).alias("first")
    copies = nodes.filter("n_shingles > 0").groupBy("name").agg(first, F.count(F.lit(1)).alias("copies"))
    home = materialise(_blocks(met.groupBy("name").agg(F.min("leader").alias("cluster")), block).join(copies, "name"), "blocks")
    texts = docs.join(home.select(*[F.col(f"first.{c}").alias(c) for c in ROW], "name", "block", "copies").hint("merge"), ROW)
    texts = materialise(texts.select("name", "block", "copies", "text"), "met-texts")
    stays = texts.withColumn("visiting", F.lit(0))
    names, met_names = texts.select("name"), met.select("key", "name")
    if count_links:
        visits = _visits(home.select("name", "block"), met_names.withColumn("root", F.col("name")))
        found = _verified(stays.unionByName(visits.join(texts.drop("block").hint("merge"), "name").withColumn("visiting", F.lit(1))), width, percent)
        edges = [found.filter("a <> b").select("a", "b")]
        roots = _rooted(names, edges[0])
        degree = found.filter("a = b").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))
    else:
        roots, degree = _connected(home, texts, met_names, block, width, percent), None

    rooted = roots.join(copies, "name")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = copies.join(rooted.join(least, "root").select("name", "least"), "name", "left").select("name", "copies", F.coalesce("least", "first").alias("least"))
    if degree is not None:
        named = named.join(degree, "name", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return nodes, named


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` after edges between names: components of their roots alone, which are few."""
    at = lambda c: roots.select(F.col("name").alias(c), F.col("root").alias(f"root_{c}"))
    edges = more.join(at("a"), "a").join(at("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    moved = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return materialise(roots.join(moved, "root", "left").select("name", F.coalesce("to", "root").alias("root")), "roots")


def _connected(home: DataFrame, texts: DataFrame, met: DataFrame, block: int, width: int, percent: int) -> DataFrame:
    """(name, root) of all names, without comparing what is linked already.

    First every block on its own. Then, for as long as it joins more than a few, one set of each
    component meets the others under its keys in new blocks, so a large group of near copies closes in a
    few rounds of shrinking size. Last, under keys that still hold sets of several components, the sets
    of a block visit each block whose components are not its own; that finds every link left.
    """
    edges = _verified(texts.withColumn("visiting", F.lit(0)), width, percent).filter("a <> b").select("a", "b")
    names = texts.select("name")
    roots = _rooted(names, edges)
    while True:
        several = met.join(roots, "name").select("key", "root").distinct()
        several = several.join(several.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("cluster")).filter("n > 1"), "key")
        heads = materialise(several.groupBy(F.col("root").alias("name")).agg(F.min("cluster").alias("cluster")), "heads")
        n = heads.count()
        if not n:
            return roots
        work = _blocks(heads, block).join(texts.drop("block").hint("merge"), "name").withColumn("visiting", F.lit(0))
        more = _verified(work, width, percent).filter("a <> b").select("a", "b")
        joined = more.count()
        if joined:
            roots = _joined(roots, more)
        if joined * 8 < n:
            break
    still = met.join(roots, "name")
    still = still.join(still.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"), "key", "left_semi")
    still = materialise(still.select("key", "name", "root"), "open-keys")
    places = home.select("name", "block").join(still.select("name").distinct(), "name", "left_semi")
    visits = materialise(_visits(places, still), "visits")
    # A block that many visit stands in several places, each for a share of its visitors.
    sized = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (4 * block)).cast("int").alias("parts"))
    at = lambda part: F.xxhash64("block", part).alias("block")
    visits = visits.join(sized, "block").select("name", at(F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")), F.lit(1).alias("visiting"))
    stays = places.join(sized, "block").select("name", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("name", at(F.col("part")), F.lit(0).alias("visiting"))
    work = stays.select("name", "block", "visiting").unionByName(visits.select("name", "block", "visiting")).join(texts.drop("block").hint("merge"), "name")
    more = _verified(work, width, percent).filter("a <> b").select("a", "b")
    return roots if more.isEmpty() else _joined(roots, more)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = 256, count_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and, if ``count_links``, n_links.

    ``percent`` may be raised above 80, which the index is built for, not lowered. Counting links compares
    every two sets that meet, also those whose component is known, which a large group of near copies
    makes dear.
    """
    docs = rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    nodes, named = _linked(docs, width, percent, block, count_links)
    counted = [F.col("n_links")] if count_links else []
    full = nodes.filter("n_shingles > 0").join(named, "name").select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), *counted)
    none = [F.lit(0).cast("long").alias("n_links")] if count_links else []
    blank = nodes.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *none)
    return full.unionByName(blank)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The first row of every component, with all columns: of the smallest identifier, one row where it repeats.

    Rows without a shingle link with nothing and stay.
    """
    docs = rows(docs)
    nodes, named = _linked(docs.select(*ROW, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    kept = named.select(*(F.col(f"least.{c}").alias(c) for c in ROW)).unionByName(nodes.filter("n_shingles = 0").select(*ROW))
    return docs.join(kept, ROW, "left_semi").drop(*ROW)
