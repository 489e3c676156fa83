"""The prefix trie of conversations: one node for each distinct sequence of first turns.

A turn is its digest (SHA-256 of role and text), so texts are read once and never shuffled. Turns are
ranked in range partitions whose counts are added up, so one conversation may hold any share of the
rows. A node's key is 128 bits that fold the digests of its turns with their places; the partial sums of
stretches of ``STRETCH`` turns make keys of any depth without a walk along the conversation.

Every partition of turns combines its own rows to a partial trie: a row for each node it met, with its
members counted and the smallest. Partial tries meet ``FAN`` at a time, keyed by node, until one is left;
what reaches a task for a key has at most ``FAN`` rows, the root's too. All rows of a node must agree on
its parent and its last turn, or the merge fails: two sequences never share a node by their keys. The
conversations that end at a node are merged as sorted runs of ``RUN`` identifiers, and a digest is taken
over the runs in order, one run in memory at a time.

The rollup passes sums from the deepest node up: nodes with one smallest member stand one below the other
on that member's path, so each such chain sums itself from its end, and hands its total to every node
above on its member's own path. That is one aggregation, whatever the depth.

Edge cases: turns are ordered null first, turns of equal number by their digests; repeated rows are turns
of their own; a null role or text is empty; rows without a conversation identifier belong to none and are
left out; an empty table has no node, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialise

FAN = 16
STRETCH = 4096
RUN = 1 << 15
KEY = ["key1", "key2"]


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: the role's length in bytes, the role, the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (from 1), ``digest`` and ``n_bytes`` of every turn of every conversation."""
    text = F.coalesce("text", F.lit(""))
    own = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(n, "conv_id", F.col("turn").asc_nulls_first(), "digest", "row")
    dealt = materialise(dealt.select("conv_id", "turn", "digest", "n_bytes", "row", F.spark_partition_id().alias("part")), "turns")
    within = Window.partitionBy("conv_id", "part")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation has a row for each partition it reaches into
    starts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(within.orderBy(F.col("turn").asc_nulls_first(), "digest", "row")))
    return ranked.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("rank")).alias("at"), "digest", "n_bytes")


def share_heads(own: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another: (turns, ``conv_id`` and ``n_turns`` of all).

    With h the CRC-32 of the identifier modulo ``most``, conversation c takes the first h turns of
    conversation c - c % ``group`` (all where there are fewer, none where it is unknown), then its own after its first h.
    """
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("of"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("of"), F.col("n").alias("n_of"))
    plan = plan.join(bases, "of", "left").withColumn("taken", F.least("h", F.coalesce("n_of", F.lit(0))))
    plan = materialise(plan, "heads")
    heads = own.filter(F.col("at") < most).select(F.col("conv_id").alias("of"), "at", "digest", "n_bytes")
    head = plan.join(heads, "of").filter(F.col("at") <= F.col("taken")).select("conv_id", "at", "digest", "n_bytes")
    tail = own.join(plan.select("conv_id", "h", "taken"), "conv_id").filter(F.col("at") > F.col("h")).select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "n_bytes")
    members = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return head.unionByName(tail), members


def paths(steps: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each conversation and each of its nodes, the root at depth 0: its key, its parent's, its last turn.

    A key is the exclusive-or of a hash of every turn with its place, so that of any turn is the fold of
    all stretches before its own, and of its own up to it.
    """
    salted = [F.xxhash64(F.lit(salt), "at", "digest") for salt in (17, 71)]
    rows = steps.withColumn("stretch", F.floor((F.col("at") - 1) / STRETCH)).select("*", *(h.alias(f"own{i + 1}") for i, h in enumerate(salted)))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv_id", "stretch").agg(F.bit_xor("own1").alias("w1"), F.bit_xor("own2").alias("w2"))
    starts = whole.select("conv_id", "stretch", *(F.coalesce(F.bit_xor(f"w{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)))
    upto = Window.partitionBy("conv_id", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    folded = rows.join(starts, ["conv_id", "stretch"])
    keys = [F.bit_xor(f"own{i}").over(upto).bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)]
    keyed = folded.select("conv_id", F.col("at").alias("depth"), "digest", "n_bytes", *(k.alias(name) for k, name in zip(keys, KEY, strict=True)), "own1", "own2")
    # the key without the last turn is the parent's
    keyed = keyed.select("conv_id", "depth", "digest", "n_bytes", *KEY, *(F.col(f"key{i}").bitwiseXOR(F.col(f"own{i}")).alias(f"parent{i}") for i in (1, 2)))
    root = members.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(k) for k in KEY), *(F.lit(None).cast("long").alias(k) for k in ("parent1", "parent2")))
    return materialise(keyed.unionByName(root), "paths")


def _merged(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """Rows combined by key in their own partition, then the tables of ``FAN`` partitions at a time until one is left.

    ``sums`` are aggregates that can be taken again over their own results, under the same names.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(rows.inputFiles()))
    out, width = rows.withColumn("part", F.spark_partition_id()), 1
    while width * FAN < parts:
        out, width = out.groupBy(*keys, F.floor(F.col("part") / FAN).alias("part")).agg(*sums), width * FAN
    return out.groupBy(*keys).agg(*sums)


def merge(path_rows: DataFrame) -> DataFrame:
    """The trie's nodes: key, depth, last turn, parent's key, smallest member ``conv_id`` and ``n_convs``."""
    held = [*KEY, "depth", "digest", "n_bytes", "parent1", "parent2"]
    same = F.xxhash64(*held[2:])
    rows = path_rows.select(*held, "conv_id", F.lit(1).cast("long").alias("n_convs"), same.alias("least"), same.alias("most"))
    sums = [F.min(c).alias(c) for c in (*held[2:], "conv_id", "least")] + [F.sum("n_convs").alias("n_convs"), F.max("most").alias("most")]
    nodes = _merged(rows, KEY, *sums)
    sound = F.when(F.col("least") == F.col("most"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two sequences of turns share a key")))
    return nodes.select(*held, "conv_id", sound.alias("n_convs"))


def end_runs(path_rows: DataFrame, members: DataFrame) -> DataFrame:
    """Sorted runs of the conversations that end at a node: key, ``first`` of the run, ``ids`` joined by commas."""
    last = members.select("conv_id", F.col("n_turns").alias("depth"))
    ends = path_rows.join(last, ["conv_id", "depth"]).select(*KEY, "conv_id")
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, out = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pylist([{"key1": k[0], "key2": k[1], "first": ids[0], "ids": ",".join(map(str, ids))} for k, ids in out], schema)
            out.clear()

        schema = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        held = 0
        for batch in batches:
            for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if run and (key != (k1, k2) or len(run) == RUN):
                    out.append((key, run))
                    held, run = held + len(run), []
                    if held >= RUN:
                        yield from flush()
                        held = 0
                key = (k1, k2)
                run.append(c)
        if run:
            out.append((key, run))
        if out:
            yield from flush()

    return dealt.mapInArrow(fold, "key1 long, key2 long, first long, ids string")


def end_digests(runs: DataFrame) -> DataFrame:
    """``ends_sha256`` of every node where a conversation ends, over its runs in order."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (own := (row["key1"], row["key2"])) == key:
                    state.update(b",")
                else:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(row["ids"].encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key1", "key2", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["key1", "key2", "ends_sha256"])

    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "key1 long, key2 long, ends_sha256 string")


def rollup(nodes: DataFrame, path_rows: DataFrame) -> DataFrame:
    """Nodes with ``n_children``, ``n_leaves`` and ``saved_tokens`` of their subtrees, and their parent's ``parent_conv_id``."""
    children = _merged(nodes.filter("parent1 is not null").select("parent1", "parent2", F.lit(1).cast("long").alias("n_children")), ["parent1", "parent2"], F.sum("n_children").alias("n_children"))
    children = children.select(F.col("parent1").alias("key1"), F.col("parent2").alias("key2"), "n_children")
    own = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("saving", (F.col("n_convs") - 1) * F.col("n_bytes"))
    own = materialise(own.withColumn("stretch", F.floor(F.col("depth") / STRETCH)), "trie-nodes")

    chains = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saving").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    chains = materialise(chains, "trie-chains")
    after = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(1, Window.unboundedFollowing)
    deeper = own.groupBy("conv_id", "stretch").agg(F.sum("saving").alias("part")).select("conv_id", "stretch", F.coalesce(F.sum("part").over(after), F.lit(0)).alias("deeper"))
    below = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(0, Window.unboundedFollowing)
    in_chain = own.join(deeper, ["conv_id", "stretch"]).withColumn("in_chain", F.sum("saving").over(below) + F.col("deeper"))

    above = path_rows.join(chains, "conv_id").filter(F.col("depth") < F.col("top")).select(*KEY, F.col("leaves").alias("hung_leaves"), F.col("total").alias("hung"))
    hung = _merged(above, KEY, F.sum("hung_leaves").alias("hung_leaves"), F.sum("hung").alias("hung"))
    summed = in_chain.join(chains.select("conv_id", "leaves", "top"), "conv_id").join(hung, KEY, "left")
    summed = summed.withColumn("n_leaves", F.col("leaves") + F.coalesce("hung_leaves", F.lit(0))).withColumn("saved_tokens", F.col("in_chain") + F.coalesce("hung", F.lit(0)))
    parents = own.select(F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("of"))
    # only the top of a chain has another's node above it
    tops = own.join(chains.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).select("conv_id", "depth", "parent1", "parent2").join(parents, ["parent1", "parent2"]).select("conv_id", "depth", "of")
    out = summed.join(tops, ["conv_id", "depth"], "left")
    return out.withColumn("parent_conv_id", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("of")))


def trie(steps: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node: ``conv_id`` (its smallest member), ``depth``, ``digest`` of its last turn, ``parent_conv_id``, counts, sums and the digest of the conversations that end there."""
    path_rows = paths(steps, members)
    nodes = materialise(merge(path_rows), "trie")
    ends = end_digests(end_runs(path_rows, members))
    out = rollup(nodes, path_rows).join(ends, KEY, "left")
    none = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "digest", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are (``conv_id``, ``turn``, ``role``, ``text``)."""
    own = materialise(turns(conversations), "ranked")
    return trie(own, own.groupBy("conv_id").agg(F.max("at").alias("n_turns")))


def shared_trie(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """The trie of conversations that share their heads, see ``share_heads``."""
    own = materialise(turns(conversations), "ranked")
    steps, members = share_heads(own, group, most)
    return trie(steps, members)


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with ``role`` and ``text`` of their last turn; the root has none."""
    said = conversations.groupBy(digest(F.col("role"), F.col("text")).alias("digest")).agg(F.first(F.coalesce("role", F.lit(""))).alias("role"), F.first(F.coalesce("text", F.lit(""))).alias("text"))
    return nodes.join(said, "digest", "left")
