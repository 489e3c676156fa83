"""Graph operators over edge tables (child, parent): recursion by doubling.

Edges are written once, so their columns are plain ones, and each round's pairs are written too; a
round joins pairs with pairs, which doubles the length that they span, so a chain of n nodes takes
log2(n) rounds. Every loop runs to its fixpoint. Where ways are counted by length, a cycle would make
them endless: that raises ``CycleError``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import discard, materialise


class CycleError(ValueError):
    """The edges have a cycle, so lengths have no bound."""


def _edges(edges: DataFrame) -> DataFrame:
    return materialise(edges.select("child", "parent").filter("child is not null and parent is not null").distinct(), "graph-edges")


def _longest_way(edges: DataFrame) -> int:
    """More edges than any way without a cycle has: the number of distinct nodes."""
    return edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct().count()


def walk_up(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): every node above each start, once for each length of a way to it; the start has depth 0.

    ``edges``: child, parent; ``starts``: start.
    """
    edges = _edges(edges)
    bound, span = _longest_way(edges), 1
    reach = materialise(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "ways")
    hop = edges  # the pairs exactly ``span`` edges apart
    while not hop.isEmpty():
        if span > bound:
            raise CycleError("a way up never ends")
        on = reach.join(hop, reach["node"] == hop["child"]).select("start", F.col("parent").alias("node"), (F.col("depth") + span).alias("depth"))
        longer, old = materialise(reach.unionByName(on).distinct(), "ways"), reach
        further, passed = materialise(_chained(hop, hop).distinct(), "hops"), hop
        discard(old)
        discard(passed)
        reach, hop, span = longer, further, span * 2
    return reach


def paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, path, cyclic): every way up from each start as an array of nodes, and whether it comes back to a node of its own, where it ends."""
    edges = _edges(edges)
    open_ways = starts.select("start", F.array("start").alias("path"), F.lit(False).alias("cyclic")).distinct()
    rounds = []
    while True:
        rounds.append(materialise(open_ways, "paths"))
        going = rounds[-1].filter("not cyclic")
        if going.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        on = going.join(edges, F.element_at("path", -1) == F.col("child"))
        open_ways = on.select("start", F.array_append("path", F.col("parent")).alias("path"), F.array_contains("path", F.col("parent")).alias("cyclic"))


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth): the longest way down to each node from a root, a row whose parent is null.

    Where every node has one parent, pointers to the parent jump twice as far each round. Else each
    level is a join of the nodes on it, once each, with the edges, and there are as many as levels.
    Nodes that no root leads to have no row.
    """
    own = materialise(edges.select("child", "parent").filter("child is not null").distinct(), "graph-edges")
    if own.groupBy("child").count().filter("count > 1").isEmpty():
        return _forest_depths(own)
    down = own.filter("parent is not null")
    bound, level = _longest_way(down), 0
    fronts = [materialise(own.filter("parent is null").select(F.col("child").alias("node"), F.lit(0).alias("depth")), "level")]
    while not fronts[-1].isEmpty():
        if level > bound:
            raise CycleError("a root leads to a cycle")
        level += 1
        fronts.append(materialise(down.join(fronts[-1], down["parent"] == fronts[-1]["node"]).select(F.col("child").alias("node"), F.lit(level).alias("depth")).distinct(), "level"))
    return reduce(DataFrame.unionByName, fronts).groupBy("node").agg(F.max("depth").alias("depth"))


def _forest_depths(own: DataFrame) -> DataFrame:
    jump = materialise(own.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("depth")), "jumps")
    before, going = -1, jump.filter("up is not null").count()
    while going and going != before:  # nodes on a cycle, and those below it, go on without an end
        further, old = materialise(_jumped(_jumped(jump)), "jumps"), jump
        discard(old)
        jump = further
        before, going = going, jump.filter("up is not null").count()
    return jump.filter("up is null").select("node", "depth")


def _jumped(jump: DataFrame) -> DataFrame:
    """Each pointer on to where its target points."""
    above = jump.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
    on = jump.filter("up is not null").join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
    return jump.filter("up is null").unionByName(on)


def child_counts(edges: DataFrame) -> DataFrame:
    """(parent, child_count): distinct direct children of every parent."""
    return edges.filter("parent is not null").groupBy(F.col("parent")).agg(F.countDistinct("child").cast("int").alias("child_count"))


def closure(edges: DataFrame) -> DataFrame:
    """(child, parent): every node with every node above it, once each; cycles end too, with a node above itself."""
    reach = _edges(edges)
    hop, n, now = reach, -1, reach.count()
    while now != n:
        twice = _chained(hop, hop).distinct()
        near = reach.unionByName(_chained(reach, hop)).distinct()
        reach, hop = materialise(near.unionByName(_chained(near, twice)).distinct(), "closure"), materialise(_chained(twice, twice).distinct(), "hops")
        n, now = now, reach.count()
    return reach


def _chained(low: DataFrame, high: DataFrame) -> DataFrame:
    """Pairs over a node in between."""
    return low.select("child", F.col("parent").alias("middle")).join(high.select(F.col("child").alias("middle"), "parent"), "middle").select("child", "parent")


def closure_counts(edges: DataFrame) -> DataFrame:
    """(parent, child_count): distinct descendants of every parent, at any depth."""
    return closure(edges).groupBy("parent").agg(F.count(F.lit(1)).cast("int").alias("child_count"))


def _rings(edges: DataFrame) -> DataFrame:
    """(child, parent, ring): the edges on a cycle, with the least node that they are on a cycle with."""
    left = _edges(edges)
    size, now = -1, left.count()
    while now and now != size:  # peel nodes without a way in or out for as long as that takes a quarter of the edges
        parents, children = left.select(F.col("parent").alias("child")).distinct(), left.select(F.col("child").alias("parent")).distinct()
        left = materialise(left.join(parents, "child", "left_semi").join(children, "parent", "left_semi").select("child", "parent"), "peeled")
        size, now = now, left.count()
        if 4 * now > 3 * size:
            break
    if not now:
        return left.withColumn("ring", F.col("child"))
    above = closure(left)
    mutual = above.join(above.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"], "left_semi")
    ring = mutual.groupBy("child").agg(F.min("parent").alias("ring"))
    return left.join(mutual, ["child", "parent"], "left_semi").join(ring, "child").select("child", "parent", "ring")


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges that lie on a cycle."""
    return _rings(edges).select("child", "parent")


def break_cycles(edges: DataFrame, age: str) -> DataFrame:
    """Edges without cycles: of the cyclic ones, the one with the least ``age`` goes, again and again.

    Cycles that share no node don't touch each other's order, so each set of nodes that reach one
    another loses an edge a round. Cycles that are left lie among the edges that were on one before.
    """
    left = edges = materialise(edges, "dated-edges")
    gone = []
    while True:
        bad = materialise(_rings(left), "rings")
        if bad.isEmpty():
            return edges.join(reduce(DataFrame.unionByName, gone), ["child", "parent"], "left_anti") if gone else edges
        dated = left.join(bad, ["child", "parent"])
        first = F.struct(F.col(age).isNull(), F.col(age), "child", "parent")
        gone.append(materialise(dated.groupBy("ring").agg(F.min(first).alias("x")).select("x.child", "x.parent"), "broken"))
        left = materialise(dated.drop("ring").join(gone[-1], ["child", "parent"], "left_anti"), "dated-edges")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): the starts and all that they lead to. ``edges``: a, b; ``starts``: node.

    A round joins the nodes last found with the edges, so the work is that of what is found.
    """
    seen = front = materialise(starts.select("node").distinct(), "reached")
    while not front.isEmpty():
        further = edges.join(front, edges["a"] == front["node"]).select(F.col("b").alias("node")).distinct()
        front = materialise(further.join(seen, "node", "left_anti"), "front")
        seen = seen.unionByName(front)
    return materialise(seen, "reached")


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    """The node and all it links to or is linked from, once each. ``edges``: source, target."""
    out = edges.filter(F.col("source") == node).select(F.col("target").alias("node"))
    into = edges.filter(F.col("target") == node).select(F.col("source").alias("node"))
    own = edges.sparkSession.range(1).select(F.lit(node).cast("long").alias("node"))
    return own.unionAll(out).unionAll(into).distinct()


def link_weights(edges: DataFrame, members: DataFrame) -> DataFrame:
    """For each member: its links to other members with their counts, and the weight of links into it."""
    inner = edges.join(members.select(F.col("node").alias("source")), "source").join(members.select(F.col("node").alias("target")), "target")
    links = inner.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    out = links.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_targets"), F.sum("weight").alias("weight_out"))
    into = links.groupBy(F.col("target").alias("node")).agg(F.sum("weight").alias("weight_in"))
    zero = F.lit(0).cast("long")
    return members.join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("n_targets", zero).alias("n_targets"), F.coalesce("weight_out", zero).alias("weight_out"), F.coalesce("weight_in", zero).alias("weight_in"))
