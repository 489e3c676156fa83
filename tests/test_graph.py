"""Graph operators on chains, forks and cycles, against plain Python."""

from __future__ import annotations

import random

import pytest

from marlow.operators import graph


def table(spark, edges, schema="child long, parent long"):
    return spark.createDataFrame(edges, schema)


def test_depths_of_a_long_chain(spark):
    edges = [(0, None)] + [(k, k - 1) for k in range(1, 500)] + [(900, 901), (901, 900), (950, 999)]
    got = dict(graph.depths(table(spark, edges)).collect())
    assert got == {k: k for k in range(500)}  # neither the cycle nor what hangs on no row
    assert graph.closure_counts(table(spark, edges[:40])).filter("parent = 0").first().child_count == 39


def test_depths_where_ways_meet(spark):
    edges = [(1, None), (2, 1), (3, 1), (3, 2), (4, 3), (4, 1), (4, 4)]
    with pytest.raises(graph.CycleError):
        graph.depths(table(spark, edges))
    assert dict(graph.depths(table(spark, edges[:-1])).collect()) == {1: 0, 2: 1, 3: 2, 4: 3}


def test_walk_up(spark):
    edges = table(spark, [(1, None), (2, 1), (3, 1), (3, 2), (4, 3), (4, 3)])
    starts = table(spark, [(4,), (9,)], "start long")
    assert sorted(graph.walk_up(edges, starts).collect()) == [(4, 1, 2), (4, 1, 3), (4, 2, 2), (4, 3, 1), (4, 4, 0), (9, 9, 0)]
    with pytest.raises(graph.CycleError):
        graph.walk_up(table(spark, [(1, 2), (2, 1)]), starts)
    assert graph.walk_up(table(spark, []), starts).count() == 2


def brute(edges, age):
    edges = dict(edges)
    while True:
        def reach(x):
            seen, todo = set(), [x]
            while todo:
                y = todo.pop()
                for c, p in edges:
                    if c == y and p not in seen:
                        seen.add(p)
                        todo.append(p)
            return seen

        bad = [(edges[e], *e) for e in edges if e[0] in reach(e[1]) or e[0] == e[1]]
        if not bad:
            return set(edges)
        del edges[min(bad)[1:]]


def test_cycles_against_brute_force(spark):
    rnd = random.Random(3)
    edges = {(rnd.randrange(10), rnd.randrange(10)): rnd.randrange(5) for _ in range(16)} | {(20 + k, 21 + k): 1 for k in range(5)}
    rows = table(spark, [(c, p, a) for (c, p), a in edges.items()], "child long, parent long, age int")
    assert {(r.child, r.parent) for r in graph.break_cycles(rows, "age").collect()} == brute(edges, "age")
    bridge = table(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)])  # an edge from a cycle to a cycle is on none
    assert sorted(graph.cyclic_edges(bridge).collect()) == [(1, 2), (2, 1), (3, 4), (4, 3)]


def test_trees_under_cycles_are_peeled_before_ways_are_paired(spark, monkeypatch):
    edges = [(k, k // 2) for k in range(8, 512)] + [(a, b) for k in range(4, 8) for a, b in ((k, k + 10000), (k + 10000, k))]
    sizes, closure = [], graph.closure
    monkeypatch.setattr(graph, "closure", lambda e: sizes.append(e.count()) or closure(e))
    rows = table(spark, [(c, p, c) for c, p in edges], "child long, parent long, age int")
    left = {(r.child, r.parent) for r in graph.break_cycles(rows, "age").collect()}
    assert left == set(edges) - {(k, k + 10000) for k in range(4, 8)}
    assert len(sizes) == 1 and sizes[0] < 60  # of 512 edges, and not again once the cycles are gone
