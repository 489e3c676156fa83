"""Marked hits against a plain reading of each text."""

from __future__ import annotations

import random
import re

from marlow.operators import highlight
from marlow.operators.text import MARK

A, B = MARK


def test_clauses():
    assert highlight.clauses('Ships "the Port of" tol* the') == [[("stem", "ships")], [("term", "the"), ("term", "port"), ("term", "of")], [("start", "tol")]]
    assert highlight.clauses('the "" *') == []


MARKS = [
    ("ship", "A Ship, two ships; shipping? hardship", f"A {A}Ship{B}, two {A}ships{B}; {A}shipping{B}? hardship"),
    ("tol*", "toll tolls, atoll TOLLED", f"{A}toll{B} {A}tolls{B}, atoll {A}TOLLED{B}"),
    ('"port dues"', "port, dues port  dues duesport dues", f"{A}port, dues{B} {A}port  dues{B} duesport dues"),
    ('"a b" "b c" c', "a b c a b, b c", f"{A}a b c{B} {A}a b{B}, {A}b c{B}"),  # overlapping ones are one
    ('"a a"', "a a a b a", f"{A}a a a{B} b a"),
    ("ship", "\U0001f600 ship é\U00010400 ships", f"\U0001f600 {A}ship{B} é\U00010400 {A}ships{B}"),  # beyond the basic plane
    ("ship", "", ""), ("ship", None, None), ("the", "the ship", "the ship"), ("ship", " -- ", " -- "),
]


def test_marks(spark):
    for query in sorted({q for q, _, _ in MARKS}):
        own = [(i, t, want) for i, (q, t, want) in enumerate(MARKS) if q == query]
        docs = spark.createDataFrame([(i, t) for i, t, _ in own], "id long, t string")
        got = highlight.marked(docs, "id", "t", highlight.spans(highlight.offsets(docs, "id", "t"), query)).collect()
        assert {r.id: r.marked for r in got} == {i: want for i, _, want in own}


def plain_spans(text, phrases):
    words = [(m[0].lower(), *m.span()) for m in re.finditer(r"\w+", text)]
    hits = sorted((words[i][1], words[i + len(p) - 1][2]) for p in phrases for i in range(len(words) - len(p) + 1) if all(words[i + k][0] == w for k, w in enumerate(p)))
    out = []
    for a, b in hits:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def plain_fragments(text, spans, number, size):
    tiles = {}
    for a, b in spans:
        tiles.setdefault(a // size, []).append((a, b))
    out = []
    for tile in sorted(tiles, key=lambda k: (-len(tiles[k]), k))[:number]:
        at, end = tile * size, max(tile * size + size, tiles[tile][-1][1])
        while at and re.match(r"\w", text[at - 1]) and at < end and re.match(r"\w", text[at]):
            at += 1
        said = ""
        for a, b in tiles[tile]:
            said, at = said + text[at:a] + A + text[a:b] + B, b
        out.append((tile, said + text[at:end]))
    return out or [(0, text[:size])]


def test_random_texts_and_long_ones(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice(["a", "b", "ab", "B"]) + dice.choice([" ", ", ", " - "]) for _ in range(dice.randrange(40))) for _ in range(60)] + ["x a b " * 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = highlight.spans(highlight.offsets(docs, "id", "t"), '"a b" "b a" "ab"').cache()
    phrases = [("a", "b"), ("b", "a"), ("ab",)]
    want = {i: plain_spans(t, phrases) for i, t in enumerate(texts)}
    got = {}
    for r in found.orderBy("id", "start").collect():
        got.setdefault(r.id, []).append([r.start, r.stop])
    assert got == {i: s for i, s in want.items() if s}
    rows = {}
    for r in highlight.fragments(docs, "id", "t", found, number=3, size=11).collect():
        rows.setdefault(r.id, []).append((r.tile, r.fragment))
    assert {i: sorted(f) for i, f in rows.items()} == {i: sorted(plain_fragments(t, want[i], 3, 11)) for i, t in enumerate(texts)}


def test_an_index_of_documents_shuffles_no_words(spark):
    from marlow.operators import index

    docs = spark.createDataFrame([(1, "red ring red"), (2, "ring")], "id long, title string")
    built = index.build(docs, "id", {"title": ["simple"]})
    assert built._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.term, r.id, r.tf, r.length, r.places) for r in built.collect()) == [("red", 1, 2, 3, [0, 2]), ("ring", 1, 1, 3, [1]), ("ring", 2, 1, 1, [0])]
