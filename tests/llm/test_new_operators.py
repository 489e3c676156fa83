"""Vector codes, the prefix trie and language identification against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlow.llm import language_id, prefix_trie, vector_codes


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# vector codes


def coded(rows, parts=8, entries=16, rounds=6):
    """Codes with Python integers."""
    sound = [(i, v, x) for i, v, x in rows if v and len(v) % parts == 0 and all(c is not None and math.isfinite(c) and abs(c) < 2**50 for c in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not sound:
        return {}, ""
    dims = len(sound[0][1])
    sound = [r for r in sound if len(r[1]) == dims]
    d = dims // parts
    ints = [[math.floor(4096 * c) for c in v] for _, v, _ in sound]
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(p, v[p])[1] for v in cut]
            books[p] = [[sum(v[p][j] for v, o in zip(cut, own, strict=True) if o == e) // own.count(e) for j in range(d)] if e in own else c for e, c in enumerate(books[p])]
    found, by_label = [], {}
    for (i, _, label), v in zip(sound, cut, strict=True):
        near = [nearest(p, v[p]) for p in range(parts)]
        error = sum(e for e, _ in near)
        by_label[label] = by_label.get(label, 0) + error
        found.append((i, "".join(f"{e:02x}" for _, e in near), error, label))
    return sorted(((i, c, e, by_label[x]) for i, c, e, x in found), key=str), sha(",".join(str(c) for b in books for e in b for c in e))


def vectors(seed, n, dims):
    rnd = random.Random(seed)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(dims)], rnd.choice([None, 1, 2])) for i in rnd.sample(range(-50, 400), n)]
    same = rows[0][1]
    return [*rows, *((500 + k, same, 7) for k in range(n // 2)), (None, same, None), (3000, None, 1), (3001, [], 1), (3002, [*same[:-1], None], 1), (3003, [*same[:-1], float("nan")], 1), (3004, [*same[:-1], float("-inf")], 1), (3005, [*same, 1.0], 1), (3006, same + same, 2)]


@pytest.mark.parametrize(("seed", "n", "dims"), [(1, 60, 16), (2, 9, 8), (3, 120, 32)])
def test_vector_codes(spark, seed, n, dims):
    rows = vectors(seed, n, dims)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    want, digest = coded(rows)
    got = vector_codes.compress(table).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_vector_codes_of_large_components_and_of_none(spark):
    rows = [(i, [float((-1) ** i * 3 ** (i + k)) for k in range(8)], 1) for i in range(24)] + [(99, [2.0**51] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, digest = coded(rows, rounds=3)
    got = vector_codes.compress(table, rounds=3).collect()
    capped = sorted(((r.vec_id, r.code, r.error) for r in got), key=str)
    assert capped == [(i, c, min(e, (1 << 63) - 1)) for i, c, e, _ in want]
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert vector_codes.compress(table.limit(0)).collect() == []
    assert vector_codes.compress(table.filter("vec_id = 99")).collect() == []


def test_vector_codes_decode(spark):
    table = spark.createDataFrame(vectors(5, 40, 16), "vec_id long, embedding array<double>, label int")
    kept = vector_codes.kept_vectors(table, "vec_id", "embedding", "label", 8)
    books = vector_codes.train(kept)
    both = vector_codes.decode(vector_codes.encode(kept, books), books).join(kept.withColumnRenamed("vector", "was"), "vec_id").collect()
    for r in both:
        assert r.error == sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(r.was, r.vector, strict=True))


# prefix trie


def trie_of(convs):
    """Nodes of {conversation: [(role, text)]} by walking every prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    parents = {p[:-1] for p in members if p}
    saving = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in members.items()}
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(q[:-1] == p for q in members if q), sum(q not in parents for q in below[p]), sum(saving[q] for q in below[p]), sha(ends)))
    return sorted(out, key=str)


def in_order(rows):
    """{conversation: turns} of rows as the operator orders them."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def nodes(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def talk(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(-7, 40), 1000, 10**12]:
        for turn in range(rnd.randrange(12)):
            rows.append((c, rnd.choice([None, 0, 1]) if rnd.random() < 0.1 else turn, rnd.choice(["user", "user", None]), rnd.choice(["ja", "né", "x" * 40, None, ""])))
    rows += [(c, 0, "user", "hello") for c in range(2000, 2040)] + [(3, 2, "user", "again")] * 5 + [(None, 0, "user", "lost")] * 3
    return rows


@pytest.fixture(params=[1, 2])
def spoken(spark, request):
    rows = talk(request.param)
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, at string").repartition(5)


@pytest.mark.parametrize("sizes", [(prefix_trie.FAN, prefix_trie.STRETCH, prefix_trie.RUN), (2, 3, 2)])
def test_prefix_trie(spoken, monkeypatch, sizes):
    for name, value in zip(("FAN", "STRETCH", "RUN"), sizes, strict=True):
        monkeypatch.setattr(prefix_trie, name, value)
    rows, table = spoken
    own = in_order(rows)
    assert nodes(prefix_trie.prefix_trie(table)) == trie_of(own)
    assert nodes(prefix_trie.shared_trie(table)) == trie_of(rebuilt(own))


def test_prefix_trie_of_one_long_conversation_and_of_none(spark, monkeypatch):
    """A conversation of 3000 turns beside copies of its start; then no conversation at all."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 100)
    rows = [(1, k, "user", f"turn {k}") for k in range(3000)] + [(c, k, "user", f"turn {k}") for c in range(2, 30) for k in range(c)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = nodes(prefix_trie.prefix_trie(table))
    assert len(got) == 3001
    deep = {r[1]: r for r in got}
    assert deep[0][3:6] == (29, 1, 1) and deep[3000][3:7] == (1, 0, 1, 0)
    assert deep[0][6] == sum((28 - max(0, d - 2)) * len(f"turn {d - 1}") for d in range(1, 30))
    assert deep[5][7] == sha("5") and deep[30][7] == sha("")
    assert prefix_trie.prefix_trie(table.limit(0)).collect() == []
    assert prefix_trie.shared_trie(table.limit(0)).collect() == []


def test_prefix_trie_texts(spoken):
    rows, table = spoken
    said = {(r.depth, r.conv_id): (r.role, r.text) for r in prefix_trie.with_turns(prefix_trie.prefix_trie(table), table).collect()}
    for c, turns in in_order(rows).items():
        for d in range(1, len(turns) + 1):
            if (d, c) in said:
                assert said[d, c] == turns[d - 1]


# language identification


def spellings(unit, odds):
    """The summed probability of all segmentations, by trying each."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(unit)]
        total += math.prod(odds.get(unit[a:b], 0.0) for a, b in itertools.pairwise(at))
    return total


def test_forward_and_expected_against_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"abc", b"bc", b" a", b"cab", b"abcabcabc", b"bcabcabcab"}, key=lambda p: (len(p), p))
    own = language_id.Pieces(pieces)
    rng = np.random.default_rng(3)
    weights = np.vstack([rng.random((len(pieces), 2)) * 0.4, np.zeros(2)])
    words = [b" abc", b" abcabc", b" cab", b" a", b"x", b" abcabcabcab", b"bcabcabcabc"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    units = language_id.Units(raw, (ends - [len(w) for w in words])[order], ends[order], own)
    got = units.forward(weights)
    language, times = np.array([i % 2 for i in order]), np.arange(1, len(words) + 1)
    counts = units.expected(weights, language, times)
    want = np.zeros_like(counts)
    for k, i in enumerate(order):
        for lang in (0, 1):
            odds = {p: weights[j, lang] for j, p in enumerate(pieces)}
            assert got[k, lang] == pytest.approx(spellings(words[i], odds))
        odds = {p: weights[j, language[k]] for j, p in enumerate(pieces)}
        for j, p in enumerate(pieces):  # the derivative of the log probability, by doubling one piece's own odds
            if p in words[i]:
                step = 1e-6
                up = spellings(words[i], odds | {p: odds[p] * (1 + step)})
                want[j, language[k]] += times[k] * (up / spellings(words[i], odds) - 1) / step
    assert counts == pytest.approx(want, rel=1e-3, abs=1e-4)


@pytest.fixture(scope="module")
def pieces_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_multi_50k.tiktoken")


SYLLABLES = {"aa": "ka to ri mé nu sa".split(), "bb": "st ung ver keit ö ein".split(), "cc": "ción el ado qu ía ar".split()}


def speech(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken_docs(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        lang = rnd.choice(list(SYLLABLES))
        rows.append((i, speech(rnd, lang, rnd.randint(3, 60)).title() + " 123 #!", lang))
    odd = [(9000, None, "aa"), (9001, "", "bb"), (9002, "12 34 !?", "cc"), (None, speech(rnd, "bb", 40), "bb"), (None, None, None), (9004, speech(rnd, "cc", 5) * 20_000, "cc"), (9005, "ungverkeit" * 30_000, None)]
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows + odd + [rows[0]] * 20], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4).cache()


def test_language_id_held_out(spoken_docs, pieces_path):
    model = language_id.train(spoken_docs, pieces_path)
    got = language_id.predict(spoken_docs, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    said = spoken_docs.select("doc_id", "lang", F.col("text").rlike(r"\p{L}").alias("spoken")).dropDuplicates(["doc_id"])
    rows = got.join(said, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert r.spoken or (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in rows if r.held_out and r.spoken and r.lang]
    assert len(held) > 120
    for lang in SYLLABLES:  # a constant answer would fail here
        own = [r.lang_pred for r in held if r.lang == lang]
        assert own.count(lang) >= 0.97 * len(own) > 20
    assert {r.lang_pred for r in rows if r.doc_id == 9005} == {"bb"}
    assert got.count() == spoken_docs.count()


def test_language_id_learns_nothing_from_what_it_may_not(spoken_docs, pieces_path):
    """Other languages, sources and texts of held-out rows leave the model as it is; so does the order of rows."""
    held = language_id.held_out(F.col("doc_id"), 3, 1)
    other = spoken_docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("text", F.when(held, F.reverse("text")).otherwise(F.col("text"))).repartition(7)
    a, b = (language_id.train(x, pieces_path) for x in (spoken_docs, other))
    assert a.languages == b.languages == sorted(SYLLABLES)
    assert np.allclose(a.weights, b.weights, atol=1e-7)


def test_language_id_samples_by_a_stated_bound(spoken_docs, pieces_path):
    model = language_id.train(spoken_docs, pieces_path, train_docs=40)
    rows = language_id.predict(spoken_docs.filter("doc_id < 600"), model).join(spoken_docs.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_id_without_languages(spark, spoken_docs, pieces_path):
    assert language_id.train(spoken_docs.limit(0), pieces_path) is None
    none = language_id.predict(spoken_docs, language_id.train(spoken_docs.withColumn("lang", F.lit(None).cast("string")), pieces_path))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    model = language_id.train(spoken_docs, pieces_path)
    assert language_id.predict(spoken_docs.limit(0), model).collect() == []


def test_vocabulary_is_all_of_the_file(spark, pieces_path):
    own = language_id.vocabulary(spark, pieces_path)
    assert len(own) > 50_000 and os.path.getsize(pieces_path) > 0
    assert max(map(len, own)) <= language_id.PIECE
