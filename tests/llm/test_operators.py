"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlow.llm import bpe, decontaminate, exact_dedup, licenses, lm_scoring, ngram_join, pii, quality, range_coder, substring_dedup, token_files
from marlow.llm.store import new_path
from marlow.llm.textnum import chunks

SCHEMA = "doc_id long, text string, name string, n int, digest string, keys array<string>, block int"
WORD = "[^\x20\x09-\x0d]+"


def words_of(text):
    return re.findall(WORD, text or "")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    vocabulary = ["lorem", "Ipsum", "dolor,", "sit", "amet.", "ñandú", "中文", "a", "of", "the", "shall", "x" * 50]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage = make(120), make(60)
    edited = base.split(" ")
    edited[60] = "other"
    far = base.split(" ")
    for k in range(0, 120, 12):
        far[k] = "changed"
    out = [None, "", " \t\n", "one two", "one  two", "ONE two", base, base, base.replace(" ", "\n"), " ".join(edited), " ".join(far), make(40) + " " + passage + " " + make(10), passage, make(30) + " " + passage, make(3000), base.upper(), "a b c d", "a b c d e", "x " * 100, "Mail a.b@mail.example.com, +1 (017) 555-7713, 4111 1111 1111 1111 or 1.2.3.4 1.2.3.400", "it's 'tis <|endoftext|> \xa0 1234　end  "]
    return out + [make(rnd.randint(1, 90)) for _ in range(25)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", i, "d", ["k"], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_exact_dedup(spark, docs, texts, none):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, run_rows=4, fan_in=2).collect()}
    assert len(got) == len(texts)
    for norm, rows in groups.items():
        for _, i in rows:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(rows)[1], len(rows), i == min(rows)[1], hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)
    twice = exact_dedup.exact_dedup(docs.unionByName(docs)).filter("doc_id = 6").collect()
    assert [(r.keep_id, r.group_size) for r in twice] == [(6, 6)] * 2


def shingles(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(texts):
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(sets[i]), find(i), links[i]) for i in range(len(texts))]


def test_ngram_join(spark, docs, texts, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {i: x[:2] for i, x in enumerate(linked(texts))}
    assert ngram_join.ngram_join(none).count() == 0
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_ngram_join_of_a_large_near_group(spark):
    """Copies edited more and less: chains of links, many blocks, small blocks."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            own[rnd.randrange(90)] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(own))
    for n in range(4, 14):  # short sets that differ by one shingle
        texts += [" ".join(f"s{n}-{k}" for k in range(n + 4)), " ".join(f"s{n}-{k}" for k in range(n + 5))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = linked(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(rows, block=8, count_links=True).collect()}
    assert got == dict(enumerate(want))
    for block in (4, 32):  # most links between blocks, or within
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(rows, block=block).collect()}
        assert got == {i: x[:2] for i, x in enumerate(want)}


def test_substring_dedup(spark, docs, texts, none):
    own = [words_of(t) for t in texts]
    count = collections.Counter(tuple(w[k : k + 35]) for w in own for k in range(len(w) - 34))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    for i, w in enumerate(own):
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert substring_dedup.substring_dedup(none).count() == 0


def test_pii_base_spans(spark, docs, texts, none):
    def luhn(s):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0

    more = ["a@b.c_d@e.f", "x@@y.z a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 +2 (3) 456-7890 1", "ñ" * 5 + "q@w.é r@t.io", "7" * 5000, "a" * 20000 + "@", 'token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62"']
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    every = dict(enumerate(texts)) | {1000 + i: t for i, t in enumerate(more)}
    got = {r.doc_id: r for r in pii.digests(pii.find_pii(rows)).collect()}
    for i, t in every.items():
        want = []
        for order, (kind, pattern) in enumerate(pii.BASE_PLAIN.items()):
            for m in re.finditer(pattern, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]():
                    want.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        joined = ",".join(s for _, _, s in sorted(want))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, joined)
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    assert "secret:9:49" in got[1008].spans
    assert pii.find_pii(none).count() == 0


def test_bpe(spark, docs, texts, none, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for bound in (2, 1 << 19):  # a table with no room, and one with room for all
        got = bpe.bpe_decode(bpe.bpe_encode(docs, path, table_words=bound), path).collect()
        assert sorted(bpe.bpe_both(docs, path, table_words=bound).collect(), key=str) == sorted(got, key=str)
        assert {r.doc_id: r.ids for r in got} == want
        assert {r.doc_id: r.decoded for r in got} == {i: tokenizer.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
    assert bpe.bpe_encode(none, path).count() == 0


def test_bpe_words_are_the_tokenizers_own(path):
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    table = bpe.Table(pa.chunked_array([pa.array([b" the"])]), pa.chunked_array([pa.array(own.encode([b" the"]))]))
    rnd = random.Random(1)
    pieces = ["a", "s", "t", "re", "ll", "d", "'", " ", "  ", "\n", "\t", "1", "22", "!", "é", "　", "\xa0", "<|endoftext|>", "<|end", "'s", "'ve", "\U0001f600", "中"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 20))) for _ in range(4000)]
    for first, end, raw, at in chunks(pa.array(texts), 5000):
        ids, rows = bpe.encode_chunk(own, table, raw, at)
        for k in range(end - first):
            assert ids[rows[k] : rows[k + 1]].tolist() == tokenizer.encode(texts[first + k], add_special_tokens=False).ids, texts[first + k]


@pytest.mark.parametrize("ids", [[], [0], [5, 5, 5], list(range(3000)), [1 << 19] * 10, [7, 8, 9] * 5000])
def test_range_coder_round_trip(ids):
    block = range_coder.encode_block(np.array(ids, np.int64))
    assert range_coder.decode_block(block).tolist() == ids
    if ids:
        broken = bytearray(block)
        broken[-1] ^= 1
        with pytest.raises(ValueError, match="block|checksum"):
            range_coder.decode_block(bytes(broken))


def test_token_files(spark, docs, texts, none, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = new_path(spark, "test-tokens")
    token_files.write_tokens(docs, out, path, end_id=2)
    got = sorted(token_files.read_tokens(spark, out).collect())
    start = 0
    assert len(got) == len(texts)
    for r, (i, t) in zip(got, enumerate(texts), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    empty = new_path(spark, "test-tokens")
    token_files.write_tokens(none, empty, path, end_id=2)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_decontaminate_edits(spark, docs, none):
    item = "The quick brown fox jumps over the lazy dog while seventeen other animals look on in plain surprise."
    near = item.replace("jumps", "jumped").replace("lazy", "lasy")
    far = item.replace("brown fox jumps over the lazy", "red cat sits under that busy")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"before {item} after"), (2, near.upper()), (3, far), (4, None), (5, "x " * 5000 + item.replace(" ", "\n\n")), (6, item[:50])], "doc_id long, text string")
    got = {r.doc_id: [(h.item_id, h.edits) for h in r.hits] for r in decontaminate.find_leaks(rows, items).collect()}
    assert got == {1: [(1, 0)], 2: [(1, 3)], 3: [], 4: [], 5: [(1, 0)], 6: []}
    assert {r.doc_id for r in decontaminate.keep_clean(rows, items).collect()} == {3, 4, 6}
    assert {r.doc_id: len(r.hits) for r in decontaminate.find_leaks(rows, items, block_chars=40).collect()} == {k: len(v) for k, v in got.items()}
    assert decontaminate.find_leaks(docs, items).count() == docs.count()
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(rows, items.limit(0)).filter("size(hits) > 0").count() == 0


def test_quality_learns_held_out_labels(spark, none):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "river", "ran", "over", "stones.", "And", "people", "came,", "late"]) for _ in range(rnd.randint(5, 300)))
    bad = lambda: " ".join(rnd.choice(["the***", "RIVER!!", "|", "a%%%", "$$$"]) for _ in range(rnd.randint(5, 300)))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)] + [(9000, None), (9001, ""), (9002, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)] + [(5, 1), (None, 1), (7, None), (10**9, 0)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.classify(docs, net).collect()}
    assert len(got) == 603
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 4 > 0) for i in held) >= 0.97 * len(held)
    assert quality.keep_good(docs, net).columns == docs.columns
    assert quality.classify(none, net).count() == 0
    alone = quality.train(docs, labels.filter("quality = 1"))
    assert quality.classify(docs, alone).filter("predicted = 1").count() == 603
    assert quality.classify(docs, quality.train(docs, labels.limit(0))).filter("abs(score - 0.5) < 1e-9").count() == 603


def test_lm_scoring(spark, docs, texts, none, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 8)  # most words meet their counts in the join
    own = {i: [*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 0] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in own}
    count = collections.Counter(w for i, ws in own.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm_scoring.score_all(docs).collect()}
    assert len(got) == len(texts)
    for i, ws in own.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score < 0
    assert lm_scoring.score_all(none).count() == 0


def test_licenses(spark, none):
    lines = {
        1: ["apache"], 2: ["gpl"], 3: ["cc"], 4: ["mit"], 5: [], 6: [], 7: [], 8: ["apache", "gpl"],
    }
    text = {
        1: "Some text.\nLicensed under the Apache License, Version 2.0.", 2: "This work is licensed under the GNU General Public License, version 3.\nMore.", 3: "Licensed under CC BY-NC 4.0.",
        4: "Released under the MIT License.", 5: None, 6: "Ein Satz mit Worten.", 7: "The driver renewed the license of the old car last week.",
        8: "Licensed under the Apache License, Version 2.0.\nYou should have received a copy of the GNU General Public License along with this program.",
    }
    rows = spark.createDataFrame(list(text.items()), "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scan_documents(rows).collect()}
    assert {k: r.families for k, r in got.items()} == lines
    assert got[8].n_notices == 2
    assert licenses.scan_documents(none).count() == 0


def test_licenses_wrapped_at_any_width(spark):
    """A notice keeps its family however its lines are broken, in comments too, and counts once."""
    notices = {
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    }
    rows = []
    for family, notice in notices.items():
        for width in (24, 40, 72, 400):
            for mark in ("", " * ", "# ", "// "):
                wrapped = "\n".join(mark + s for s in textwrap.wrap(notice, width))
                rows += [(len(rows), family, wrapped), (len(rows) + 1, family, f"{mark}The river ran over stones.\n{wrapped}\n{mark}And people came late.")]
    docs = spark.createDataFrame(rows, "doc_id long, family string, text string")
    got = {r.doc_id: (r.families, r.n_notices) for r in licenses.scan_documents(docs).collect()}
    assert got == {i: ([family], 1) for i, family, _ in rows}


def test_licenses_by_name_alone(spark):
    """Short notices count, capitalised prose in a language with the word does not."""
    named = {"MIT": ["mit"], "BSD-3-Clause": ["bsd"], "GNU GPL v3 or later": ["gpl"], "CC BY 4.0": ["cc"], "CC0": ["cc"], "MIT License": ["mit"], "GNU software by Ann": ["unknown"]}
    prose = ["DIE STADT MIT DEM FLUSS.", "MIT IHM GING ER.", "SIE WAR MIT DER ARBEIT FERTIG UND GING.", "DIE!! MIT!! UND!! DEM!! ENUNG!!"]
    docs = spark.createDataFrame(list(enumerate([*named, *prose])), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.scan_documents(docs).collect()}
    assert got == dict(enumerate([*named.values(), *[[]] * len(prose)]))
