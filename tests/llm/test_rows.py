"""Null, repeated and clashing identifiers through all operators and stages, and words made to collide."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlow.llm import bpe, decontaminate, exact_dedup, licenses, lm_scoring, ngram_join, pii, quality, substring_dedup, token_files
from marlow.llm.expressions import sums_before
from marlow.llm.store import ROW, new_path, rows

from .test_operators import linked, words_of

NOTICE = "Released under the MIT License."
ITEM = "The quick brown fox jumps over the lazy dog while seventeen other animals look on in plain surprise."


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(4)
    make = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet of the in stone river".split()) + str(rnd.randrange(30)) for _ in range(n))
    base, passage = make(60), make(40)
    near = base.replace(base.split(" ")[30], "other")
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    return [
        (None, base), (None, base), (1, near), (1, passage + " " + make(9)), (1, passage + " " + make(9)), (2, make(20)), (2, make(20)), (None, make(30)), (None, passage), (3, None), (None, None), (None, ""),
        (4, f"{ITEM} {NOTICE}"), (4, f"{ITEM} {NOTICE}"), (None, NOTICE), (5, f"{make(4)}\n{NOTICE}"), (6, a), (6, b), (7, " ".join([a] * 40)), (7, " ".join([b] * 40)), (None, "a.b@mail.example.com"), (None, "a.b@mail.example.com"),
    ]


@pytest.fixture(scope="module")
def docs(spark, table):
    rows = [(i, t, "clash", 1, "row") for i, t in table]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, block int, row string").repartition(3).cache()


def bag(rows):
    return collections.Counter(rows)


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def test_ngram_join(docs, table):
    texts = [t for _, t in table]
    found = linked(texts)
    groups = collections.defaultdict(list)
    for (i, _), (_, root, _) in zip(table, found, strict=True):
        groups[root].append(i)
    want = bag((i, n, least(groups[root]), links) for (i, _), (n, root, links) in zip(table, found, strict=True))
    assert bag(tuple(r) for r in ngram_join.ngram_join(docs, count_links=True).collect()) == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert bag(r.doc_id for r in kept.collect()) == bag(least(v) for v in groups.values())


def test_bpe_and_token_files(spark, docs, table):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = [tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in table]
    got = bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()
    assert bag((r.doc_id, tuple(r.ids), r.decoded) for r in got) == bag((i, x, t or "") for (i, t), x in zip(table, ids, strict=True))
    out = new_path(spark, "test-tokens")
    token_files.write_tokens(docs, out, path, end_id=2)
    back = sorted(token_files.read_tokens(spark, out).collect(), key=lambda r: r.start)
    assert bag((r.doc_id, tuple(r.ids)) for r in back) == bag((i, (*x, 2)) for (i, _), x in zip(table, ids, strict=True))
    assert [r.doc_id for r in back] == sorted((i for i, _ in table), key=lambda i: -1 if i is None else i)
    assert [r.start for r in back] == [sum(r.n_tokens for r in back[:k]) for k in range(len(back))]


@pytest.mark.parametrize("block_chars", [1 << 22, 40])
def test_decontaminate(spark, docs, table, block_chars):
    items = spark.createDataFrame([(1, ITEM), (2, ITEM.replace("quick", "slow")), (None, None)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items, block_chars=block_chars).collect()
    assert bag((r.doc_id, tuple(sorted(h.item_id for h in r.hits))) for r in got) == bag((i, (1, 2) if ITEM in (t or "") else ()) for i, t in table)
    kept = decontaminate.keep_clean(docs, items, block_chars=block_chars)
    assert kept.columns == docs.columns
    assert bag((r.doc_id, r.text) for r in kept.collect()) == bag((i, t) for i, t in table if ITEM not in (t or ""))


def test_substring_dedup(docs, table):
    own = [words_of(t) for _, t in table]
    count = collections.Counter(tuple(w[k : k + 35]) for w in own for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(table, own, strict=True):
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert bag(tuple(r) for r in substring_dedup.substring_dedup(docs).collect()) == bag(want)


def test_exact_dedup(docs, table):
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in table]
    groups = collections.defaultdict(list)
    for (i, t), x in zip(table, norm, strict=True):
        groups[x].append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup.exact_dedup(docs, run_rows=4, fan_in=2).collect()
    assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == bag((i, min(groups[x])[3], len(groups[x]), hashlib.sha256(x.encode()).hexdigest()) for (i, _), x in zip(table, norm, strict=True))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert bag(r.doc_id for r in kept.collect()) == bag(min(g)[3] for g in groups.values())


def test_pii(docs, table):
    got = pii.digests(pii.find_pii(docs)).collect()
    assert bag((r.doc_id, r.n_email) for r in got) == bag((i, (t or "").count("@")) for i, t in table)


def test_quality_and_lm_scoring(spark, docs, table):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    assert bag(r.doc_id for r in got) == bag(i for i, _ in table)
    scored = lm_scoring.score_all(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    total = sum(len(words_of(t)) + 1 for i, t in table if not held(i))
    assert bag((r.doc_id, r.held_out, r.n_tokens, r.train_tokens) for r in scored) == bag((i, held(i), len(words_of(t)) + 1, total) for i, t in table)


def test_licenses(docs, table):
    got = licenses.scan_documents(docs).collect()
    assert bag((r.doc_id, tuple(r.families), r.n_notices) for r in got) == bag((i, ("mit",) if NOTICE in (t or "") else (), int(NOTICE in (t or ""))) for i, t in table)


def test_stages_keep_columns_and_survive_an_empty_table(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, folder)
            assert name == "bpe" or out.columns == rows.columns
            assert out.count() <= rows.count()


def test_columns_named_like_those_that_name_rows(docs):
    clash = docs.withColumns({"__row_file": F.lit(1), "__row_at": F.lit("x")})
    for keep in (exact_dedup.keep_one, ngram_join.keep_one):
        assert keep(clash).columns == clash.columns
        assert keep(clash).count() == keep(docs).count()


def test_sums_before(spark):
    rnd = random.Random(1)
    arrays = [[rnd.randrange(9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 16, 17, 100, 1001)]
    got = spark.createDataFrame([(a,) for a in arrays], "a array<int>").select("a", sums_before(F.col("a")).alias("s")).collect()
    for r in got:
        assert r.s == np.append(0, np.cumsum(r.a))[: len(r.a)].tolist()


def test_long_lines_take_linear_time(spark):
    """A line of 20,000 words that speaks of a licence, and 100,000 addresses in one text."""
    rows = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(20_000)) + " license"), (2, " ".join(f"a{k}@b.example" for k in range(100_000)))], "doc_id long, text string")
    began = time.time()
    assert licenses.scan_documents(rows).count() == 2
    assert [r.n_email for r in pii.digests(pii.find_pii(rows)).orderBy("doc_id").collect()] == [0, 100_000]
    assert time.time() - began < 120


def test_rows_have_names_of_their_own(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    scan = spark.read.parquet(path)
    some = scan.filter("doc_id is not null").select("doc_id", "text")
    twice = scan.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    for own, written in ((scan, False), (some, False), (twice, True), (scan.unionByName(scan), True), (docs, True)):
        named = rows(own)
        assert named.select(*ROW).distinct().count() == own.count()
        assert named.columns == [*ROW, *own.columns]
        assert (path not in " ".join(named.inputFiles())) == written
    norm = {re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in docs.collect()}
    assert exact_dedup.keep_one(twice).count() == len(norm)
