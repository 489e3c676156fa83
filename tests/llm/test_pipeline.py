"""The pipeline's stages, each on what the one before kept, against brute force on the smallest table."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from marlow.llm import quality
from marlow.llm.queries import tokenizer_path
from marlow.llm.store import materialise

from .test_operators import linked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Documents before the first stage and after each but the last, then the last one's rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, columns = [sorted(docs.collect())], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        out.append(sorted(docs.collect()))
    return [*out, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()]


def ids(rows):
    return [r.doc_id for r in rows]


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_join", "decontaminate", "bpe"]


def test_quality_stage_keeps_what_the_classifier_accepts(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(kept[1]) == sorted(ids(quality.classify(docs, net).filter("predicted = 1").collect()))
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in ids(kept[0]) if label.get(i) == 1]
    assert len(set(good) & set(ids(kept[1]))) >= 0.95 * len(good)
    assert len(kept[1]) < len(kept[0])


def test_exact_stage(kept):
    best = {}
    for r in kept[1]:
        key = re.sub("[\x20\x09-\x0d]", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert ids(kept[2]) == sorted(i for _, i in best.values())


def test_near_stage(kept):
    rows = kept[2]
    assert ids(kept[3]) == [r.doc_id for k, (r, (_, first, _)) in enumerate(zip(rows, linked([r.text for r in rows]), strict=True)) if first == k]


def test_leak_stage(spark, kept):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in kept[3] if not any(p in (r.text or "") for p in items)]
    assert set(ids(kept[4])) <= set(clean)
    assert len(clean) - len(kept[4]) <= 0.02 * len(clean)  # edited passages


def test_token_stage(kept):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    text = {r.doc_id: r.text for r in kept[4]}
    assert sorted(ids(kept[5])) == sorted(text)
    for r in kept[5]:
        assert r.ids == tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids)
