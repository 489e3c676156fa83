"""Python functions of documents give out their results a few rows at a time, in order, whatever is null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from marlow.functions import render, slices
from marlow.sources import documents


def test_no_more_rows_are_held_than_said(spark):
    seen = []
    run = slices.sliced(lambda s: seen.append(len(s)) or s, "string").func
    out = list(run(iter([pd.Series(range(1000)), pd.Series([], dtype=object), pd.Series(range(3))])))
    assert max(seen) <= slices.HELD and sum(seen) == 1003
    assert [x for s in out for x in s] == [*range(1000), 0, 1, 2]
    for udf in (render.render_udf(), render.contents_udf, render.fragmented_udf(), documents.xml_root):
        assert max(len(s) for s in udf.func(iter([pd.Series(["<a/>"] * 1000)]))) <= slices.HELD


def test_rows_keep_their_results(spark):
    docs = spark.range(1500).select("id", F.when(F.col("id") % 7 == 3, None).when(F.col("id") % 7 == 4, "<bad").otherwise(F.concat(F.lit('<act id="A'), "id", F.lit('"><prov><label>'), "id", F.lit("</label></prov></act>"))).alias("xml")).coalesce(1)
    got = docs.select("id", render.render_udf()("xml").alias("a"), render.contents_udf("xml").alias("b"), render.fragmented_udf()("xml").alias("c"), documents.xml_root("xml").alias("d")).collect()
    assert len(got) == 1500
    for r in got:
        if r.id % 7 in (3, 4):
            assert r.a is None and r.b is None and not (r.c and r.c.skeleton) and not (r.d and r.d.tag)
        else:
            assert f'data-location="s {r.id}"' in r.a and f">{r.id} <" in r.b + " <" or f">{r.id}</li>" in r.b
            assert len(r.c.parts) == 1 and r.d.attributes["id"] == f"A{r.id}"
