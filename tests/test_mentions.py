"""Mentions of benchmark items against their SQL, where copies touch and items lie within one another."""

from __future__ import annotations

import duckdb

from marlow.plans import document_queries


def test_copies_that_touch_and_items_within_items(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (1, 'a b'), (2, 'a, b'), (3, 'b a b c'), (4, 'c'), (5, ''), (6, NULL)) AS t(item_id, text)")
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'a b a b a b'), (2, 'a b x a b. a b'), (3, 'a b a b c c c C'), (4, 'none'), (5, NULL), (6, 'c c, c c c')) AS t(doc_id, text)")
    for name in ("benchmark", "documents"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in document_queries.title_mentions(spark, str(tmp_path)).select("doc_id", "n").collect())
    assert got == sorted(con.sql(document_queries.ORACLES["title_mentions"]).fetchall())
    assert dict(got)[1] == 2 and dict(got)[6] == 3
