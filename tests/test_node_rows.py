"""Node tables: rows equal to a parsed document's, made a bounded number at a time."""

from __future__ import annotations

import pyarrow as pa

from marlow.operators import tree

ODD = [
    '<a id="A"> x <!-- c --><b/> t <label> (1) <i>2</i></label>tail<label>3</label> end</a>',
    '<n:a xmlns:n="u"><n:intref>z<resourcepair targetXmlId="w"/><resourcepair targetXmlId="v"/></n:intref><?p q?> after<link href=""/> </n:a>',
    None, "", "<a>", "<a>&amp; \n b&#160;c</a>", "<a/>",
]


def test_rows_are_those_of_the_parsed_documents(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, xml string")
    got = [r.asDict(recursive=True) for r in tree.node_table(docs, "doc_id", "xml").collect()]
    want = [{"doc_id": k, **n} for k, xml in enumerate(ODD) for n in tree.parse(xml)]
    order = lambda r: (r["doc_id"], r["pre"])
    assert sorted(got, key=order) == sorted(want, key=order) and len(want) == 12
    assert [n["string_value"] for n in tree.parse(ODD[0])][:1] == ["x t (1) 2 tail 3 end"]
    assert [n["href"] for n in tree.parse(ODD[1])] == [None, "w", None, None, None]


def test_a_worker_holds_a_bounded_number_of_rows():
    long = "<a>" + "<b>word</b>" * 40000 + "</a>"
    wide = "<a>" + "<b>" * 40 + "w" * 400000 + "</b>" * 40 + "</a>"
    xmls = pa.array(["<a><b>x</b></a>"] * 30000 + [long, None, wide])
    sizes, n, pres = [], 0, []
    for held in tree._rows(xmls):
        batch = held.batch(pa.array(range(len(xmls))))
        sizes.append((batch.num_rows, sum(len(s) for s in batch.column("string_value").to_pylist())))
        n += batch.num_rows
        pres += [p for d, p in zip(batch.column("doc_id").to_pylist(), batch.column("pre").to_pylist(), strict=True) if d == 30000]
    assert n == 60000 + 40001 + 41 and pres == list(range(40001))
    assert max(rows for rows, _ in sizes) <= tree.ROWS_HELD
    assert max(said for _, said in sizes) <= tree.CHARACTERS_HELD + 400000
