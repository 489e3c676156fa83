"""Chains of pages, loops among them, and full views that lose nothing."""

from __future__ import annotations

import random
import re
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from marlow.api import full_view
from marlow.functions.render import fragmented, render
from marlow.sources import pages


def test_absolute_links(spark):
    bases = ["http://a.example/b/c/d?x=1", "http://a.example/b/", "https://a.example/x.html"]
    hrefs = ["e", "/e/f", "?y=2", "#top", "../e", "../../e#t", "./e", "../../../../e", "http://b.example/z", "g/../h", "", "e/./f"]
    rows = [(h, b) for h in hrefs for b in bases]
    got = spark.createDataFrame(rows, "h string, b string").select("h", "b", pages.absolute(F.col("h"), F.col("b")).alias("u")).collect()
    for r in got:
        assert r.u == (urldefrag(urljoin(r.b, r.h)).url if r.h not in ("", "#top") else r.b), (r.h, r.b, r.u)


def page(rows, following, more=""):
    listed = "".join(f'<tr><td><a href="{h}">{n}</a></td><td>{k}</td></tr>' for n, k, h in rows)
    return f"<table>{listed}</table>{more}" + (f'<a href="{following}">Next</a>' if following else "")


def test_crawled_pages_and_loops(spark):
    """A chain of 40 pages, one that loops back into its middle, one that enters another's chain, a link to a page that is not stored."""
    rnd, rows, chains = random.Random(3), [], {"a": [(k, k + 1) for k in range(39)] + [(39, None)], "b": [(k, k + 1) for k in range(9)] + [(9, 4)], "d": [(0, 77)]}
    for s, links in chains.items():
        for k, n in links:
            rows.append((f"http://x.example/{s}/{k}", page([(f"{s}{k}-{i}", str(i), f"../r/{s}{k}{i}") for i in range(2)], None if n is None else str(n))))
            rows.append((f"http://x.example/r/{s}{k}0", f"<dl><dt>Kind</dt><dd>{s} {k}</dd></dl>"))
    rows.append(("http://x.example/c/0", page([("c0-0", "0", "/nowhere")], "/a/35")))
    rows += [(None, "lost"), rows[0]]
    rnd.shuffle(rows)
    starts = spark.createDataFrame([(f"http://x.example/{s}/0",) for s in ("a", "b", "c", "d", "missing")], "url string")
    stored = spark.createDataFrame(rows, "url string, html string")
    got = pages.followed(stored, starts).collect()
    said = {(r.start[-3], int(r.place)): r.url for r in got}
    assert len(said) == len(got) == 40 + 10 + 6 + 1
    assert [said["a", k] for k in range(40)] == [f"http://x.example/a/{k}" for k in range(40)]
    assert [said["c", k] for k in range(1, 6)] == [f"http://x.example/a/{k}" for k in range(35, 40)]
    records = pages.crawled(stored, starts, ["name", "number"]).collect()
    assert sorted(r.name for r in records) == sorted([f"{s}{k}-{i}" for s, x in chains.items() for k, _ in x for i in range(2)] + ["c0-0"])
    assert all((r.details == {"Kind": f"{r.name[0]} {r.name[1:-2]}"}) if r.name.endswith("-0") and r.name != "c0-0" else r.details is None for r in records)


def provision(k, text):
    return f'<prov id="p{k}"><label>{k}</label><prov.body><para><text>{text}</text></para></prov.body></prov>'


ACT = "<act><cover><title>T</title></cover><body>intro " + provision(1, "a ship sank") + "<part><label>2</label>" + provision(2, "no <amend>" + provision(9, "ship") + "</amend> more") + "</part><amend>" + provision(8, "kept") + "</amend></body><schedule><label>1</label>" + provision(3, "x") + " end</schedule> tail</act>"


def whole(skeleton, parts):
    return re.sub(r'<div class="part" data-part="(\d+)"[^>]*></div>', lambda m: parts[int(m[1])], skeleton)


def test_fragments_make_the_document_again():
    skeleton, parts = fragmented(ACT)
    assert len(parts) == 3 and "sank" not in skeleton and "kept" in skeleton
    assert whole(skeleton, parts) == render(ACT)
    assert fragmented("<a") is None and fragmented(None) is None


def test_full_view_loses_nothing(spark):
    long = "<act><body>" + "".join(provision(k, f"word{k} " * 30) for k in range(1, 400)) + "</body></act>"
    assert len(long) > 100_000
    rows = spark.createDataFrame([(1, "short", ACT), (2, "long", long), (3, "none", None), (4, "bad", "<a")], "id int, title string, xml string")
    got = {r.id: r for r in full_view(rows, "xml").collect()}
    assert not got[1].skeleton and got[1].html == render(ACT) and got[1].parts == []
    assert got[2].skeleton and [p.num for p in got[2].parts] == list(range(399))
    assert whole(got[2].html, [p.html for p in got[2].parts]) == render(long)
    assert got[3].html is None and got[4].html is None
    marked = {r.id: r for r in full_view(rows, "xml", "ship").collect()}
    assert marked[1].skeleton and "search_match" in marked[1].parts[0].html and "search_match" not in marked[1].parts[2].html
