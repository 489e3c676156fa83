"""Rows by transitive overlap and the states of lines against a direct walk of random pages."""

from __future__ import annotations

import random
import re
from collections import Counter

from marlow.operators import layout
from marlow.operators.layout import COLUMN, EARLY, GAP_FACTOR, NEAR, PAGE_LEFT

SCHEMA = "doc_id long, page int, text string, left double, right double, top double, bottom double, font double"


def pages(seed):
    rnd, out = random.Random(seed), []
    for doc in range(25):
        for page in range(rnd.randint(1, 3)):
            y = 700.0
            for k in range(rnd.randint(1, 14)):
                y -= rnd.choice([12.0, 12.5, 13.0, 40.0])
                left, font = rnd.choice([(72.0, 12.0), (72.0, 12.0), (90.0, 12.0), (100.0, 10.0), (72.0, 8.0)])
                mark = rnd.choice(["", "", "[3] ", "(a) "])
                if rnd.random() < 0.2:
                    at = left
                    for j in range(rnd.randint(2, 4)):
                        shift = j * 0.01 - rnd.choice([0.0, 4.0])
                        out.append((doc, page, f"c{k}{j}", at, at + 50.0, y - shift, y - 10 - shift, font))
                        at += 50 + rnd.choice([5.0, 60.0])
                else:
                    out.append((doc, page, f"{mark}t{k}", left, rnd.choice([523.0, 520.0, 300.0]), y, y - 10, font))
    return out


def walk(boxes):
    """{doc: [(state, text, lines)]} box by box."""
    out = {}
    for doc in sorted({b[0] for b in boxes}):
        rows = []
        for page in sorted({b[1] for b in boxes if b[0] == doc}):
            group, low = [], None
            for b in sorted((b for b in boxes if b[:2] == (doc, page)), key=lambda b: (-b[5], b[3])):
                if low is None or b[5] <= low:
                    group.append([])
                group[-1].append(b)
                low = b[6] if low is None else min(low, b[6])
            for g in group:
                g = sorted(g, key=lambda b: (b[3], b[4]))
                columns, reach = 1, g[0][4]
                for b in g[1:]:
                    columns += b[3] - reach > COLUMN
                    reach = max(reach, b[4])
                texts = [b[2] for b in sorted(g, key=lambda b: (b[3], b[2]))]
                rows.append({"page": page, "text": " ".join(texts), "left": g[0][3], "right": reach, "top": max(b[5] for b in g), "bottom": min(b[6] for b in g), "font": max(b[7] for b in g), "columns": columns})
        fonts = Counter(r["font"] for r in rows)
        usual = min(f for f, n in fonts.items() if n == max(fonts.values()))
        table = foot = False
        for i, r in enumerate(rows):
            same = i > 0 and rows[i - 1]["page"] == r["page"]
            foot = foot and same
            wide = not same or rows[i - 1]["bottom"] - r["top"] > GAP_FACTOR * (r["top"] - r["bottom"])
            small, inner = r["font"] <= usual - 1, r["left"] > PAGE_LEFT + NEAR
            foot = foot or (small and not inner)
            if small and foot:
                r["state"] = "footer"
            elif r["columns"] > 1:
                r["state"] = "table"
            elif small and inner:
                r["state"] = "quote"
            elif inner:
                r["state"] = "table" if table and not wide else "indent"
            else:
                r["state"] = "paragraph"
            table = r["state"] == "table"
        found, prev = [], None
        for r in [r for r in rows if r["state"] != "footer"] + [r for r in rows if r["state"] == "footer"]:
            fresh = prev is None or prev["state"] != r["state"]
            if not fresh and r["state"] != "table":
                near = prev["page"] == r["page"]
                fresh = (near and prev["bottom"] - r["top"] > GAP_FACTOR * (r["top"] - r["bottom"])) or r["right"] - prev["right"] > EARLY or bool(re.match(r"\s*(?:\[\d+\]|\([a-z]{1,4}\)|\d+\s)", r["text"])) or (r["state"] == "footer" and not near)
            if fresh:
                found.append((r["state"], []))
            found[-1][1].append(r["text"])
            prev = r
        out[doc] = [(state, ("\n" if state == "table" else " ").join(ts), len(ts)) for state, ts in found]
    return out


def test_blocks_of_random_pages(spark):
    seen = set()
    for seed in (1, 2):
        boxes = pages(seed)
        got: dict[int, list] = {}
        made = layout.blocks(layout.states(layout.rows(spark.createDataFrame(boxes, SCHEMA).repartition(4))))
        for r in made.orderBy("doc_id", "block").collect():
            got.setdefault(r.doc_id, []).append((r.state, r.text, r.n_lines))
        assert got == walk(boxes)
        seen |= {s for x in got.values() for s, _, _ in x}
    assert seen == {"paragraph", "indent", "quote", "table", "footer"}


def test_rows_overlap_in_steps(spark):
    """A tall box holds two rows together that do not touch each other."""
    boxes = [(1, 0, "tall", 72.0, 90.0, 700.0, 660.0, 12.0), (1, 0, "a", 100.0, 200.0, 699.0, 690.0, 12.0), (1, 0, "b", 100.0, 200.0, 680.0, 670.0, 12.0), (1, 0, "c", 100.0, 200.0, 660.0, 650.0, 12.0)]
    got = layout.rows(spark.createDataFrame(boxes, SCHEMA)).orderBy("row").collect()
    assert [(r.text, r.n_boxes) for r in got] == [("tall a b", 3), ("c", 1)]


def test_what_a_task_sorts_does_not_grow_with_the_boxes(spark, monkeypatch):
    """Four times as many rows are dealt to four times as many partitions, and nothing gathers them again."""
    from marlow.plans import registry

    query = registry.QUERIES["layout_blocks"]
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    rows = sorted(query(spark, "/root/testdata/sf0.001").collect())
    for held in (256, 64):
        monkeypatch.setattr(layout, "DEALT", held, raising=False)
        found = query(spark, "/root/testdata/sf0.001")
        assert found.rdd.getNumPartitions() >= lines // held
        assert sorted(found.collect()) == rows
