"""Judgment layout: lines with boxes to rows, paragraphs, tables, footnotes and bands, by windows over line order.

A line table has doc_id, page, line_no, text, left, top, right, bottom, font (size), bold and italic;
``top`` is above ``bottom`` and grows upwards, as page coordinates do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Page frame and tolerances, in points.
PAGE_LEFT, PAGE_RIGHT, CENTER = 72.0, 523.0, 297.5
NEAR, GAP_FACTOR, SUPERSCRIPT = 3.0, 1.5, 0.8
#: The gap between columns, and how much shorter a line must be than the next to end its paragraph.
COLUMN, EARLY = 20.0, 40.0
#: Rows that a task sorts, about.
DEALT = 1 << 18


def dealt(rows: DataFrame, key: str, most: int = DEALT) -> DataFrame:
    """A table dealt by ``key`` to as many partitions as it has rows for, ``most`` in each on the average, so that what a task sorts does not grow with it.

    Left to itself a plan takes the sizes of compressed rows, which are many times larger in memory, once
    for each order that the windows below need. The windows and groups of a document need no further exchange.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(n, key)


def reading_order(boxes: DataFrame) -> DataFrame:
    """Line numbers by page, from the top down, then from the left."""
    return boxes.withColumn("line_no", F.row_number().over(W.partitionBy("doc_id").orderBy("page", F.desc("top"), "left")) - 1)


def left_aligned() -> Column:
    return F.abs(F.col("left") - PAGE_LEFT) <= NEAR


def right_aligned() -> Column:
    return (F.abs(F.col("right") - PAGE_RIGHT) <= NEAR) & ~left_aligned()


def centered() -> Column:
    return (F.abs((F.col("left") + F.col("right")) / 2 - CENTER) <= NEAR) & ~left_aligned()


def indented() -> Column:
    return (F.col("left") > PAGE_LEFT + NEAR) & ~centered() & ~right_aligned()


def full_width() -> Column:
    return left_aligned() & (F.abs(F.col("right") - PAGE_RIGHT) <= NEAR)


def flags(lines: DataFrame) -> DataFrame:
    """The alignment of every line, and whether it is a superscript by the usual font of its document."""
    usual = F.mode("font").over(W.partitionBy("doc_id"))
    return lines.withColumns({"left_al": left_aligned(), "right_al": right_aligned(), "center": centered(), "indent": indented(), "full": full_width(), "superscript": F.col("font") < SUPERSCRIPT * usual})


def rows(boxes: DataFrame) -> DataFrame:
    """Boxes that overlap in height, directly or by others between them, share a row; a row's texts are joined from the left.

    A line swept down the page meets a new row where it has left all boxes above. ``columns`` counts the
    stretches of a row with a gap of ``COLUMN`` between them.
    """
    w = W.partitionBy("doc_id", "page").orderBy(F.desc("top"), "left")
    lowest = F.min("bottom").over(w.rowsBetween(W.unboundedPreceding, -1))
    numbered = boxes.withColumn("__new", F.coalesce(F.col("top") <= lowest, F.lit(True))).withColumn("row", F.sum(F.col("__new").cast("int")).over(w) - 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda s: s["text"])
    across = W.partitionBy("doc_id", "page", "row").orderBy("left", "right")
    reach = F.max("right").over(across.rowsBetween(W.unboundedPreceding, -1))
    numbered = numbered.withColumn("__column", (F.col("left") - reach > COLUMN).cast("int"))
    return numbered.groupBy("doc_id", "page", "row").agg(
        F.array_join(texts, " ").alias("text"), F.count(F.lit(1)).alias("n_boxes"), F.min("left").alias("left"), F.max("right").alias("right"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.max("font").alias("font"), (F.coalesce(F.sum("__column"), F.lit(0)) + 1).alias("columns")
    )


def states(lines: DataFrame) -> DataFrame:
    """Rows (as ``rows`` gives them) with ``state``: paragraph, indent, quote, table or footer, in reading order ``line_no``.

    Small print at the margin is a footer, and so is all small print below it on the page. A row of
    several columns is a table's, as are the rows set in below it until a gap. Small print that is set in
    is a quotation; other rows that are set in are indents, and the rest paragraphs.
    """
    order = W.partitionBy("doc_id").orderBy("page", "row")
    usual = F.mode("font", deterministic=True).over(W.partitionBy("doc_id"))
    on_page = W.partitionBy("doc_id", "page").orderBy("row")
    own = lines.withColumn("line_no", F.row_number().over(order) - 1).withColumn("__usual", usual)
    own = own.withColumn("__small", F.col("font") <= F.col("__usual") - 1).withColumn("__in", F.col("left") > PAGE_LEFT + NEAR)
    own = own.withColumn("__wide", F.coalesce(F.lag("bottom").over(on_page) - F.col("top") > GAP_FACTOR * (F.col("top") - F.col("bottom")), F.lit(True)))
    foot = F.max(F.col("__small") & ~F.col("__in")).over(on_page)
    first = F.when(F.col("__small") & foot, "footer").when(F.col("columns") > 1, "table").when(F.col("__small") & F.col("__in"), "quote").when(F.col("__in"), "indent").otherwise("paragraph")
    own = own.withColumn("__first", first)
    kept = F.last(F.when((F.col("__first") != "indent") | F.col("__wide"), F.col("__first")), ignorenulls=True).over(order)
    own = own.withColumn("state", F.when((F.col("__first") == "indent") & (kept == "table"), "table").otherwise(F.col("__first")))
    return own.drop("__usual", "__small", "__in", "__first", "__wide")


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, state, text, first_line, n_lines): rows with states as whole paragraphs, quotations, tables and so on.

    A block ends where the state changes, and but for tables at a wide gap, at a paragraph's number, at an
    indent's mark, and after a line that ended well short of the next. Footers stand after the other
    blocks of their page: the text runs on over the page's end.
    """
    own = lines.withColumn("__foot", F.col("state") == "footer")
    # the text of all pages first, then the footers page by page
    w = W.partitionBy("doc_id").orderBy("__foot", "line_no")
    before = lambda c: F.lag(c).over(w)
    near = before("page") == F.col("page")
    wide = near & (before("bottom") - F.col("top") > GAP_FACTOR * (F.col("top") - F.col("bottom")))
    short = F.col("right") - before("right") > EARLY
    marked = F.col("text").rlike(r"^\s*(?:\[\d+\]|\([a-z]{1,4}\)|\d+\s)")
    turned = before("state").isNull() | (before("state") != F.col("state"))
    fresh = turned | ((F.col("state") != "table") & (wide | short | marked)) | ((F.col("state") == "footer") & ~near)
    numbered = own.withColumn("__fresh", fresh).withColumn("block", F.sum(F.col("__fresh").cast("int")).over(w) - 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: F.trim(s["text"]))
    joined = F.when(F.first("state") == "table", F.array_join(texts, "\n")).otherwise(F.array_join(texts, " "))
    return numbered.groupBy("doc_id", "block").agg(F.first("state").alias("state"), joined.alias("text"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines grouped until the gap above grows past the usual one, the indent changes or the page's last line was short."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    gap = F.lag("bottom").over(w) - F.col("top")
    height = F.col("top") - F.col("bottom")
    fresh = F.lag("line_no").over(w).isNull() | (gap > GAP_FACTOR * height) | (F.abs(F.col("left") - F.lag("left").over(w)) > NEAR)
    numbered = lines.withColumn("__fresh", fresh).withColumn("para", F.sum(F.col("__fresh").cast("int")).over(w) - 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: F.trim(s["text"]))
    return numbered.groupBy("doc_id", "para").agg(F.array_join(texts, " ").alias("text"), F.min("line_no").alias("first_line"), F.min("left").alias("left"))


def footnotes(lines: DataFrame) -> DataFrame:
    """(doc_id, key, text): a superscript number opens a note that goes on until the next."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    key = F.when(F.col("superscript"), F.regexp_extract(F.trim("text"), r"^(\d+)$", 1).try_cast("int"))
    noted = lines.withColumn("__key", key).withColumn("key", F.last("__key", ignorenulls=True).over(w)).filter("key is not null and __key is null")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: F.trim(s["text"]))
    return noted.groupBy("doc_id", "key").agg(F.array_join(texts, " ").alias("text"))


def contents_rows(lines: DataFrame) -> DataFrame:
    """Rows of a table of contents: page number split off, wrapped rows joined to the row that ends them."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    number = F.regexp_extract("text", r"[\s.]*\[?(\d+)\]?\s*$", 1).try_cast("int")
    title = F.trim(F.regexp_replace("text", r"[\s.]*\[?\d+\]?\s*$", ""))
    ends = lines.withColumn("number", number).withColumn("title", F.when(number.isNotNull(), title).otherwise(F.trim("text")))
    ends = ends.withColumn("entry", F.coalesce(F.sum(F.col("number").isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "title"))), lambda s: s["title"])
    return ends.groupBy("doc_id", "entry").agg(F.array_join(titles, " ").alias("title"), F.max("number").alias("number"), (F.min("left") > PAGE_LEFT + NEAR).alias("minor"))


def band(lines: DataFrame, rule: Column) -> DataFrame:
    """The lines between the first and the second horizontal rule of each document."""
    seen = F.sum(rule.cast("int")).over(W.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("__seen", seen).filter((F.col("__seen") == 1) & ~rule).drop("__seen")


def band_entries(lines: DataFrame) -> DataFrame:
    """Entries A, B, C … of a band, each with the lines that follow it."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    mark = F.nullif(F.regexp_extract("text", r"^\s*([A-Z])\s+", 1), F.lit(""))
    own = lines.withColumn("__mark", mark).withColumn("mark", F.last("__mark", ignorenulls=True).over(w)).filter("mark is not null")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("text", r"^\s*[A-Z]\s+", "").alias("t")))), lambda s: F.trim(s["t"]))
    return own.groupBy("doc_id", "mark").agg(F.array_join(texts, " ").alias("text"))


def parents(titles: DataFrame, texts: DataFrame, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """(child, parent): parents that a subordinate title's document names by key phrase.

    Only titles of amendments, rules and regulations have parents; a document is not its own, nor is one
    of the same title. ``texts``: id, text.
    """
    found = parent_names(titles, texts, id_col, title_col)
    known = titles.select(F.col(id_col).alias("parent"), F.col(title_col).alias("name"))
    return found.join(known, "name").filter("parent <> child").select("child", "parent").distinct()


def parent_names(titles: DataFrame, texts: DataFrame, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """(child, name): the titles, other than its own, that a subordinate document names as its parents', once each."""
    subordinate = titles.filter(F.col(title_col).rlike("Amendment|Rules|Regulations")).select(F.col(id_col).alias("child"), F.col(title_col).alias("own"))
    named = F.regexp_extract_all("text", F.lit(r"(?:pursuant to|made under|amends|principal Act is) (?:section \S+ of )?the ([A-Z][\w ()-]*? Act \d{4})"), F.lit(1))
    found = texts.select(F.col(id_col).alias("child"), F.explode(named).alias("name")).distinct()
    return found.join(subordinate, "child").filter("name <> own").select("child", "name")
