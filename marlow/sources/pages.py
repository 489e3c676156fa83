"""Tables, links and details out of web pages, by expressions over their markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.text import html_text
from ..store import materialise


def cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table, row, cell, text, href): every cell of every table, with its first link."""
    tables = F.regexp_extract_all(html_col, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))
    rows = F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    found = F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    out = pages.select(id_col, F.posexplode(tables).alias("table", "t")).select(id_col, "table", F.posexplode(rows).alias("row", "r")).select(id_col, "table", "row", F.posexplode(found).alias("cell", "c"))
    return out.select(id_col, "table", "row", "cell", html_text(F.col("c")).alias("text"), F.nullif(F.regexp_extract("c", r'(?is)<a\b[^>]*\bhref="([^"]*)"', 1), F.lit("")).alias("href"))


def records(pages: DataFrame, id_col: str, html_col: str, columns: list[str]) -> DataFrame:
    """Rows of a page's tables as records: a column per name, by place; rows of fewer cells are left out."""
    each = cells(pages, id_col, html_col).filter(F.col("cell") < len(columns))
    rows = each.groupBy(id_col, "table", "row").agg(*(F.max(F.when(F.col("cell") == k, F.col("text"))).alias(c) for k, c in enumerate(columns)), F.min_by("href", F.when(F.col("href").isNotNull(), F.col("cell"))).alias("href"), F.count(F.lit(1)).alias("__n"))
    return rows.filter(F.col("__n") == len(columns)).drop("__n")


def details(html: Column) -> Column:
    """A page's ``dt`` and ``dd`` pairs as a map; of a name that comes twice the last value stays."""
    names = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<dt\b[^>]*>(.*?)</dt>"), F.lit(1)), html_text)
    values = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<dd\b[^>]*>(.*?)</dd>"), F.lit(1)), html_text)
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = F.filter(pairs, lambda p, i: p["k"].isNotNull() & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def next_page(html: Column) -> Column:
    """The link that a pager's *next* leads to; null on the last page."""
    return F.nullif(F.regexp_extract(html, r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>\s*(?:next|&gt;|›|»)', 1), F.lit(""))


def absolute(href: Column, base: Column) -> Column:
    """Where a link on a page leads: an address as it is, a path from the page's host, or one from its folder; fragments and dots off."""
    plain = F.regexp_replace(href, "#.*$", "")
    host = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(.*/)[^/]*$", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    joined = F.when(plain.rlike(r"^[a-zA-Z][\w+.-]*:"), plain).when(plain.startswith("/"), F.concat(host, plain)).when(plain.startswith("?"), F.concat(page, plain)).when(plain == "", base).otherwise(F.concat(folder, plain))
    # each pass takes away the folders that stand before two dots
    passes = F.sequence(F.lit(1), F.size(F.split(joined, r"/\.\./")))
    dotless = F.aggregate(passes, F.regexp_replace(joined, r"/(?:\./)+", "/"), lambda u, _: F.regexp_replace(u, r"(?<=[^/:])/(?!\.\./)[^/?]+/\.\./", "/"))
    return F.regexp_replace(dotless, r"^([a-zA-Z][\w+.-]*://[^/]*/)(?:\.\./)+", "$1")


def followed(pages: DataFrame, starts: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(start, url, place): the stored pages that *next* links lead to from each start, itself at place 0.

    ``starts``: url. Each round doubles how far a link reaches, so a chain of n pages takes log2(n)
    rounds; a chain that comes back to a page of its own ends there, with the page at its first place.
    A link to a page that is not stored ends its chain. Of pages of one address the least text counts.
    """
    stored = pages.groupBy(F.col(url_col).alias("url")).agg(F.min(html_col).alias("html")).filter("url is not null")
    hop = stored.select("url", absolute(next_page(F.col("html")), F.col("url")).alias("next")).filter("next is not null")
    hop = materialise(hop.join(stored.select(F.col("url").alias("next")), "next", "left_semi").select("url", "next"), "page-links")
    reach = starts.select(F.col("url").alias("start")).distinct().join(stored.select(F.col("url").alias("start")), "start", "left_semi")
    reach = materialise(reach.select("start", F.col("start").alias("url"), F.lit(0).cast("long").alias("place")), "page-reach")
    n, now, span = -1, reach.count(), 1
    while now != n:
        on = reach.join(hop, "url").select("start", F.col("next").alias("url"), (F.col("place") + span).alias("place"))
        reach = materialise(reach.unionByName(on).groupBy("start", "url").agg(F.min("place").alias("place")), "page-reach")
        further = hop.select("url", F.col("next").alias("middle")).join(hop.select(F.col("url").alias("middle"), "next"), "middle").select("url", "next")
        hop, span = materialise(further, "page-links"), span * 2
        n, now = now, reach.count()
    return reach


def crawled(pages: DataFrame, starts: DataFrame, columns: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of all pages of each series, with the details of the page that each record links to.

    (start, place, table, row, one column a name, href, details): a page that several series lead to
    counts for the first of them, so every record comes once. ``details`` is a map, null where the link
    leads to no stored page.
    """
    reach = followed(pages, starts, url_col, html_col).groupBy("url").agg(F.min(F.struct("start", "place")).alias("x")).select("url", "x.*")
    stored = pages.groupBy(F.col(url_col).alias("url")).agg(F.min(html_col).alias("html"))
    listed = records(stored.join(reach.select("url"), "url", "left_semi"), "url", "html", columns).join(reach, "url")
    listed = listed.withColumn("href", absolute(F.col("href"), F.col("url")))
    told = stored.select(F.col("url").alias("href"), details(F.col("html")).alias("details"))
    return listed.join(told, "href", "left").select("start", "place", "table", "row", *columns, "href", "details")
