"""Documents, judgments and page boxes made of the synthetic tables, so that the document queries read whole tables.

An act per customer with orders: a section per order, numbered by order key, with two paragraphs, the
second linking to the section before; the first section defines a term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import layout
from .relational_queries import t


#: Orders of a partition: their compressed rows are a small part of the text that is made of them, about 14 MB, and of the work of parsing it.
ORDERS = 1 << 15


def sections(spark: SparkSession, d: str) -> DataFrame:
    """c, o, r (place among the customer's orders), prev, p, s, name, segment."""
    own = t(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").cast("date").alias("day"))
    own = layout.dealt(own, "c", ORDERS)
    w = W.partitionBy("c").orderBy("o")
    named = t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return own.withColumns({"r": F.row_number().over(w).cast("long"), "prev": F.lag("o").over(w)}).join(named, "c")


#: The same in SQL.
SECTIONS = """(SELECT o_custkey AS c, o_orderkey AS o, o_orderpriority AS p, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, c_name AS name, lower(c_mktsegment) AS segment, c_nationkey AS nation FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _text(template: str) -> Column:
    """The template with ``{column}`` filled in."""
    pieces = template.replace("{", "\0{").replace("}", "\0").split("\0")
    return F.concat(*(F.col(p[1:]).cast("string") if p.startswith("{") else F.lit(p) for p in pieces))


def acts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, xml."""
    rows = sections(spark, d).withColumn("verb", F.when(F.col("c") % 2 == 0, "means").otherwise("includes"))
    first = _text('<text>In this Act, status {s}</text><def-para id="D{c}"><para><text><def-term id="T{c}">{segment} ship</def-term> {verb} a vessel</text></para></def-para>')
    later = _text("<text>status {s}</text>")
    link = _text('<text>see <link href="S{prev}">section ').cast("string")
    body = F.concat(
        _text('<prov id="S{o}"><label>{r}</label><heading>{p}</heading><prov.body><subprov id="U{o}"><label>1</label><para>'),
        F.when(F.col("r") == 1, first).otherwise(later),
        _text('<label-para id="L{o}"><label>a</label><para><text>order {o} of a {segment} ship</text></para></label-para><label-para id="M{o}"><label>b</label><para>'),
        F.when(F.col("r") == 1, F.lit("<text>none before</text>")).otherwise(F.concat(link, (F.col("r") - 1).cast("string"), F.lit("</link></text>"))),
        F.lit("</para></label-para></para></subprov></prov.body></prov>"),
    )
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", body.alias("x")))), lambda x: x["x"]), "")
    whole = rows.groupBy("c", "name").agg(parts.alias("body"))
    return whole.select(F.col("c").alias("doc_id"), F.concat(_text('<act id="A{c}" year="1993" date.assent="1993-07-01"><cover><title>{name}</title></cover><body id="B{c}">'), "body", F.lit("</body></act>")).alias("xml"))


def scoped_acts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, xml: acts of parts of three sections; each part defines a term for itself, and the first section one for sections 2 and 4 where there are four, by two links or by one."""
    rows = sections(spark, d).withColumns({"k": F.floor((F.col("r") - 1) / 3) + 1, "n": F.max("r").over(W.partitionBy("c")), "o2": F.max(F.when(F.col("r") == 2, F.col("o"))).over(W.partitionBy("c")), "o4": F.max(F.when(F.col("r") == 4, F.col("o"))).over(W.partitionBy("c"))})
    ours = _text('<subprov id="U{o}"><label>1</label><para><text>In this Part,</text><def-para><para><text><def-term id="T{o}">{segment} ship</def-term> means a boat</text></para></def-para></para></subprov>')
    links = F.when(F.col("c") % 2 == 0, _text('<link href="S{o2}">section 2</link> and <intref>section 4<resourcepair targetXmlId="S{o4}"/></intref>')).otherwise(_text('<link href="S{o2}">sections 2 and 4</link>'))
    theirs = F.concat(_text('<subprov id="V{o}"><label>2</label><para><text>For the purposes of '), links, _text(',</text><def-para><para><text><def-term id="F{c}">fast vessel</def-term> means a boat</text></para></def-para></para></subprov>'))
    body = F.concat(
        F.when((F.col("r") - 1) % 3 == 0, _text('<part id="P{o}"><label>{k}</label>')).otherwise(""), _text('<prov id="S{o}"><label>{r}</label><prov.body>'), F.when((F.col("r") - 1) % 3 == 0, ours).otherwise(""), F.when((F.col("r") == 1) & (F.col("n") >= 4), theirs).otherwise(""),
        _text('<subprov id="W{o}"><label>3</label><para><text id="X{o}">order {o} of a {segment} ship or a fast vessel</text></para></subprov></prov.body></prov>'), F.when((F.col("r") % 3 == 0) | (F.col("r") == F.col("n")), "</part>").otherwise(""),
    )
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", body.alias("x")))), lambda x: x["x"]), "")
    return rows.groupBy("c").agg(parts.alias("body")).select(F.col("c").alias("doc_id"), F.concat(_text('<act id="A{c}"><body id="B{c}">'), "body", F.lit("</body></act>")).alias("xml"))


def judgment_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_no, text: a judgment per customer with orders, two lines an order."""
    rows = sections(spark, d).join(t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("land")), "nation")
    head = rows.filter("r = 1").withColumn("long_day", F.date_format("day", "d MMMM yyyy"))
    lines = ["[2014] NZHC {c}", "UNDER the {segment} Act", "BETWEEN", "{name}", "Plaintiff", "AND", "{land}", "Defendant", "Hearing: {long_day}", "Counsel: B {segment} for the plaintiff", "THE FACTS"]
    top = head.select(F.col("c").alias("doc_id"), F.posexplode(F.array(*map(_text, lines))).alias("line_no", "text"))
    body = rows.select(F.col("c").alias("doc_id"), F.col("r"), F.posexplode(F.array(_text("[{r}] Order {o} was made."), _text("(a) status {s}"))).alias("k", "text"))
    body = body.select("doc_id", (F.lit(len(lines) - 2) + 2 * F.col("r") + F.col("k")).cast("int").alias("line_no"), "text")
    return top.unionByName(body).withColumn("line_no", F.col("line_no").cast("long"))


def joined_cases(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_no, text: an intituling of two cases per customer with orders, each with its court file, matter and parties; every third has no parties."""
    rows = sections(spark, d).filter("r = 1").join(t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("land")), "nation")
    sides = lambda a, b: ["BETWEEN", f"{{{a}}}", "Plaintiff", "AND", f"{{{b}}}", "Defendant"]
    files = ["CIV-2014-404-{c}", "UNDER the {segment} Act"], ["CIV-2015-404-{o}", "IN THE MATTER OF order {o}"]
    body = ["[1] Order {o} was made.", "BETWEEN", "nobody"]
    both, alone = [*files[0], *sides("name", "land"), *files[1], *sides("land", "name"), *body], [files[0][1], "Registry of {land}", files[0][0], *body]
    made = lambda lines: F.array(*map(_text, lines))
    return rows.select(F.col("c").alias("doc_id"), F.posexplode(F.when(F.col("c") % 3 == 0, made(alone)).otherwise(made(both))).alias("line_no", "text"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page per order, one for each line item; two neighbours share a row, every fifth is small."""
    own = layout.dealt(t(spark, d, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"))
    row, side = F.floor(F.col("n") / 2).cast("double"), F.col("n") % 2
    top = 700.0 - 40.0 * row
    return own.select("doc_id", F.lit(0).alias("page"), F.concat(F.lit("part "), "part").alias("text"), top.alias("top"), (top - 10).alias("bottom"),
                      F.when(side == 0, 72.0).otherwise(310.0).alias("left"), F.when(side == 0, 300.0).otherwise(523.0).alias("right"), F.when(F.col("n") == 5, 7.0).otherwise(12.0).alias("font"), "n")
