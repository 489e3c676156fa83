"""Layout, amendment and remaining scalar queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, layout, links
from ..sources import documents as src
from .acts import boxes
from .relational_queries import t

def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n, part: an order's lines, once each."""
    return layout.dealt(t(spark, d, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"))


NUMBERED = "(SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2)"


def line_flags(spark: SparkSession, d: str) -> DataFrame:
    return layout.flags(layout.reading_order(boxes(spark, d))).select("doc_id", "n", "line_no", "left_al", "right_al", "center", "indent", "full")


def superscripts(spark: SparkSession, d: str) -> DataFrame:
    """Small boxes of pages whose usual size is plain: those with four lines or more."""
    own = boxes(spark, d)
    long = own.groupBy("doc_id").count().filter("count >= 4").select("doc_id")
    return layout.flags(own.join(long, "doc_id", "left_semi")).filter("superscript").select("doc_id", "n")


def layout_rows(spark: SparkSession, d: str) -> DataFrame:
    return layout.rows(boxes(spark, d)).select("doc_id", F.col("row").cast("int").alias("row"), "text", "n_boxes")


def layout_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines in groups of three by number, a wide gap between groups."""
    n, top = F.col("n"), 700.0 - 13 * F.col("n") - 20 * F.floor(F.col("n") / 3)
    lines = _numbered(spark, d).select("doc_id", n.alias("line_no"), F.concat(F.lit("part "), "part").alias("text"), top.alias("top"), (top - 10).alias("bottom"), F.lit(72.0).alias("left"))
    every = lines.select("doc_id").distinct().withColumn("line_no", F.explode(F.sequence(F.lit(1), F.lit(7)))).join(lines.select("doc_id", "line_no", "text"), ["doc_id", "line_no"], "left")
    top = 700.0 - 13 * F.col("line_no") - 20 * F.floor(F.col("line_no") / 3)
    every = every.select("doc_id", "line_no", F.coalesce("text", F.lit("-")).alias("text"), top.alias("top"), (top - 10).alias("bottom"), F.lit(72.0).alias("left"))
    return layout.paragraphs(every).select("doc_id", F.col("para").cast("int").alias("para"), "text")


def layout_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of pages of an order's lines, three plain ones above them: text, an indent, a quotation, a table's row of three boxes that overlap in steps, one set in below it, a footer."""
    n = F.col("n")
    top = 700.0 - 13 * n - F.when((n >= 2) & (F.col("doc_id") % 2 == 0), 30).otherwise(0)
    said = F.concat(F.lit("part "), "part")
    left = F.when(n.isin(3, 6), 90.0).when(n == 4, 100.0).otherwise(72.0)
    font = F.when(n == 4, 10.0).when(n == 7, 8.0).otherwise(12.0)
    box = lambda text, left, right, shift: F.struct(text.alias("text"), left.alias("left"), right.alias("right"), (top - shift).alias("top"), (top - 10 - shift).alias("bottom"), font.alias("font"))
    own = F.when(n == 5, F.array(box(said, F.lit(72.0), F.lit(200.0), 0), box(F.lit("b"), F.lit(250.0), F.lit(300.0), -1.5), box(F.lit("c"), F.lit(400.0), F.lit(523.0), -2.5))).otherwise(F.array(box(said, left, F.lit(523.0), 0)))
    boxed = _numbered(spark, d).select("doc_id", F.lit(0).alias("page"), F.explode(own).alias("x")).select("doc_id", "page", "x.*")
    head = boxed.select("doc_id", "page").distinct().select("doc_id", "page", F.lit("head").alias("text"), F.lit(72.0).alias("left"), F.lit(523.0).alias("right"), F.explode(F.array(F.lit(800.0), F.lit(787.0), F.lit(774.0))).alias("top"))
    boxed = boxed.unionByName(head.withColumn("bottom", F.col("top") - 10).withColumn("font", F.lit(12.0)))
    return layout.blocks(layout.states(layout.rows(boxed))).select("doc_id", F.col("block").cast("long").alias("block"), "state", "text", F.col("n_lines").cast("long").alias("n_lines"))


def layout_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """A superscript number, then a line of its note, and a second one for even numbers."""
    note = F.array(F.struct(F.lit(True).alias("superscript"), F.col("n").cast("string").alias("text")), F.struct(F.lit(False).alias("superscript"), F.concat(F.lit(" part "), "part").alias("text")), F.struct(F.lit(False).alias("superscript"), F.lit("and more ").alias("text")))
    lines = _numbered(spark, d).select("doc_id", "n", F.posexplode(F.slice(note, F.lit(1), F.when(F.col("n") % 2 == 0, 3).otherwise(2))).alias("k", "x"))
    return layout.footnotes(lines.select("doc_id", (F.col("n") * 3 + F.col("k")).alias("line_no"), "x.*")).select("doc_id", "key", "text")


def contents_table(spark: SparkSession, d: str) -> DataFrame:
    """Entries with page numbers, every third one wrapped."""
    entry = F.when(F.col("n") % 3 == 0, F.array(F.concat(F.lit("Part "), "part", F.lit(" begins")), F.concat(F.lit("and on .... ["), "n", F.lit("]")))).otherwise(F.array(F.concat(F.lit("Part "), "part", F.lit(" .... ["), "n", F.lit("]"))))
    lines = _numbered(spark, d).select("doc_id", "n", F.when(F.col("n") % 2 == 0, 108.0).otherwise(72.0).alias("left"), F.posexplode(entry).alias("k", "text"))
    return layout.contents_rows(lines.select("doc_id", (F.col("n") * 2 + F.col("k")).alias("line_no"), "text", "left")).select("doc_id", "title", "number", "minor")


def waistband(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a judgment between two rules, an entry a letter, even ones of two lines."""
    lines = _numbered(spark, d)
    rules = lines.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit("before").alias("text")), F.struct(F.lit(1).alias("line_no"), F.lit("----").alias("text")), F.struct(F.lit(98).alias("line_no"), F.lit("----").alias("text")), F.struct(F.lit(99).alias("line_no"), F.lit("Z  after").alias("text")))).alias("x")).select("doc_id", "x.*")
    entry = F.concat(F.char(F.col("n") + 64), F.lit("  Part "), "part", F.lit(" is allowed"))
    body = lines.select("doc_id", (F.col("n") * 3).alias("line_no"), entry.alias("text")).unionByName(lines.filter("n % 2 = 0").select("doc_id", (F.col("n") * 3 + 1).alias("line_no"), F.lit("in part.").alias("text")))
    return layout.band_entries(layout.band(rules.unionByName(body), F.col("text").rlike("^-{4}"))).select("doc_id", "mark", "text")


def amendments(spark: SparkSession, d: str) -> DataFrame:
    """History notes of line items, those on even days without a date."""
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.lit("nulldate"))
    notes = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Section 3: amended, on "), day, F.lit(", by section 5 of the Order "), "o_custkey", F.lit(" Act 2014.")).alias("note"))
    return annotate.amendment_rows(notes, "note").select("id", "amendment_date", "amending")


def resolved_amendments(spark: SparkSession, d: str) -> DataFrame:
    """Notes with the document that their amending title names."""
    notes = t(spark, d, "orders").select(F.col("o_orderkey").alias("target"), F.lit("n").alias("node_id"), F.concat(F.lit("repealed, on 1 July 2014, by section 6 of the Order "), F.col("o_custkey") % 50, F.lit(" Act 2014.")).alias("note"))
    titles = t(spark, d, "customer").filter("c_custkey < 40").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Order "), "c_custkey", F.lit(" Act 2014")).alias("title"))
    return links.amendments(notes, titles).select("target", "amendment_date", "amending", "source")


def parent_instruments(spark: SparkSession, d: str) -> DataFrame:
    """Acts and regulations of nations; regulations are made under the act of their nation, amendments under that of their region."""
    n = t(spark, d, "nation")
    act, rules, later = F.concat("n_name", F.lit(" Act 1993")), F.concat("n_name", F.lit(" Regulations 1995")), F.concat("n_name", F.lit(" Amendment Act 1999"))
    titles = n.select(F.explode(F.array(F.struct(F.col("n_nationkey").alias("id"), act.alias("title")), F.struct((F.col("n_nationkey") + 100).alias("id"), rules.alias("title")), F.struct((F.col("n_nationkey") + 200).alias("id"), later.alias("title")))).alias("x")).select("x.*")
    named = n.alias("a").join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("first")), F.col("n_regionkey") == F.col("k"))
    made = named.select((F.col("n_nationkey") + 100).alias("id"), F.concat(F.lit("These regulations are made under section 5 of the "), "n_name", F.lit(" Act 1993.")).alias("text"))
    amends = named.select((F.col("n_nationkey") + 200).alias("id"), F.concat(F.lit("This Act amends the "), "first", F.lit(" Act 1993 and the "), "n_name", F.lit(" Amendment Act 1999.")).alias("text"))
    return layout.parents(titles, made.unionByName(amends))


def best_of_field_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files' metadata joined by name, each field from the metadata or the row's own."""
    own = t(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"))
    meta = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"))
    return src.enriched(own, meta, "key", ["title"])


def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "d MMM yyyy").alias("short"))
    return e.select("event_id", F.date_format(F.try_to_timestamp("iso"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.try_to_timestamp("short", F.lit("d MMM yyyy")).cast("date").alias("day"))


QUERIES = {f.__name__: f for f in (
    line_flags, superscripts, layout_rows, layout_blocks, layout_paragraphs, layout_footnotes, contents_table, waistband, amendments, resolved_amendments, parent_instruments, best_of_field_scan, iso_dates,
)}

ORACLES = {
    "line_flags": f"SELECT doc_id, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS line_no, n % 2 = 0 AS left_al, n % 2 = 1 AS right_al, false AS center, false AS indent, false AS \"full\" FROM {NUMBERED}",
    "superscripts": f"SELECT doc_id, n FROM {NUMBERED} WHERE n = 5 AND doc_id IN (SELECT doc_id FROM {NUMBERED} GROUP BY 1 HAVING count(*) >= 4)",
    "layout_rows": f"SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS \"row\", text, n_boxes FROM (SELECT doc_id, n // 2 AS k, string_agg('part ' || part, ' ' ORDER BY n) AS text, count(*) AS n_boxes FROM {NUMBERED} GROUP BY 1, 2)",
    "layout_blocks": f"""WITH l AS (SELECT doc_id, n, 'part ' || part || CASE WHEN n = 5 THEN ' b c' ELSE '' END AS t, CASE WHEN n = 2 THEN CASE WHEN doc_id % 2 = 0 OR NOT bool_or(n = 1) OVER doc THEN 2 ELSE 1 END WHEN n = 6 THEN CASE WHEN bool_or(n = 5) OVER doc THEN 5 ELSE 6 END ELSE n END AS g FROM {NUMBERED} WINDOW doc AS (PARTITION BY doc_id)),
h AS (SELECT DISTINCT doc_id FROM l)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) AS block, CASE WHEN g IN (3, 6) THEN 'indent' WHEN g = 4 THEN 'quote' WHEN g = 5 THEN 'table' WHEN g = 7 THEN 'footer' ELSE 'paragraph' END AS state, CASE g WHEN 5 THEN string_agg(t, chr(10) ORDER BY n) ELSE string_agg(t, ' ' ORDER BY n) END AS text, count(*) AS n_lines FROM l GROUP BY doc_id, g
UNION ALL SELECT doc_id, 0, 'paragraph', 'head head head', 3 FROM h""",
    "layout_paragraphs": f"""SELECT doc_id, CAST(n // 3 AS INT) AS para, string_agg(coalesce('part ' || part, '-'), ' ' ORDER BY n) AS text FROM (SELECT DISTINCT doc_id FROM {NUMBERED}) CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INT) AS n) LEFT JOIN {NUMBERED} AS x USING (doc_id, n) GROUP BY 1, 2""",
    "layout_footnotes": f"SELECT doc_id, n AS key, 'part ' || part || (CASE WHEN n % 2 = 0 THEN ' and more' ELSE '' END) AS text FROM {NUMBERED}",
    "contents_table": f"SELECT doc_id, 'Part ' || part || (CASE WHEN n % 3 = 0 THEN ' begins and on' ELSE '' END) AS title, n AS number, n % 2 = 0 AS minor FROM {NUMBERED}",
    "waistband": f"SELECT doc_id, chr(64 + n) AS mark, 'Part ' || part || ' is allowed' || (CASE WHEN n % 2 = 0 THEN ' in part.' ELSE '' END) AS text FROM {NUMBERED}",
    "amendments": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS amendment_date, 'Order ' || o_custkey || ' Act 2014' AS amending FROM orders",
    "resolved_amendments": "SELECT o_orderkey AS target, DATE '2014-07-01' AS amendment_date, 'Order ' || (o_custkey % 50) || ' Act 2014' AS amending, c_custkey AS source FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 40) ON c_custkey = o_custkey % 50",
    "parent_instruments": "SELECT n_nationkey + 100 AS child, n_nationkey AS parent FROM nation UNION SELECT n_nationkey + 200, n_regionkey FROM nation",
    "best_of_field_scan": "SELECT p_partkey AS key, coalesce(s_name, p_name) AS title FROM part LEFT JOIN supplier ON s_suppkey = p_partkey",
    "iso_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(ts AS DATE) AS day FROM events",
}
