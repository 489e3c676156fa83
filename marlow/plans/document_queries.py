"""Tree, annotation, citation, judgment and incremental queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import citation
from ..operators import annotate, cases, matcher
from ..sources import pages
from ..store import materialise
from ..streaming import incremental
from .acts import SECTIONS, joined_cases, judgment_lines
from .relational_queries import t

#: Phrases of number words and what they stand for.
NUMBERS = [("one", 1), ("twelve", 12), ("seventy two", 72), ("three hundred", 300), ("twelve hundred", 1200), ("twelve thousand three hundred and four", 12304), ("six million four hundred thousand five", 6400005), ("four decillion", 4 * 10**33), ("no number", None)]
#: Words and the forms they are looked up under.
FORMS = [("Capital letters", "Capital letter|Capital letters"), ("classes", "class|classes"), ("class", "class|classes"), ("fish", "fish|fishes"), ("sheep", "sheep|sheeps"), ("child", "child|children|childrens|childs")]

def _literal(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    def cell(v: object) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)} AS t({names})")


def dictionary_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Which frequent two-word names of parts occur in part names, leftmost and longest first."""
    p = t(spark, d, "part").select("p_partkey", "p_name")
    words = p.select(F.explode(F.split("p_name", " ")).alias("term")).distinct().unionByName(p.select(F.col("p_name").alias("term")).filter(F.col("term").like("red %")).distinct())
    return annotate.occurrences(p, words, ["p_partkey"], "p_name", "term").select("p_partkey", "start", "term")


def title_mentions(spark: SparkSession, d: str) -> DataFrame:
    """How often the whole words of benchmark items occur in a document, case kept; of copies one right after the other every second counts, for they share a blank."""
    items = t(spark, d, "benchmark").select("item_id", F.array_join(annotate.text_words(F.col("text")), " ").alias("term"))
    docs = t(spark, d, "documents").select("doc_id", "text")
    return annotate.apart(annotate.every_occurrence(docs, items, ["doc_id"], "text", "term"), ["doc_id"]).groupBy("doc_id").agg(F.sum("n").alias("n"))


def exclusive_split(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") > 30).alias("x")))).alias("r"))
    ids, flags = F.transform("r", lambda r: r["l_linenumber"].cast("string")), F.transform("r", lambda r: r["x"])
    return own.select("l_orderkey", annotate.split_exclusive(ids, flags).alias("s")).select("l_orderkey", "s.primary", "s.other")


def canonical_links(spark: SparkSession, d: str) -> DataFrame:
    """Link texts made of orders' numbers, in five turns of phrase."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 7 + 1
    says = [
        F.concat(F.lit("section "), k, F.lit("("), n, F.lit(")")), F.concat(F.lit("sections "), k, F.lit(" to "), k + n, F.lit(" of the Tax Act 1994")), F.concat(F.lit("clause "), n, F.lit(" of Part 2 of Schedule "), k),
        F.concat(F.lit("subsection ("), n, F.lit(") of section "), k), F.concat(F.lit("LC "), k, F.lit("("), n, F.lit("), ("), n + 1, F.lit("),")),
    ]
    raw = F.get(F.array(*says), (k % 5).cast("int"))
    return t(spark, d, "orders").select(raw.alias("raw")).select("raw", citation.canonical_link_udf("raw").alias("canonical"))


def text_to_num(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of parts in words, and back."""
    small = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    k = F.col("p_partkey") % 1000
    low, word = k % 100, lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    rest = F.when(low == 0, F.lit("")).when(low < 20, word(small, low - 1)).otherwise(F.concat_ws(" ", word(tens, F.floor(low / 10) - 2), F.when(low % 10 > 0, word(small, low % 10 - 1))))
    hundreds = F.when(k >= 100, F.concat(word(small, F.floor(k / 100) - 1), F.lit(" hundred"), F.when(low > 0, " and ").otherwise("")))
    words = F.concat(F.lit("six million "), F.coalesce(hundreds, F.lit("")), rest)
    return t(spark, d, "part").select("p_partkey", citation.words_to_number_udf(F.trim(words)).cast("string").alias("number"))


def number_words(spark: SparkSession, d: str) -> DataFrame:
    """The largest scales, and words that are no number."""
    return _literal(spark, [(a,) for a, _ in NUMBERS], "words").select("words", citation.words_to_number_udf("words").cast("string").alias("number"))


def plural_keys(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, [(a,) for a, _ in FORMS], "word").select("word", F.array_join(citation.word_forms_udf("word"), "|").alias("forms"))


def field_extraction(spark: SparkSession, d: str) -> DataFrame:
    return cases.find_fields(judgment_lines(spark, d), "doc_id", "line_no", "text").select("doc_id", "neutral_citation", "hearing", "counsel")


def party_split(spark: SparkSession, d: str) -> DataFrame:
    return cases.parties(judgment_lines(spark, d), "doc_id", "line_no", "text").select("doc_id", "plaintiffs", "defendants")


def party_roles(spark: SparkSession, d: str) -> DataFrame:
    return cases.party_lines(judgment_lines(spark, d), "doc_id", "line_no", "text").select("doc_id", "role", "name", "descriptor")


def case_matters(spark: SparkSession, d: str) -> DataFrame:
    return cases.matters(judgment_lines(spark, d), "doc_id", "line_no", "text").select("doc_id", "qualifier", "value")


def case_sets(spark: SparkSession, d: str) -> DataFrame:
    """Matters and parties that take turns, each set with its court file."""
    return cases.matters_and_parties(joined_cases(spark, d), "doc_id", "line_no", "text").select("doc_id", "set", "kind", "label", "value", "court_file")


def case_body(spark: SparkSession, d: str) -> DataFrame:
    return cases.body_kinds(judgment_lines(spark, d), "text").filter("line_no >= 10").select("doc_id", "line_no", "kind", "label")


def paragraph_anchors(spark: SparkSession, d: str) -> DataFrame:
    return cases.paragraph_anchors(judgment_lines(spark, d), "doc_id", "line_no", "text").select("doc_id", "number", "place")


def case_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every judgment assembled by the rule table."""
    made = cases.assembled(cases.match(judgment_lines(spark, d), "doc_id", "line_no", "text"), "doc_id")
    return made.select("doc_id", "neutral_citation", "matter", "parties", "hearing", "counsel", "body")


def judgment_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every hit of the patterns in the judgments' bodies, whether it counts, and the tags open after it.

    Headings are made bold and lines of even orders left-aligned; two rules beside the judgments' own
    open a table at an open order and a quotation over a line's end.
    """
    rules = [*matcher.RULES, matcher.Rule("(a) status O", ("table",), ("paragraph",), ("is_body", matcher.Not("is_table"))), matcher.Rule("made.\n(a) status F\n", ("quote",), (), (matcher.Or(("is_body", "is_bold")),))]
    lines = judgment_lines(spark, d).filter("line_no >= 10")
    order = F.regexp_extract("text", r"^\[\d+\] Order (\d+)", 1).try_cast("long")
    faces = {name: F.lit(False) for name in matcher.LINE_TESTS} | {"is_left_aligned": F.coalesce(order % 2 == 0, F.lit(False))}
    found = matcher.apply_rules(lines.withColumns(faces), "doc_id", "line_no", "text", rules)
    return found.select("doc_id", "place", F.col("at").cast("long").alias("at"), F.col("rule").cast("long").alias("rule"), "counts", F.array_join("tags", ",").alias("tags"))


def _region_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per region: a table of its nations, a pager and details."""
    row = F.concat(F.lit('<tr><td><a href="/n/'), "n_nationkey", F.lit('">'), "n_name", F.lit("</a></td><td> "), "n_nationkey", F.lit(" </td></tr>"))
    own = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"), F.count(F.lit(1)).alias("n"))
    pager = F.when(F.col("n_regionkey") < 4, F.concat(F.lit('<a href="/r/'), F.col("n_regionkey") + 1, F.lit('">Next</a>'))).otherwise(F.lit("end"))
    return own.select("n_regionkey", F.concat(F.lit("<table><tr><th>Name</th></tr>"), "rows", F.lit("</table><dl><dt>Nations</dt><dd>"), "n", F.lit("</dd></dl>"), pager).alias("html"))


def scraped_records(spark: SparkSession, d: str) -> DataFrame:
    return pages.records(_region_pages(spark, d), "n_regionkey", "html", ["name", "number"]).select("n_regionkey", "name", "number", "href")


def scraped_details(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return _region_pages(spark, d).select("n_regionkey", pages.details(html)["Nations"].alias("nations"), pages.next_page(html).alias("following"))


def _customer_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lists of each nation's customers, seven a page, and a page for each customer; every other nation's last page leads back to its first."""
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"), F.lower("c_mktsegment").alias("segment"))
    own = own.withColumn("k", F.floor((F.row_number().over(W.partitionBy("n").orderBy("c")) - 1) / 7))
    row = F.concat(F.lit('<tr><td><a href="../customers/'), "c", F.lit('">'), "name", F.lit("</a></td><td>"), "c", F.lit("</td></tr>"))
    lists = own.groupBy("n", "k").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows")).withColumn("last", F.max("k").over(W.partitionBy("n")))
    following = F.when(F.col("k") < F.col("last"), F.concat(F.lit("?page="), F.col("k") + 1)).when(F.col("n") % 2 == 0, F.concat(F.lit("/nations/"), "n", F.lit("?page=0")))
    pager = F.coalesce(F.concat(F.lit('<a href="'), following, F.lit('#top">next</a>')), F.lit(""))
    lists = lists.select(F.concat(F.lit("http://x.example/nations/"), "n", F.lit("?page="), "k").alias("url"), F.concat(F.lit("<table>"), "rows", F.lit("</table>"), pager).alias("html"))
    single = own.select(F.concat(F.lit("http://x.example/customers/"), "c").alias("url"), F.concat(F.lit("<dl><dt>Segment</dt><dd>"), "segment", F.lit("</dd></dl>")).alias("html"))
    return lists.unionByName(single)


def crawled_records(spark: SparkSession, d: str) -> DataFrame:
    """Every customer once, by following the lists of all nations from their first pages, with its own page's details."""
    stored = materialise(_customer_pages(spark, d), "customer-pages")
    starts = t(spark, d, "nation").select(F.concat(F.lit("http://x.example/nations/"), "n_nationkey", F.lit("?page=0")).alias("url"))
    found = pages.crawled(stored, starts, ["name", "number"])
    return found.select("start", "place", "name", "number", F.col("details")["Segment"].alias("segment"))


def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    fields = lines.groupBy("doc_id").agg(F.min_by("line", "line_no").alias("full_citation"), F.min_by("line", F.when(F.col("line").contains("icense"), F.col("line_no"))).alias("waistband"))
    parties = fields.select("doc_id", F.lit("a").alias("plaintiffs"), F.when(F.col("doc_id") % 2 == 0, F.lit("b")).alias("defendants"))
    return cases.validate(fields, parties, "doc_id")


def sibling_walk(spark: SparkSession, d: str) -> DataFrame:
    """Per order, lines from each first large quantity for as long as they stay above 10."""
    own = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return cases.walk(own, "l_orderkey", "l_linenumber", F.col("l_quantity") > 40, F.col("l_quantity") > 10).select("l_orderkey", "l_linenumber", F.col("run").cast("long").alias("run"))


def stale_merge(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events").select("user_id", F.col("ts").alias("updated"), "value")
    cut = events.groupBy("user_id").agg(F.max(F.struct("updated", "value")).alias("m")).select("user_id", "m.updated", "m.value")
    stored = cut.filter("user_id % 3 <> 0").withColumn("updated", F.when(F.col("user_id") % 2 == 0, F.col("updated") - F.expr("interval 1 day")).otherwise(F.col("updated")))
    return incremental.stale(cut, stored, "user_id", "updated").select("user_id")


def merged_state(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    feed = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("value"))
    return incremental.upsert(c, feed, "id")


QUERIES = {f.__name__: f for f in (
    dictionary_annotation, title_mentions, exclusive_split, canonical_links, text_to_num, number_words, plural_keys, field_extraction, party_split, party_roles, case_matters, case_sets, case_body, paragraph_anchors, case_rules, judgment_tags, scraped_records, scraped_details, validation_rules,
    crawled_records, sibling_walk, stale_merge, merged_state,
)}


def _values(rows: list[tuple], names: str) -> str:
    def cell(v: object) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


ORACLES = {
    "title_mentions": r"""WITH b AS (SELECT DISTINCT array_to_string(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_''’-]+'), lambda w: w <> ''), ' ') AS term FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_''’-]+'), lambda w: w <> ''), ' ') || ' ' AS text FROM documents)
SELECT doc_id, CAST(sum((length(text) - length(replace(text, ' ' || term || ' ', ' '))) / (length(term) + 1)) AS BIGINT) AS n FROM d JOIN b ON term <> '' AND contains(text, ' ' || term || ' ') GROUP BY 1""",
    "exclusive_split": """WITH c AS (SELECT *, min(CASE WHEN l_quantity > 30 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS cut FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))
SELECT l_orderkey, coalesce(string_agg(l_linenumber, ';' ORDER BY l_linenumber) FILTER (WHERE cut IS NULL OR l_linenumber <= cut), '') AS "primary", coalesce(string_agg(l_linenumber, ';' ORDER BY l_linenumber) FILTER (WHERE l_linenumber > cut), '') AS other FROM c GROUP BY 1""",
    "dictionary_annotation": r"""WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part)
SELECT p_partkey, CAST(0 AS INT) AS start, p_name AS term FROM w WHERE p_name LIKE 'red %' UNION ALL
SELECT p_partkey, CAST(generate_subscripts(ws, 1) - 1 AS INT), unnest(ws) FROM w WHERE p_name NOT LIKE 'red %'""",
    "canonical_links": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS n FROM orders)
SELECT CASE k % 5 WHEN 0 THEN 'section ' || k || '(' || n || ')' WHEN 1 THEN 'sections ' || k || ' to ' || (k + n) || ' of the Tax Act 1994' WHEN 2 THEN 'clause ' || n || ' of Part 2 of Schedule ' || k
  WHEN 3 THEN 'subsection (' || n || ') of section ' || k ELSE 'LC ' || k || '(' || n || '), (' || (n + 1) || '),' END AS raw,
CASE k % 5 WHEN 0 THEN 's ' || k || '(' || n || ')' WHEN 1 THEN 's ' || k || '-' || (k + n) WHEN 2 THEN 'sch ' || k || ' part 2 cl ' || n WHEN 3 THEN 's ' || k || '(' || n || ')' ELSE 's LC ' || k || '(' || n || ')+(' || (n + 1) || ')' END AS canonical FROM o""",
    "text_to_num": "SELECT p_partkey, CAST(6000000 + p_partkey % 1000 AS VARCHAR) AS number FROM part",
    "number_words": _values([(a, None if b is None else str(b)) for a, b in NUMBERS], "words, number"),
    "plural_keys": _values(FORMS, "word, forms"),
    "field_extraction": f"SELECT c AS doc_id, '[2014] NZHC ' || c AS neutral_citation, strftime(day, '%-d %B %Y') AS hearing, 'B ' || segment || ' for the plaintiff' AS counsel FROM {SECTIONS} WHERE r = 1",
    "party_split": f"SELECT c AS doc_id, name AS plaintiffs, n_name AS defendants FROM {SECTIONS} JOIN nation ON n_nationkey = nation WHERE r = 1",
    "party_roles": f"SELECT c AS doc_id, unnest(['plaintiffs', 'defendants']) AS role, unnest([name, n_name]) AS name, unnest(['plaintiff', 'defendant']) AS descriptor FROM {SECTIONS} JOIN nation ON n_nationkey = nation WHERE r = 1",
    "case_matters": f"SELECT c AS doc_id, 'UNDER' AS qualifier, 'the ' || segment || ' Act' AS value FROM {SECTIONS} WHERE r = 1",
    "case_sets": f"""WITH h AS (SELECT c, o, segment, name, n_name AS land FROM {SECTIONS} JOIN nation ON n_nationkey = nation WHERE r = 1)
SELECT c AS doc_id, CAST(unnest([1, 1, 1, 2, 2, 2]) AS BIGINT) AS set, unnest(['matter', 'party', 'party', 'matter', 'party', 'party']) AS kind, unnest(['UNDER', 'plaintiffs', 'defendants', 'IN THE MATTER OF', 'plaintiffs', 'defendants']) AS label,
  unnest(['the ' || segment || ' Act', name, land, 'order ' || o, land, name]) AS value, unnest(['CIV-2014-404-' || c, 'CIV-2014-404-' || c, 'CIV-2014-404-' || c, 'CIV-2015-404-' || o, 'CIV-2015-404-' || o, 'CIV-2015-404-' || o]) AS court_file FROM h WHERE c % 3 <> 0
UNION ALL SELECT c, 1, 'matter', 'UNDER', 'the ' || segment || ' Act Registry of ' || land, 'CIV-2014-404-' || c FROM h WHERE c % 3 = 0""",
    "case_body": f"""SELECT c AS doc_id, CAST(10 AS BIGINT) AS line_no, 'title' AS kind, CAST(NULL AS VARCHAR) AS label FROM {SECTIONS} WHERE r = 1
UNION ALL SELECT c, unnest([9 + 2 * r, 10 + 2 * r]), unnest(['paragraph', 'list']), unnest([CAST(r AS VARCHAR), 'a']) FROM {SECTIONS}""",
    "paragraph_anchors": f"SELECT c AS doc_id, CAST(r AS INT) AS number, 9 + 2 * r AS place FROM {SECTIONS}",
    "case_rules": f"""SELECT c AS doc_id, '[2014] NZHC ' || c AS neutral_citation, 'UNDER the ' || any_value(segment) || ' Act' AS matter, concat_ws(chr(10), 'BETWEEN', any_value(name), 'Plaintiff', 'AND', any_value(n_name), 'Defendant') AS parties,
'Hearing: ' || strftime(arg_min(day, r), '%-d %B %Y') AS hearing, 'Counsel: B ' || any_value(segment) || ' for the plaintiff' AS counsel, string_agg('[' || r || '] Order ' || o || ' was made.' || chr(10) || '(a) status ' || s, chr(10) ORDER BY r) AS body
FROM {SECTIONS} JOIN nation ON n_nationkey = nation GROUP BY c""",
    "judgment_tags": f"""WITH l AS (SELECT c AS doc_id, 9 + 2 * r AS place, 0 AS rule, strlen('[' || r || '] ') - 1 AS pos, o % 2 = 0 AS ok, 'n' AS kind FROM {SECTIONS} UNION ALL
  SELECT c, 9 + 2 * r, 12, 0, false, '-' FROM {SECTIONS} UNION ALL
  SELECT c, 10 + 2 * r, CASE s WHEN 'O' THEN 15 ELSE 16 END, CASE s WHEN 'O' THEN 11 ELSE 12 END, true, CASE s WHEN 'O' THEN 't' ELSE 'q' END FROM {SECTIONS} WHERE s IN ('O', 'F')),
b AS (SELECT *, coalesce(bool_or(kind = 'n' AND ok) OVER w1, false) AS body, coalesce(bool_or(kind = 'q') OVER w1, false) AS any_q, last_value(CASE WHEN kind = 't' THEN true WHEN kind = 'n' AND ok THEN false END IGNORE NULLS) OVER w1 AS t0
  FROM l WINDOW w1 AS (PARTITION BY doc_id ORDER BY place, pos, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE kind WHEN 'n' THEN ok AND (NOT body OR coalesce(t0, false)) WHEN 't' THEN body AND NOT coalesce(t0, false) WHEN 'q' THEN body ELSE false END AS counts FROM
  (SELECT * REPLACE (CASE WHEN body THEN t0 END AS t0) FROM (SELECT * REPLACE (last_value(CASE WHEN kind = 't' AND body THEN true WHEN kind = 'n' AND ok THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place, pos, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t0) FROM b))),
g AS (SELECT *, coalesce(bool_or(kind = 'n' AND counts) OVER w2, false) AS b1, coalesce(bool_or(kind = 'q' AND counts) OVER w2, false) AS q1, coalesce(last_value(CASE WHEN counts AND kind IN ('n', 't') THEN kind = 't' END IGNORE NULLS) OVER w2, false) AS t1
  FROM f WINDOW w2 AS (PARTITION BY doc_id ORDER BY place, pos, rule ROWS UNBOUNDED PRECEDING))
SELECT doc_id, place, CAST(pos AS BIGINT) AS "at", CAST(rule AS BIGINT) AS rule, counts, concat_ws(',', CASE WHEN b1 THEN 'body' ELSE 'intituling' END, CASE WHEN b1 AND NOT t1 THEN 'paragraph' END, CASE WHEN t1 THEN 'table' END, CASE WHEN q1 THEN 'quote' END) AS tags FROM g""",
    "scraped_records": "SELECT n_regionkey, n_name AS name, CAST(n_nationkey AS VARCHAR) AS number, '/n/' || n_nationkey AS href FROM nation",
    "scraped_details": "SELECT n_regionkey, CAST(count(*) AS VARCHAR) AS nations, CASE WHEN n_regionkey < 4 THEN '/r/' || (n_regionkey + 1) END AS following FROM nation GROUP BY 1",
    "crawled_records": "SELECT 'http://x.example/nations/' || n || '?page=0' AS start, (k - 1) // 7 AS place, name, CAST(c AS VARCHAR) AS number, segment FROM (SELECT c_custkey AS c, c_name AS name, c_nationkey AS n, lower(c_mktsegment) AS segment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey)",
    "validation_rules": """WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS c, contains(text, 'icense') AS w FROM documents)
SELECT doc_id, 'parties' AS fault FROM f WHERE doc_id % 2 <> 0 UNION ALL SELECT doc_id, 'citation' FROM f WHERE length(c) < 20 UNION ALL SELECT doc_id, 'waistband' FROM f WHERE NOT w""",
    "sibling_walk": """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS run FROM lineitem)
SELECT l_orderkey, l_linenumber, run FROM (SELECT *, min(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber) AS ok FROM r WHERE run > 0) WHERE ok = 1""",
    "stale_merge": "SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0 OR user_id % 2 = 0",
    "merged_state": "SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY 1",
}
