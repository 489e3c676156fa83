"""Full-text and scalar queries over the synthetic tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citation
from ..functions import scalars as fn
from ..functions.stemmer import stems_sql
from ..operators import highlight
from ..operators import text as tx
from ..sources import documents
from .relational_queries import t

WORD_SPLIT = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')"
JOINED = f"(' ' || array_to_string(list_filter({WORD_SPLIT}, lambda w: w <> ''), ' ') || ' ')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "lang", "source", "text")


def _where(spark: SparkSession, d: str, query: str, mode: str) -> DataFrame:
    return _docs(spark, d).filter(tx.contains(F.col("text"), query, mode)).select("doc_id")


def contains_all(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "the of and", "all_words")


def contains_any(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "mente oder und que", "any_words")


def contains_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "of the", "phrase")


def contains_not(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "the -of", "all_words")


def contains_query_string(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, '("of the" | tion*) +and -mente', "all_words")


def title_search(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "part").select("p_partkey", "p_name")
    words = tx.tokens(F.col("p_name"))
    grams = F.flatten(F.transform(words, lambda w: tx.edge_grams(w)))
    return own.filter(tx.parse_query("red widget", words) | tx.has_all(grams, ["gree", "ring"])).select("p_partkey")


def year_range(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").filter(tx.year_query(F.year("o_orderdate"), "1995-1997")).select("o_orderkey")


def year_list(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").filter(tx.year_query(F.year("o_orderdate"), "1994 1996")).select("o_orderkey")


def _flags(spark: SparkSession, d: str, mode: str) -> DataFrame:
    own = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    kinds = {"act": F.col("lang") == "en", "regulation": F.col("lang") == "de", "bill": F.col("lang") == "fr"}
    keep = tx.instrument_filter(kinds, ["act", "bill"], F.col("n_chars") > 100, F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False)), True, True, mode)
    return own.filter(keep).select("doc_id")


def instrument_filters_reference(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d, "reference")


def instrument_filters_intended(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d, "intended")


def has_child(spark: SparkSession, d: str) -> DataFrame:
    turns = t(spark, d, "conversations")
    parents = turns.select("conv_id").distinct()
    return tx.with_child(parents, turns.filter(F.col("role") == "assistant").filter(tx.contains(F.col("text"), "the", "all_words")), "conv_id")


def has_parent(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).filter("lang = 'en'")
    return tx.with_parent(t(spark, d, "labels"), docs, "doc_id").select("doc_id", "quality")


def snippet_highlight(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", tx.highlight(F.col("p_name"), ["red", "ring"]).alias("marked"))


def text_fragments(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "part").select("p_partkey", tx.fragments(F.col("p_name"), "widget", 5, 10).alias("f"))
    return own.select("p_partkey", F.element_at("f", 1).alias("fragment"))


#: By stem, by beginning, and as phrases, two of which can overlap.
SOUGHT = 'ering menton* "of the" "the that"'


def highlighted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text whole, with the hits marked."""
    docs = _docs(spark, d)
    hits = highlight.spans(highlight.offsets(docs, "doc_id", "text"), SOUGHT)
    return highlight.marked(docs, "doc_id", "text", hits).select(F.col("id").alias("doc_id"), "marks", F.md5("marked").alias("marked"))


def hit_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of every text with most hits."""
    docs = _docs(spark, d)
    hits = highlight.spans(highlight.offsets(docs, "doc_id", "text"), SOUGHT)
    return highlight.fragments(docs, "doc_id", "text", hits).select(F.col("id").alias("doc_id"), "tile", "fragment")


def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return tx.ranked(_docs(spark, d), "doc_id", {"text": 1.0, "source": 3.0}, "er tion")


def stemmed_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents and occurrences of every English stem in the documents' texts."""
    own = tx.stemmed_words(t(spark, d, "documents"), "doc_id", "text")
    return own.groupBy(F.col("stem").alias("term")).agg(F.countDistinct("doc_id").alias("df"), F.sum("n").alias("cf"))


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every token."""
    own = t(spark, d, "part").select("p_partkey", tx.tokens(F.col("p_name")).alias("ts"))
    return own.select("p_partkey", F.explode("ts").alias("term")).groupBy("term").agg(F.countDistinct("p_partkey").alias("df"), F.count(F.lit(1)).alias("cf"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return tx.links(t(spark, d, "pages"), "page_id", "html").select("page_id", F.col("place").cast("long").alias("place"), "href")


def link_histogram(spark: SparkSession, d: str) -> DataFrame:
    found = tx.links(t(spark, d, "pages"), "page_id", "html")
    known = t(spark, d, "pages").select(F.explode(F.split(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), " ")).alias("w")).select(F.concat(F.lit("/"), "w").alias("href")).distinct()
    return found.join(known, "href").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def fragment_parts(spark: SparkSession, d: str) -> DataFrame:
    return tx.text_parts(_docs(spark, d), "doc_id", "text").select("doc_id", F.col("num").cast("long").alias("num"), "data")


def merge_missing_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = tx.text_parts(_docs(spark, d), "doc_id", "text").withColumn("num", F.col("num").cast("long"))
    marked = parts.filter(F.col("num") % 3 == 0).withColumn("data", F.concat(F.lit("<"), "data", F.lit(">")))
    return tx.merge_parts(marked, parts, ["doc_id", "num"])


def part_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each document that hold a word, as a sorted list of numbers."""
    parts = tx.text_parts(_docs(spark, d), "doc_id", "text").filter(tx.has_all(tx.tokens(F.col("data")), ["thonor"]))
    return parts.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("num")), ";").alias("part_matches"))


def title_from_html(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


def outline_from_html(spark: SparkSession, d: str) -> DataFrame:
    heads = F.regexp_extract_all("html", F.lit("(?s)<h[1-6]>(.*?)</h[1-6]>"), F.lit(1))
    return t(spark, d, "pages").select("page_id", F.posexplode(heads).alias("place", "heading")).select("page_id", F.col("place").cast("long").alias("place"), "heading")


def edge_grams(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").select("n_name", F.array_join(tx.edge_grams(F.lower("n_name")), "|").alias("grams"))


def best_by_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "part").select("p_partkey", "p_name", F.levenshtein("p_name", F.lit("red bold")).alias("distance"))
    return own.agg(F.min(F.struct("distance", "p_partkey", "p_name")).alias("b")).select("b.distance", "b.p_partkey", "b.p_name")


def mode_value(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max(F.struct("n", (-F.col("l_quantity")).alias("q"))).alias("m")).select((-F.col("m.q")).alias("mode"), F.col("m.n").alias("n"))


def minmax_bounds(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


def date_formats(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t(spark, d, "orders").select("o_orderkey", fn.long_date(day).alias("long_date"), fn.padded_date(day).alias("padded"), fn.safe_date(F.date_format(day, "yyyy-MM-dd")).alias("back"), fn.guarded_long_date(F.concat(F.lit("on "), fn.long_date(day))).alias("guarded"))


def safe_dates(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("nulldate")
    return t(spark, d, "orders").select("o_orderkey", fn.safe_date(s).alias("day"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_join(F.map_keys(F.from_json("props", "map<string,string>")), ",").alias("keys"))


def map_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").select("event_id", F.explode(F.map_entries(F.from_json(F.coalesce("props", F.lit("{}")), "map<string,string>"))).alias("e"))
    return rows.select("event_id", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def principal_flag(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    return p.select("p_partkey", (~F.col("p_name").ilike("%ring%")).alias("principal"), F.concat_ws("-", "p_partkey", "p_size").alias("id"), ((F.col("p_type").isNull()) | (F.col("p_type") == "")).alias("blank"), fn.version_text(F.col("p_size")).alias("version"))


def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", fn.clean_title(c).alias("title"), fn.label(c).alias("label"), fn.mostly_upper(c).alias("upper"), fn.is_title(c).alias("caps"))


def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Small text functions on names with what they take away put in."""
    n = F.col("p_name")
    return t(spark, d, "part").select(
        "p_partkey", fn.strip_namespace(F.concat(F.lit("{urn:x}"), "p_brand")).alias("tag"), fn.squeeze(F.concat(n, F.lit("   \x01x"))).alias("squeezed"), fn.trailing_number(F.col("p_brand")).alias("digits"),
        fn.text_equal(F.concat(F.lit(" "), n), n).alias("same"), fn.remove_nbsp(F.concat(n, F.lit("\u00a0x\u2060"))).alias("blank"), fn.query_string(find=n, id=F.lit(None)).alias("query"),
        citation.replace_number_udf(F.concat(F.lit("section twelve of "), n)).alias("numbered"), documents.data_uri(n.cast("binary"), F.lit("jpg")).alias("picture"),
    )


def location_helpers(spark: SparkSession, d: str) -> DataFrame:
    """A location's pieces, locations without those that the next one goes on from, and slices of a list."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    said = F.concat(F.lit("s "), k, F.lit("("), n, F.lit(")(a), cl "), n)
    every = F.array(F.concat(F.lit("s "), k), F.concat(F.lit("s "), k, F.lit("("), n, F.lit(")")), F.concat(F.lit("s "), k, F.lit("0")), F.concat(F.lit("s "), k, F.lit("01")))
    slices = fn.consecutive_slices(F.array(k, n, k, n, k), [1, 4])
    return t(spark, d, "orders").select("o_orderkey", F.array_join(fn.location_tokens(said), "|").alias("pieces"), F.array_join(citation.merged_locations(every), ";").alias("merged"), F.array_join(F.transform(slices, lambda x: F.array_join(x.cast("array<string>"), ",")), "|").alias("slices"))


def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    q, x = F.col("l_quantity"), F.col("l_discount") * 100
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.gap(q, q + 5, x, x + 2).alias("gap"), fn.signed_gap(q, q + 5, x, x + 2).alias("signed"))


QUERIES = {f.__name__: f for f in (
    contains_all, contains_any, contains_phrase, contains_not, contains_query_string, title_search, year_range, year_list, instrument_filters_reference, instrument_filters_intended, has_child, has_parent,
    snippet_highlight, text_fragments, highlighted_texts, hit_fragments, ranked_search, stemmed_terms, term_counts, html_text, html_links, link_histogram, fragment_parts, merge_missing_parts, part_search, title_from_html, outline_from_html, edge_grams,
    best_by_edit_distance, mode_value, minmax_bounds, date_formats, safe_dates, json_props, map_entries, principal_flag, text_cleaning, text_helpers, location_helpers, interval_gaps,
)}

LINKS = "(SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS place FROM pages)"
PARTS = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS data, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS num FROM documents)"
FLAGS = "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND n_chars > 100"
HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
 '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g'))"""

SPANS = rf"""WITH w1 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS word, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), 1) AS place, unnest(list_resize(regexp_split_to_array(text, '[\p{{L}}\p{{N}}_]+'), len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')))) AS gap FROM documents),
w2 AS (SELECT doc_id, place, lower(word) AS term, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) AS stop, length(word) AS size FROM w1),
w AS (SELECT doc_id, place, term, stop - size AS start, stop, lead(term) OVER (PARTITION BY doc_id ORDER BY place) AS next, lead(stop) OVER (PARTITION BY doc_id ORDER BY place) AS far FROM w2),
v AS (SELECT DISTINCT term FROM w WHERE term LIKE 'er%' AND term NOT IN ({', '.join(f"'{x}'" for x in tx.STOP_WORDS)})), st AS (SELECT term FROM ({stems_sql("v")}) WHERE stem = 'er'),
h AS (SELECT doc_id, start, stop FROM w WHERE term IN (FROM st) OR term LIKE 'menton%' UNION ALL SELECT doc_id, start, far FROM w WHERE (term = 'of' AND next = 'the') OR (term = 'the' AND next = 'that')),
g AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seen FROM h),
k AS (SELECT *, sum(CASE WHEN start < seen THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS grp FROM g), m AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM k GROUP BY doc_id, grp)"""

ORACLES = {
    "highlighted_texts": f"""{SPANS}, p AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM m),
x AS (SELECT doc_id, CAST(count(*) AS INT) AS marks, max(stop) AS last, string_agg(substr(text, before + 1, start - before) || '{tx.MARK[0]}' || substr(text, start + 1, stop - start) || '{tx.MARK[1]}', '' ORDER BY start) AS s FROM p JOIN documents USING (doc_id) GROUP BY 1)
SELECT d.doc_id, coalesce(marks, 0) AS marks, md5(coalesce(s || substr(text, last + 1), text)) AS marked FROM documents d LEFT JOIN x USING (doc_id)""",
    "hit_fragments": rf"""{SPANS}, q AS (SELECT doc_id, start // 100 AS tile, count(*) AS hits, greatest(100, max(stop) - (start // 100) * 100) AS size FROM m GROUP BY 1, 2),
b AS (SELECT doc_id, tile, size, text, CASE WHEN tile > 0 AND regexp_matches(substr(text, tile * 100, 1), '[\p{{L}}\p{{N}}_]') THEN length(regexp_extract(substr(text, tile * 100 + 1, size), '^[\p{{L}}\p{{N}}_]+')) ELSE 0 END AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, tile) AS rk FROM q) JOIN documents USING (doc_id) WHERE rk <= 5),
p AS (SELECT b.*, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id, tile ORDER BY start), tile * 100 + cut) AS before FROM b JOIN m USING (doc_id) WHERE m.start // 100 = tile),
x AS (SELECT doc_id, tile, any_value(text) AS text, max(stop) AS last, any_value(tile * 100 + size) AS until, string_agg(substr(text, before + 1, start - before) || '{tx.MARK[0]}' || substr(text, start + 1, stop - start) || '{tx.MARK[1]}', '' ORDER BY start) AS s FROM p GROUP BY 1, 2)
SELECT doc_id, tile, s || substr(text, last + 1, until - last) AS fragment FROM x UNION ALL SELECT doc_id, 0, substr(text, 1, 100) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM m)""",
    "contains_all": f"SELECT doc_id FROM documents WHERE {JOINED} LIKE '% the %' AND {JOINED} LIKE '% of %' AND {JOINED} LIKE '% and %'",
    "contains_any": f"SELECT doc_id FROM documents WHERE {JOINED} LIKE '% mente %' OR {JOINED} LIKE '% oder %' OR {JOINED} LIKE '% und %' OR {JOINED} LIKE '% que %'",
    "contains_phrase": f"SELECT doc_id FROM documents WHERE {JOINED} LIKE '% of the %'",
    "contains_not": f"SELECT doc_id FROM documents WHERE {JOINED} LIKE '% the %' AND {JOINED} NOT LIKE '% of %'",
    "contains_query_string": f"SELECT doc_id FROM documents WHERE ({JOINED} LIKE '% of the %' OR {JOINED} LIKE '% tion%') AND {JOINED} LIKE '% and %' AND {JOINED} NOT LIKE '% mente %'",
    "title_search": "SELECT p_partkey FROM part WHERE (p_name LIKE '%red%' AND p_name LIKE '%widget%') OR (p_name LIKE 'green%' AND p_name LIKE '%ring%')",
    "year_range": "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997",
    "year_list": "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1994, 1996)",
    "instrument_filters_reference": FLAGS,
    "instrument_filters_intended": FLAGS + " AND coalesce(toxic, 0) <> 1 AND coalesce(quality, 1) <> 0",
    "has_child": f"SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND {JOINED} LIKE '% the %'",
    "has_parent": "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "snippet_highlight": r"""SELECT p_partkey, regexp_replace(p_name, '\b(ring|red)\b', '<span class="search_match">\1</span>', 'gi') AS marked FROM part""",
    "text_fragments": r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\bwidget\b') THEN regexp_extract(p_name, '.{0,2}\bwidget\b.{0,2}') ELSE substr(p_name, 1, 10) END AS fragment FROM part",
    "ranked_search": rf"""WITH w AS (SELECT doc_id, f, unnest(list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')) AS t FROM (SELECT doc_id, 'text' AS f, text AS x FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)),
p AS (SELECT t AS term FROM w WHERE t LIKE 'e%' OR t LIKE 'tio%' GROUP BY 1), z AS (SELECT doc_id, f, stem AS s FROM w JOIN ({stems_sql("p")}) ON t = term),
n AS (SELECT doc_id, f, count(*) FILTER (s = 'er') AS a, count(*) FILTER (s = 'tion') AS b FROM z GROUP BY 1, 2), k AS (SELECT count(*) AS total FROM documents),
d AS (SELECT f, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM n GROUP BY 1)
SELECT doc_id, max((a * ln(1 + (total - da + 0.5) / (da + 0.5)) + b * ln(1 + (total - db + 0.5) / (db + 0.5))) * CASE f WHEN 'source' THEN 3.0 ELSE 1.0 END) AS score FROM n JOIN d USING (f), k WHERE a > 0 AND b > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
    "stemmed_terms": rf"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS term FROM documents),
u AS (SELECT term, doc_id, count(*) AS n FROM w WHERE term NOT IN ({', '.join(f"'{x}'" for x in tx.STOP_WORDS)}) GROUP BY 1, 2), v AS (SELECT DISTINCT term FROM u)
SELECT stem AS term, count(DISTINCT doc_id) AS df, CAST(sum(n) AS BIGINT) AS cf FROM u JOIN ({stems_sql("v")}) USING (term) GROUP BY 1""",
    "term_counts": "SELECT term, count(DISTINCT p_partkey) AS df, count(*) AS cf FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part) GROUP BY 1",
    "html_text": f"SELECT page_id, {HTML} AS text FROM pages",
    "html_links": f"SELECT page_id, place, href FROM {LINKS}",
    "link_histogram": f"SELECT page_id, href, count(*) AS n FROM {LINKS} WHERE href IN (SELECT '/' || unnest(string_split(regexp_extract(html, '<h1>(.*?)</h1>', 1), ' ')) FROM pages) GROUP BY 1, 2",
    "fragment_parts": f"SELECT doc_id, num, data FROM {PARTS}",
    "merge_missing_parts": f"SELECT doc_id, num, CASE WHEN num % 3 = 0 THEN '<' || data || '>' ELSE data END AS data FROM {PARTS}",
    "part_search": f"SELECT doc_id, string_agg(num, ';' ORDER BY num) AS part_matches FROM {PARTS} WHERE {JOINED.replace('text', 'data')} LIKE '% thonor %' GROUP BY 1",
    "title_from_html": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages",
    "outline_from_html": "SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h[1-6]>(.*?)</h[1-6]>', 1)) AS heading, generate_subscripts(regexp_extract_all(html, '(?s)<h[1-6]>(.*?)</h[1-6]>', 1), 1) - 1 AS place FROM pages",
    "edge_grams": "SELECT n_name, coalesce((SELECT string_agg(substr(lower(n_name), 1, k), '|' ORDER BY k) FROM range(4, 21) r(k) WHERE k <= length(n_name)), '') AS grams FROM nation",
    "best_by_edit_distance": "SELECT CAST(levenshtein(p_name, 'red bold') AS INT) AS distance, p_partkey, p_name FROM part ORDER BY 1, 2 LIMIT 1",
    "mode_value": "SELECT l_quantity AS mode, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "minmax_bounds": "SELECT l_suppkey, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1",
    "date_formats": "SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS long_date, strftime(o_orderdate, '%d ') || rpad(strftime(o_orderdate, '%B'), 9, ' ') || strftime(o_orderdate, ' %Y') AS padded, CAST(o_orderdate AS DATE) AS back, CAST(o_orderdate AS DATE) AS guarded FROM orders",
    "safe_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, array_to_string(json_keys(props), ',') AS keys FROM events",
    "map_entries": "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events",
    "principal_flag": "SELECT p_partkey, p_name NOT ILIKE '%ring%' AS principal, p_partkey || '-' || p_size AS id, (p_type IS NULL OR p_type = '') AS blank, printf('%.1f', CAST(p_size AS DOUBLE)) AS version FROM part",
    "text_cleaning": r"SELECT doc_id, regexp_replace(trim(text, ' '), '[\n\r]+', ' ', 'g') AS title, trim(regexp_replace(translate(lower(text), '()', '  '), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS label, length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 >= length(text) AS upper, (upper(text) = text AND regexp_matches(text, '[A-Z]')) AS caps FROM documents",
    "text_helpers": """SELECT p_partkey, p_brand AS tag, p_name || ' x' AS squeezed, regexp_extract(p_brand, '[0-9]+$') AS digits, true AS same, p_name || ' x' AS blank, 'find=' || replace(p_name, ' ', '+') AS query,
'section 12 of ' || p_name AS numbered, 'data:image/jpeg;base64,' || base64(encode(p_name)) AS picture FROM part""",
    "location_helpers": """SELECT o_orderkey, 's|' || o_orderkey || '|(' || o_custkey || ')|(a)|cl|' || o_custkey AS pieces, 's ' || o_orderkey || '(' || o_custkey || ');s ' || o_orderkey || '0;s ' || o_orderkey || '01' AS merged,
o_orderkey || '|' || o_custkey || ',' || o_orderkey || ',' || o_custkey AS slices FROM orders""",
    "interval_gaps": "SELECT l_orderkey, l_linenumber, greatest(0.0, l_discount * 100 - l_quantity - 5, l_quantity - l_discount * 100 - 2) AS gap, CASE WHEN l_discount * 100 > l_quantity + 5 THEN l_discount * 100 - l_quantity - 5 WHEN l_quantity > l_discount * 100 + 2 THEN l_discount * 100 + 2 - l_quantity ELSE 0.0 END AS signed FROM lineitem",
}
