"""Full-text operators: analyzers, predicates, filters, joins of parents and children, highlighting, ranking.

Predicates are Column expressions over a token array, so they run inside the scan's stage; nothing here
needs a Python worker.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemmer import stems
from ..store import materialise

#: The English stop list of the standard search analyzer.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
MARK = ('<span class="search_match">', "</span>")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Tokens without stop words, in their English stems."""
    return stems(F.filter(tokens(text), lambda w: ~w.isin(STOP_WORDS)))


def stemmed_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, term, n, stem): how often each text has each token that is no stop word. A word is stemmed once, however many texts have it."""
    kept = F.filter(tokens(F.col(text_col)), lambda w: ~w.isin(STOP_WORDS))
    own = materialise(docs.select(id_col, F.explode(kept).alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("n")), "words")
    return own.join(own.select("term").distinct().select("term", stem(F.col("term")).alias("stem")), "term")


def stem(word: Column) -> Column:
    """The English stem of one word."""
    return F.get(stems(F.array(word)), F.lit(0))


def edge_grams(word: Column, least: int = 4, most: int = 20) -> Column:
    """Beginnings of a word from ``least`` to ``most`` letters; shorter words have none."""
    ends = F.sequence(F.lit(least), F.least(F.length(word), F.lit(most)))
    return F.when(F.length(word) >= least, F.transform(ends, lambda n: F.substring(word, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def folded_keyword(text: Column) -> Column:
    """The whole text as one token, accents and case folded."""
    return F.lower(F.translate(text, "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"))


def has_all(tokens_col: Column, words: list[str]) -> Column:
    wanted = sorted({w.lower() for w in words})
    return F.size(F.array_intersect(tokens_col, F.array(*map(F.lit, wanted)))) == len(wanted)


def has_any(tokens_col: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens_col, F.array(*(F.lit(w.lower()) for w in words)))


def has_phrase(tokens_col: Column, words: list[str]) -> Column:
    """The words next to one another, in order: tokens are joined and the phrase is looked up between blanks."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens_col, " "), F.lit(" ")), F.lit(" " + " ".join(w.lower() for w in words) + " "))


def has_prefix(tokens_col: Column, start: str) -> Column:
    return F.exists(tokens_col, lambda w: w.startswith(start.lower()))


_LEXEME = re.compile(r'"([^"]*)"|([()|+-])|([^\s()|+"]+)')


def parse_query(query: str, tokens_col: Column, every: bool = True) -> Column:
    """A simple query string as a predicate: ``-word``, ``+``, ``|``, "phrase", ``begin*`` and parentheses.

    Words side by side are all wanted where ``every``, else any one is enough. An empty query holds
    everywhere; brackets that do not match are closed at the end.
    """
    parts = [m.groups() for m in _LEXEME.finditer(query)]
    at = 0

    def words_of(text: str) -> list[str]:
        return [w for w in re.split(r"[^\w]+", text.lower()) if w]

    def atom() -> Column | None:
        nonlocal at
        phrase, sign, word = parts[at]
        at += 1
        if phrase is not None:
            own = words_of(phrase)
            return has_phrase(tokens_col, own) if own else None
        if sign == "(":
            inner = either()
            if at < len(parts) and parts[at][1] == ")":
                at += 1
            return inner
        if sign == "-":
            inner = atom() if at < len(parts) else None
            return ~inner if inner is not None else None
        if sign:
            return None
        if word.endswith("*") and words_of(word):
            return has_prefix(tokens_col, words_of(word)[-1])
        own = words_of(word)
        return has_phrase(tokens_col, own) if own else None

    def row() -> Column | None:
        nonlocal at
        found: list[tuple[Column, bool]] = []
        must = False
        while at < len(parts) and parts[at][1] not in (")", "|"):
            if parts[at][1] == "+":
                must, at = True, at + 1
                continue
            negative = parts[at][1] == "-"
            got = atom()
            if got is not None:
                found.append((got, must or negative))
            must = False
        if not found:
            return None
        if every or len(found) == 1:
            return reduce(lambda a, b: a & b, [c for c, _ in found])
        firm = [c for c, m in found if m]
        loose = [c for c, m in found if not m]
        out = [reduce(lambda a, b: a | b, loose)] if loose else []
        return reduce(lambda a, b: a & b, out + firm)

    def either() -> Column | None:
        nonlocal at
        options = [row()]
        while at < len(parts) and parts[at][1] == "|":
            at += 1
            options.append(row())
        options = [o for o in options if o is not None]
        return reduce(lambda a, b: a | b, options) if options else None

    out = either()
    while at < len(parts):  # a closing bracket without its opening one
        at += 1
        more = either()
        out = more if out is None else out & more if more is not None else out
    return F.lit(True) if out is None else out


def contains(text: Column, query: str, mode: str = "phrase") -> Column:
    """all_words, any_words or phrase."""
    own = tokens(text)
    if mode == "all_words":
        return parse_query(query, own, True)
    if mode == "any_words":
        return parse_query(query, own, False)
    return has_phrase(own, re.findall(r"\w+", query.lower()))


def year_query(year: Column, query: str) -> Column:
    """``a-b`` is a range with both ends, anything else a list of years."""
    if m := re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", query):
        return year.between(int(m[1]), int(m[2]))
    return year.isin([int(y) for y in re.findall(r"\d+", query)])


def instrument_filter(kinds: dict[str, Column], wanted: list[str], latest: Column, repealed: Column, not_in_force: Column, drop_repealed: bool, drop_not_in_force: bool, mode: str = "intended") -> Column:
    """Kinds OR-ed, and what is excluded.

    ``mode="reference"`` excludes only rows that are not the latest and meet every excluded condition
    at once; as the latest are asked for anyway, nothing more goes. ``mode="intended"`` excludes each.
    """
    keep = reduce(lambda a, b: a | b, [kinds[k] for k in wanted]) if wanted else F.lit(True)
    out = [c for c, use in ((repealed, drop_repealed), (not_in_force, drop_not_in_force)) if use]
    if mode == "reference":
        return keep & latest & ~reduce(lambda a, b: a & b, out, ~latest)
    return reduce(lambda a, b: a & ~b, out, keep & latest)


def with_child(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children, key, "left_semi")


def with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_semi")


def highlight(text: Column, words: list[str]) -> Column:
    """The text with each whole word marked, whatever the case."""
    either = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, rf"(?i)\b({either})\b", MARK[0] + "$1" + MARK[1])


def fragments(text: Column, word: str, number: int = 5, size: int = 100) -> Column:
    """Up to ``number`` stretches of about ``size`` characters around hits; the beginning where there is none."""
    half = max(0, (size - len(word)) // 2)
    around = F.regexp_extract_all(text, F.lit(rf"(?is).{{0,{half}}}\b{re.escape(word)}\b.{{0,{half}}}"), F.lit(0))
    return F.when(F.size(around) > 0, F.slice(around, 1, number)).otherwise(F.array(F.substring(text, 1, size)))


#: Names of the character entities that texts of pages use, and their characters.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "copy": "©", "reg": "®", "sect": "§", "para": "¶", "middot": "·", "eacute": "é", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß"}


def entities(text: Column) -> Column:
    """Character entities, by name, decimal and hexadecimal number, as their characters; ``&amp;`` last."""
    def one(piece: Column, i: Column) -> Column:
        body = F.substring_index(piece, ";", 1)
        rest = F.substring(piece, F.length(body) + 2, F.length(piece))
        code = F.when(body.rlike("^#[0-9]{1,7}$"), F.substring(body, F.lit(2), F.length(body)).cast("int")).when(body.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("int"))
        code = F.when(code == 160, 32).otherwise(code)
        utf16 = F.when(code < 0x10000, F.unhex(F.lpad(F.hex(code), 4, "0"))).otherwise(F.unhex(F.concat(F.hex(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), F.hex(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))))))
        char = F.decode(F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), utf16), "UTF-16BE")
        named = reduce(lambda out, kv: out.when(body == kv[0], kv[1]), ENTITIES.items(), F.when(F.lit(False), ""))
        found = F.coalesce(named, char)
        return F.when((i > 0) & F.contains(piece, F.lit(";")) & found.isNotNull(), F.concat(found, rest)).when(i > 0, F.concat(F.lit("&"), piece)).otherwise(piece)

    joined = F.array_join(F.transform(F.split(text, "&"), one), "")
    return F.replace(F.when(F.contains(text, F.lit("&")), joined).otherwise(text), F.lit("&amp;"), F.lit("&"))


def html_text(html: Column) -> Column:
    """The text of a page: no comments, scripts, styles or tags, character entities resolved, blanks squeezed."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    out = entities(F.regexp_replace(out, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def links(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, place, href) of every link, in order."""
    found = F.regexp_extract_all(html_col, F.lit(r'href="([^"]*)"'), F.lit(1))
    return df.select(id_col, F.posexplode(found).alias("place", "href"))


def postings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, tf, length): the inverted index, aggregated before it is dealt by term."""
    rows = df.select(id_col, terms(text).alias("ts")).withColumn("length", F.size("ts"))
    return rows.select(id_col, "length", F.explode("ts").alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def ranked(df: DataFrame, id_col: str, fields: dict[str, float], query: str, size: int = 25) -> DataFrame:
    """The best documents that hold every query term in one field; score is the best field's boost * tf * idf.

    Term and document frequencies come from the query's terms only, so the index is never shuffled
    whole. Ties go to the smaller identifier.
    """
    words = sorted(set(re.findall(r"\w+", query.lower())) - set(STOP_WORDS))
    if not words:
        return df.select(id_col, F.lit(0.0).alias("score")).limit(0)
    total = df.count()
    wanted = df.sparkSession.range(1).select(*(stem(F.lit(w)).alias(f"s{i}") for i, w in enumerate(words))).first()
    # A stem begins its word but for its last letter, so most words are passed over without one.
    near_words = lambda text: stems(F.filter(tokens(text), lambda w: ~w.isin(STOP_WORDS) & reduce(lambda a, b: a | b, [w.startswith(s[: max(1, len(s) - 1)]) for s in wanted])))
    each = F.array(*(F.struct(F.lit(f).alias("field"), near_words(F.coalesce(F.col(f), F.lit(""))).alias("ts")) for f in fields))
    asked = df.select(id_col, F.explode(each).alias("x")).select(id_col, "x.field", F.explode("x.ts").alias("term")).filter(F.col("term").isin(*wanted))
    counts = materialise(asked.groupBy(id_col, "field").agg(*(F.count_if(F.col("term") == s).alias(f"n_{i}") for i, s in enumerate(wanted))), "term-counts")
    sums = {r["field"]: r for r in counts.groupBy("field").agg(*(F.count_if(F.col(f"n_{i}") > 0).alias(f"d_{i}") for i in range(len(words)))).collect()}
    best = F.lit(None).cast("double")
    for f, boost in fields.items():
        if f in sums:
            score = reduce(lambda a, b: a + b, [F.col(f"n_{i}") * float(_idf(total, sums[f][f"d_{i}"])) for i in range(len(words))])
            full = reduce(lambda a, b: a & b, [F.col(f"n_{i}") > 0 for i in range(len(words))])
            best = F.when((F.col("field") == f) & full, score * boost).otherwise(best)
    out = counts.withColumn("score", best).filter("score is not null").groupBy(id_col).agg(F.max("score").alias("score"))
    return out.orderBy(F.desc("score"), id_col).limit(size)


def _idf(total: int, n: int) -> float:
    import math

    return math.log(1 + (total - n + 0.5) / (n + 0.5))


def text_parts(df: DataFrame, id_col: str, text_col: str, separator: str = "\n") -> DataFrame:
    """(id, num, data): a document's fragments by place."""
    return df.select(id_col, F.posexplode(F.split(text_col, separator)).alias("num", "data"))


def merge_parts(highlighted: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Every part, highlighted where there is a highlighted one."""
    return parts.join(highlighted.withColumnRenamed("data", "marked"), keys, "left").select(*keys, F.coalesce("marked", "data").alias("data"))
