"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def remove_nbsp(s: Column) -> Column:
    """No-break spaces become spaces, word joiners go."""
    return F.translate(s, " ⁠", " ")


def text_equal(a: Column, b: Column) -> Column:
    """Equal but for blanks around; both empty or null are equal; ``*`` on either side matches all."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    return (x == "*") | (y == "*") | (x == y)


def clean_title(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"[\n\r]+", " ")


def strip_namespace(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^\{[^}]*\}", "")


def trailing_number(s: Column) -> Column:
    return F.regexp_extract(s, r"(\d+)$", 1)


def squeeze(s: Column) -> Column:
    """Control characters go, runs of blanks become one."""
    return F.regexp_replace(F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), " {2,}", " ")


def label(s: Column) -> Column:
    """A label for comparison: lower case, brackets to blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(s), "()", "  "), r"\s+", " "))


def style_map(style: Column) -> Column:
    """A CSS style string as a map."""
    parts = F.filter(F.split(style, ";"), lambda p: F.contains(p, F.lit(":")))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value"))))


def consecutive_slices(items: Column, ends: list[int]) -> Column:
    """Slices between consecutive ends; what follows the last end is dropped."""
    starts = [0, *ends[:-1]]
    return F.array(*(F.slice(items, a + 1, max(0, b - a)) for a, b in zip(starts, ends, strict=True)))


def is_title(s: Column) -> Column:
    return (F.upper(s) == s) & s.rlike("[A-Z]")


def mostly_upper(s: Column) -> Column:
    """At least half of the characters are capitals."""
    return F.length(F.regexp_replace(s, "[^A-Z]", "")) * 2 >= F.length(s)


def location_tokens(s: Column) -> Column:
    """``s 2(1)(a), cl 3`` as its pieces."""
    return F.filter(F.transform(F.split(F.regexp_replace(s, r"\(", " ("), r"[,\s]+"), lambda p: F.trim(p)), lambda p: p != "")


def query_string(**parts: Column) -> Column:
    """URL-encoded ``key=value`` pairs joined by ``&``; null values are left out."""
    return F.concat_ws("&", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in parts.items()))


def safe_date(s: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date, or null on anything else."""
    return F.try_to_timestamp(s, F.lit(pattern)).cast("date")


def long_date(d: Column) -> Column:
    """``D Month YYYY`` without padding."""
    return F.date_format(d, "d MMMM yyyy")


def padded_date(d: Column) -> Column:
    """``DD Month YYYY`` with the month padded to nine characters."""
    return F.concat(F.date_format(d, "dd"), F.lit(" "), F.rpad(F.date_format(d, "MMMM"), 9, " "), F.lit(" "), F.date_format(d, "yyyy"))


def guarded_long_date(s: Column) -> Column:
    """A day-month-year text as a date; null where it is not one."""
    hit = F.regexp_extract(F.coalesce(s, F.lit("")), rf"(\d{{1,2}} (?:{MONTHS}) \d{{4}})", 1)
    return F.when(hit != "", F.try_to_timestamp(hit, F.lit("d MMMM yyyy")).cast("date"))


def version_text(v: Column) -> Column:
    return F.format_string("%.1f", v.cast("double"))


def gap(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """Distance between two intervals, 0 where they overlap."""
    return F.greatest(F.lit(0.0), low2 - high1, low1 - high2)


def signed_gap(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """As ``gap``, negative where the second lies before the first."""
    return F.when(low2 > high1, low2 - high1).when(low1 > high2, high2 - low1).otherwise(0.0)


def column_share(width: Column, total: Column) -> Column:
    """A column's width as whole percents of the table's."""
    return F.floor(100 / total) * width


def leading_points(leading: Column, factor: float = 1.0) -> Column:
    """A line's leading as whole points."""
    return F.round(leading * factor).cast("int")


def pixels(style: Column, names: list[str]) -> Column:
    """A style map in which bare numbers of the named properties get a ``px``."""
    return F.transform_values(style, lambda k, v: F.when(k.isin(*names) & v.rlike(r"^-?\d+(\.\d+)?$"), F.concat(v, F.lit("px"))).otherwise(v))


def normalise_space(s: Column) -> Column:
    """Blanks at the ends off, runs of white space one blank."""
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def before(s: Column, mark: str) -> Column:
    """What stands before the first mark; empty where there is none."""
    return F.when(F.contains(s, F.lit(mark)), F.substring_index(s, mark, 1)).otherwise(F.lit(""))


def after(s: Column, mark: str) -> Column:
    """What stands after the first mark; empty where there is none."""
    at = F.locate(mark, s)
    return F.when(at > 0, F.substring(s, at + len(mark), F.length(s))).otherwise(F.lit(""))


def id_list(s: Column, mark: str = ";") -> Column:
    """A list of ids in a string as an array, without empty entries."""
    return F.filter(F.transform(F.split(s, rf"\{mark}"), lambda p: F.trim(p)), lambda x: x != "")
