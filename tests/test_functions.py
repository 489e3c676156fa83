from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlow.functions import citation, numbers, scalars
from marlow.operators import graph, text, tree


@pytest.mark.parametrize(("words", "value"), [("one", 1), ("twelve hundred", 1200), ("six million four hundred thousand five", 6400005), ("four decillion", 4 * 10**33)])
def test_number_words(words, value):
    assert numbers.words_to_number(words) == value


def test_unknown_number_word_raises():
    with pytest.raises(ValueError, match="not a number word"):
        numbers.words_to_number("twelve apples")


def test_ordinals_go_behind_their_unit():
    assert numbers.ordinals_behind("the fourth schedule and the thirty ninth section") == "the schedule fourth and the section thirty ninth"
    assert numbers.replace_number("schedule thirty ninth, part two") == "schedule 39, part two"


@pytest.mark.parametrize(("raw", "path"), [("sections HM 51 and", "s HM 51"), ("LC 1(3A), (3B),", "s LC 1(3A)+(3B)"), ("section 57B of the Tax Administration Act 1994", "s 57B"), ("Section EH 28", "s EH 28"), ("hcr 10.5", "hcr 10.5"), ("rr 12.1(2)", "r 12.1(2)"), (None, None)])
def test_canonical_links(raw, path):
    assert citation.canonical_link(raw) == path


def test_word_forms():
    assert citation.word_forms("child") == ("child", "children", "childrens", "childs")
    assert citation.word_forms("Capital letters") == ("Capital letter", "Capital letters")


def test_merge_locations():
    assert citation.merge_locations(["s 1", "s 1(2)", "s 1(2)(a)", "cl 3"]) == ["s 1(2)(a)", "cl 3"]
    assert citation.merge_locations(["s 1", "s 10", "cl 3", "cl 3"]) == ["s 1", "s 10", "cl 3"]


def test_merged_locations(spark):
    rows = spark.createDataFrame([(["s 1", "s 1(2)", "cl 3"],), (["s 1", "s 10"],), ([],)], "p array<string>")
    assert [r.m for r in rows.select(citation.merged_locations(F.col("p")).alias("m")).collect()] == [["s 1(2)", "cl 3"], ["s 1", "s 10"], []]


def test_scalars(spark):
    df = spark.sql(r"SELECT 'a b⁠c' AS n, 'color: red; top : 4px' AS style, array(1, 2, 3, 4, 5) AS xs, 's 2(1)(a), cl 3' AS loc, 'x12' AS t")
    r = df.select(scalars.remove_nbsp(F.col("n")).alias("n"), scalars.style_map(F.col("style")).alias("m"), scalars.consecutive_slices(F.col("xs"), [1, 4]).alias("s"), scalars.location_tokens(F.col("loc")).alias("l"), scalars.trailing_number(F.col("t")).alias("t"), scalars.text_equal(F.lit(" a "), F.lit("a")).alias("e"), scalars.text_equal(F.lit("*"), F.lit("b")).alias("w"), scalars.query_string(find=F.lit("a b"), id=F.lit(None)).alias("q")).first()
    assert (r.n, r.m, r.s, r.l, r.t, r.e, r.w, r.q) == ("a bc", {"color": "red", "top": "4px"}, [[1], [2, 3, 4]], ["s", "2", "(1)", "(a)", "cl", "3"], "12", True, True, "find=a+b")


@pytest.mark.parametrize(("query", "hits"), [("justice -prison", [1]), ('"prison of"', [2]), ("just*", [1, 2]), ("(justice | law) +order", [3]), ("", [1, 2, 3]), (")(", [1, 2, 3]), ("-", [1, 2, 3])])
def test_query_strings(spark, query, hits):
    rows = spark.createDataFrame([(1, "Justice is done"), (2, "justice in the prison of old"), (3, "law and order")], "id int, t string")
    assert sorted(r.id for r in rows.filter(text.parse_query(query, text.tokens(F.col("t")))).collect()) == hits


def test_paths_of_broken_documents():
    assert tree.parse(None) == tree.parse("<a>") == []
    with pytest.raises(tree.PathError):
        tree.lookup([], "s 1")


def test_cycles_are_broken(spark):
    edges = spark.createDataFrame([(1, 2, 1990), (2, 3, 1980), (3, 1, 2000), (4, 3, 1970)], "child long, parent long, year int")
    assert sorted(tuple(r) for r in graph.cyclic_edges(edges).collect()) == [(1, 2), (2, 3), (3, 1)]
    assert sorted((r.child, r.parent) for r in graph.break_cycles(edges, "year").collect()) == [(1, 2), (3, 1), (4, 3)]


def test_stream_refresh(spark, tmp_path):
    from marlow.streaming import incremental

    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "id long, updated int, v string"
    for rows in ([(1, 1, "a"), (2, 5, "b"), (1, 3, "c")], [(1, 2, "late"), (2, 6, "new"), (3, 1, "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.refresh(spark.readStream.schema(schema).parquet(source), table, "id", "updated", str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in incremental.current(spark, table).collect()) == [(1, 3, "c"), (2, 6, "new"), (3, 1, "x")]
