"""The queries of the training-data operators, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, language_id, licenses, lm_scoring, ngram_join, pii, prefix_trie, quality, substring_dedup, token_files, vector_codes
from .store import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; MARLOW_TOKENIZERS names another folder to take it from."""
    if folder := os.environ.get("MARLOW_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    both = bpe.bpe_decode(bpe.bpe_encode(_table(spark, sf_dir, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"), F.array_min("hits.edits").alias("least_edits"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(_table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_all(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), out, tokenizer_path(), end_id=2)
    return token_files.read_tokens(spark, out, with_ids=False)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_trie(_table(spark, sf_dir, "conversations")).drop("digest")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe": op2_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_token_files": op9_token_files,
    "op10_licenses": op10_licenses,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_language_id": op13_language_id,
}



def _vector_codes_sql(rounds: int = 6) -> str:
    """One assignment and one set of means for each round, written out."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x, min(d) AS d, arg_min(e, d * 16 + e) AS e
  FROM (SELECT vec_id, parts.p AS p, x, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM parts JOIN b{r} ON parts.p = b{r}.p) GROUP BY 1, 2)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m
    FROM (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (p, e))""")
    steps = ", ".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS t(p)
), b0 AS (SELECT p, e, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts) WHERE e < 16
), {steps}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} JOIN kept USING (vec_id) GROUP BY 1, 2
), digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


ORACLES: dict[str, str] = {
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
), least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id FROM sets s JOIN least l USING (doc_id)
""",
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), repeated AS (SELECT s FROM windows GROUP BY 1 HAVING count(*) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows WHERE s IN (SELECT s FROM repeated)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY 1
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
    "op6_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS kept,
       text_sha256
FROM n
""",
    "op11_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos, d, n FROM (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id AS c, conv_id - conv_id % 5 AS base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_transform(range(8), lambda b: (ascii(x) >> b) & 1)))),
    lambda r, b: xor(r >> 1, CASE WHEN (xor(r, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 9 AS h, count(*) AS n FROM own GROUP BY 1
), plan AS (SELECT convs.*, least(convs.h, coalesce(b.n, 0)) AS taken FROM convs LEFT JOIN convs b ON b.c = convs.base
), steps AS (
  SELECT c, pos, d, own.n FROM plan JOIN own ON own.conv_id = base AND pos <= taken UNION ALL
  SELECT c, pos - h + taken, d, own.n FROM plan JOIN own ON own.conv_id = c AND pos > h
), paths AS (
  SELECT c, 0 AS depth, [] AS p, 0 AS w FROM plan UNION ALL
  SELECT c, pos, list(d) OVER (PARTITION BY c ORDER BY pos), n FROM steps
), lasts AS (SELECT c, max(depth) AS n FROM paths GROUP BY 1
), nodes AS (
  SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saving, coalesce(string_agg(CASE WHEN depth = n THEN c END, ',' ORDER BY c), '') AS ends
  FROM paths JOIN lasts USING (c) GROUP BY 1, 2
), children AS (SELECT p[:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), flat AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (p)
), above AS (SELECT p[:k] AS p, saving, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM flat)
), sums AS (SELECT p, CAST(sum(saving) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY 1)
SELECT a.conv_id, a.depth, up.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, sha256(a.ends) AS ends_sha256
FROM flat a JOIN sums USING (p) LEFT JOIN flat up ON a.depth > 0 AND up.p = a.p[:a.depth - 1]
""",
    "op12_vector_codes": _vector_codes_sql(),
}
