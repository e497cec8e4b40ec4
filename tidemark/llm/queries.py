"""The thin queries: each applies one operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_text

    return score_text(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_file import token_file

    return token_file(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_jaccard_join, op2_license, op3_decontaminate, op4_language, op5_html, op6_lm_score, op7_bpe, op8_quality, op9_toxicity, op10_token_file)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The other operators are trained models, a tokenizer's bytes, a parser or a file format, which SQL cannot express.
ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
      f AS (SELECT doc_id, unnest(s) AS x FROM s), n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS k FROM s),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
      l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), k AS (SELECT a, count(*) AS k FROM e GROUP BY 1),
      r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
      SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(root) AS component_id, CASE WHEN n.n > 0 THEN min(n.doc_id) OVER (PARTITION BY n.k) END AS class_id, coalesce(any_value(k.k), 0) AS n_links FROM n JOIN r ON r.doc_id = n.doc_id LEFT JOIN k ON k.a = n.doc_id GROUP BY n.doc_id, n.n, n.k""",
    "op3_decontaminate": rf"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
      v AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' ')) END) AS s FROM i WHERE len(w) > 0),
      p AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM v) WHERE len(w) >= m), t AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM p),
      h AS (SELECT t.doc_id, t.k, t.m, v.item_id FROM t JOIN v ON v.m = t.m AND v.s = t.s), x AS (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS at FROM h), c AS (SELECT doc_id, count(*) AS n_hit FROM x GROUP BY 1),
      g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
      FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id""",
}
