"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from ticklake.llm.common import table


def _vocab(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.bpe import digests
    return digests(table(spark, sf_dir, "documents"), _vocab("byte_bpe_multi_50k.tiktoken"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.minhash import near_dedup
    return near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), width=200, with_text=False)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.embed_dedup import near_dedup
    return near_dedup(table(spark, sf_dir, "embeddings"))


def op8_pivot_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.ann import search
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.secret_scan import fit, scan
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.langid import fit, predict
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.license_scan import scan
    return scan(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.html_extract import extract
    return extract(table(spark, sf_dir, "pages"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.url_filter import judge_table
    return judge_table(table(spark, sf_dir, "pages"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.token_align import align
    return align(table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"), _vocab("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ticklake.llm.conversation_repair import damage_and_repair
    return damage_and_repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_pivot_ann": op8_pivot_ann,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}

_REACH = """, reach AS (
  SELECT id, id AS other FROM vertex
  UNION
  SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a
), comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


def _op3_sql() -> str:
    return f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM good
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (a.n * b.n) >= 0.95
), vertex AS (SELECT vec_id AS id FROM embeddings){_REACH},
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.id = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id"""


def _op10_sql() -> str:
    return f"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM word
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), rare AS (SELECT g, count(*) AS f FROM each GROUP BY g
), ranked AS (
  SELECT e.doc_id, e.g, e.n, row_number() OVER (PARTITION BY e.doc_id ORDER BY r.f, e.g) AS k FROM each e JOIN rare r ON r.g = e.g
), head AS (SELECT doc_id, g FROM ranked WHERE k <= n - ((4 * n + 4) // 5) + 1
), pair AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM head a JOIN head b ON a.g = b.g AND a.doc_id <> b.doc_id
), link AS (
  SELECT p.a, p.b FROM pair p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
), vertex AS (SELECT doc_id AS id FROM documents){_REACH}
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN comp c ON c.id = s.doc_id"""


def _oracles() -> dict[str, str]:
    from ticklake.llm.license_scan import oracle_sql
    return {"op3_embedding_near_dedup": _op3_sql(), "op4_license_scan": oracle_sql(), "op10_minhash_near_dedup": _op10_sql()}


#: The other queries fit models, merge or hash bytes, or pack: no SQL form; tests hold them against brute force.
ORACLE = _oracles()

REGISTERED = (QUERIES, ORACLE)
