"""One query for each operator, over its whole table, and DuckDB SQL where it can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file that packing counts with by default; ``pack_documents`` takes any other."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.quality import score_quality

    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op5_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.html_text import extract_text

    return extract_text(_read(spark, sf_dir, "pages"))


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_minhash_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.minhash_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.repeats import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), digest=True)


def op9_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.decontaminate import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.toxicity import score_toxicity

    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


_OPERATORS = [
    op1_quality_cotraining,
    op2_embedding_collisions,
    op3_line_chunks,
    op4_license_notices,
    op5_html_tag_paths,
    op6_cost_packing,
    op7_minhash_fast_sketch,
    op8_suffix_repeats,
    op9_benchmark_containment,
    op10_toxicity_noisy_channel,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}


_COMPONENTS = """
walk AS (
  SELECT a AS id, b AS root FROM links
  UNION
  SELECT w.id, l.b FROM walk w JOIN links l ON l.a = w.root
), roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id)
"""

_OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), {_COMPONENTS}
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(r.root, m.vec_id)) AS component_id,
       m.vec_id = least(m.vec_id, coalesce(r.root, m.vec_id)) AS kept
FROM embeddings m
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = m.vec_id
LEFT JOIN roots r ON r.id = m.vec_id
"""

_OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.root, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(r.root, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN roots r ON r.id = d.doc_id
"""


def _shingles(table: str, key: str) -> str:
    return f"""
  SELECT {key}, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END) AS shingle
  FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM {table} WHERE text IS NOT NULL)"""


_OP9 = f"""
WITH d AS ({_shingles("documents", "doc_id")}
), i AS ({_shingles("benchmark", "item_id")}
), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id
), c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, n_shared, n_shared / n AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op2_embedding_collisions": _OP2, "op7_minhash_fast_sketch": _OP7, "op9_benchmark_containment": _OP9}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
