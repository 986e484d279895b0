"""The queries of this subpackage, each over its whole table, and their SQL for DuckDB.

An operator that SQL can't express has no entry in ORACLES; it is tested against
a brute-force version in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_groups
from .language import languages
from .licenses import license_scan
from .near_dedup import near_groups
from .packing import pack
from .pieces import piece_digests
from .pii import pseudonyms
from .scoring import scores
from .top_k import top_k
from .toxicity import toxicity

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles are at least 80 % alike."""
    return near_groups(table(spark, sf_dir, "documents"), size=4, percent=80)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"), byte_bpe_path(), capacity=2048, end=0)


def op2_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms for the personal data in it."""
    docs = table(spark, sf_dir, "documents")
    return pseudonyms(docs.select("doc_id", "text"))


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text."""
    return scores(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return languages(table(spark, sf_dir, "documents"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return piece_digests(table(spark, sf_dir, "documents"), piece_model_path())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every text."""
    return license_scan(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), e AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), r AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (
  SELECT w.doc_id, least(w.doc_id, coalesce(min(r.y), w.doc_id)) AS component_id
  FROM w LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_pii_feistel, op3_best_fit_packing, op4_toxicity_grammar, op5_exact_dedup, op6_context_mixing, op7_language_id, op8_sentencepiece, op9_license_scan, op10_exact_top_k)}
