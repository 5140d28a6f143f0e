"""The ``opN_*`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.llm import (bpe, fingerprints, html_extract, lexical, licenses, mixing, neardup, quality, quotes,
                             substrings, token_files, topk, whitening)


#: Where the vocabulary files of the queries come from.
TOKENIZERS = public_tokenizers.path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_table(spark, sf_dir, "documents")).select("doc_id", "source", "mix.*")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.scratch_path(spark)
    token_files.write(_table(spark, sf_dir, "documents"), path, TOKENIZERS("word_bpe_49k.json"), end_id=2)
    return token_files.digest(spark, path)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in reply order, without quotations."""
    return quotes.threads(_table(spark, sf_dir, "conversations"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.tiktoken"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their expected grade, tail probability and whether the classifier selects them."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return (quality.score(docs.select("doc_id", "text"), model)
            .select("doc_id", "expected_grade", "p_best", (F.col("p_best") >= quality.THRESHOLD).alias("selected")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).drop("dim")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the documents without passages of 50 words or more that a smaller document has."""
    return (substrings.repeats(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))


#: DuckDB SQL of exact top-k: integer components, all pairs of queries and candidates.
_TOP_K_SQL = """
WITH valid AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
    FROM valid q JOIN valid c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: DuckDB SQL of ranked lexical search: postings of all terms, joined with the items' terms.
_LEXICAL_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
held AS (SELECT r, doc_id, ts, len(ts) AS n FROM words WHERE len(ts) > 0),
facts AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM held),
tfs AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf
        FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM held) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM tfs, facts GROUP BY t, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scored AS (
    SELECT item_id, r, any_value(doc_id) AS doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (t) JOIN tfs USING (t), facts GROUP BY item_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                  doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

#: DuckDB SQL of substring dedup: all windows of 50 words, and the words that repeated ones cover.
_SUBSTRINGS_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (
    SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
    FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM words)),
gone AS (
    SELECT DISTINCT r, i + k AS i
    FROM (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS smallest FROM windows)
          WHERE doc_id > smallest), range(50) AS t(k)),
kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
    FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM words)
    ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""


#: Name: (query, DuckDB SQL or None).
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_fingerprints": (op1_fingerprints, None),
    "op2_licenses": (op2_licenses, None),
    "op3_mixing": (op3_mixing, None),
    "op4_html": (op4_html, None),
    "op5_token_files": (op5_token_files, None),
    "op6_top_k": (op6_top_k, _TOP_K_SQL),
    "op7_near_duplicates": (op7_near_duplicates, None),
    "op8_quotes": (op8_quotes, None),
    "op9_bpe": (op9_bpe, None),
    "op10_quality": (op10_quality, None),
    "op11_whitening": (op11_whitening, None),
    "op12_lexical": (op12_lexical, _LEXICAL_SQL),
    "op13_substrings": (op13_substrings, _SUBSTRINGS_SQL),
}
