"""One query per operator over its whole table, and SQL twins where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, byte_bpe, decontam, language_model, lexical, line_dedup, packing, quality, secrets, simhash, token_store, topk, warc,
)
from .common import scratch, table

#: Folder of the public vocabulary files.
TOKENIZERS = os.path.dirname(public_tokenizers.path("LICENSES.txt"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that holds a word, with its class, its links and whether it goes."""
    return line_dedup.removed_lines(_documents(spark, sf_dir).select("doc_id", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontam.leaks(_documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, through a ledger that starts empty."""
    return secrets.digest(secrets.scan(_documents(spark, sf_dir), "doc_id", "text", scratch(spark, "ledger")))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_documents(spark, sf_dir).select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary(byte_bpe.load_ranks(os.path.join(folder, "byte_bpe_50k.tiktoken")))
    encoded = byte_bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded, vocabulary)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.transactions(warc.read_records(spark, path)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_token_store(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    return token_store.store_roundtrip(_documents(spark, sf_dir).select("doc_id", "text"), os.path.join(folder, "word_bpe_49k.json"))


def op11_packing(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 ids."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return packing.digests(packing.pack(docs, os.path.join(folder, "word_bpe_49k.json")))


def op12_alignment(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Groups and links of the tokens of two tokenizers per document, with corpus-wide counts of linked pairs."""
    paths = [os.path.join(folder, name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_tokens(_documents(spark, sf_dir).select("doc_id", "text"), *paths, public_tokenizers.PATTERN)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(_documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_decontamination, op3_secret_scan, op4_top_k, op5_language_model, op6_byte_bpe, op7_quality, op8_warc,
              op9_simhash, op10_token_store, op11_packing, op12_alignment, op13_lexical_search, pipeline)
}

LINE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
p AS (SELECT *, doc_id::HUGEINT * 1000000000 + line_no AS place FROM l WHERE regexp_matches(line, '[^ \\t\\x0B\\f\\r]')),
d AS (SELECT line, min(place) AS first FROM p GROUP BY line),
s AS (SELECT line, first, list_distinct(list_filter(string_split_regex(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '')) AS ws FROM d),
t AS (SELECT first, len(ws) AS n, unnest(ws) AS w FROM s),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
r AS (SELECT first, n, w, row_number() OVER (PARTITION BY first ORDER BY df, w) AS i FROM t JOIN f USING (w)),
x AS (SELECT * FROM r WHERE i <= n - (n * 4 + 4) // 5 + 1),
c AS (SELECT DISTINCT a.first AS a, b.first AS b FROM x a JOIN x b ON a.w = b.w AND a.n * 5 >= b.n * 4 AND (a.n < b.n OR (a.n = b.n AND a.first < b.first))),
o AS (SELECT a, b, len(list_intersect(sa.ws, sb.ws)) AS common, len(sa.ws) AS na, len(sb.ws) AS nb
      FROM c JOIN s sa ON sa.first = a JOIN s sb ON sb.first = b),
m AS (SELECT a, b FROM o WHERE common * 5 >= (na + nb - common) * 4),
k AS (SELECT id, count(*) AS links, min(other) AS earliest FROM (SELECT a AS id, b AS other FROM m UNION ALL SELECT b, a FROM m) GROUP BY id)
SELECT p.doc_id, p.line_no::INTEGER AS line_no, (d.first // 1000000000)::BIGINT AS class_doc_id, (d.first % 1000000000)::INTEGER AS class_line_no,
  coalesce(k.links, 0) AS links, (least(d.first, coalesce(k.earliest, d.first)) // 1000000000)::BIGINT AS match_doc_id,
  (least(d.first, coalesce(k.earliest, d.first)) % 1000000000)::INTEGER AS match_line_no, least(d.first, coalesce(k.earliest, d.first)) < p.place AS removed
FROM p JOIN d USING (line) LEFT JOIN k ON k.id = d.first
"""

TOP_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {at}, 5))::INT >> {shift}) & 31) + 1, 1)"
_BASE32 = " || ".join(_DIGIT.format(at=5 * g + 1, shift=15 - 5 * k) for g in range(8) for k in range(4))
_ID = ("'<urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>'")


def _urn(kind: str) -> str:
    return _ID.replace("m,", f"md5('{kind}|' || page_id || '|' || payload_digest),")


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (SELECT DISTINCT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, {_urn('capture')} AS capture_id, {_urn('request')} AS request_id, {_urn('metadata')} AS metadata_id
FROM t
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": LINE_SQL, "op2_decontamination": decontam.ORACLE, "op4_top_k": TOP_SQL, "op8_warc": WARC_SQL,
}
