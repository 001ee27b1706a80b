"""One query for each corpus operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from granary.llm import fingerprints, html_extraction, jaccard_join, language_id, language_model, media, packing, sentencepiece_codec, substring_dedup, warc

#: Documents with this remainder of crc32(doc_id) mod FOLDS are held out of fitting the language classifier.
FOLDS, HELD = 4, 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trains(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) != HELD


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_packed", 256).alias("ids_sha256"), F.sha2("decoded_text", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.shingle_components(_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"), fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"), fingerprints.resemblance(own, after).alias("near_next"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(_table(spark, sf_dir, "pages"), strict=True)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures that the vectors of embeddings stand for, and an edited copy of each, in groups of copies."""
    return media.copy_groups(media.drawn_media(_table(spark, sf_dir, "embeddings")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit_model(docs.filter(_trains()))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~_trains()).alias("held_out"), "lang_pred", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_jaccard_join, op4_fingerprints, op5_packing, op6_lm_scoring, op7_warc, op8_media_copies, op9_language_id, op10_html_extraction)}
    return out


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM p),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM k WHERE r > 1),
g AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
b AS (SELECT h, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN b ON p.h = b.h
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op7_warc": OP7_SQL}
