"""Corpus preparation in four stages: language ID, near-duplicate removal, repeated passages, packing.

Each stage is (name, function of (spark, docs, sf_dir)) and gets what its predecessor kept. The columns of documents
(doc_id, text, lang, source, n_chars) come through all stages but the last, whose rows are the pieces of packed
sequences; so do further columns, whatever their names, for no stage looks at them or writes to them. Only doc_id and
text are needed. An empty table goes through all stages and gives no pieces.

Null and empty texts, and texts without letters, are rejected by the first stage. Rows with a null doc_id are documents:
no stage removes one as a copy of another, since nothing tells them apart, but their passages are compared (they come
first). Rows that share a doc_id are one document for the second stage (they stay or go together) and documents of their
own for the others; rows alike in doc_id and text lose the same passages. Ties are settled by the smaller doc_id. Texts of
any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from granary.llm import jaccard_join, language_id, packing, substring_dedup
from granary.llm.common import settle
from granary.llm.queries import _trains

#: Documents whose most likely language is less likely than this, or that have no letters, are rejected.
LEAST_SCORE = 0.4
#: Words of a shingle and likeness in percent from which documents are near duplicates.
SHINGLE, LIKE = 5, 80
#: No query gives the rows of the classifier, of the joins' hashes or of the tokenizer in SQL.
ORACLE_SQL = None


def _parcelled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all else in one column, out of reach of the operators' own columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("string")).alias("__rest"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__rest.`{c}`").alias(c) for c in columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows. It is fitted on the labelled ones of docs itself (lang may be
    missing: then nothing is known, and nothing is rejected but texts without letters)."""
    named = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model = language_id.fit_model(named.filter(_trains()))
    found = language_id.identify(_parcelled(docs), model)
    if model.labels:
        kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    else:
        kept = found.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return _unpacked(kept, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    found = jaccard_join.shingle_components(docs, n=SHINGLE, num=LIKE)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one too; those of which nothing is left go. A document that
    loses nothing keeps its text as it was. n_chars, where it is there, is of the text that is left."""
    found = substring_dedup.remove_repeats(_parcelled(docs)).filter("n_removed = 0 or n_removed < n_words")
    kept = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        now = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__rest.n_chars"))
        kept = kept.withColumn("__rest", F.col("__rest").withField("n_chars", now))
    return _unpacked(kept, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; ids are those of the tokenizer of the public vocabulary."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
