"""Corpus records: dialects, sections, manifests, fingerprints, checks, histories and prompts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window, functions as F

from granary.functions import text as X

LEAST_WORDS = 10


def with_sections(lines: DataFrame, document: str, pos: str, line: str) -> DataFrame:
    """Adds ``section``: the last heading up to each line."""
    w = Window.partitionBy(document).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(X.heading(line), F.trim(F.regexp_replace(line, r"\s+", " ")))
    return lines.withColumn("section", F.last(title, ignorenulls=True).over(w))


def vector_report(vectors: DataFrame, vector: str) -> DataFrame:
    """Count, least and largest dimension, and vectors that are null or hold a number that isn't finite."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector).cast("long")).alias("least"), F.max(F.size(vector).cast("long")).alias("most"), F.sum(F.coalesce(bad, F.lit(True)).cast("long")).alias("bad"))


def with_skip_reason(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("skipped", F.when(F.size(X.words_of(text)) < LEAST_WORDS, "insufficient_usable_text"))


def partition_counts(records: DataFrame, domain: str) -> DataFrame:
    return records.groupBy(domain).agg(F.count(F.lit(1)).alias("n")).orderBy(domain)


def manifest(docs: DataFrame, domain: str, text: str) -> DataFrame:
    """One row: documents, indexed, skipped, and counts by domain."""
    by = docs.groupBy(domain).agg(F.count(F.lit(1)).alias("n"), F.sum((F.size(X.words_of(text)) >= LEAST_WORDS).cast("long")).alias("ok"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("ok") > 0, F.struct(F.col(domain).alias("d"), F.col("ok").alias("n")))))
    per = F.array_join(F.transform(pairs, lambda p: F.concat(p["d"], F.lit("="), p["n"].cast("string"))), ",")
    return by.agg(F.sum("n").alias("document_count"), F.sum("ok").alias("indexed"), (F.sum("n") - F.sum("ok")).alias("skipped"), per.alias("per_domain"))


def unified(rows: DataFrame) -> DataFrame:
    """One shape for the three dialects of records: with ``metadata``, with ``chunk_id``, and flat. Blank texts go."""
    nested, legal = F.col("metadata").isNotNull(), F.col("chunk_id").isNotNull()
    domain = F.when(nested, F.coalesce("metadata.domain", F.lit("space"))).when(legal, F.coalesce("domain", F.lit("legal"))).otherwise(F.coalesce("domain", F.lit("healthcare")))
    source = F.when(nested, F.coalesce("metadata.source", F.lit("unknown"))).when(legal, F.lit("legal")).otherwise(F.coalesce("source", F.lit("unknown")))
    out = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return out.withColumns({"domain": domain, "source": source}).drop("metadata", "chunk_id")


def combined(parts: list[DataFrame]) -> DataFrame:
    """Corpora one after the other; ids stay as they are."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Keys of which one digest is made at a time.
SPAN = 4096


def fingerprint(docs: DataFrame, key: str, text: str, version: str = "v2") -> DataFrame:
    """One digest of all texts by their keys (integers), and their number; it tells whether an index is still of this
    corpus. A tree of digests: texts of a key, keys of a span of SPAN, spans of SPAN of those, and all of these; none of
    its nodes has more than SPAN children but for rows that share a key, and for the last, which has one for each
    SPAN * SPAN keys."""
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda s: s["h"]), ",")
    by = docs.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(F.coalesce(text, F.lit("")), 256))), ","), 256).alias("h"))
    for _ in range(2):
        by = by.groupBy(F.floor(F.col("k") / SPAN).alias("s")).agg(F.sum("n").alias("n"), F.sha2(joined(F.struct("k", "h")), 256).alias("h")).withColumnRenamed("s", "k")
    return by.agg(F.sha2(F.concat(F.lit(version + ","), joined(F.struct("k", "h"))), 256).alias("fingerprint"), F.sum("n").alias("n"))


def index_metadata(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("ntotal"), F.max(F.size(vector).cast("long")).alias("dimension"), F.lit("inner_product").alias("metric"), F.count_distinct(key).alias("distinct_ids"))


def consistency(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of vectors and rows, and of either without the other (columns ``id``)."""
    sides = vectors.select("id", F.lit(1).alias("v"), F.lit(0).alias("r")).union(rows.select("id", F.lit(0), F.lit(1)))
    by = sides.groupBy("id").agg(F.sum("v").alias("v"), F.sum("r").alias("r"))
    return by.agg(F.sum("v").alias("vectors"), F.sum("r").alias("rows"), F.sum(F.when(F.col("r") == 0, F.col("v")).otherwise(0)).alias("vectors_without_row"), F.sum(F.when(F.col("v") == 0, F.col("r")).otherwise(0)).alias("rows_without_vector"))


def history(turns: DataFrame, last: int = 6, most: int = 1200) -> DataFrame:
    """conv_id, history: the last turns of user and assistant that aren't blank, cut to ``most`` characters."""
    usable = turns.filter(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    ranked = usable.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("r") <= last)
    line = F.concat("role", F.lit(": "), F.substring(F.trim("text"), 1, most))
    told = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return ranked.groupBy("conv_id").agg(F.array_join(F.transform(told, lambda t: t["line"]), "\n").alias("history"))


def json_object(rows: DataFrame, raw: str, *names: str) -> DataFrame:
    """The first JSON object of a text that may stand in a code fence; ``ok`` tells whether it could be read."""
    bare = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    out = rows.withColumn("__o", F.from_json(span, "map<string,string>"))
    return out.withColumns({n: F.try_element_at("__o", F.lit(n)) for n in names}).withColumn("ok", F.col("__o").isNotNull()).drop("__o")


def evidence_blocks(docs: DataFrame, key: str, order: str, text: str, most: int = 6, chars: int = 2500) -> DataFrame:
    """Numbered blocks of the first documents of each key."""
    ranked = docs.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("r") <= most)
    block = F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), F.substring(text, 1, chars))
    told = F.array_sort(F.collect_list(F.struct("r", block.alias("b"))))
    return ranked.groupBy(key).agg(F.array_join(F.transform(told, lambda t: t["b"]), "\n\n").alias("prompt"))
