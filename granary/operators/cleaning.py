"""Cleaning of paged documents: repeated headers and footers, page numbers, junk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions import text as X

#: Share of a page's lines at either edge; share of a document's pages on which a line must stand to be boilerplate.
EDGE, REPEATED = 0.15, 0.35


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 0), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def edge_lines(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """The lines at the top and bottom of each page, with their signatures."""
    split = pages.select(document, page, F.split(text, "\n").alias("ls"))
    n = F.size("ls")
    edge = F.greatest(F.lit(1), F.ceil(n * F.lit(EDGE)))
    found = split.select(document, page, n.alias("n"), edge.alias("edge"), F.posexplode("ls").alias("pos", "line"))
    kept = found.filter((F.col("pos") < F.col("edge")) | (F.col("pos") >= F.col("n") - F.col("edge")))
    line = F.trim("line")
    return kept.select(document, page, line.alias("line"), X.line_signature(line).alias("signature"))


def repeated_lines(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Signatures of headers and footers: document, signature, n. A page counts each of its distinct lines; documents
    of fewer than three pages have none. Counting combines on the map side, so a signature on every page is no skew."""
    distinct = edge_lines(pages, document, page, text).distinct()
    usable = distinct.filter((F.length("signature") >= 3) & (F.col("signature") != "#"))
    counts = usable.groupBy(document, "signature").agg(F.count(F.lit(1)).alias("n"))
    total = pages.groupBy(document).agg(F.count(F.lit(1)).alias("pages"))
    least = F.greatest(F.lit(2), F.floor(F.lit(REPEATED) * F.col("pages")))
    return counts.join(total, document).filter((F.col("pages") >= 3) & (F.col("n") >= least)).select(document, "signature", "n")


def page_number_lines(found: DataFrame, page: str, number: Column, edge: int = 3) -> DataFrame:
    """Edge lines that are their own page's number."""
    last = F.max("pos").over(Window.partitionBy(page))
    own = F.regexp_extract(F.lower(F.trim("line")), r"^(?:page\s*)?(\d{1,5})$", 1)
    at_edge = (F.col("pos") < edge) | (F.col("pos") > F.col("last") - edge)
    return found.withColumn("last", last).filter(at_edge & (own == number.cast("string"))).select(page, "pos", F.trim("line").alias("line"))


def clean_pages(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """document, page, clean, cleaned_word_count: pages without the lines that their document repeats, junk, broken
    words and repeated neighbours."""
    repeated = repeated_lines(pages, document, page, text).groupBy(document).agg(F.collect_set("signature").alias("repeated"))
    told = pages.join(repeated, document, "left")
    known = F.coalesce("repeated", F.array().cast("array<string>"))
    kept = F.filter(F.transform(F.split(X.normalized_text(text), "\n"), X.squeezed), lambda x: ~F.array_contains(known, X.line_signature(x)) & ~X.junk_line(x))
    clean = F.coalesce(X.deduped_words(X.repaired_text(F.array_join(kept, "\n"))), F.lit(""))
    return told.select(document, page, clean.alias("clean")).withColumn("cleaned_word_count", F.size(X.words_of("clean")))
