"""Queries over sources: pages as blocks, reading order, text of pages, windows of events."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import functions as F

from granary.operators import corpus, models as M, retrieval as O
from granary.plans.base import Registry, table
from granary.plans.retrieval_queries import BM25, TERM_STATS, sparse, text_queries
from granary.session import settled, shared_folder
from granary.sources import pages as P, tables as T
from granary.streaming import ingest

R = Registry()


def laid_out(spark, d):
    """Each document as a page whose lines are blocks of two columns."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    block = F.transform(
        lines,
        lambda x, i: F.struct(
            x.alias("text"), F.when(i * 2 < n, 50.0).otherwise(330.0).alias("x0"), (F.when(i * 2 < n, i).otherwise(i - F.ceil(n / 2)) * 12.0 + 20.0).alias("y0"),
            F.when(i * 2 < n, 280.0).otherwise(560.0).alias("x1"), (F.when(i * 2 < n, i).otherwise(i - F.ceil(n / 2)) * 12.0 + 30.0).alias("y1"), i.cast("int").alias("block_no"), F.lit(0).alias("block_type"),
        ),
    )
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.lit(612.0).alias("width"), F.shuffle(block, F.lit(7)).alias("blocks"))


ORDERED = r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x01-\x08\x0B-\x1F]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: length(x) >= 2), chr(10)) AS text FROM documents WHERE text IS NOT NULL"""


@R.add("reading_order", "S4 S6 S7", ORDERED)
def reading_order(spark, d):
    return P.reading_order(laid_out(spark, d)).select("doc_id", "text")


@R.add("block_overlap", "S8", """
WITH e AS (SELECT user_id, event_id, value AS x0, value + 10 + event_id % 7 AS x1, lead(value) OVER w AS y0, lead(value + 10 + event_id % 7) OVER w AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(greatest(0, least(x1, y1) - greatest(x0, y0)) / least(x1 - x0, y1 - y0), 6)::DOUBLE AS ratio FROM e WHERE y0 IS NOT NULL""")
def block_overlap(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    box = F.struct(F.col("value").alias("x0"), (F.col("value") + 10 + F.col("event_id") % 7).alias("x1"))
    rows = table(spark, d, "events").select("event_id", box.alias("a"), F.lead(box).over(w).alias("b")).filter("b is not null")
    return rows.select("event_id", F.round(P.overlap_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@R.add("page_text", "S3")
def page_text(spark, d):
    return P.html_pages(table(spark, d, "pages"))


@R.add("event_windows", "", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, d):
    return ingest.event_windows(table(spark, d, "events")).withColumn("value", F.round("value", 4))


def folder(spark, name: str) -> str:
    """A new folder among the intermediate tables."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("page_blocks_roundtrip", "S2", ORDERED)
def page_blocks_roundtrip(spark, d):
    """Pages with their blocks, written as another program would leave them, read back and put in order."""
    path = folder(spark, "blocks")
    P.write_pages(laid_out(spark, d).withColumn("height", F.lit(792.0)), path)
    return P.reading_order(P.stored_pages(spark, path, "doc_id long")).select("doc_id", "text")


@R.add("pdf_page_scan", "S1 S2", """
SELECT lang AS domain, count(*) AS pages, CAST(sum(strlen(replace(coalesce(text, ''), chr(10), ' '))) AS BIGINT) AS bytes FROM documents GROUP BY lang""")
def pdf_page_scan(spark, d):
    """Files of pages found below a folder by kind, whatever their reader: here each file has a line a page."""
    path = folder(spark, "found")
    lines = table(spark, d, "documents").select(F.translate(F.coalesce("text", F.lit("")), "\n", " ").alias("value"), F.concat(F.lit("in "), "lang").alias("domain"))
    lines.write.partitionBy("domain").option("lineSep", "\n").text(path)
    found = P.files(spark, path, "*.txt")

    def reader(content: bytes, name: str):
        for line in io.BytesIO(content):
            yield 612.0, 792.0, [(line[:-1].decode(), 50.0, 50.0, 500.0, 90.0, 0, 0)]

    pages = P.pdf_pages(found, reader).filter("error is null")
    rows = pages.join(found.select("path", "domain"), "path").select(F.regexp_replace("domain", "^domain_in_?(?:20)?", "").alias("domain"), F.octet_length(F.col("blocks")[0]["text"]).cast("long").alias("n"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("bytes"))


@R.add("file_timestamps", "F21", "SELECT true AS found, true AS dated")
def file_timestamps(spark, d):
    """Whether every file of a folder has a time of its own, in the form of the corpus records."""
    path = folder(spark, "dated")
    table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    dated = F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)$")
    return P.files(spark, path, "*.txt").agg((F.count(F.lit(1)) > 0).alias("found"), F.bool_and(dated).alias("dated"))


@R.add("json_roundtrip", "S9 S12 S13", "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '-')) AS sha FROM documents")
def json_roundtrip(spark, d):
    path = folder(spark, "json")
    T.write_json(table(spark, d, "documents"), path)
    back = T.read_json(spark, path, "doc_id long, text string, lang string, source string, n_chars long", lines=True)
    return back.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("-")), 256).alias("sha"))


@R.add("vectors_roundtrip", "S10 S11", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def vectors_roundtrip(spark, d):
    path = folder(spark, "vectors")
    T.write_vectors(table(spark, d, "embeddings"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return T.read_vectors(spark, path).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 5).alias("total"))


@R.add("domain_sink_roundtrip", "S14", "SELECT lang AS domain, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def domain_sink_roundtrip(spark, d):
    path = folder(spark, "domains")
    T.write_by_domain(table(spark, d, "documents").withColumnRenamed("lang", "domain"), path)
    return spark.read.parquet(path).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("bytes"))


@R.add("index_roundtrip", "S19 M23", TERM_STATS)
def index_roundtrip(spark, d):
    """Term statistics from an index that is saved, and loaded while the corpus is the one it is of."""
    docs, path = table(spark, d, "documents"), folder(spark, "index")
    mark = corpus.fingerprint(docs, "doc_id", "text").first().fingerprint
    posted = settled(O.postings(docs))
    T.save_index(posted, O.term_stats(posted, docs.count()), mark, path)
    if T.load_index(spark, "another", path) is not None:
        raise ValueError("an index of another corpus was loaded")
    stats = T.load_index(spark, mark, path)[1]
    again = T.cached(stats, mark, f"{path}/results", ("idf",))
    return again.select("term", "df", F.round("idf", 6).alias("idf"))


# --- hooks for models ----------------------------------------------------------------------------------------------


def vowel_counts():
    """An encoder that SQL can tell too: how often each vowel stands in a text."""
    return lambda texts: np.array([[t.count(v) for v in "aeiou"] for t in texts], float).reshape(-1, 5)


@R.add("encoded_texts", "M3 M4 M24", """
WITH n AS (SELECT conv_id, turn, list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: length(text) - length(replace(text, v, ''))) AS c FROM conversations),
l AS (SELECT conv_id, turn, c, sqrt(list_sum(list_transform(c, lambda x: (x * x)::DOUBLE))) AS n FROM n) SELECT conv_id, turn, array_to_string(list_transform(c, lambda x: printf('%.3f', CASE WHEN n > 0 THEN x / n ELSE 0 END + 1e-6)), ' ') AS vector FROM l""")
def encoded_texts(spark, d):
    rows = M.encoded(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", vowel_counts, "vowels")
    shown = F.array_join(F.transform("vector", lambda x: F.format_string("%.3f", x.cast("double") + 1e-6)), " ")
    return rows.select("conv_id", "turn", F.when(F.col("vector").isNotNull(), shown).alias("vector"))


def length_gaps():
    return lambda a, b: np.array([-abs(len(x) - len(y)) for x, y in zip(a, b)], float)


@R.add("rerank_reuse", "M5", f"WITH {BM25} SELECT query_id, s.doc_id, -abs(length(b.text) - length(coalesce(d.text, '')))::DOUBLE AS rerank_score FROM sparse s JOIN documents d ON d.doc_id = s.doc_id JOIN benchmark b ON b.item_id = query_id")
def rerank_reuse(spark, d):
    """Scores of all candidates where those of the first ranks are known from a round before."""
    pairs = settled(sparse(spark, d).join(text_queries(spark, d), "query_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))
    first = settled(M.reranked(pairs.filter("rank <= 5"), length_gaps, name="gaps"))
    return M.reranked(pairs, length_gaps, first, "gaps").select("query_id", "doc_id", "rerank_score")


@R.add("named_entities", "M6", r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,}')))), '|') AS acronyms FROM documents""")
def named_entities(spark, d):
    found = F.filter("names", lambda x: ~x.contains(" ") & x.rlike("^[A-Z]+$"))
    return M.with_names(table(spark, d, "documents"), "text").select("doc_id", F.array_join(F.sort_array(found), "|").alias("acronyms"))


@R.add("query_planning", "M26 S26", r"""
WITH c AS (SELECT conv_id * 100 + turn AS query_id, list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), '. '), lambda x: trim(x)), lambda x: x <> ''))[1:3] AS seen, list_filter(list_transform(string_split(coalesce(text, ''), '. '), lambda x: trim(x)), lambda x: x <> '') AS parts, trim(coalesce(text, '')) AS whole FROM conversations WHERE turn < 100),
u AS (SELECT query_id, whole, list_filter(parts, lambda x, i: NOT list_contains(parts[1:i - 1], x))[1:3] AS kept FROM c), w AS (SELECT query_id, CASE WHEN len(kept) > 0 THEN kept ELSE [whole] END AS kept FROM u)
SELECT query_id, CAST(i AS INT) AS part, kept[i] AS search FROM (SELECT query_id, kept, unnest(generate_series(1, len(kept))) AS i FROM w)""")
def query_planning(spark, d):
    q = table(spark, d, "conversations").filter("turn < 100").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return M.planned(q, lambda c: F.split(c, r"\. "))


@R.add("checked_requests", "S25", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS query, CASE WHEN event_id % 3 > 0 THEN event_id % 25 END AS k, CASE WHEN event_id % 4 > 0 THEN event_id % 23 END AS m FROM events),
x AS (SELECT event_id, query, coalesce(k, 3) AS k, coalesce(m, 3) AS m FROM r) SELECT event_id, k AS top_k_documents, m AS max_sentences, CASE WHEN query = '' THEN 'query is empty' WHEN k NOT BETWEEN 1 AND 20 THEN 'top_k_documents is not within 1 and 20' WHEN m NOT BETWEEN 1 AND 20 THEN 'max_sentences is not within 1 and 20' END AS problem, query <> '' AND k BETWEEN 1 AND 20 AND m BETWEEN 1 AND 20 AS valid FROM x""")
def checked_requests(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(i % 5 == 0, "").otherwise(F.col("event_type")).alias("query"), F.when(i % 3 > 0, i % 25).alias("top_k_documents"), F.when(i % 4 > 0, i % 23).alias("max_sentences"))
    return M.checked_requests(rows).select("event_id", "top_k_documents", "max_sentences", "problem", "valid")
