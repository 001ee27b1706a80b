"""Queries over text: cleaning, quality, sentences, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from granary.functions import text as X
from granary.operators import cleaning, corpus
from granary.plans.base import Registry, table

R = Registry()
#: Lines of documents in SQL: doc_id, pos (from 0), line.
LINES = "lines AS (SELECT doc_id, CAST(p - 1 AS INT) AS pos, ls[p] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
SQUEEZE = r"trim(regexp_replace({0}, '[ \t]+', ' ', 'g'))"


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.lines(table(spark, d, "documents"))


@R.add("normalize_block_text", "S5", r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\x00', ' ', 'g'), '\r\n?', chr(10), 'g'), '[\x01-\x08\x0B-\x1F]', '', 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS block_text FROM documents""")
def normalize_block_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.block_text("text").alias("block_text"))


@R.add("normalize_lines", "F1 F2 F3", rf"""
WITH {LINES} SELECT doc_id, pos, {SQUEEZE.format(r"regexp_replace(nfc_normalize(line), '[\p{Cc}\p{Cf}\x{00AD}\x{200B}-\x{200D}\x{FEFF}]', '', 'g')").replace("[\\p{Cc}", "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F")} AS line FROM lines""")
def normalize_lines(spark, d):
    return doc_lines(spark, d).select("doc_id", "pos", X.normalized_line("line").alias("line"))


SIGNATURE = r"trim(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '\s+', ' ', 'g'))"


@R.add("line_signature", "F4", rf"""WITH {LINES} SELECT {SIGNATURE} AS signature, count(*) AS n FROM lines GROUP BY 1""")
def line_signature(spark, d):
    return doc_lines(spark, d).groupBy(X.line_signature("line").alias("signature")).agg(F.count(F.lit(1)).alias("n"))


JUNK = r"""(length(v) <= 1 OR regexp_full_match(lower(v), '(page\s*)?\d{1,5}') OR regexp_full_match(lower(v), 'page\s+\d+\s*(of|/)\s*\d+') OR regexp_full_match(lower(v), '(page|pg\.?)\s*\d+')
 OR (regexp_full_match(lower(v), '[ivxlcdm]+') AND length(v) > 4) OR regexp_full_match(v, '[^A-Za-z0-9]{1,8}') OR (length(v) BETWEEN 3 AND 13 AND length(replace(v, left(v, 1), '')) = 0)
 OR (len(ws) > 0 AND len(list_filter(ws, lambda w: NOT (length(w) <= 8 AND regexp_full_match(w, '\p{L}+') AND len(list_distinct(string_split(lower(w), ''))) <= 2))) = 0
     AND length(array_to_string(ws, '')) >= 4 AND len(list_distinct(string_split(lower(array_to_string(ws, '')), ''))) <= 2))"""


@R.add("junk_lines", "F5", rf"""
WITH {LINES}, v AS (SELECT doc_id, pos, trim(line) AS v, {WORDS.format("trim(line)")} AS ws FROM lines)
SELECT doc_id, pos, v AS line FROM v WHERE {JUNK}""")
def junk_lines(spark, d):
    return doc_lines(spark, d).filter(X.junk_line("line")).select("doc_id", "pos", F.trim("line").alias("line"))


@R.add("page_number_artifacts", "F6", rf"""
WITH {LINES}, e AS (SELECT doc_id, pos, trim(line) AS line, max(pos) OVER (PARTITION BY doc_id) AS last FROM lines)
SELECT doc_id, pos, line FROM e WHERE (pos < 3 OR pos > last - 3) AND regexp_extract(lower(line), '^(?:page\s*)?(\d{{1,5}})$', 1) = CAST(doc_id AS VARCHAR)""")
def page_number_artifacts(spark, d):
    return cleaning.page_number_lines(doc_lines(spark, d), "doc_id", F.col("doc_id"))


@R.add("repair_hyphenation", "F7", rf"""
WITH RECURSIVE {LINES}, t AS (SELECT doc_id, pos, trim(line) AS line FROM lines),
w AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM t),
c AS (SELECT *, coalesce(regexp_matches(line, '[A-Za-z]{{2,}}-$') AND regexp_matches(nxt, '^[a-z]'), false) AS can FROM w),
g AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(grp, 0) ORDER BY pos) AS r FROM g)
SELECT doc_id, array_to_string(list(CASE WHEN can AND r % 2 = 1 THEN regexp_replace(line, '-$', '') || nxt ELSE line END ORDER BY pos), chr(10)) AS repaired
FROM k WHERE r % 2 = 1 GROUP BY doc_id""")
def repair_hyphenation(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    lines = X.trimmed(F.split("text", "\n"))
    return docs.select("doc_id", X.repaired_text(F.array_join(lines, "\n")).alias("repaired"))


@R.add("dedupe_adjacent_words", "F8", rf"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, p, ws[p] AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w)),
b AS (SELECT *, CASE WHEN lower(w) = lag(lower(w)) OVER (PARTITION BY doc_id ORDER BY p) THEN 0 ELSE 1 END AS new FROM u),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS grp FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY p) AS r FROM g)
SELECT doc_id, array_to_string(list(w ORDER BY p), ' ') AS deduped FROM r WHERE r % 2 = 1 GROUP BY doc_id""")
def dedupe_adjacent_words(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", X.deduped_words("text").alias("deduped")).filter("deduped <> ''")


@R.add("clean_text", "F10")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cleaned("text").alias("clean"))


@R.add("repeated_lines", "A1", rf"""
WITH {LINES}, e AS (SELECT source, l.doc_id, pos, trim(line) AS line, max(pos) OVER (PARTITION BY l.doc_id) + 1 AS n FROM lines l JOIN documents USING (doc_id)),
s AS (SELECT DISTINCT source, doc_id, line, {SIGNATURE} AS signature FROM e WHERE pos < greatest(1, ceil(n * 0.15)) OR pos >= n - greatest(1, ceil(n * 0.15))),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
SELECT s.source, signature, count(*) AS n FROM s JOIN p USING (source) WHERE length(signature) >= 3 AND signature <> '#' AND pages >= 3
GROUP BY s.source, signature, pages HAVING count(*) >= greatest(2, floor(0.35 * pages))""")
def repeated_lines(spark, d):
    return cleaning.repeated_lines(table(spark, d, "documents"), "source", "doc_id", "text")


@R.add("clean_pages", "F9")
def clean_pages(spark, d):
    return cleaning.clean_pages(table(spark, d, "documents"), "source", "doc_id", "text")


LETTERS = "len(list_distinct(string_split(lower(w), '')))"


@R.add("text_quality", "F11", rf"""
WITH w AS (SELECT doc_id, text, {WORDS.format("coalesce(text, '')")} AS ws FROM documents)
SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 0 ELSE (CASE WHEN len(ws) < 20 THEN 0.75 ELSE 1.0 END)::DOUBLE * (CASE WHEN len(list_filter(ws, lambda w: length(w) = 1)) / len(ws) > 0.2 THEN 0.65 ELSE 1.0 END)::DOUBLE
  * (CASE WHEN length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(length(text), 1) > 0.35 THEN 0.75 ELSE 1.0 END)::DOUBLE
  * (CASE WHEN len(list_filter(ws, lambda w: length(w) >= 3 AND {LETTERS} <= 2)) / len(ws) > 0.2 THEN 0.55 ELSE 1.0 END)::DOUBLE END, 6)::DOUBLE AS quality FROM w""")
def text_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.text_quality("text"), 6).alias("quality"))


@R.add("chunk_quality", "F15 P2", rf"""
WITH w AS (SELECT doc_id, text, {WORDS.format("coalesce(text, '')")} AS ws FROM documents)
SELECT doc_id, q AS quality, q >= 0.3 AS kept FROM (SELECT doc_id, round(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 WHEN len(ws) < 45 THEN 0.4 ELSE
  (CASE WHEN len(list_filter(ws, lambda w: length(w) = 1)) / len(ws) > 0.15 THEN 0.7 ELSE 1.0 END)::DOUBLE * (CASE WHEN length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(length(text), 1) > 0.30 THEN 0.75 ELSE 1.0 END)::DOUBLE END, 6)::DOUBLE AS q FROM w)""")
def chunk_quality(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.round(X.chunk_quality("text"), 6).alias("quality"))
    return q.withColumn("kept", F.col("quality") >= 0.3)


@R.add("chunk_text_normalize", "F12", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS normalized FROM documents""")
def chunk_text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.chunk_text("text").alias("normalized"))


@R.add("split_sentences", "F13 F14")
def split_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))


@R.add("safe_name", "F16", r"""
SELECT DISTINCT source, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'general') AS name FROM documents""")
def safe_name(spark, d):
    return table(spark, d, "documents").select("source", X.safe_name("source").alias("name")).distinct()


@R.add("infer_domain", "F17", r"""
WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', ''), '/') AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) > 1 THEN coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(parts[1])), '[^a-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'general') ELSE 'general' END AS domain FROM p""")
def infer_domain(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", X.domain_of(path).alias("domain"))


@R.add("document_type", "F18", """
SELECT item_id, CASE WHEN contains(lower(t), 'health') THEN 'medical_guideline' WHEN contains(lower(t), 'legal') THEN 'legal_document' WHEN contains(lower(t), 'education') THEN 'educational_document'
 WHEN contains(lower(t), 'space') OR contains(lower(t), 'science') THEN 'scientific_document' ELSE 'document' END AS document_type
FROM (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'Health care' WHEN 1 THEN 'legal' WHEN 2 THEN 'Education' WHEN 3 THEN 'deep space' WHEN 4 THEN 'Science' ELSE 'other' END AS t FROM benchmark)""")
def document_type(spark, d):
    domain = F.element_at(F.array(*map(F.lit, ("Health care", "legal", "Education", "deep space", "Science", "other"))), (F.col("item_id") % 6 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", X.document_type(domain).alias("document_type"))


@R.add("text_hash", "F19", "SELECT doc_id, sha256(text) AS text_hash, substr(sha256(text), 1, 16) AS document_id FROM documents")
def text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.substring(F.sha2("text", 256), 1, 16).alias("document_id"))


HEADING = rf"(v <> '' AND length(v) <= 110 AND len(string_split(v, ' ')) <= 16 AND NOT regexp_matches(v, '[.?!]$') AND regexp_matches(v, '{X.HEADING.replace(chr(39), chr(39) * 2)}'))"


@R.add("section_headings", "F20", rf"""
WITH {LINES}, v AS (SELECT doc_id, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS v FROM lines) SELECT doc_id, pos, v AS heading FROM v WHERE {HEADING}""")
def section_headings(spark, d):
    return doc_lines(spark, d).filter(X.heading("line")).select("doc_id", "pos", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("heading"))


@R.add("section_forward_fill", "W3", rf"""
WITH {LINES}, v AS (SELECT doc_id, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS v FROM lines)
SELECT doc_id, pos, last_value(CASE WHEN {HEADING} THEN v END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM v""")
def section_forward_fill(spark, d):
    return corpus.with_sections(doc_lines(spark, d), "doc_id", "pos", "line").select("doc_id", "pos", "section")


TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"


@R.add("tokenize", "F22", f"SELECT doc_id, {TOK.format('text')} AS tokens, CAST(len({TOK.format('text')}) AS INT) AS n FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tokens("text").alias("tokens"), F.size(X.tokens("text")).alias("n"))


@R.add("answer_clean_text", "F38", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g'), '(?i)https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '([.!?])([A-Z])', '\1 \2', 'g')) AS clean FROM documents""")
def answer_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.answer_text("text").alias("clean"))


KNOWN_BROKEN = " OR ".join(f"contains(s, '{p}')" for p in X.BROKEN_TEXT)


@R.add("broken_fragments", "F39", rf"""
WITH {LINES}, s AS (SELECT doc_id, pos, lower(trim(line)) AS s FROM lines)
SELECT doc_id, pos, len({WORDS.format("s")}) < 5 OR {KNOWN_BROKEN} OR regexp_matches(s, '(?:^|[^\p{{L}}\p{{N}}_])(?:and|or|to|of|for|with|from|by|in|on|the)\s*[.!?]?$') OR regexp_matches(s, '^(?:and|or|but|because|while|where|when|how|which|that)(?:[^\p{{L}}\p{{N}}_]|$)') AS broken FROM s""")
def broken_fragments(spark, d):
    return doc_lines(spark, d).select("doc_id", "pos", X.broken_fragment("line").alias("broken"))


LOSS = " + ".join([f"CASE WHEN contains(low, '{p}') THEN 0.45 ELSE 0 END" for p in X.BROKEN_TEXT] + [f"CASE WHEN contains(low, '{p}') THEN 0.25 ELSE 0 END" for p in X.GLUED_WORDS])


@R.add("sentence_quality", "F49", rf"""
WITH {LINES}, s AS (SELECT doc_id, pos, trim(line) AS s, lower(trim(line)) AS low, len({WORDS.format("trim(line)")}) AS n FROM lines),
x AS (SELECT *, ({LOSS} + CASE WHEN contains(low, 'chun-drə') OR contains(s, '/ˌ') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(low, '^(?:and|or|but|because|while|which|that)(?:[^\p{{L}}\p{{N}}_]|$)') THEN 0.2 ELSE 0 END
 + CASE WHEN regexp_matches(low, '(?:^|[^\p{{L}}\p{{N}}_])(?:and|or|to|of|for|with|from|by|in|on)\s*[.!?]?$') THEN 0.25 ELSE 0 END + CASE WHEN n > 70 THEN 0.2 ELSE 0 END + CASE WHEN length(s) - length(replace(s, '•', '')) >= 2 THEN 0.3 ELSE 0 END
 + CASE WHEN length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) > 20 AND length(regexp_replace(s, '[^\p{{Lu}}]', '', 'g')) / length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) > 0.75 THEN 0.15 ELSE 0 END)::DOUBLE AS loss FROM s)
SELECT doc_id, pos, CASE WHEN n < 5 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1.0 - loss)), 6) END::DOUBLE AS quality FROM x""")
def sentence_quality(spark, d):
    return doc_lines(spark, d).select("doc_id", "pos", F.round(X.sentence_quality("line"), 6).alias("quality"))


# --- sources, sinks and corpus records ---------------------------------------------------------------------------


@R.add("embedding_validation", "S10", "SELECT count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most, count_if(embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS bad FROM embeddings")
def embedding_validation(spark, d):
    return corpus.vector_report(table(spark, d, "embeddings"), "embedding")


@R.add("domain_counts", "A2", rf"SELECT lang AS domain, count(*) AS documents, CAST(sum(len({WORDS.format('coalesce(text, chr(32))')})) AS BIGINT) AS words, count_if(len({WORDS.format('coalesce(text, chr(32))')}) >= 10) AS usable FROM documents GROUP BY lang")
def domain_counts(spark, d):
    n = F.size(X.words_of("text"))
    return table(spark, d, "documents").groupBy(F.col("lang").alias("domain")).agg(F.count(F.lit(1)).alias("documents"), F.sum(n.cast("long")).alias("words"), F.sum((n >= 10).cast("long")).alias("usable"))


@R.add("minimum_document_size", "P1", rf"SELECT doc_id, CASE WHEN len({WORDS.format('coalesce(text, chr(32))')}) < 10 THEN 'insufficient_usable_text' END AS skipped FROM documents")
def minimum_document_size(spark, d):
    return corpus.with_skip_reason(table(spark, d, "documents"), "text").select("doc_id", "skipped")


@R.add("domain_partition_counts", "S14 T12", "SELECT lang AS domain, count(*) AS n FROM documents GROUP BY lang ORDER BY lang")
def domain_partition_counts(spark, d):
    return corpus.partition_counts(table(spark, d, "documents").withColumnRenamed("lang", "domain"), "domain")


@R.add("manifest_summary", "S15", rf"""
WITH w AS (SELECT lang, len({WORDS.format("coalesce(text, chr(32))")}) >= 10 AS ok FROM documents)
SELECT count(*) AS document_count, count_if(ok) AS indexed, count_if(NOT ok) AS skipped, (SELECT array_to_string(list(lang || '=' || n ORDER BY lang), ',') FROM (SELECT lang, count(*) AS n FROM w WHERE ok GROUP BY lang)) AS per_domain FROM w""")
def manifest_summary(spark, d):
    return corpus.manifest(table(spark, d, "documents"), "lang", "text")


@R.add("normalize_records", "S16 S18", """
WITH r AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN struct_pack(domain := lang, source := source) END AS metadata, CASE WHEN doc_id % 3 = 1 THEN doc_id END AS chunk_id, CASE WHEN doc_id % 3 = 1 THEN lang END AS domain, CASE WHEN doc_id % 3 = 2 THEN source END AS source FROM documents)
SELECT doc_id, text, CASE WHEN metadata IS NOT NULL THEN coalesce(metadata.domain, 'space') WHEN chunk_id IS NOT NULL THEN coalesce(domain, 'legal') ELSE coalesce(domain, 'healthcare') END AS domain,
 CASE WHEN metadata IS NOT NULL THEN coalesce(metadata.source, 'unknown') WHEN chunk_id IS NOT NULL THEN 'legal' ELSE coalesce(source, 'unknown') END AS source FROM r WHERE trim(coalesce(text, '')) <> ''""")
def normalize_records(spark, d):
    docs = table(spark, d, "documents")
    kind = F.col("doc_id") % 3
    rows = docs.select("doc_id", "text", F.when(kind == 0, F.struct(F.col("lang").alias("domain"), F.col("source").alias("source"))).alias("metadata"), F.when(kind == 1, F.col("doc_id")).alias("chunk_id"), F.when(kind == 1, F.col("lang")).alias("domain"), F.when(kind == 2, F.col("source")).alias("source"))
    return corpus.unified(rows).select("doc_id", "text", "domain", "source")


@R.add("combine_sources", "S17", "SELECT 'documents' AS corpus, doc_id AS id, lang AS domain FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark")
def combine_sources(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    b = table(spark, d, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("id"))
    return corpus.combined([a, b])


@R.add("corpus_fingerprint", "S20", """
WITH k AS (SELECT doc_id AS k, count(*) AS n, sha256(array_to_string(list_sort(list(sha256(coalesce(text, '')))), ',')) AS h FROM documents GROUP BY doc_id),
a AS (SELECT k // 4096 AS k, sum(n) AS n, sha256(array_to_string(list(h ORDER BY k), ',')) AS h FROM k GROUP BY ALL), b AS (SELECT k // 4096 AS k, sum(n) AS n, sha256(array_to_string(list(h ORDER BY k), ',')) AS h FROM a GROUP BY ALL)
SELECT sha256('v2,' || array_to_string(list(h ORDER BY k), ',')) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM b""")
def corpus_fingerprint(spark, d):
    return corpus.fingerprint(table(spark, d, "documents"), "doc_id", "text")


@R.add("index_metadata", "S21", "SELECT count(*) AS ntotal, max(len(embedding)) AS dimension, 'inner_product' AS metric, count(DISTINCT vec_id) AS distinct_ids FROM embeddings")
def index_metadata(spark, d):
    return corpus.index_metadata(table(spark, d, "embeddings"), "vec_id", "embedding")


@R.add("index_consistency", "S22", "SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS vectors_without_row, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS rows_without_vector")
def index_consistency(spark, d):
    return corpus.consistency(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@R.add("chunk_sections", "J12", rf"""
WITH {LINES}, v AS (SELECT doc_id, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS v FROM lines),
s AS (SELECT doc_id, pos, last_value(CASE WHEN {HEADING} THEN v END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM v)
SELECT doc_id, pos AS page_start, section FROM s""")
def chunk_sections(spark, d):
    """The section of every page on which a chunk starts: here each line is a page."""
    lines = doc_lines(spark, d)
    sections = corpus.with_sections(lines, "doc_id", "pos", "line").select("doc_id", F.col("pos").alias("page_start"), "section")
    return lines.select("doc_id", F.col("pos").alias("page_start")).join(sections, ["doc_id", "page_start"], "left")


@R.add("conversation_history", "S27", "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def conversation_history(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.row_number().over(w).cast("long").alias("position"))


@R.add("normalize_history", "F53", """
WITH t AS (SELECT conv_id, turn, role, substr(trim(text), 1, 1200) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')
SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn), chr(10)) AS history FROM t WHERE r <= 6 GROUP BY conv_id""")
def normalize_history(spark, d):
    return corpus.history(table(spark, d, "conversations"))


@R.add("export_markdown", "S13 T12", "SELECT conv_id, array_to_string(list('**' || role || '**: ' || coalesce(text, '') ORDER BY turn), chr(10) || chr(10)) AS markdown FROM conversations GROUP BY conv_id")
def export_markdown(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("**"), "role", F.lit("**: "), F.coalesce("text", F.lit(""))).alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n\n").alias("markdown"))


@R.add("needs_planning", "F54", r"""
SELECT conv_id, turn, turn > (SELECT min(turn) FROM conversations c WHERE c.conv_id = t.conv_id) OR regexp_matches(lower(text), '\b(?:and|also|then|plus)\b.*\b(?:what|who|where|when|why|how|explain|describe|compare)\b') AS needs FROM conversations t WHERE role = 'user'""")
def needs_planning(spark, d):
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    rows = table(spark, d, "conversations").withColumn("first", first).filter("role = 'user'")
    asked = F.lower("text").rlike(r"\b(?:and|also|then|plus)\b.*\b(?:what|who|where|when|why|how|explain|describe|compare)\b")
    return rows.select("conv_id", "turn", ((F.col("turn") > F.col("first")) | asked).alias("needs"))


@R.add("parse_json_object", "F55", "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS ok FROM events")
def parse_json_object(spark, d):
    return corpus.json_object(table(spark, d, "events").withColumn("raw", F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "raw", "k").select("event_id", "k", "ok")


@R.add("format_evidence", "F56", """
WITH k AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT source, array_to_string(list('[' || r || '] ' || substr(text, 1, 2500) ORDER BY r), chr(10) || chr(10)) AS prompt FROM k WHERE r <= 6 GROUP BY source""")
def format_evidence(spark, d):
    return corpus.evidence_blocks(table(spark, d, "documents"), "source", "doc_id", "text")


@R.add("defensive_coercions", "F57", "SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS as_float, coalesce(TRY_CAST(CAST(event_id AS VARCHAR) AS BIGINT), 0) AS as_int, round(coalesce(CASE WHEN isfinite(value) THEN value END, 0.0), 6) AS value FROM events")
def defensive_coercions(spark, d):
    value = F.when(F.isnan("value") | F.col("value").isin(float("inf"), float("-inf")), 0.0).otherwise(F.coalesce("value", F.lit(0.0)))
    return table(spark, d, "events").select("event_id", F.coalesce(F.expr("try_cast(event_type as double)"), F.lit(0.0)).alias("as_float"), F.coalesce(F.expr("try_cast(cast(event_id as string) as bigint)"), F.lit(0).cast("long")).alias("as_int"), F.round(value, 6).alias("value"))
