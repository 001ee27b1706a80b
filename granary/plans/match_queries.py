"""Queries that match questions and evidence. Questions are made of the passages of the benchmark, evidence is the
documents, and each question meets the documents that BM25 ranks first for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions import definitions as D, matching as M
from granary.operators import answers, retrieval as O
from granary.plans.base import Registry, table
from granary.plans.retrieval_queries import bm25_sql
from granary.session import settled

R = Registry()
#: Questions over the benchmark in SQL: query_id, query; and texts to match: doc_id, text.
FORMS = ("What is {0}?", "Why does Article 12 mention {0}?", "How is {0} built", "compare {0} and Section 7b", "When was NASA {0} launched?", "explain '{0}' please", "who developed {0}", "where is chapter 3 of {0}")
ASKED = (
    "asked AS (SELECT item_id AS query_id, CASE item_id % 8 " + " ".join(f"WHEN {i} THEN replace('{f.replace(chr(39), chr(39) * 2)}', '{{0}}', t)" for i, f in enumerate(FORMS))
    + r" END AS query FROM (SELECT item_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+'), ' ') AS t FROM benchmark))"
)
EVIDENCE = "evidence AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Article 12. ' WHEN 1 THEN 'It is a process, because of NASA in 1998: ' WHEN 2 THEN 'Sections 7B and 3; ' ELSE '' END || text AS text FROM documents WHERE text IS NOT NULL)"
NEAR = 3
PAIRS = f"{ASKED}, {EVIDENCE}, {bm25_sql('SELECT * FROM asked', NEAR, 'wanted')}, pairs AS (SELECT s.query_id, query, s.doc_id, e.text FROM sparse s JOIN asked USING (query_id) JOIN evidence e ON e.doc_id = s.doc_id)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    t = F.array_join(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")
    form = F.element_at(M.lits(FORMS), (F.col("item_id") % 8 + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.replace(form, F.lit("{0}"), t).alias("query"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    lead = F.element_at(M.lits(("Article 12. ", "It is a process, because of NASA in 1998: ", "Sections 7B and 3; ", "")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.concat(lead, "text").alias("text"))


def known() -> dict:
    return {"focus": F.col("focus"), "refs": F.col("refs")}


def analysed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with what is known of the question: each question is analysed once."""
    told = asked(spark, d).withColumns({"focus": M.focus_phrases("query"), "refs": M.references("query"), "want": M.intents("query")}).drop("query")
    return pairs(spark, d).join(settled(told), "query_id")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each question with the evidence that BM25 ranks first for it."""
    q = asked(spark, d)
    near = O.bm25_best(table(spark, d, "documents").select("doc_id", "text"), q, NEAR).select("query_id", "doc_id")
    return settled(near.join(q, "query_id").join(evidence(spark, d), "doc_id").select("query_id", "query", "doc_id", "text"))


@R.add("match_tokens", "F23", rf"WITH {EVIDENCE} SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)*') AS tokens FROM evidence")
def match_tokens(spark, d):
    return evidence(spark, d).select("doc_id", M.match_tokens("text").alias("tokens"))


MATCH = r"lower(trim(regexp_replace(replace(replace(replace({0}, '–', '-'), '—', '-'), '−', '-'), '\s+', ' ', 'g')))"


@R.add("match_normalize", "F24", f"SELECT doc_id, {MATCH.format('text')} AS normalized FROM documents")
def match_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", M.match_text("text").alias("normalized"))


@R.add("phrase_present", "F25", rf"""
WITH {PAIRS}, p AS (SELECT query_id, doc_id, {MATCH.format('text')} AS t, regexp_extract(lower(query), '[a-z]{{4,}}') AS phrase FROM pairs)
SELECT query_id, doc_id, phrase, phrase <> '' AND regexp_matches(t, '(?:^|[^a-z0-9])' || phrase || '(?:$|[^a-z0-9])') AS present FROM p""")
def phrase_present(spark, d):
    rows = pairs(spark, d).withColumn("phrase", F.regexp_extract(F.lower("query"), "[a-z]{4,}", 0))
    return rows.select("query_id", "doc_id", "phrase", M.phrase_present("text", "phrase").alias("present"))


REFS = r"list_distinct(list_transform(regexp_extract_all(lower({0}), '\b(?:articles?|sections?|chapters?|clauses?|rules?|paragraphs?)\s*[0-9]+[a-z]?\b'), lambda r: regexp_replace(regexp_extract(r, '^[a-z]+'), 's$', '') || ' ' || regexp_extract(r, '[0-9]+[a-z]?$')))"


@R.add("extract_references", "F26 U4", rf"WITH {ASKED}, {EVIDENCE}, x AS (SELECT query_id AS id, query AS t FROM asked UNION ALL SELECT -1 - doc_id, text FROM evidence) SELECT id, array_to_string(list_sort({REFS.format('t')}), '|') AS refs FROM x")
def extract_references(spark, d):
    both = asked(spark, d).select(F.col("query_id").alias("id"), F.col("query").alias("t")).union(evidence(spark, d).select(-1 - F.col("doc_id"), "text"))
    return both.select("id", F.array_join(F.sort_array(M.references("t")), "|").alias("refs"))


@R.add("reference_match", "F27", rf"""
WITH {PAIRS}, r AS (SELECT query_id, doc_id, {MATCH.format('text')} AS t, unnest({REFS.format('query')}) AS ref FROM pairs)
SELECT query_id, doc_id, ref, regexp_matches(t, '(?:^|[^a-z0-9])' || replace(ref, ' ', '\s+') || '(?:$|[^a-z0-9])') OR (starts_with(ref, 'article ') AND regexp_matches(t, '(?:^|[^0-9])' || regexp_extract(ref, '[0-9]+[a-z]?$') || '\s*[.)]\s*')) AS present FROM r""")
def reference_match(spark, d):
    rows = pairs(spark, d).withColumn("ref", F.explode(M.references("query")))
    return rows.select("query_id", "doc_id", "ref", M.reference_present("text", "ref").alias("present"))


@R.add("focus_phrases", "F28")
def focus_phrases(spark, d):
    return asked(spark, d).select("query_id", "query", M.focus_phrases("query").alias("focus"))


@R.add("detect_intents", "F29")
def detect_intents(spark, d):
    return asked(spark, d).select("query_id", M.intents("query").alias("intents"))


@R.add("analyze_query", "F30")
def analyze_query(spark, d):
    return answers.analyzed(asked(spark, d), "query")


@R.add("lexical_match", "F31 U3")
def lexical_match(spark, d):
    rows = analysed_pairs(spark, d).withColumn("m", M.lexical_match("query", "text", **known()))
    return rows.select("query_id", "doc_id", F.round("m.score", 6).alias("score"), "m.matched", "m.missing", "m.exact_phrase", "m.reference_match")


@R.add("missing_focus", "U3")
def missing_focus(spark, d):
    return analysed_pairs(spark, d).select("query_id", "doc_id", F.explode(M.lexical_match("query", "text", **known())["missing"]).alias("missing"))


@R.add("intent_cue", "F32")
def intent_cue(spark, d):
    return analysed_pairs(spark, d).select("query_id", "doc_id", F.round(M.intent_cue("query", "text", F.col("want")), 6).alias("cue"))


@R.add("evidence_support", "F33 F34")
def evidence_support(spark, d):
    rows = analysed_pairs(spark, d).withColumns({"m": M.lexical_match("query", "text", **known())["score"], "cue": M.intent_cue("query", "text", F.col("want"))})
    support = F.least(F.lit(1.0), 0.72 * F.col("m") + 0.28 * F.col("cue"))
    return rows.select("query_id", "doc_id", F.round(support, 6).alias("support"), M.definition_matches("query", "text", **known()).alias("defines"))


@R.add("answerability", "F35")
def answerability(spark, d):
    return answers.answerability(asked(spark, d), pairs(spark, d))


STOP = ", ".join(f"'{w}'" for w in M.STOPWORDS)
TERMS = rf"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda x: x NOT IN ({STOP}) AND (length(x) >= 3 OR regexp_full_match(x, '\d+')))"


@R.add("query_terms", "F42", rf"WITH {ASKED} SELECT query_id, array_to_string(list_sort(list_distinct({TERMS.format('query')})), ' ') AS terms FROM asked")
def query_terms(spark, d):
    return asked(spark, d).select("query_id", F.array_join(F.sort_array(M.query_terms("query")), " ").alias("terms"))


@R.add("question_targets", "F43", rf"WITH {ASKED}, q AS (SELECT query_id, lower(trim(query)) AS q FROM asked) SELECT query_id, " + ", ".join(f"regexp_matches(q, '{p}') AS {k}" for k, p in M.TARGETS.items()) + " FROM q")
def question_targets(spark, d):
    return asked(spark, d).select("query_id", M.targets("query").alias("t")).select("query_id", "t.*")


HAS = "regexp_matches(lower(text), '(?:^|[^a-z0-9])' || t || '(?:$|[^a-z0-9])')"


@R.add("lexical_question_score", "F44 F46", rf"""
WITH {PAIRS}, t AS (SELECT query_id, doc_id, text, unnest(list_distinct({TERMS.format('query')})) AS t FROM pairs)
SELECT query_id, doc_id, round(avg(CASE WHEN {HAS} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS score FROM t GROUP BY ALL""")
def lexical_question_score(spark, d):
    rows = pairs(spark, d).filter(F.size(M.query_terms("query")) > 0)
    return rows.select("query_id", "doc_id", F.round(M.lexical_question("query", "text"), 6).alias("score"))


@R.add("anchor_score", "F45")
def anchor_score(spark, d):
    return pairs(spark, d).select("query_id", "doc_id", F.round(M.anchor_score("query", "text"), 6).alias("score"))


@R.add("answer_shape", "F47 F48")
def answer_shape(spark, d):
    """With the scores of the targets that the question asks for; null where it doesn't."""
    rows = pairs(spark, d).withColumns({"shape": M.answer_shape("query", "text"), "anchor": M.anchor_score("query", "text"), "focus": D.definition_focus("query")})
    rows = rows.withColumn("identity", D.identity_score("query", "text", F.col("focus"), F.col("anchor"), F.col("shape")))
    rows = rows.withColumn("t", M.target_scores("query", F.col("anchor"), F.col("shape"), F.col("identity")))
    each = [F.round(F.col(f"t.{k}"), 6).alias(k) for k in ("identity", "organization", "location", "date")]
    return rows.select("query_id", "doc_id", F.round("shape", 6).alias("shape"), *each, F.round(M.target_score(F.col("t"), F.col("shape")), 6).alias("target"))


@R.add("lexical_grounding", "F52", rf"""
WITH {PAIRS}, t AS (SELECT query_id, doc_id, list_distinct({TERMS.format('query')}) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM pairs)
SELECT query_id, doc_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, s)) / len(q) END, 6)::DOUBLE AS grounding FROM t""")
def lexical_grounding(spark, d):
    q, s = M.query_terms("query"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    return pairs(spark, d).select("query_id", "doc_id", F.round(F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, s)) / F.size(q)), 6).alias("grounding"))


@R.add("short_entity_query", "F58", rf"""
WITH {ASKED} SELECT query_id, len(list_filter(string_split_regex(trim(query), '\s+'), lambda w: w <> '')) BETWEEN 1 AND 8 AND regexp_matches(lower(query), '^(?:what is|what are|who is|who was|define|meaning of|explain|tell me about)\b')
 AND regexp_matches(query, '(?:^|[^A-Za-z0-9])[A-Z][A-Z0-9]{{1,7}}(?:$|[^A-Za-z0-9])') AS short_entity FROM asked""")
def short_entity_query(spark, d):
    return asked(spark, d).select("query_id", M.short_entity_query("query").alias("short_entity"))


TECHNICAL = ", ".join(f"'{w}'" for w in answers.TECHNICAL)
MULTIHOP = ", ".join(f"'{w}'" for w in answers.MULTIHOP)


@R.add("query_complexity", "M6 M7")
def query_complexity(spark, d):
    return answers.complexity(asked(spark, d), "query")


@R.add("retrieval_plan", "M8", """
WITH c AS (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS complexity, 1 + doc_id % 10 AS requested FROM documents),
t AS (SELECT doc_id, complexity, requested, greatest(10, requested, 5 + round_even(complexity * 15, 0)) AS target FROM c)
SELECT doc_id, complexity, requested, CAST(least(20, 5 + ceil((target - 5) / 5) * 5) AS INT) AS max_k, 5 AS initial_k FROM t""")
def retrieval_plan(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 101 / 100.0).alias("complexity"), (F.col("doc_id") % 10 + 1).alias("requested"))
    return answers.with_plan(rows, "complexity", "requested")


@R.add("candidate_depth", "M9", """
WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' WHEN 2 THEN 'complex' WHEN 3 THEN 'very_complex' END AS kind, (doc_id % 101) / 100.0 AS complexity, doc_id % 3 = 0 AS short, (doc_id % 11) / 10.0::DOUBLE AS agreement, (doc_id % 13) / 12.0::DOUBLE AS stability, 1 + doc_id % 24 AS k FROM documents),
b AS (SELECT *, CASE kind WHEN 'simple' THEN 10 WHEN 'medium' THEN 20 WHEN 'complex' THEN 30 WHEN 'very_complex' THEN 40 ELSE CASE WHEN complexity < 0.30 THEN 10 WHEN complexity < 0.55 THEN 20 WHEN complexity < 0.75 THEN 30 ELSE 40 END END AS base FROM c)
SELECT doc_id, CAST(least(40, greatest(10, 2 * k, (CASE WHEN short THEN greatest(base, 15) ELSE base END) + (CASE WHEN 1.0 - agreement >= 0.75 THEN 10 WHEN 1.0 - agreement >= 0.5 THEN 5 ELSE 0 END) + (CASE WHEN 1.0 - stability >= 0.6 THEN 10 WHEN 1.0 - stability >= 0.4 THEN 5 ELSE 0 END))) AS INT) AS depth FROM b""")
def candidate_depth(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "simple").when(i % 5 == 1, "medium").when(i % 5 == 2, "complex").when(i % 5 == 3, "very_complex")
    return table(spark, d, "documents").select("doc_id", answers.candidate_depth(kind, i % 101 / 100.0, i % 3 == 0, i % 11 / 10.0, i % 13 / 12.0, i % 24 + 1).alias("depth"))
