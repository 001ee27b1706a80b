"""Queries over answers, chunks, measures and the controller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from granary.functions import definitions as D, rules, text as X
from granary.functions.numeric import sigmoid
from granary.operators import answers as A, chunking as C, evaluation as V, retrieval as O
from granary.plans.base import Registry, table
from granary.plans.match_queries import TERMS, asked
from granary.plans.retrieval_queries import BM25, BOTH, DEPTH, K, MM, RR, TOKENS, both, dense, nearest, sparse, text_queries
from granary.plans.text_queries import LINES, WORDS
from granary.session import settled

R = Registry()


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@R.add("sigmoid_scores", "F37", "SELECT event_id, round(1 / (1 + exp(-greatest(-40, least(40, value)))), 6)::DOUBLE AS p, round(greatest(0, least(1, (value - 2) / 28.0)), 6)::DOUBLE AS scaled FROM events")
def sigmoid_scores(spark, d):
    from granary.functions.numeric import scaled

    return table(spark, d, "events").select("event_id", F.round(sigmoid(F.col("value")), 6).alias("p"), F.round(scaled(F.col("value"), 2, 30), 6).alias("scaled"))


# --- sentences -----------------------------------------------------------------------------------------------------


@R.add("answer_sentences", "F40")
def answer_sentences(spark, d):
    """Only documents whose doc_id another one has, too, are shuffled for their equal sentences."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    twice = settled(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__twice")))
    if twice.isEmpty():
        return A.answer_sentences(docs, "doc_id", "text", repeats=False)
    on = F.col("doc_id").eqNullSafe(F.col("__twice"))
    once = A.answer_sentences(docs.join(twice, on, "left_anti"), "doc_id", "text", repeats=False)
    return once.unionByName(A.answer_sentences(docs.join(twice, on, "left_semi"), "doc_id", "text"))


@R.add("recovered_definitions", "F41", r"""
WITH s AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 100000 + item_id, 'Some lead. The cell division refers to ' || text FROM benchmark), q AS (SELECT item_id, text || ' ' || CASE item_id % 3 WHEN 0 THEN 'Photosynthesis is the process of ' || replace(text, '.', '') || ' KEY POINT more' WHEN 1 THEN 'Photosynthesis is discussed here' ELSE 'We mean that photosynthesis means ' || replace(text, '.', '') END AS t FROM benchmark),
f AS (SELECT item_id, regexp_extract(t, '(?is)\bphotosynthesis(?:\s+is\s+the|\s+means)\b.*$') <> '' AS has, regexp_replace(regexp_extract(t, '(?is)\bphotosynthesis\b.*$'), '(?is)\s+KEY\s+POINT\b.*$', '') AS part FROM q)
SELECT item_id, CASE WHEN has THEN CASE WHEN part LIKE '%.' THEN part ELSE regexp_replace(part, '[ ,;:-]+$', '') || '.' END END AS definition FROM f""")
def recovered_definitions(spark, d):
    """Each passage with a definition, a topical mention or a meaning of one subject spliced in."""
    text, bare, i = F.col("text"), F.replace("text", F.lit("."), F.lit("")), F.col("item_id") % 3
    tail = F.when(i == 0, F.concat(F.lit("Photosynthesis is the process of "), bare, F.lit(" KEY POINT more"))).when(i == 1, F.lit("Photosynthesis is discussed here")).otherwise(F.concat(F.lit("We mean that photosynthesis means "), bare))
    rows = table(spark, d, "benchmark").select("item_id", F.concat(text, F.lit(" "), tail).alias("t"))
    return rows.select("item_id", F.try_element_at(D.recovered("t", F.lit("Photosynthesis")), F.lit(1)).alias("definition"))


@R.add("dedupe_sentences", "U5", rf"""WITH {LINES}, k AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) ORDER BY pos) AS r FROM lines) SELECT doc_id, pos, line FROM k WHERE r = 1""")
def dedupe_sentences(spark, d):
    from granary.operators.cleaning import lines

    return A.deduped(lines(table(spark, d, "documents")), "doc_id", "pos", "line")


@R.add("dedupe_evidence", "A22", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def dedupe_evidence(spark, d):
    return A.first_of(table(spark, d, "documents"), ["source", "lang"], "doc_id").select("source", "lang", "doc_id")


@R.add("ordered_sources", "A22", """
WITH f AS (SELECT lang, source, min(doc_id) AS first_id FROM documents WHERE source IS NOT NULL GROUP BY ALL) SELECT lang, list(source ORDER BY first_id) AS sources FROM f GROUP BY lang""")
def ordered_sources(spark, d):
    return A.ordered_distinct(table(spark, d, "documents"), "lang", "doc_id", "source").select("lang", F.col("values").alias("sources"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of each question's best documents."""
    near = nearest(spark, d, 3).select("query_id", "doc_id")
    told = near.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(asked(spark, d), "query_id")
    keyed = told.withColumn("pair", F.struct("query_id", "doc_id"))
    found = A.answer_sentences(keyed, "pair", "text", "query").select("pair.query_id", "pair.doc_id", "pos", "sentence")
    return settled(found.join(asked(spark, d), "query_id").select("query_id", "query", "doc_id", "pos", "sentence"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return settled(A.scored_sentences(candidates(spark, d), "query", "sentence"))


@R.add("score_sentences", "T9 M19 M3 F48 F50")
def score_sentences(spark, d):
    rows = A.scored_sentences(candidates(spark, d), "query", "sentence")
    w = Window.partitionBy("query_id").orderBy(*[F.desc(F.round(c, 9)) for c in ("evidence_score", "anchor", "semantic", "lexical", "quality")], "doc_id", "pos")
    return rows.withColumn("rank", F.row_number().over(w)).select("query_id", "doc_id", "pos", *_r("semantic", "lexical", "anchor", "target", "shape", "quality", "identity", "contamination", "evidence_score"), "rank")


G = """SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS quality, (doc_id % 7) / 10.0::DOUBLE AS contamination, (doc_id % 13) / 12.0::DOUBLE AS evidence_score, (doc_id % 17) / 16.0::DOUBLE AS semantic, (doc_id % 5) / 4.0::DOUBLE AS anchor, (doc_id % 3) / 2.0::DOUBLE AS lexical, (doc_id % 19) / 18.0::DOUBLE AS target, (doc_id % 23) / 22.0::DOUBLE AS shape FROM documents"""


def signals(spark, d):
    i = F.col("doc_id")
    parts = {"quality": (11, 10.0), "contamination": (7, 10.0), "evidence_score": (13, 12.0), "semantic": (17, 16.0), "anchor": (5, 4.0), "lexical": (3, 2.0), "target": (19, 18.0), "shape": (23, 22.0)}
    return table(spark, d, "documents").select("doc_id", *[(i % a / b).alias(k) for k, (a, b) in parts.items()])


@R.add("grounded_sentences", "P4", f"WITH g AS ({G}) SELECT doc_id FROM g WHERE quality >= 0.35 AND contamination < 0.55 AND ((evidence_score >= 0.48 AND semantic >= 0.38) OR (anchor >= 0.8 AND lexical >= 0.35 AND evidence_score >= 0.52))")
def grounded_sentences(spark, d):
    return signals(spark, d).filter(A.grounded()).select("doc_id")


@R.add("evidence_blend", "M19", f"""WITH g AS ({G}), s AS (SELECT *, 0.4 * semantic + 0.18 * lexical + 0.2 * anchor + 0.1 * target + 0.07 * shape + 0.05 * quality AS b FROM g),
f AS (SELECT *, CASE WHEN anchor >= 0.95 THEN greatest(b, 0.72 + 0.18 * semantic) WHEN lexical >= 0.8 AND semantic >= 0.55 THEN greatest(b, 0.6 + 0.2 * semantic) ELSE b END AS c FROM s)
SELECT doc_id, round(greatest(0, least(1, c * (1 - 0.8 * contamination) * CASE WHEN quality < 0.35 THEN 0.2 ELSE 1.0 END)), 5)::DOUBLE AS score FROM f""")
def evidence_blend(spark, d):
    return A.with_evidence_score(signals(spark, d).drop("evidence_score")).select("doc_id", F.round("evidence_score", 5).alias("score"))


@R.add("select_evidence", "T10")
def select_evidence(spark, d):
    return A.selected(scored(spark, d)).select("query_id", "doc_id", "pos", "rank", *_r("evidence_score", "novelty"))


@R.add("extractive_answer", "M20 J7")
def extractive_answer(spark, d):
    found = candidates(spark, d)
    chosen = A.selected(settled(A.scored_sentences(found, "query", "sentence"))).select("query_id", "rank", "sentence")
    docs = found.select("query_id", "doc_id").distinct().join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return A.provenance(chosen, docs)


@R.add("evidence_provenance", "J7", f"""
WITH s AS (SELECT item_id, text AS sentence FROM benchmark) SELECT item_id, min(doc_id) AS source_doc FROM s LEFT JOIN documents d ON contains(d.text, s.sentence) GROUP BY item_id""")
def evidence_provenance(spark, d):
    q = text_queries(spark, d)
    found = V.relevant(q, table(spark, d, "documents")).groupBy("query_id").agg(F.min("doc_id").alias("source_doc"))
    return q.join(found, "query_id", "left").select(F.col("query_id").alias("item_id"), "source_doc")


@R.add("fuse_sentences", "G16 U6 J11")
def fuse_sentences(spark, d):
    rows = A.scored_sentences(candidates(spark, d), "query", "sentence").withColumn("vector", A.hashed_vector(F.col("sentence")))
    best = O.top(rows, 8, F.desc(F.round("evidence_score", 9)), F.asc("doc_id"), F.asc("pos")).select("query_id", "doc_id", "pos", "sentence", "vector", "rank")
    return A.fused_sentences(best).select("query_id", "doc_id", "pos", "rank", "group_no")


SETS = rf"list_distinct({TOKENS.format('{0}')})"


@R.add("sentence_graph", "J11", rf"""
WITH {LINES}, l AS (SELECT doc_id, pos, list_distinct({TOKENS.format('line')}) AS t FROM lines)
SELECT a.doc_id, a.pos AS src, b.pos AS dst, round(len(list_intersect(a.t, b.t)) / sqrt(len(a.t)::DOUBLE * len(b.t)), 6) AS weight FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.pos < b.pos WHERE len(a.t) > 0 AND len(b.t) > 0 AND round(len(list_intersect(a.t, b.t)) / sqrt(len(a.t)::DOUBLE * len(b.t)), 9) > 0.45""")
def sentence_graph(spark, d):
    from granary.operators.cleaning import lines

    return A.sentence_edges(lines(table(spark, d, "documents")), "doc_id", "pos", "line").select("doc_id", "src", "dst", *_r("weight"))


# --- context, validation, confidence ---------------------------------------------------------------------------------

BROKEN = " + ".join(f"CASE WHEN contains(low, '{p}') THEN 0.2 ELSE 0 END" for p in A.CONTEXT_BROKEN)


@R.add("context_quality", "F51", f"""WITH t AS (SELECT doc_id, trim(coalesce(text, '')) AS s, lower(trim(coalesce(text, ''))) AS low, len({WORDS.format("trim(coalesce(text, ''))")}) AS n FROM documents)
SELECT doc_id, round(CASE WHEN n < 5 THEN 0 ELSE greatest(0, 1 - ({BROKEN} + CASE WHEN length(s) - length(replace(s, '•', '')) >= 3 THEN 0.2 ELSE 0 END + CASE WHEN n > 450 THEN 0.1 ELSE 0 END)) END, 6)::DOUBLE AS quality FROM t""")
def context_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(A.context_quality("text"), 6).alias("quality"))


def contexts(spark, d):
    near = nearest(spark, d, 5).select("query_id", "doc_id").join(text_queries(spark, d), "query_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    whole = A.overlap_cosine(F.col("query"), F.col("text"))
    best = F.array_max(F.transform(A.context_sentences("text"), lambda s: A.overlap_cosine(F.col("query"), s)))
    rows = near.select("query_id", "doc_id", whole.alias("whole"), F.coalesce(best, F.lit(0.0)).alias("sentence_score"), A.context_quality("text").alias("quality"))
    return rows.withColumn("context_score", A.context_score(F.col("whole"), F.col("sentence_score"), F.col("quality")))


@R.add("context_scores", "A18 M21 M4")
def context_scores(spark, d):
    return contexts(spark, d).select("query_id", "doc_id", *_r("whole", "sentence_score", "quality", "context_score"))


@R.add("context_selection", "T7", """
WITH v AS (SELECT doc_id, doc_id // 8 AS query_id, ((doc_id * 7) % 31 - 15)::DOUBLE AS rerank_score, (doc_id % 13) / 12.0::DOUBLE AS context_score, (doc_id % 17) / 16.0::DOUBLE AS sentence_score, (doc_id % 11) / 10.0::DOUBLE AS quality FROM documents),
s AS (SELECT *, round(0.45 / (1 + exp(-rerank_score)) + 0.35 * context_score + 0.15 * sentence_score + 0.05 * quality, 9) AS selection_score FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY selection_score DESC, context_score DESC, rerank_score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(selection_score, 6)::DOUBLE AS selection_score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def context_selection(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 8").alias("query_id"), (i * 7 % 31 - 15).cast("double").alias("rerank_score"), (i % 13 / 12.0).alias("context_score"), (i % 17 / 16.0).alias("sentence_score"), (i % 11 / 10.0).alias("quality"))
    return A.context_selection(rows).select("query_id", "doc_id", *_r("selection_score"), "rank")


@R.add("answer_validity", "P5 M22", """
WITH v AS (SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS a, (doc_id % 13) / 12.0::DOUBLE AS s, (doc_id % 7) / 6.0::DOUBLE AS l, doc_id % 2 = 0 AS i, doc_id % 3 = 0 AS f FROM documents)
SELECT doc_id, a >= 0.4 AND (NOT i OR f) AND (greatest(0.6 * s + 0.4 * l, l) >= 0.43 OR l >= 0.6 OR s >= 0.6) AS valid FROM v""")
def answer_validity(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", A.valid_answer(i % 11 / 10.0, i % 13 / 12.0, i % 7 / 6.0, i % 2 == 0, i % 3 == 0).alias("valid"))


@R.add("low_confidence", "P7", "SELECT doc_id, CASE WHEN (doc_id % 101) / 101.0 < 0.40 THEN 'low_confidence' ELSE 'ok' END AS status FROM documents")
def low_confidence(spark, d):
    return table(spark, d, "documents").select("doc_id", A.confidence_status(F.col("doc_id") % 101 / 101.0).alias("status"))


CT = [f"CASE WHEN ({' OR '.join(f"contains(s, '{x}')" for x in has)}){''.join(f" AND NOT contains(q, '{x}')" for x in lacks)}{' AND list_has_any(t, [' + ', '.join(f"'{x}'" for x in asks) + '])' if asks else ''} THEN {p} ELSE 0 END" for has, lacks, asks, p in rules.TOPICS]


@R.add("cross_topic_penalty", "F50", rf"""
WITH v AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'What did MOM find on Mars? ' WHEN 1 THEN 'When was Chandrayaan launched? ' WHEN 2 THEN 'Is Mangalyaan near Mars? ' ELSE 'who ' END || text AS query, CASE item_id % 5 WHEN 0 THEN 'Chandrayaan reached the Moon. ' WHEN 1 THEN 'Aditya-L1 and the lunar base. ' WHEN 2 THEN 'Gaganyaan carries people. ' ELSE '' END || text AS sentence FROM benchmark),
p AS (SELECT item_id, lower(query) AS q, lower(sentence) AS s, {TERMS.format('query')} AS t FROM v) SELECT item_id, round(least(1, {' + '.join(CT)}), 6)::DOUBLE AS penalty FROM p""")
def cross_topic_penalty(spark, d):
    i = F.col("item_id")
    query = F.concat(F.when(i % 4 == 0, "What did MOM find on Mars? ").when(i % 4 == 1, "When was Chandrayaan launched? ").when(i % 4 == 2, "Is Mangalyaan near Mars? ").otherwise("who "), "text")
    sentence = F.concat(F.when(i % 5 == 0, "Chandrayaan reached the Moon. ").when(i % 5 == 1, "Aditya-L1 and the lunar base. ").when(i % 5 == 2, "Gaganyaan carries people. ").otherwise(""), "text")
    rows = table(spark, d, "benchmark").select("item_id", query.alias("query"), sentence.alias("sentence"))
    return rows.select("item_id", F.round(A.contamination("query", "sentence"), 6).alias("penalty"))


@R.add("selected_answerability", "F36", r"""
WITH v AS (SELECT doc_id // 4 AS query_id, CASE (doc_id // 4) % 3 WHEN 0 THEN 'What is rain?' WHEN 1 THEN 'Why does it rain' ELSE 'define snow' END AS query, CASE doc_id % 9 WHEN 0 THEN 'Rain is the water that falls. ' WHEN 1 THEN 'Snow refers to ice. ' ELSE 'Rain is discussed. ' END || coalesce(text, '') AS text,
 (doc_id % 11) / 10.0::DOUBLE AS a, (doc_id % 7) / 6.0::DOUBLE AS t, (doc_id % 13) / 12.0::DOUBLE AS s, (doc_id % 5) / 4.0::DOUBLE AS q, (doc_id % 17) / 16.0::DOUBLE AS r FROM documents),
g AS (SELECT query_id, any_value(query) AS query, 0.35 * max(a) + 0.30 * max(t) + 0.15 * max(s) + 0.10 * max(q) + 0.10 * max(r) AS raw, bool_or(regexp_matches(text, '(?i)\brain\s+(?:is\s+(?:a|an|the)|refers\s+to|means|denotes|is\s+defined\s+as|is\s+known\s+as|is\s+called)\b|\b(?:has|have)\s+defined\s+rain\s+as\b')) AS rain, bool_or(regexp_matches(text, '(?i)\bsnow\s+(?:is\s+(?:a|an|the)|refers\s+to|means|denotes|is\s+defined\s+as|is\s+known\s+as|is\s+called)\b|\b(?:has|have)\s+defined\s+snow\s+as\b')) AS snow FROM v GROUP BY query_id),
x AS (SELECT query_id, raw, query <> 'Why does it rain' AS asks, CASE query WHEN 'What is rain?' THEN NOT rain WHEN 'define snow' THEN NOT snow ELSE false END AS missing FROM g)
SELECT query_id, round(CASE WHEN missing THEN raw * 0.35 ELSE raw END + 1e-9, 6)::DOUBLE AS score, CASE WHEN missing THEN 'identity_definition_required' ELSE 'evidence_supported' END AS reason, NOT missing AND raw >= CASE WHEN asks THEN 0.55 ELSE 0.45 END AS answerable FROM x""")
def selected_answerability(spark, d):
    i = F.col("doc_id")
    query_id = F.expr("doc_id div 4")
    lead = F.when(i % 9 == 0, "Rain is the water that falls. ").when(i % 9 == 1, "Snow refers to ice. ").otherwise("Rain is discussed. ")
    rows = table(spark, d, "documents").select(query_id.alias("query_id"), F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"), (i % 11 / 10.0).alias("anchor"), (i % 7 / 6.0).alias("target"), (i % 13 / 12.0).alias("semantic"), (i % 5 / 4.0).alias("quality"), (i % 17 / 16.0).alias("evidence_score"))
    query = F.when(F.col("query_id") % 3 == 0, "What is rain?").when(F.col("query_id") % 3 == 1, "Why does it rain").otherwise("define snow")
    out = A.selected_answerability(rows.select("query_id").distinct().withColumn("query", query), rows)
    return out.select("query_id", F.round(F.col("score") + 1e-9, 6).alias("score"), "reason", "answerable")


@R.add("confidence_components", "A19", f"""
WITH {BM25}, s AS (SELECT query_id, max(score) AS top, max(score) FILTER (rank = 2) AS second, min(score) AS low, avg(score) AS mean, count(*) AS n FROM sparse GROUP BY query_id),
c AS (SELECT query_id, max(least(1.0, score / 50)) AS best, avg(least(1.0, score / 50)) AS mean FROM sparse GROUP BY query_id),
m AS (SELECT query_id, max(k) / sum(k) AS share FROM (SELECT query_id, source, count(*) AS k FROM sparse JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY query_id)
SELECT query_id, round(CASE WHEN n = 1 THEN 1 ELSE greatest(0, least(1, (0.65 * (top - second) + 0.35 * (top - s.mean)) / greatest(1e-6, top - low))) END, 6)::DOUBLE AS ranking, round(0.75 * best + 0.25 * c.mean, 6)::DOUBLE AS context, round(share, 6)::DOUBLE AS source_consistency FROM s JOIN c USING (query_id) JOIN m USING (query_id)""")
def confidence_components(spark, d):
    rows = sparse(spark, d)
    by = rows.groupBy("query_id").agg(F.collect_list("score").alias("s"))
    share = rows.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("k")).groupBy("query_id").agg((F.max("k") / F.sum("k")).alias("source_consistency"))
    out = by.select("query_id", A.ranking_confidence(F.col("s")).alias("ranking"), A.weighted_best(F.transform("s", lambda x: x / 50), 0.75).alias("context"))
    return out.join(share, "query_id").select("query_id", *_r("ranking", "context", "source_consistency"))


CONF = {k: (m, float(m - 1)) for k, m in zip(A.WEIGHTS, (11, 13, 17, 19, 23, 29, 31, 37, 41, 43))}
RAW = " + ".join(f"{w}::DOUBLE * (doc_id % {CONF[k][0]}) / {CONF[k][1]}::DOUBLE" for k, w in A.WEIGHTS.items())
GR = f"(doc_id % {CONF['query_grounding'][0]}) / {CONF['query_grounding'][1]}::DOUBLE"


@R.add("calibrated_confidence", "A20", f"""
WITH v AS (SELECT doc_id, {RAW} - 0.16::DOUBLE * ((doc_id % 5) / 7.0::DOUBLE) AS raw, {GR} AS g, doc_id % 4 > 0 AS has, doc_id % 6 > 0 AS valid, (doc_id % {CONF['target'][0]}) / {CONF['target'][1]} >= 0.5 AND (doc_id % {CONF['relevance'][0]}) / {CONF['relevance'][1]} >= 0.75 AND {GR} >= 0.55 AS boost FROM documents),
r AS (SELECT *, raw * CASE WHEN has THEN 1.0 ELSE 0.55 END::DOUBLE * CASE WHEN valid THEN 1.0 ELSE 0.45 END::DOUBLE * CASE WHEN has AND g < 0.35 THEN 0.45 WHEN has AND g < 0.45 THEN 0.7 ELSE 1.0 END::DOUBLE + CASE WHEN has AND boost THEN 0.03 ELSE 0 END::DOUBLE AS x FROM v)
SELECT doc_id, round(least(0.08 + 0.88 * greatest(0, least(1, x)), CASE WHEN has THEN 1.0 ELSE 0.45 END, CASE WHEN valid THEN 1.0 ELSE 0.22 END, CASE WHEN has AND g < 0.35 THEN 0.25 WHEN has AND g < 0.45 THEN 0.4 ELSE 1.0 END), 6)::DOUBLE AS confidence FROM r""")
def calibrated_confidence(spark, d):
    i = F.col("doc_id")
    c = {k: i % m / F.lit(b) for k, (m, b) in CONF.items()}
    return table(spark, d, "documents").select("doc_id", F.round(A.calibrated(c, i % 5 / 7.0, i % 4, i % 6 > 0), 6).alias("confidence"))


@R.add("multi_query_merge", "A21", """WITH v AS (SELECT conv_id, (turn * 7 % 11) / 10.0::DOUBLE AS a, (turn * 5 % 13) / 12.0::DOUBLE AS b, turn % 20 AS k FROM conversations)
SELECT conv_id, min(a) AS agreement, min(b) AS margin, min(a) AS stability, min(b) AS confidence, max(a) AS complexity, max(k) AS topk FROM v GROUP BY conv_id""")
def multi_query_merge(spark, d):
    t = F.col("turn")
    a, b = t * 7 % 11 / 10.0, t * 5 % 13 / 12.0
    rows = table(spark, d, "conversations").select("conv_id", a.alias("agreement"), b.alias("margin"), a.alias("stability"), b.alias("confidence"), a.alias("complexity"), (t % 20).alias("topk"))
    return V.merged_requests(rows, "conv_id")


# --- chunks --------------------------------------------------------------------------------------------------------


@R.add("chunk_documents", "W7 M1")
def chunk_documents(spark, d):
    return C.chunks(table(spark, d, "documents"), "doc_id", "text")


@R.add("chunk_pages", "W7 W8 M1")
def chunk_pages(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return C.chunks(lines, "doc_id", "text", "page", *C.LIBRARY)


@R.add("corpus_records", "M2")
def corpus_records(spark, d):
    docs = table(spark, d, "documents")
    return C.records(C.chunks(docs, "doc_id", "text").join(docs.select("doc_id", "lang", "source"), "doc_id"), "doc_id", "lang", "source")


@R.add("reconstruct_documents", "W9")
def reconstruct_documents(spark, d):
    return C.reconstructed(C.chunks(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def qrels(spark, d):
    return settled(V.relevant(text_queries(spark, d), table(spark, d, "documents")))


@R.add("chunking_ablation", "A25")
def chunking_ablation(spark, d):
    docs, q, marks = table(spark, d, "documents"), text_queries(spark, d), qrels(spark, d)
    parts = []
    sentences = settled(C.split(docs, "doc_id", "text"))
    for size, overlap in C.VARIANTS:
        found = settled(C.from_sentences(sentences, "doc_id", size, overlap).select("doc_id", "text", F.xxhash64("doc_id", "chunk_index").alias("id")))
        hits = O.bm25_best(found.select(F.col("id").alias("doc_id"), "text"), q, 5, plain=True)
        rows = hits.select("query_id", F.col("doc_id").alias("id"), "rank").join(found.select("id", "doc_id", "text"), "id")
        parts.append(V.chunk_measures(rows, q, marks).select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "queries", *_r("recall", "precision", "mrr", "relevance", "support")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- measures ------------------------------------------------------------------------------------------------------

QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@R.add("qrels", "J10", f"WITH {QRELS} SELECT query_id, doc_id FROM qrels")
def relevant_documents(spark, d):
    return qrels(spark, d)


def ir(source: str, k: int) -> str:
    return f"""(SELECT q.query_id, hits / relevant AS recall, CASE WHEN returned > 0 THEN hits / returned ELSE 0 END AS precision, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, coalesce(1.0 / first, 0) AS mrr FROM (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY 1) q
LEFT JOIN (SELECT s.query_id, count(r.doc_id) AS hits, count(*) AS returned, min(CASE WHEN r.doc_id IS NOT NULL THEN rank END) AS first FROM {source} s LEFT JOIN qrels r ON r.query_id = s.query_id AND r.doc_id = s.doc_id WHERE rank <= {k} GROUP BY 1) h ON h.query_id = q.query_id)"""


@R.add("ir_metrics", "A23", f"WITH {BM25}, {QRELS} SELECT query_id, round(coalesce(recall, 0), 6)::DOUBLE AS recall, round(precision, 6)::DOUBLE AS precision, hit_rate::DOUBLE AS hit_rate, round(mrr, 6)::DOUBLE AS mrr FROM {ir('sparse', 3)}")
def ir_metrics(spark, d):
    return V.measures(sparse(spark, d), qrels(spark, d), 3).select("query_id", *_r("recall", "precision", "hit_rate", "mrr"))


FUSED = f"""{BOTH}, {QRELS}, mm AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round({MM}, 9) DESC, round(dense_score, 9) DESC, round(sparse_score, 9) DESC, doc_id) AS rank FROM pair),
rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round({RR}, 12) DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, doc_id) AS rank FROM pair),
res AS (SELECT 'minmax' AS method, * FROM {ir('mm', 3)} UNION ALL SELECT 'rrf', * FROM {ir('rr', 3)}),
a AS (SELECT method, count(*) AS queries, avg(coalesce(recall, 0)) AS recall, avg(precision) AS precision, avg(hit_rate) AS hit_rate, avg(mrr) AS mrr FROM res GROUP BY method), b AS (SELECT *, (recall + precision + hit_rate + mrr) / 4 AS mean FROM a)"""


@R.add("fusion_ablation", "A24", f"WITH {FUSED} SELECT method, queries, round(recall, 6)::DOUBLE AS recall, round(precision, 6)::DOUBLE AS precision, round(hit_rate, 6)::DOUBLE AS hit_rate, round(mrr, 6)::DOUBLE AS mrr, round(mean, 6)::DOUBLE AS mean, method = (SELECT method FROM b ORDER BY round(mean, 9) DESC, method LIMIT 1) AS wins FROM b")
def fusion_ablation(spark, d):
    rows = settled(both(spark, d))
    out = V.compared({"minmax": O.minmax_fusion(rows, K), "rrf": O.rrf(rows, K)}, qrels(spark, d), 3)
    return out.select("method", "queries", *_r("recall", "precision", "hit_rate", "mrr", "mean"), "wins")


@R.add("resolve_ground_truth", "J8", "WITH t AS (SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text) SELECT d.doc_id AS query_id, CASE WHEN n = 1 THEN t.doc_id END AS doc_id, n FROM documents d JOIN t ON d.text = t.text")
def resolve_ground_truth(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return V.ground_truth(docs.withColumnRenamed("doc_id", "query_id"), docs)


@R.add("valid_ground_truth", "P8", f"WITH {QRELS} SELECT item_id AS query_id, count(doc_id) AS n_labels, CAST(0 AS BIGINT) AS n_missing, count(doc_id) > 0 AS valid FROM benchmark LEFT JOIN qrels ON query_id = item_id GROUP BY item_id")
def valid_ground_truth(spark, d):
    return V.valid_truth(text_queries(spark, d), qrels(spark, d), table(spark, d, "documents").select("doc_id"))


# --- controller ----------------------------------------------------------------------------------------------------


def plans(spark, d):
    analysed = A.complexity(asked(spark, d), "query")
    return A.with_plan(analysed, "query_complexity", "recommended_topk").select("query_id", "query", "recommended_topk", "initial_k", "max_k")


def history(spark, d):
    return V.adaptive(plans(spark, d), dense(spark, d), sparse(spark, d))


@R.add("adaptive_retrieval", "M10 M11 W10")
def adaptive_retrieval(spark, d):
    return history(spark, d).select("query_id", "k", *_r("agreement", "margin", "stability", "confidence"), "decision", "stop", "stop_reason")


@R.add("three_way_diagnostic", "M27")
def three_way_diagnostic(spark, d):
    p = plans(spark, d)
    fused = settled(O.minmax_fusion(both(spark, d), DEPTH))
    depth = fused.join(p, "query_id")
    ctl = fused.join(V.last_rounds(history(spark, d)).select("query_id", "k"), "query_id")
    methods = {"fixed": fused.filter("rank <= 5"), "complexity": depth.filter("rank <= recommended_topk"), "controller": ctl.filter("rank <= k")}
    out = V.compared({m: r.select("query_id", "doc_id", "rank") for m, r in methods.items()}, qrels(spark, d), DEPTH)
    return out.select("method", "queries", *_r("recall", "precision", "hit_rate", "mrr", "mean"), "wins")


@R.add("rag_pipeline", "M25 M26 S26")
def rag_pipeline(spark, d):
    """One row per question: plan, last round of the controller, evidence and confidence."""
    last = V.last_rounds(history(spark, d)).select("query_id", "k", "agreement", "margin", "stability", "confidence", "decision", "stop_reason")
    rows = scored(spark, d)
    told = A.selected(rows).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence", "evidence_score", "semantic", "quality", "contamination", "target"))).alias("evidence"))
    out = plans(spark, d).join(last, "query_id", "left").join(told, "query_id", "left")
    e = F.coalesce("evidence", F.array().cast(told.schema["evidence"].dataType))
    out = out.withColumn("e", e)
    best = lambda f: A.weighted_best(F.transform("e", lambda x: x[f]), 0.70)
    c = {"retrieval": F.coalesce("confidence", F.lit(0.0)), "ranking": F.coalesce("margin", F.lit(0.0)), "context": best("semantic"), "answer_agreement": F.when(F.size("e") > 0, 1.0).otherwise(0.0), "query_grounding": best("semantic"), "relevance": best("evidence_score"), "semantic": best("semantic"), "quality": best("quality"), "target": best("target"), "source_consistency": F.lit(1.0)}
    bad = F.when(F.size("e") > 0, F.array_max(F.transform("e", lambda x: x["contamination"]))).otherwise(1.0)
    answer = F.array_join(F.transform("e", lambda x: x["sentence"]), " ")
    return out.select("query_id", "query", "k", "decision", "stop_reason", answer.alias("answer"), F.size("e").alias("n_evidence"), F.round(A.calibrated(c, bad, F.size("e"), F.size("e") > 0), 6).alias("confidence"))
