"""Queries over rankings. Text queries are the benchmark's passages; query vectors are those with ids divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from granary.operators import answers, retrieval as O
from granary.plans.base import Registry, table
from granary.session import settled

R = Registry()
K, DEPTH = 10, 20

TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"


def bm25_sql(queries: str, depth: int = DEPTH, terms: str = "asked") -> str:
    """The common tables from postings to ``sparse``, the best documents of queries (query_id, query)."""
    return rf"""
posted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, len({TOKENS.format('text')}) AS len FROM documents),
raw AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM posted GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
{terms} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM ({queries})) GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lengths))))::DOUBLE AS score FROM posted JOIN {terms} USING (term) JOIN stats USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= {depth})"""


BM25 = bm25_sql("SELECT item_id AS query_id, text AS query FROM benchmark")
#: Query i of the vectors stands beside passage i / 100 of the texts.
KNN = f"""
dots AS (SELECT q.vec_id // 100 AS query_id, v.vec_id AS doc_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dots) WHERE rank <= {DEPTH})"""
NORM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
BOTH = f"""{BM25}, {KNN},
d AS (SELECT query_id, doc_id, score AS dense_raw, {NORM} AS dense_score, rank AS dense_rank FROM dense WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, doc_id, score AS sparse_raw, {NORM} AS sparse_score, rank AS sparse_rank FROM sparse WINDOW w AS (PARTITION BY query_id)),
pair AS (SELECT query_id, doc_id, coalesce(dense_raw, 0) AS dense_raw, coalesce(dense_score, 0) AS dense_score, dense_rank, coalesce(sparse_raw, 0) AS sparse_raw, coalesce(sparse_score, 0) AS sparse_score, sparse_rank FROM d FULL OUTER JOIN s USING (query_id, doc_id))"""


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).filter(F.col("doc_id") % 100 == 0).select(F.expr("doc_id div 100").alias("query_id"), "vector")


def scores(spark, d):
    return O.bm25(table(spark, d, "documents").select("doc_id", "text"), text_queries(spark, d))


def sparse(spark, d):
    return nearest(spark, d, DEPTH)


def nearest(spark, d, k):
    return O.bm25_best(table(spark, d, "documents").select("doc_id", "text"), text_queries(spark, d), k)


def dense(spark, d):
    return O.knn(vectors(spark, d), query_vectors(spark, d), DEPTH)


def both(spark, d):
    return O.outer(dense(spark, d), sparse(spark, d))


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


TERM_STATS = rf"""
WITH counted AS MATERIALIZED (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term),
r AS MATERIALIZED (SELECT term, df, ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) AS x FROM counted)
SELECT term, df, round(CASE WHEN x < 0 THEN 0.25 * (SELECT avg(x) FROM r) ELSE x END, 6) AS idf FROM r"""


@R.add("term_stats", "A3", TERM_STATS)
def term_stats(spark, d):
    docs = table(spark, d, "documents")
    return O.term_stats(O.postings(docs), docs.count()).select("term", "df", *_six("idf"))


@R.add("bm25_scores", "J3 A4", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM scores")
def bm25_scores(spark, d):
    return scores(spark, d).select("query_id", "doc_id", *_six("score"))


@R.add("bm25_topk", "J3 A4 T4", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM sparse WHERE rank <= {K}")
def bm25_topk(spark, d):
    return nearest(spark, d, K).select("query_id", "doc_id", *_six("score"), "rank")


@R.add("bm25_simple", "A5", rf"""
WITH {BM25}, i AS (SELECT term, greatest(0.0, ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1.0) AS idf FROM stats)
SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lengths))))::DOUBLE, 4) AS score FROM posted JOIN asked USING (term) JOIN i USING (term) JOIN lengths USING (doc_id) GROUP BY ALL""")
def bm25_simple(spark, d):
    rows = O.bm25_plain(table(spark, d, "documents").select("doc_id", "text"), text_queries(spark, d))
    return rows.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@R.add("knn_exact", "J4", f"WITH {KNN} SELECT query_id, doc_id, round(score, 6) AS score FROM dense")
def knn_exact(spark, d):
    return dense(spark, d).select("query_id", "doc_id", *_six("score"))


@R.add("knn_topk", "T5", f"WITH {KNN} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dense WHERE rank <= {K}")
def knn_topk(spark, d):
    return O.knn(vectors(spark, d), query_vectors(spark, d), K).select("query_id", "doc_id", *_six("score"), "rank")


@R.add("knn_ivf", "S21 J4")
def knn_ivf(spark, d):
    """Found by the index, with the share of the exact results that each query's ten have."""
    index, centroids = O.ivf(vectors(spark, d))
    q = query_vectors(spark, d)
    found = settled(O.search_ivf(settled(index), centroids, q, K))
    return found.join(O.recall(found, O.knn(vectors(spark, d), q, K)), "query_id").select("query_id", "doc_id", *_six("score"), "rank", "recall")


@R.add("prepare_ranking", "W1", f"""
WITH {BM25}, p AS (SELECT query_id, CASE WHEN rank % 7 = 0 THEN NULL WHEN rank % 5 = 0 THEN min(doc_id) OVER (PARTITION BY query_id) ELSE doc_id END AS doc_id, rank FROM sparse)
SELECT query_id, doc_id, CAST(min(rank) AS INT) AS rank FROM p WHERE doc_id IS NOT NULL GROUP BY ALL""")
def prepare_ranking(spark, d):
    first = F.min("doc_id").over(Window.partitionBy("query_id"))
    rows = sparse(spark, d).withColumn("first", first).withColumn("doc_id", F.when(F.col("rank") % 7 == 0, None).when(F.col("rank") % 5 == 0, F.col("first")).otherwise(F.col("doc_id")))
    return O.prepared(rows.withColumn("position", F.col("rank"))).select("query_id", "doc_id", "rank")


@R.add("minmax_normalize", "W2", f"WITH {BM25} SELECT query_id, doc_id, round({NORM}, 6) AS normalized FROM sparse WINDOW w AS (PARTITION BY query_id)")
def minmax_normalize(spark, d):
    return sparse(spark, d).select("query_id", "doc_id", F.round(O.minmax("score", "query_id"), 6).alias("normalized"))


@R.add("hybrid_full_outer", "J1", f"WITH {BOTH} SELECT query_id, doc_id, round(dense_score, 6)::DOUBLE AS dense_score, round(sparse_score, 6)::DOUBLE AS sparse_score FROM pair")
def hybrid_full_outer(spark, d):
    return both(spark, d).select("query_id", "doc_id", *_six("dense_score", "sparse_score"))


@R.add("candidate_union", "U1", f"WITH {BM25}, {KNN} SELECT query_id, doc_id FROM dense UNION SELECT query_id, doc_id FROM sparse")
def candidate_union(spark, d):
    return dense(spark, d).select("query_id", "doc_id").union(sparse(spark, d).select("query_id", "doc_id")).distinct()


MM = "0.6 * dense_score + 0.4 * sparse_score"


@R.add("minmax_fusion", "T2", f"""WITH {BOTH}, f AS (SELECT query_id, doc_id, {MM} AS fusion_score, row_number() OVER (PARTITION BY query_id ORDER BY round({MM}, 9) DESC, round(dense_score, 9) DESC, round(sparse_score, 9) DESC, doc_id) AS rank FROM pair)
SELECT query_id, doc_id, round(fusion_score, 6)::DOUBLE AS fusion_score, CAST(rank AS INT) AS rank FROM f WHERE rank <= {K}""")
def minmax_fusion(spark, d):
    return O.minmax_fusion(both(spark, d), K).select("query_id", "doc_id", *_six("fusion_score"), "rank")


RR = "(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0))"


@R.add("rrf_fusion", "A6 T3", f"""WITH {BOTH}, f AS (SELECT query_id, doc_id, {RR} AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round({RR}, 12) DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, doc_id) AS rank FROM pair)
SELECT query_id, doc_id, round(rrf_score, 8)::DOUBLE AS rrf_score, CAST(rank AS INT) AS rank FROM f WHERE rank <= {K}""")
def rrf_fusion(spark, d):
    return O.rrf(both(spark, d), K).select("query_id", "doc_id", F.round("rrf_score", 8).alias("rrf_score"), "rank")


@R.add("result_rows", "J2", f"WITH {BM25} SELECT query_id, s.doc_id, lang, source, n_chars FROM sparse s JOIN documents d ON s.doc_id = d.doc_id")
def result_rows(spark, d):
    return sparse(spark, d).join(table(spark, d, "documents"), "doc_id").select("query_id", "doc_id", "lang", "source", "n_chars")


@R.add("anchor_candidates", "J6")
def anchor_candidates(spark, d):
    from granary.plans.match_queries import asked

    return O.anchors(asked(spark, d), table(spark, d, "documents"))


@R.add("hybrid_topk", "T1")
def hybrid_topk(spark, d):
    from granary.plans.match_queries import asked

    return O.hybrid(both(spark, d), asked(spark, d), table(spark, d, "documents"), K).select("query_id", "doc_id", *_six("ranking_score", "hybrid_score"), "exact_phrase", "reference_match", "rank")


@R.add("agreement", "A7 U2", f"""WITH {BOTH} SELECT query_id, round(CASE WHEN sum(dense_score + sparse_score) > 1e-12 THEN sum(CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN dense_score + sparse_score ELSE 0 END) / sum(dense_score + sparse_score) ELSE 0 END, 6)::DOUBLE AS agreement,
 count_if(dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS n_both, count(*) AS n_any FROM pair GROUP BY query_id""")
def agreement(spark, d):
    return O.agreement(both(spark, d)).select("query_id", *_six("agreement"), "n_both", "n_any")


@R.add("stability", "A8", f"""
WITH {BM25}, s AS (SELECT query_id, list(doc_id) FILTER (rank <= 5) AS a, list(doc_id) FILTER (rank <= 7) AS b, list(doc_id) FILTER (rank <= 9) AS c FROM sparse GROUP BY query_id)
SELECT query_id, round((len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + len(list_intersect(b, c)) / len(list_distinct(list_concat(b, c)))) / 2, 6) AS stability FROM s""")
def stability(spark, d):
    return O.stability(sparse(spark, d), (5, 7, 9)).select("query_id", *_six("stability"))


@R.add("margin", "A9", f"""WITH {BM25} SELECT query_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE (max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) / (abs(max(score) FILTER (rank = 1)) + 1e-8) END, 6) AS margin FROM sparse WHERE rank <= 2 GROUP BY query_id""")
def margin(spark, d):
    return O.margin(scores(spark, d), "score").select("query_id", *_six("margin"))


C = "greatest(0.0, least(1.0, 0.40::DOUBLE * a + 0.35::DOUBLE * m + 0.25::DOUBLE * s))"


@R.add("retrieval_decision", "M11", f"""
WITH v AS (SELECT doc_id, (doc_id % 101) / 101.0::DOUBLE AS a, (doc_id % 89) / 83.0::DOUBLE AS m, (doc_id % 97) / 97.0::DOUBLE AS s FROM documents)
SELECT doc_id, round({C}, 6)::DOUBLE AS confidence, CASE WHEN {C} >= 0.75 THEN 'ACCEPT' WHEN {C} >= 0.55 THEN 'EXPAND_TOPK' WHEN {C} >= 0.35 THEN 'RERANK_AGAIN' ELSE 'RETRIEVE_AGAIN' END AS decision,
 concat_ws(',', CASE WHEN a < 0.5 THEN 'low_agreement' END, CASE WHEN m < 0.2 THEN 'low_margin' END, CASE WHEN s < 0.5 THEN 'low_stability' END) AS reason FROM v""")
def retrieval_decision(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", O.decision(i % 101 / 101.0, i % 89 / 83.0, i % 97 / 97.0).alias("x"))
    return rows.select("doc_id", F.round("x.confidence", 6).alias("confidence"), "x.decision", "x.reason")


@R.add("convergence_gain", "W10", """
WITH v AS (SELECT conv_id, turn, (length(text) % 50) / 50.0::DOUBLE AS c FROM conversations), l AS (SELECT conv_id, turn, c - lag(c) OVER (PARTITION BY conv_id ORDER BY turn) AS gain FROM v)
SELECT conv_id, turn, round(gain, 6) AS gain, coalesce(gain <= 0.02, false) AS converged FROM l""")
def convergence_gain(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 50 / 50.0).alias("c"))
    gain = F.col("c") - F.lag("c").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("g", gain).select("conv_id", "turn", F.round("g", 6).alias("gain"), F.coalesce(F.col("g") <= 0.02, F.lit(False)).alias("converged"))


@R.add("rerank_order", "T6", rf"""
WITH {BM25}, r AS (SELECT query_id, s.doc_id, list_distinct({TOKENS.format('b.text')}) AS a, list_distinct({TOKENS.format('d.text')}) AS t FROM sparse s JOIN documents d ON d.doc_id = s.doc_id JOIN benchmark b ON b.item_id = query_id),
c AS (SELECT query_id, doc_id, CASE WHEN len(a) * len(t) > 0 THEN len(list_intersect(a, t)) / sqrt(len(a)::DOUBLE * len(t)) ELSE 0 END AS rerank_score FROM r)
SELECT query_id, doc_id, round(rerank_score, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, doc_id) AS INT) AS rank FROM c""")
def rerank_order(spark, d):
    rows = sparse(spark, d).select("query_id", "doc_id").join(text_queries(spark, d), "query_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    scored = rows.select("query_id", "doc_id", answers.overlap_cosine(F.col("query"), F.col("text")).alias("rerank_score"))
    return O.ranked(scored, DEPTH, "rerank_score").select("query_id", "doc_id", *_six("rerank_score"), "rank")
