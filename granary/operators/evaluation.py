"""Measures of retrieval against labels, comparisons of methods, and the adaptive controller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions.numeric import clamp
from granary.operators import retrieval as O
from granary.session import settled


def relevant(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id of documents that contain a query's whole text. They meet by the query's rarest word and
    are compared in the same row: with few queries the join is a broadcast, and no text is shuffled."""
    from granary.functions import text as X

    words = docs.select("doc_id", F.explode(F.array_distinct(X.tokens("text"))).alias("word"))
    asked = queries.select("query_id", "query", F.explode(F.array_distinct(X.tokens("query"))).alias("word"))
    counts = words.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare = asked.join(counts, "word").groupBy("query_id", "query").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    whole = docs.select("doc_id", "text", F.explode(F.array_distinct(X.tokens("text"))).alias("word"))
    return whole.join(settled(rare), "word").filter(F.contains("text", "query")).select("query_id", "doc_id")


def labelled(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results of queries that have labels; ``hit`` tells whether the document is relevant."""
    marks = qrels.select("query_id", "doc_id", F.lit(True).alias("hit")).distinct()
    return results.join(qrels.select("query_id").distinct(), "query_id", "left_semi").join(marks, ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def measures(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, recall, precision (of what was returned, at most k), hit_rate, mrr."""
    n = qrels.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    got = labelled(results.filter(F.col("rank") <= k), qrels).groupBy("query_id").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count(F.lit(1)).alias("returned"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    rows = n.join(got, "query_id", "left").fillna(0, ["hits", "returned"])
    return rows.select(
        "query_id", (F.col("hits") / F.col("relevant")).alias("recall"), F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0).alias("precision"),
        (F.col("hits") > 0).cast("double").alias("hit_rate"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def mean_measures(per_query: DataFrame) -> DataFrame:
    names = ("recall", "precision", "hit_rate", "mrr")
    out = per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(n).alias(n) for n in names])
    return out.withColumn("mean", (F.col("recall") + F.col("precision") + F.col("hit_rate") + F.col("mrr")) / 4.0)


def compared(methods: dict[str, DataFrame], qrels: DataFrame, k: int) -> DataFrame:
    """method, its measures, their mean, and whether it wins (the best mean, ties to the first name)."""
    parts = [mean_measures(measures(r, qrels, k)).withColumn("method", F.lit(m)) for m, r in methods.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.agg(F.max_by("method", F.struct(F.round("mean", 9), -F.ascii("method"))).alias("winner"))
    return rows.crossJoin(F.broadcast(best)).withColumn("wins", F.col("method") == F.col("winner")).drop("winner")


def ground_truth(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Labels given as texts, to ids: query_id, doc_id, n. A text that no row has, or more than one, has no id."""
    by = corpus.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    found = candidates.join(by, "text", "left")
    return found.select("query_id", F.when(F.col("n") == 1, F.col("doc_id")).alias("doc_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def valid_truth(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Queries with labels, all of whose labels exist: query_id, n_labels, n_missing, valid."""
    marks = qrels.join(corpus.select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    by = marks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_labels"), F.sum(F.col("known").isNull().cast("long")).alias("n_missing"))
    return queries.select("query_id").join(by, "query_id", "left").fillna(0).withColumn("valid", (F.col("n_labels") > 0) & (F.col("n_missing") == 0))


def merged_requests(rows: DataFrame, key: str) -> DataFrame:
    """Several questions of one request as one: the least of what speaks for it, the most of what it costs."""
    least, most = ("agreement", "margin", "stability", "confidence"), ("complexity", "topk")
    return rows.groupBy(key).agg(*[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])


def coverage(a: Column, b: Column) -> Column:
    """Share of a's distinct elements that b has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def chunk_measures(results: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 5, top: int = 3) -> DataFrame:
    """Means over queries with labels, for results (query_id, doc_id, text, rank) that are chunks of documents: recall,
    precision over k, MRR, context relevance, and the share whose best ``top`` hold half of the answer's tokens."""
    from granary.functions import text as X

    rows = labelled(results.filter(F.col("rank") <= k), qrels).join(queries, "query_id")
    q, t = F.array_distinct(X.tokens("query")), F.array_distinct(X.tokens("text"))
    context = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= top, t))))
    by = rows.withColumn("cover", coverage(q, t)).groupBy("query_id", "query").agg(F.max(F.col("hit").cast("double")).alias("recall"), (F.sum(F.col("hit").cast("double")) / k).alias("precision"), F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("mrr"), F.avg("cover").alias("relevance"), context.alias("context"))
    by = by.withColumn("support", (coverage(q, F.col("context")) >= 0.5).cast("double"))
    return by.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in ("recall", "precision", "mrr", "relevance", "support")])


# --- adaptive retrieval --------------------------------------------------------------------------------------------


def adaptive(plans: DataFrame, dense: DataFrame, sparse: DataFrame, threshold: float = 0.75, epsilon: float = 0.02, step: int = 5) -> DataFrame:
    """One row per query and round: depth, agreement, margin, stability, confidence, decision, stop, stop_reason.

    plans: query_id, initial_k, max_k. All queries that are still open go through each round together; those that stop
    are left out of the next (an anti-join). Depth grows by ``step``, so there are at most as many rounds as steps."""
    # each is read by every round
    plans, dense, sparse = settled(plans), settled(dense), settled(sparse)
    depth = plans.agg(F.min("initial_k"), F.max("max_k")).first()
    history: DataFrame | None = None
    open_ = plans.select("query_id", "max_k")
    k = depth[0] or 0
    while depth[1] is not None and k <= depth[1]:
        d, s = dense.filter(F.col("rank") <= k).join(open_, "query_id", "left_semi"), sparse.filter(F.col("rank") <= k).join(open_, "query_id", "left_semi")
        both = O.outer(d, s)
        fused = O.minmax_fusion(both, k)
        sets = fused.groupBy("query_id").agg(F.collect_list("doc_id").alias("ids"))
        rows = open_.join(O.agreement(both), "query_id", "left").join(O.margin(fused, "fusion_score"), "query_id", "left").join(sets, "query_id", "left")
        rows = rows.fillna(0.0, ["agreement", "margin"]).withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
        if history is None:
            rows = rows.withColumns({"stability": F.lit(0.5), "before": F.lit(None).cast("double")})
        else:
            last = history.filter(F.col("k") == k - step).select("query_id", F.col("ids").alias("old"), F.col("confidence").alias("before"))
            rows = rows.join(last, "query_id", "left").withColumn("stability", O.jaccard(F.col("ids"), F.col("old"))).drop("old")
        rows = rows.withColumn("x", O.decision(F.col("agreement"), clamp(F.col("margin")), F.col("stability"))).withColumns({"confidence": F.col("x.confidence"), "decision": F.col("x.decision"), "k": F.lit(k)}).drop("x")
        full, sure, flat = F.col("k") >= F.col("max_k"), F.col("confidence") >= threshold, F.coalesce(F.col("confidence") - F.col("before") <= epsilon, F.lit(False))
        rows = rows.withColumn("stop", full | sure | flat).withColumn("stop_reason", F.when(full, "max_k_reached").when(sure, "confidence_threshold").when(flat, "confidence_converged").otherwise("expand"))
        rows = settled(rows.select("query_id", "k", "max_k", "agreement", "margin", "stability", "confidence", "decision", "stop", "stop_reason", "ids", "before"))
        history = rows if history is None else history.unionByName(rows)
        open_ = rows.filter("not stop").select("query_id", "max_k")
        if open_.isEmpty():
            break
        k += step
    if history is None:
        return plans.select("query_id", F.lit(0).alias("k"), *[F.lit(0.0).alias(c) for c in ("agreement", "margin", "stability", "confidence")], F.lit("").alias("decision"), F.lit(True).alias("stop"), F.lit("").alias("stop_reason"), F.array().cast("array<bigint>").alias("ids")).limit(0)
    return history.drop("max_k", "before")


def last_rounds(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("k"))
    return history.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
