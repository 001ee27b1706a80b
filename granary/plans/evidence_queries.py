"""Queries over evidence vectors. Each document stands for a query whose signals follow from its id, so that every
feature takes many values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.operators import evidence as E
from granary.plans.base import Registry, table

R = Registry()

_F = " UNION ALL ".join(f"SELECT {i} AS ord, '{s}' AS source, '{n}' AS name, {E.RANGES.get(n, (0.0, 1.0))[0]}::DOUBLE AS lo, {E.RANGES.get(n, (0.0, 1.0))[1]}::DOUBLE AS hi, {E.WEIGHTS.get(n, 1.0)}::DOUBLE AS weight" for i, (s, n) in enumerate(E.ALL))
BASE = f"""f AS ({_F}), v AS (SELECT doc_id AS query_id, ord, source, name, lo, hi, weight, (((doc_id * 37 + ord * 11) % 103) / 103.0::DOUBLE) * 1.1 * hi AS value FROM (SELECT doc_id FROM documents), f),
n AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE greatest(0, least(1, (value - lo) / (hi - lo))) END::DOUBLE AS normalized FROM v),
w AS (SELECT *, normalized * weight AS weighted, CASE WHEN sum(normalized * weight) OVER (PARTITION BY query_id) > 0 THEN normalized * weight / sum(normalized * weight) OVER (PARTITION BY query_id) ELSE 0 END AS importance FROM n)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    hi = {n: v[1] for n, v in E.RANGES.items()}
    wide = table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"), *[(((F.col("doc_id") * 37 + i * 11) % 103) / 103.0 * 1.1 * hi.get(n, 1.0)).alias(f"{s}__{n}") for i, (s, n) in enumerate(E.ALL)]
    )
    return E.features(wide)


def weighted(spark, d):
    return E.weighted(E.normalized(features(spark, d)))


def _r(places: int, *names: str):
    return [F.round(n, places).alias(n) for n in names]


@R.add("evidence_features", "M13", f"WITH {BASE} SELECT query_id, ord, source, name, round(value, 6) AS value FROM v")
def evidence_features(spark, d):
    return features(spark, d).select("query_id", "ord", "source", "name", *_r(6, "value"))


@R.add("normalize_features", "M14", f"WITH {BASE} SELECT query_id, ord, name, round(normalized, 6) AS normalized FROM n")
def normalize_features(spark, d):
    return E.normalized(features(spark, d)).select("query_id", "ord", "name", *_r(6, "normalized"))


@R.add("weighted_features", "M15", f"WITH {BASE} SELECT query_id, ord, name, weight, round(weighted, 6) AS weighted FROM w")
def weighted_features(spark, d):
    return weighted(spark, d).select("query_id", "ord", "name", "weight", *_r(6, "weighted"))


@R.add("feature_importance", "A16", f"WITH {BASE} SELECT query_id, ord, round(importance, 6) AS importance FROM w")
def feature_importance(spark, d):
    return weighted(spark, d).select("query_id", "ord", *_r(6, "importance"))


@R.add("feature_groups", "A12", f"""WITH {BASE}, s AS (SELECT unnest(['retrieval', 'graph', 'quality', 'ranking', 'diagnostics']) AS source)
SELECT d.doc_id AS query_id, s.source, count(v.ord) AS n, round(coalesce(avg(value), 0), 6) AS score FROM documents d CROSS JOIN s LEFT JOIN v ON v.query_id = d.doc_id AND v.source = s.source GROUP BY ALL""")
def feature_groups(spark, d):
    return E.groups(features(spark, d)).select("query_id", "source", "n", *_r(6, "score"))


STATS = "st AS (SELECT query_id, count(*) AS n, count_if({0} <> 0) AS nonzero, avg({0}) AS mean, min({0}) AS least, max({0}) AS most, var_pop({0}) AS variance, sqrt(sum({0} * {0})) AS norm, 1.0 - count_if({0} <> 0) / count(*) AS sparsity FROM w GROUP BY query_id)"


@R.add("vector_statistics", "A13", f"WITH {BASE}, {STATS.format('value')} SELECT query_id, n, nonzero, round(mean, 6) AS mean, round(least, 6) AS least, round(most, 6) AS most, round(variance, 6) AS variance, round(norm, 6) AS norm, round(sparsity, 6)::DOUBLE AS sparsity FROM st")
def vector_statistics(spark, d):
    return E.vector_statistics(features(spark, d)).select("query_id", "n", "nonzero", *_r(6, "mean", "least", "most", "variance", "norm", "sparsity"))


UNC = """p AS (SELECT query_id, weighted AS a, CASE WHEN sum(weighted) OVER (PARTITION BY query_id) > 0 THEN weighted / sum(weighted) OVER (PARTITION BY query_id) ELSE 0 END AS p FROM w),
un AS (SELECT query_id, sum(-p * log2(p + 1e-12)) AS entropy, list_sort(list(a), 'DESC')[1] - list_sort(list(a), 'DESC')[2] AS gap, round(sum(-p * log2(p + 1e-12)) / log2(greatest(count(*), 2)), 4) AS uncertainty FROM p GROUP BY query_id)"""


@R.add("uncertainty", "A14", f"WITH {BASE}, {UNC} SELECT query_id, round(entropy, 5) AS entropy, round(gap, 6) AS gap, uncertainty FROM un")
def uncertainty(spark, d):
    return E.uncertainty(weighted(spark, d)).select("query_id", *_r(5, "entropy"), *_r(6, "gap"), "uncertainty")


HEALTH = "he AS (SELECT query_id, round((nonzero / n + greatest(0, 1 - variance) + CASE WHEN most > 0 THEN mean / most ELSE 0 END) / 3, 4) AS health FROM st)"


@R.add("vector_health", "A15", f"WITH {BASE}, {STATS.format('normalized')}, {HEALTH} SELECT query_id, health FROM he")
def vector_health(spark, d):
    return E.health(E.vector_statistics(weighted(spark, d), "normalized"))


STATE = f"""{BASE}, {STATS.format('normalized')}, {HEALTH}, {UNC}, me AS (SELECT query_id, avg(weighted) AS m FROM w GROUP BY query_id),
sc AS (SELECT query_id, round(greatest(0, least(1, 0.6 * m + 0.15)), 4)::DOUBLE AS full_score, round(greatest(0, least(1, 0.6 * m + 0.25 * health + 0.15 * (1 - uncertainty))), 4)::DOUBLE AS late_score, health, uncertainty FROM me JOIN he USING (query_id) JOIN un USING (query_id))"""


@R.add("evidence_score", "A17 M17", f"WITH {STATE} SELECT query_id, full_score, late_score FROM sc")
def evidence_score(spark, d):
    f = features(spark, d)
    return E.state(f).select("query_id", F.col("evidence_score").alias("full_score")).join(E.state(f, "incremental").select("query_id", F.col("evidence_score").alias("late_score")), "query_id")


@R.add("incremental_evidence", "M12", f"""WITH {BASE.replace("FROM (SELECT doc_id FROM documents), f)", "FROM (SELECT doc_id FROM documents), f WHERE source = 'retrieval')")}, {STATS.format('normalized')}, {HEALTH}, {UNC}, me AS (SELECT query_id, avg(weighted) AS m FROM w GROUP BY query_id)
SELECT query_id, s AS evidence_score, s >= 0.75 AS sufficient FROM (SELECT query_id, round(greatest(0, least(1, 0.6 * m + 0.25 * health + 0.15 * (1 - uncertainty))), 4)::DOUBLE AS s FROM me JOIN he USING (query_id) JOIN un USING (query_id))""")
def incremental_evidence(spark, d):
    s = E.state(features(spark, d).filter("source = 'retrieval'"), "incremental")
    return s.select("query_id", "evidence_score", (F.col("evidence_score") >= 0.75).alias("sufficient"))


@R.add("feature_profile", "W6", f"""WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(importance, 9) DESC, ord) AS r FROM w)
SELECT query_id, array_to_string(list(source || '.' || name ORDER BY r) FILTER (r <= 5), ',') AS dominant, array_to_string(list(source || '.' || name ORDER BY r) FILTER (r > {len(E.ALL)} - 3), ',') AS weakest, count_if(importance < 0.05) AS n_weak FROM r GROUP BY query_id""")
def feature_profile(spark, d):
    return E.profile(weighted(spark, d))


@R.add("reasoning_readiness", "M18", f"""WITH {STATE}, r AS (SELECT *, round(0.45 * full_score + 0.30 * health + 0.25 * (1 - uncertainty) + 1e-9, 4)::DOUBLE AS readiness FROM sc)
SELECT query_id, readiness, readiness >= 0.7 AS ready, printf('Evidence %.4f, health %.4f, uncertainty %.4f.', full_score, health, uncertainty) AS summary FROM r""")
def reasoning_readiness(spark, d):
    return E.readiness(E.state(features(spark, d))).select("query_id", "readiness", "ready", "summary")


@R.add("reasoning_text", "M18", f"""WITH {STATE}, k AS (SELECT query_id, source || '.' || name AS full_name, name, row_number() OVER (PARTITION BY query_id ORDER BY round(importance, 9) DESC, ord) AS r FROM w),
pr AS (SELECT query_id, array_to_string(list(name ORDER BY r) FILTER (r <= 5), ',') AS priority, array_to_string(list(full_name ORDER BY r) FILTER (r <= 5), ', ') AS dominant FROM k GROUP BY query_id)
SELECT query_id, printf('%d evidence documents, %d graph nodes, Evidence Score %.3f', CAST(query_id % 7 AS INT), CAST(query_id % 5 AS INT), full_score + 1e-9) AS summary, priority, 'Evidence quality is primarily influenced by ' || dominant || printf('. Overall evidence score = %.3f.', full_score + 1e-9) AS explanation FROM sc JOIN pr USING (query_id)""")
def reasoning_text(spark, d):
    context = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 7).alias("documents"), (F.col("doc_id") % 5).alias("nodes"))
    return E.reasoning(features(spark, d), context).select("query_id", "summary", F.array_join("priority", ",").alias("priority"), "explanation")


@R.add("evidence_snapshot_roundtrip", "S24", f"WITH {BASE} SELECT query_id, ord, name, round(value, 6) AS value, round(importance, 6) AS importance FROM w")
def evidence_snapshot_roundtrip(spark, d):
    return E.restored(E.snapshot(weighted(spark, d))).select("query_id", "ord", "name", "value", "importance")


NAMES = ("words", "letters", "lines")


def labelled(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.length("text")
    words = F.least(F.lit(1.0), F.size(F.split("text", r"\s+")) / 1000.0)
    return docs.select(F.col("quality").cast("int").alias("label"), words.alias("words"), (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.greatest(n, F.lit(1))).alias("letters"), (1.0 / F.size(F.split("text", "\n"))).alias("lines"))


@R.add("weight_accuracy", "M16", r"""
WITH x AS (SELECT CAST(quality AS INT) AS label, least(1.0, len(string_split_regex(text, '\s+')) / 1000.0) AS a, length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) AS b, 1.0 / len(string_split(text, chr(10))) AS c FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS n, round(avg(CASE WHEN CAST((a + b + c) / 3 >= 0.5 AS INT) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM x""")
def weight_accuracy(spark, d):
    return E.accuracy(labelled(spark, d), {n: 1.0 for n in NAMES}).select("n", *_r(6, "accuracy"))


@R.add("weight_tuning", "M16")
def weight_tuning(spark, d):
    rows = labelled(spark, d)
    found = E.tune_weights(rows, NAMES)
    return E.accuracy(rows, found).select("n", "accuracy", *[F.lit(found[n]).alias(n) for n in NAMES])
