"""The evidence vector: features in long form, scales, weights, diagnostics, score, reasoning and tuning.

Features are rows (query_id, source, name, ord, value); a vector is what ``ord`` orders. Statistics are aggregations, so
any number of queries is one plan.
"""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions.numeric import clamp

# The features by source, in order.
FEATURES = {
    "retrieval": ("agreement", "margin", "stability", "retrieval_confidence", "query_complexity", "recommended_topk", "novelty", "evidence_quality", "evidence_coverage", "evidence_diversity", "evidence_consistency"),
    "graph": ("graph_score", "graph_density", "graph_coherence", "connected_components", "average_degree", "average_betweenness", "average_closeness", "average_eigenvector", "average_pagerank"),
    "quality": ("evidence_quality", "graph_consensus"),
    "ranking": ("ranking_average_score", "ranking_highest_score", "ranking_lowest_score"),
    "diagnostics": ("health_score", "uncertainty", "vector_sparsity", "vector_norm"),
}
ALL = tuple((source, name) for source, names in FEATURES.items() if source != "diagnostics" for name in names)
# Scales other than 0 to 1.
RANGES = {"recommended_topk": (1.0, 10.0), "connected_components": (0.0, 20.0), "average_degree": (0.0, 20.0), "vector_norm": (0.0, 10.0)}
# Weights other than 1.
WEIGHTS = {
    "retrieval_confidence": 1.20, "margin": 1.15, "agreement": 1.10, "query_complexity": 0.90, "graph_score": 1.25, "graph_density": 0.90, "graph_coherence": 1.20, "graph_consensus": 1.15,
    "average_degree": 0.80, "average_betweenness": 0.90, "average_closeness": 0.90, "average_eigenvector": 1.00, "average_pagerank": 1.10, "evidence_quality": 1.30, "health_score": 1.00, "uncertainty": 1.10,
}


def lookup(values: dict, c: Column | str, default: float) -> Column:
    """A number by name from a fixed table."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(m, F.col(c) if isinstance(c, str) else c), F.lit(default))


def features(wide: DataFrame, names: tuple[tuple[str, str], ...] = ALL) -> DataFrame:
    """Long features of rows that have a column ``source__name`` or ``name`` for each feature; what is missing is 0."""
    have = set(wide.columns)

    def value(source: str, name: str) -> Column:
        c = f"{source}__{name}" if f"{source}__{name}" in have else name
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)

    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(n).alias("name"), F.lit(i).alias("ord"), value(s, n).alias("value")) for i, (s, n) in enumerate(names)])
    return wide.select("query_id", F.inline(rows))


def normalized(rows: DataFrame) -> DataFrame:
    """Adds ``normalized``: each value on its own feature's scale, 0 to 1; what isn't finite counts as the least."""
    low, high = lookup({k: v[0] for k, v in RANGES.items()}, "name", 0.0), lookup({k: v[1] for k, v in RANGES.items()}, "name", 1.0)
    v = F.when(F.isnan("value") | (F.abs("value") == float("inf")), low).otherwise(F.col("value"))
    return rows.withColumn("normalized", F.when(high == low, 0.0).otherwise(clamp((v - low) / (high - low))))


def weighted(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``weight``, ``weighted`` and ``importance``, the share of the query's weighted sum."""
    out = rows.withColumn("weight", lookup(WEIGHTS if weights is None else weights, "name", 1.0))
    out = out.withColumn("weighted", F.col("normalized") * F.col("weight"))
    total = F.sum("weighted").over(Window.partitionBy("query_id"))
    return out.withColumn("importance", F.when(total > 0, F.col("weighted") / total).otherwise(0.0))


def groups(rows: DataFrame) -> DataFrame:
    """query_id, source, n, score: the mean raw value of each of the five groups, 0 for one without features."""
    every = rows.select("query_id").distinct().withColumn("source", F.explode(F.array(*[F.lit(s) for s in FEATURES])))
    by = rows.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("score"))
    return every.join(by, ["query_id", "source"], "left").fillna(0, ["n"]).fillna(0.0, ["score"])


def vector_statistics(rows: DataFrame, value: str = "value") -> DataFrame:
    """query_id, n, nonzero, sparsity, mean, least, most, variance (of the population), norm."""
    v = F.col(value)
    out = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum((v != 0).cast("long")).alias("nonzero"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.var_pop(v).alias("variance"), F.sqrt(F.sum(v * v)).alias("norm")
    )
    return out.withColumn("sparsity", 1.0 - F.col("nonzero") / F.col("n"))


def uncertainty(rows: DataFrame) -> DataFrame:
    """query_id, entropy, gap (between the two largest), uncertainty: entropy as a share of the most there can be."""
    a = F.abs("weighted")
    total = F.sum(a).over(Window.partitionBy("query_id"))
    p = F.when(total > 0, a / total).otherwise(0.0)
    spread = rows.select("query_id", a.alias("a"), total.alias("t"), (-p * F.log2(p + 1e-12)).alias("h"))
    top = F.reverse(F.array_sort(F.collect_list("a")))
    out = spread.groupBy("query_id").agg(F.when(F.max("t") > 0, F.sum("h")).otherwise(0.0).alias("entropy"), top.alias("top"), F.count(F.lit(1)).alias("n"))
    gap = F.when(F.size("top") > 1, F.col("top")[0] - F.try_element_at("top", F.lit(2))).otherwise(0.0)
    return out.select("query_id", "entropy", gap.alias("gap"), F.round(F.col("entropy") / F.log2(F.greatest(F.col("n"), F.lit(2))), 4).alias("uncertainty"))


def health(stats: DataFrame) -> DataFrame:
    """query_id, health: the mean of completeness, calm (1 less the variance) and mean over largest."""
    complete = F.col("nonzero") / F.col("n")
    balance = F.when(F.col("most") > 0, F.col("mean") / F.col("most")).otherwise(0.0)
    return stats.select("query_id", F.round((complete + F.greatest(F.lit(0.0), 1.0 - F.col("variance")) + balance) / 3.0, 4).alias("health"))


def score(mean_weighted: Column, health_: Column, uncertainty_: Column) -> Column:
    """With health and uncertainty unknown (null, where the full build first asks) they count as 0."""
    s = 0.6 * mean_weighted + 0.25 * F.coalesce(health_, F.lit(0.0)) + 0.15 * (1.0 - F.coalesce(uncertainty_, F.lit(0.0)))
    return F.round(clamp(s), 4)


def profile(rows: DataFrame, best: int = 5, last: int = 3, weak: float = 0.05) -> DataFrame:
    """query_id, dominant, weakest, n_weak: the features of most and least importance, and how many have little."""
    w = Window.partitionBy("query_id")
    order = [F.desc(F.round("importance", 9)), F.asc("ord")]
    placed = rows.withColumn("r", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    names = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("r", F.concat("source", F.lit("."), "name").alias("f"))))), lambda x: x["f"]), ",")
    return placed.groupBy("query_id").agg(names(F.col("r") <= best).alias("dominant"), names(F.col("r") > F.col("n") - last).alias("weakest"), F.sum((F.col("importance") < weak).cast("long")).alias("n_weak"))


def state(rows: DataFrame, mode: str = "full") -> DataFrame:
    """query_id, mean, health, uncertainty, evidence_score of features. In ``full`` mode the score is taken before
    health and uncertainty are known; in ``incremental`` mode after."""
    w = weighted(normalized(rows))
    mean = w.groupBy("query_id").agg(F.avg("weighted").alias("mean_weighted"))
    out = mean.join(health(vector_statistics(w, "normalized")), "query_id").join(uncertainty(w).select("query_id", "uncertainty"), "query_id")
    known = (F.lit(None).cast("double"), F.lit(None).cast("double")) if mode == "full" else (F.col("health"), F.col("uncertainty"))
    return out.withColumn("evidence_score", score(F.col("mean_weighted"), *known))


def readiness(states: DataFrame, least: float = 0.7) -> DataFrame:
    """Adds readiness, ready and a sentence that says so."""
    r = 0.45 * F.col("evidence_score") + 0.30 * F.col("health") + 0.25 * (1.0 - F.col("uncertainty"))
    # a trifle more, so that halves go up whatever way the sum was made
    out = states.withColumn("readiness", F.round(r + 1e-9, 4)).withColumn("ready", F.col("readiness") >= least)
    return out.withColumn("summary", F.format_string("Evidence %.4f, health %.4f, uncertainty %.4f.", "evidence_score", "health", "uncertainty"))


def reasoning(rows: DataFrame, context: DataFrame, mode: str = "full", most: int = 5) -> DataFrame:
    """What a reasoning step is told of each query: its context (query_id, query, documents, nodes, edges), a summary, the
    features of most importance, why the score is what it is, and whether it is enough."""
    w = weighted(normalized(rows))
    order = [F.desc(F.round("importance", 9)), F.asc("ord")]
    placed = w.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("__r") <= most)
    listed = F.array_sort(F.collect_list(F.struct("__r", "name")))
    priority = placed.groupBy("query_id").agg(F.transform(listed, lambda x: x["name"]).alias("priority"))
    out = readiness(state(rows, mode)).drop("summary").join(context, "query_id").join(priority, "query_id").join(profile(w).select("query_id", "dominant"), "query_id")
    shown = F.col("evidence_score") + 1e-9  # halves go up
    summary = F.format_string("%d evidence documents, %d graph nodes, Evidence Score %.3f", F.col("documents").cast("int"), F.col("nodes").cast("int"), shown)
    why = F.format_string("Evidence quality is primarily influenced by %s. Overall evidence score = %.3f.", F.replace("dominant", F.lit(","), F.lit(", ")), shown)
    return out.withColumns({"summary": summary, "explanation": why})


def snapshot(rows: DataFrame, version: str = "1.0") -> DataFrame:
    """query_id, snapshot: weighted features as JSON. A group's score there is its sum of importance."""
    f = F.array_sort(F.collect_list(F.struct("ord", "source", "name", F.round("value", 6).alias("value"), F.round("importance", 6).alias("importance"))))
    return rows.groupBy("query_id").agg(F.to_json(F.struct(F.lit(version).alias("version"), f.alias("features"))).alias("snapshot"))


def restored(snapshots: DataFrame) -> DataFrame:
    """Features of snapshots; missing values are 0."""
    read = snapshots.select("query_id", F.from_json("snapshot", "version string, features array<struct<ord:int,source:string,name:string,value:double,importance:double>>").alias("s"))
    return read.select("query_id", F.inline("s.features")).fillna(0.0, ["value", "importance"])


# --- weights from labels ------------------------------------------------------------------------------------------


def tuned(x: np.ndarray, y: np.ndarray, rounds: int = 1500, rate: float = 0.08, pull: float = 0.2) -> np.ndarray:
    """Positive weights with mean 1 (each .25 to 2.5) that tell labels apart: full-batch Adam on log weights, whose
    squares are pulled to zero. x: (rows, features) on their scales; y: 0 or 1."""
    theta, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    bias, mb, vb = 0.0, 0.0, 0.0
    for t in range(1, rounds + 1):
        w = np.exp(theta)
        p = 1 / (1 + np.exp(-np.clip(x @ w / x.shape[1] + bias, -40, 40)))
        g = (x.T @ (p - y)) / len(y) * w / x.shape[1] + pull * theta / x.shape[1]
        gb = (p - y).mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return bounded(np.exp(theta))


def bounded(w: np.ndarray, low: float = 0.25, high: float = 2.5) -> np.ndarray:
    """Weights scaled and held within bounds so that their mean is 1; the scale is found by halving."""
    least, most = 0.0, high / w.min()
    for _ in range(100):
        scale = (least + most) / 2
        least, most = (scale, most) if np.clip(scale * w, low, high).mean() < 1 else (least, scale)
    return np.clip(most * w, low, high)


def tune_weights(rows: DataFrame, names: tuple[str, ...], most: int = 10_000) -> dict[str, float]:
    """Weights of features from labelled rows (label, and a column for each name): fitted on at most ``most`` rows, the
    least by a hash of all their values."""
    some = rows.select("label", *names).orderBy(F.xxhash64("label", *names), *names).limit(most).collect()
    if not some:
        return {n: 1.0 for n in names}
    x, y = np.array([[float(r[n]) for n in names] for r in some]), np.array([float(r.label) for r in some])
    return dict(zip(names, tuned(x, y).tolist()))


def accuracy(rows: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """n, accuracy of the weighted mean against labels."""
    total = sum(weights.values()) or 1.0
    s = functools.reduce(lambda a, b: a + b, [F.col(n) * float(w) for n, w in weights.items()]) / F.lit(total)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(((s >= threshold).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
