"""Similarity graphs of evidence: edges, components, centralities, traversals, scores, checks.

A graph is two tables: nodes (query_id, node_id, ...) and edges (query_id, src, dst, weight), src < dst, each edge once.
Aggregations take any number of graphs. Centralities that need a whole graph at once run per graph, which the depth of
retrieval bounds to some 20 nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions.numeric import clamp, cosine
from granary.session import settled


def similarity_edges(nodes: DataFrame, least: float = 0.55, vector: str = "vector") -> DataFrame:
    """query_id, src, dst, weight of all pairs of one graph's nodes with a cosine of at least ``least``."""
    a = nodes.select("query_id", F.col("node_id").alias("src"), F.col(vector).alias("va"))
    b = nodes.select("query_id", F.col("node_id").alias("dst"), F.col(vector).alias("vb"))
    met = a.join(b, (a.query_id == b.query_id) & (F.col("src") < F.col("dst"))).drop(b.query_id)
    return met.withColumn("weight", cosine(F.col("va"), F.col("vb"))).filter(F.col("weight") >= least).select("query_id", "src", "dst", "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("query_id", F.col("src").alias("node_id"), F.col("dst").alias("other"), "weight").union(edges.select("query_id", "dst", "src", "weight"))


def knn_graph(edges: DataFrame, k: int = 3) -> DataFrame:
    """Edges that are among the k heaviest of either end; each once."""
    w = Window.partitionBy("query_id", "node_id").orderBy(F.desc(F.round("weight", 9)), "other")
    kept = both_ways(edges).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return kept.select("query_id", F.least("node_id", "other").alias("src"), F.greatest("node_id", "other").alias("dst"), "weight").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, node_id, component (smallest node reached), by labels that spread and jump until none changes. Each
    round halves the distance to the label's own label; rounds are written to the checkpoint folder."""
    ways = both_ways(edges).select("query_id", "node_id", "other")
    label = settled(nodes.select("query_id", "node_id", F.col("node_id").alias("component")).distinct())
    while True:
        spread = ways.join(label.withColumnRenamed("node_id", "other"), ["query_id", "other"]).groupBy("query_id", "node_id").agg(F.min("component").alias("near"))
        next_ = label.join(spread, ["query_id", "node_id"], "left").select("query_id", "node_id", F.least("component", F.coalesce("near", "component")).alias("component"))
        own = next_.select("query_id", F.col("node_id").alias("component"), F.col("component").alias("jump"))
        next_ = settled(next_.join(own, ["query_id", "component"]).select("query_id", "node_id", F.least("component", "jump").alias("component")))
        changed = next_.join(label.withColumnRenamed("component", "old"), ["query_id", "node_id"]).filter("component <> old").limit(1).count()
        label = next_
        if not changed:
            return label


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, node_id, degree, degree_centrality."""
    n = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    d = both_ways(edges).groupBy("query_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    rows = nodes.select("query_id", "node_id").join(d, ["query_id", "node_id"], "left").join(n, "query_id")
    deg = F.coalesce("degree", F.lit(0).cast("long"))
    return rows.select("query_id", "node_id", deg.alias("degree"), F.when(F.col("n") > 1, deg / (F.col("n") - 1)).otherwise(1.0).alias("degree_centrality"))


def statistics(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, n_nodes, n_edges, n_components, average_degree, average_weight, density."""
    n = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("average_weight"))
    c = labels.groupBy("query_id").agg(F.count_distinct("component").alias("n_components"))
    rows = n.join(e, "query_id", "left").join(c, "query_id", "left").fillna(0, ["n_edges", "n_components"]).fillna(0.0, ["average_weight"])
    return rows.withColumns({"average_degree": 2.0 * F.col("n_edges") / F.col("n_nodes"), "density": F.when(F.col("n_nodes") > 1, 2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)})


def clusters(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, component, size, score, centroid, members: of each component the mean of the rerank scores, the node
    with the best, and its members in order."""
    rows = labels.join(scored.select("query_id", "node_id", "rerank_score"), ["query_id", "node_id"])
    return rows.groupBy("query_id", "component").agg(
        F.count(F.lit(1)).alias("size"), F.avg("rerank_score").alias("score"),
        F.max_by("node_id", F.struct("rerank_score", -F.col("node_id"))).alias("centroid"), F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("members"),
    )


def cluster_of(found: DataFrame, node: int | Column) -> DataFrame:
    """The clusters that hold a node."""
    return found.filter(F.array_contains(F.split("members", ","), (node if isinstance(node, Column) else F.lit(node)).cast("string")))


def largest_cluster(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"), F.max("size").alias("size"), F.avg("size").alias("average_size"), F.count(F.lit(1)).alias("n_clusters"))


METRICS = ("betweenness", "closeness", "eigenvector", "pagerank", "degree")


def _centralities(ids: list, a: np.ndarray, wanted: set[str]) -> dict[str, np.ndarray]:
    n = len(ids)
    out: dict[str, np.ndarray] = {}
    links = a > 0
    if wanted & {"betweenness", "closeness"}:
        between, close = np.zeros(n), np.zeros(n)
        for s in range(n):
            far, paths = np.full(n, -1), np.zeros(n)
            far[s], paths[s] = 0, 1
            levels, front = [[s]], [s]
            while front:
                new = []
                for v in front:
                    for w in np.flatnonzero(links[v]):
                        if far[w] < 0:
                            far[w] = far[v] + 1
                            new.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                front = new
                levels.append(new)
            share = np.zeros(n)
            for level in reversed(levels[1:]):
                for w in level:
                    for v in np.flatnonzero(links[w]):
                        if far[v] == far[w] - 1:
                            share[v] += paths[v] / paths[w] * (1 + share[w])
                    between[w] += share[w]
            reached = far > 0
            total = far[reached].sum()
            if total:
                close[s] = reached.sum() / total * reached.sum() / (n - 1)
        out["betweenness"] = between / ((n - 1) * (n - 2)) if n > 2 else np.zeros(n)
        out["closeness"] = close
    if "eigenvector" in wanted:
        x = np.full(n, 1.0 / n)
        found = False
        for _ in range(1000):
            y = x + a @ x
            y = y / (np.linalg.norm(y) or 1.0)
            if np.abs(y - x).sum() < n * 1e-6:
                found = True
                break
            x = y
        out["eigenvector"] = y if found and a.any() else np.zeros(n)
    if "pagerank" in wanted:
        sums = a.sum(1)
        move = np.divide(a, sums[:, None], out=np.zeros_like(a), where=sums[:, None] > 0)
        x = np.full(n, 1.0 / n)
        for _ in range(100):
            y = 0.85 * (x @ move + x[sums == 0].sum() / n) + 0.15 / n
            if np.abs(y - x).sum() < n * 1e-6:
                break
            x = y
        out["pagerank"] = y
    if "degree" in wanted:
        out["degree"] = links.sum(1) / (n - 1) if n > 1 else np.ones(n)
    return {k: v for k, v in out.items() if k in wanted}


def centralities(nodes: DataFrame, edges: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """query_id, node_id and the metrics asked for (betweenness, closeness, eigenvector, pagerank, degree)."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(n["node_id"].tolist())
        at = {x: i for i, x in enumerate(ids)}
        a = np.zeros((len(ids), len(ids)))
        for s, d, w in zip(e["src"], e["dst"], e["weight"]):
            a[at[s], at[d]] = a[at[d], at[s]] = w
        found = _centralities(ids, a, set(metrics))
        return pd.DataFrame({"query_id": [key[0]] * len(ids), "node_id": ids} | {m: found[m] for m in metrics})

    schema = "query_id long, node_id long, " + ", ".join(f"{m} double" for m in metrics)
    return nodes.select("query_id", "node_id").groupBy("query_id").cogroup(edges.groupBy("query_id")).applyInPandas(run, schema)


def levels(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """query_id, node_id, level: breadth-first distances from each graph's start (query_id, node_id), up to depth."""
    ways = both_ways(edges).select("query_id", "node_id", "other")
    seen = starts.select("query_id", "node_id", F.lit(0).alias("level"))
    front = seen
    for i in range(1, depth + 1):
        new = front.join(ways, ["query_id", "node_id"]).select("query_id", F.col("other").alias("node_id")).distinct()
        front = settled(new.join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").withColumn("level", F.lit(i)))
        if front.isEmpty():
            break
        seen = settled(seen.union(front))
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 20) -> DataFrame:
    """query_id, source, target, path: of the shortest paths the one whose nodes come first; null without one."""
    ways = both_ways(edges).select("query_id", "node_id", "other")
    front = pairs.select("query_id", "source", "target", F.array("source").alias("path"))
    done = settled(front.filter("source = target"))
    front = front.filter("source <> target")
    for _ in range(depth):
        grown = front.withColumn("node_id", F.element_at("path", -1)).join(ways, ["query_id", "node_id"]).filter(~F.array_contains("path", F.col("other")))
        grown = grown.select("query_id", "source", "target", "other", F.concat("path", F.array("other")).alias("path"))
        # one path to each node is enough: the first
        grown = settled(grown.groupBy("query_id", "source", "target", "other").agg(F.min("path").alias("path")))
        done = settled(done.union(grown.filter("other = target").drop("other")))
        front = grown.drop("other").join(done, ["query_id", "source", "target"], "left_anti")
        if front.isEmpty():
            break
    return pairs.join(done, ["query_id", "source", "target"], "left").select("query_id", "source", "target", "path")


def importance(rows: DataFrame) -> DataFrame:
    """Adds importance (a fifth of each of the five centralities) and quick_importance (.4 rerank, .35 PageRank, .25
    degree)."""
    five = sum((0.2 * F.col(m) for m in METRICS), F.lit(0.0))
    return rows.withColumns({"importance": five, "quick_importance": 0.4 * F.col("rerank_score") + 0.35 * F.col("pagerank") + 0.25 * F.col("degree")})


def node_score(rerank: Column, importance_: Column, pagerank: Column, coherence: Column) -> Column:
    return 0.45 * clamp((rerank + 15.0) / 15.0) + 0.25 * importance_ + 0.2 * pagerank + 0.1 * coherence


def ranking(rows: DataFrame) -> DataFrame:
    """Adds node_score and rank."""
    scored = rows.withColumn("node_score", node_score(F.col("rerank_score"), F.col("importance"), F.col("pagerank"), F.col("coherence")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("node_score", 9)), F.desc(F.round("rerank_score", 9)), "node_id")))


def ranking_statistics(ranked: DataFrame) -> DataFrame:
    """query_id, average, highest, lowest of the node scores of a ranking."""
    return ranked.groupBy("query_id").agg(F.avg("node_score").alias("average"), F.max("node_score").alias("highest"), F.min("node_score").alias("lowest"))


def consensus(rows: DataFrame) -> DataFrame:
    """query_id, consensus: 1 if the best by rerank score is the best of the graph."""
    first = F.max_by("node_id", F.struct(F.round("rerank_score", 9), -F.col("node_id")))
    best = F.min_by("node_id", "rank")
    return rows.groupBy("query_id").agg(F.when(first == best, 1.0).otherwise(0.0).alias("consensus"))


def coherence(weight: Column, n_components: Column, cluster_score: Column) -> Column:
    return clamp(0.4 * weight + 0.3 / F.greatest(n_components, F.lit(1)) + 0.3 * cluster_score)


def evidence_quality(confidence: Column, coherence_: Column, graph_score: Column | float = 0.0) -> Column:
    """The graph's score isn't known yet where this is first asked for, so it counts as 0 there."""
    return 0.4 * confidence + 0.3 * (graph_score if isinstance(graph_score, Column) else F.lit(graph_score)) + 0.3 * coherence_


def graph_score(density: Column, n_components: Column, coherence_: Column, quality: Column, importance_: Column) -> Column:
    s = 0.15 * density + 0.15 / F.greatest(n_components, F.lit(1)) + 0.25 * coherence_ + 0.2 * quality + 0.25 * importance_
    return F.round(F.least(F.lit(1.0), s), 4)


def sufficient(n_nodes: Column, n_edges: Column, n_components: Column, confidence: Column) -> Column:
    return (n_nodes <= 1) | ((confidence >= 0.9) & (n_edges >= 1) & (n_components == 1))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ends = nodes.select("query_id", "node_id")
    a = edges.join(ends.withColumnRenamed("node_id", "src"), ["query_id", "src"], "left_anti")
    b = edges.join(ends.withColumnRenamed("node_id", "dst"), ["query_id", "dst"], "left_anti")
    return a.unionByName(b).distinct()


def validation(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, passed, failed, share: of five rules on nodes, edges and components."""
    n = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("ids"), F.sum(F.col("node_id").isNull().cast("long")).alias("nulls"))
    e = edges.groupBy("query_id").agg(F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"), F.sum((~F.col("weight").between(-1.0, 1.0)).cast("long")).alias("wild"))
    d = dangling(nodes, edges).groupBy("query_id").agg(F.count(F.lit(1)).alias("dangling"))
    c = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("labelled"))
    rows = n.join(e, "query_id", "left").join(d, "query_id", "left").join(c, "query_id", "left").fillna(0)
    rules = [F.col("nulls") == 0, F.col("n") == F.col("ids"), (F.col("loops") == 0) & (F.col("wild") == 0), F.col("dangling") == 0, F.col("labelled") == F.col("ids")]
    passed = sum((r.cast("long") for r in rules), F.lit(0).cast("long"))
    return rows.select("query_id", passed.alias("passed"), (len(rules) - passed).alias("failed"), (passed / float(len(rules))).alias("share"))


def snapshot(nodes: DataFrame, edges: DataFrame, version: str = "1.0") -> DataFrame:
    """query_id, snapshot: a graph as JSON."""
    n = nodes.groupBy("query_id").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
    e = edges.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.round("weight", 6).alias("weight")))).alias("edges"))
    rows = n.join(e, "query_id", "left")
    return rows.select("query_id", F.to_json(F.struct(F.lit(version).alias("version"), "nodes", "edges")).alias("snapshot"))


def restored(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of snapshots; what one lacks is empty."""
    read = snapshots.select("query_id", F.from_json("snapshot", "version string, nodes array<long>, edges array<struct<src:long,dst:long,weight:double>>").alias("s"))
    nodes = read.select("query_id", F.explode("s.nodes").alias("node_id"))
    return nodes, read.select("query_id", F.explode("s.edges").alias("e")).select("query_id", "e.*")
