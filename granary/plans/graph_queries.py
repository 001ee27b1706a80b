"""Queries over similarity graphs: of each query vector, its nearest vectors, joined where their cosine reaches LEAST."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.operators import graph as G, retrieval as O
from granary.plans.base import Registry, table
from granary.plans.retrieval_queries import KNN, query_vectors, vectors

R = Registry()
NODES, LEAST = 12, 0.15

BASE = f"""{KNN}, nodes AS (SELECT query_id, doc_id AS node_id, score AS rerank_score, embedding::DOUBLE[] AS v FROM dense JOIN embeddings ON vec_id = doc_id WHERE rank <= {NODES}),
cosines AS (SELECT a.query_id, a.node_id AS src, b.node_id AS dst, greatest(-1, least(1, list_cosine_similarity(a.v, b.v)))::DOUBLE AS weight FROM nodes a JOIN nodes b ON a.query_id = b.query_id AND a.node_id < b.node_id),
edges AS (SELECT * FROM cosines WHERE weight >= {LEAST}), ways AS (SELECT query_id, src AS node_id, dst AS other, weight FROM edges UNION ALL SELECT query_id, dst, src, weight FROM edges)"""
REACH = "reach AS (SELECT query_id, node_id, node_id AS other FROM nodes UNION SELECT r.query_id, r.node_id, w.other FROM reach r JOIN ways w ON w.query_id = r.query_id AND w.node_id = r.other), labels AS (SELECT query_id, node_id, min(other) AS component FROM reach GROUP BY ALL)"
LABELS = f"{BASE}, {REACH}"
STATS = f"""{LABELS}, st AS (SELECT query_id, n_nodes, coalesce(n_edges, 0) AS n_edges, n_components, 2.0 * coalesce(n_edges, 0) / n_nodes AS average_degree, coalesce(average_weight, 0) AS average_weight, CASE WHEN n_nodes > 1 THEN 2.0 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END AS density
FROM (SELECT query_id, count(*) AS n_nodes FROM nodes GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n_edges, avg(weight) AS average_weight FROM edges GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(DISTINCT component) AS n_components FROM labels GROUP BY 1) USING (query_id))"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    near = O.knn(vectors(spark, d), query_vectors(spark, d), NODES)
    return near.select("query_id", F.col("doc_id").alias("node_id"), F.col("score").alias("rerank_score")).join(vectors(spark, d).withColumnRenamed("doc_id", "node_id"), "node_id")


def parts(spark, d):
    from granary.session import settled

    n = settled(nodes(spark, d))
    e = settled(G.similarity_edges(n, LEAST))
    return n, e


@R.add("pairwise_cosine", "G2 J5", f"WITH {BASE} SELECT query_id, src, dst, round(weight, 6) AS weight FROM cosines")
def pairwise_cosine(spark, d):
    return G.similarity_edges(nodes(spark, d), -1.0).select("query_id", "src", "dst", F.round("weight", 6).alias("weight"))


@R.add("similarity_threshold", "P3", f"WITH {BASE} SELECT query_id, src, dst, round(weight, 6) AS weight FROM cosines WHERE weight >= 0.55")
def similarity_threshold(spark, d):
    return G.similarity_edges(nodes(spark, d)).select("query_id", "src", "dst", F.round("weight", 6).alias("weight"))


@R.add("similarity_edges", "J5 G1", f"WITH {BASE} SELECT query_id, src, dst, round(weight, 6) AS weight FROM edges")
def similarity_edges(spark, d):
    return parts(spark, d)[1].select("query_id", "src", "dst", F.round("weight", 6).alias("weight"))


@R.add("knn_graph", "T8", f"""WITH {BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY round(weight, 9) DESC, other) AS r FROM ways)
SELECT DISTINCT query_id, least(node_id, other) AS src, greatest(node_id, other) AS dst, round(weight, 6) AS weight FROM k WHERE r <= 3""")
def knn_graph(spark, d):
    return G.knn_graph(parts(spark, d)[1]).select("query_id", "src", "dst", F.round("weight", 6).alias("weight"))


@R.add("connected_components", "G3", f"WITH RECURSIVE {LABELS} SELECT query_id, node_id, component FROM labels")
def connected_components(spark, d):
    n, e = parts(spark, d)
    return G.components(n, e)


@R.add("degree_centrality", "G4", f"WITH {BASE} SELECT n.query_id, n.node_id, count(w.other) AS degree, round(count(w.other) / (count(*) OVER (PARTITION BY n.query_id) - 1), 6) AS degree_centrality FROM nodes n LEFT JOIN ways w ON w.query_id = n.query_id AND w.node_id = n.node_id GROUP BY n.query_id, n.node_id")
def degree_centrality(spark, d):
    return G.degrees(*parts(spark, d)).select("query_id", "node_id", "degree", F.round("degree_centrality", 6).alias("degree_centrality"))


@R.add("top_degree", "T11", f"WITH {BASE}, g AS (SELECT n.query_id, n.node_id, count(w.other) AS degree FROM nodes n LEFT JOIN ways w ON w.query_id = n.query_id AND w.node_id = n.node_id GROUP BY ALL) SELECT query_id, node_id, degree FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY degree DESC, node_id) AS r FROM g) WHERE r <= 3")
def top_degree(spark, d):
    return O.top(G.degrees(*parts(spark, d)), 3, F.desc("degree"), F.asc("node_id")).select("query_id", "node_id", "degree")


@R.add("graph_statistics", "A10", f"WITH RECURSIVE {STATS} SELECT query_id, n_nodes, n_edges, n_components, round(average_degree, 6)::DOUBLE AS average_degree, round(average_weight, 6)::DOUBLE AS average_weight, round(density, 6)::DOUBLE AS density FROM st")
def graph_statistics(spark, d):
    n, e = parts(spark, d)
    s = G.statistics(n, e, G.components(n, e))
    return s.select("query_id", "n_nodes", "n_edges", "n_components", *[F.round(c, 6).alias(c) for c in ("average_degree", "average_weight", "density")])


@R.add("graph_clusters", "A11 G15", f"""WITH RECURSIVE {LABELS} SELECT l.query_id, component, count(*) AS size, round(avg(rerank_score), 6) AS score, arg_max(n.node_id, rerank_score) AS centroid, array_to_string(list(n.node_id ORDER BY n.node_id), ',') AS members
FROM labels l JOIN nodes n ON n.query_id = l.query_id AND n.node_id = l.node_id GROUP BY l.query_id, component""")
def graph_clusters(spark, d):
    n, e = parts(spark, d)
    return G.clusters(n, G.components(n, e)).withColumn("score", F.round("score", 6))


@R.add("largest_cluster", "A11", f"""WITH RECURSIVE {LABELS}, c AS (SELECT query_id, component, count(*) AS size FROM labels GROUP BY ALL)
SELECT query_id, (SELECT component FROM c x WHERE x.query_id = c.query_id ORDER BY size DESC, component LIMIT 1) AS component, max(size) AS size, round(avg(size), 6) AS average_size, count(*) AS n_clusters FROM c GROUP BY query_id""")
def largest_cluster(spark, d):
    n, e = parts(spark, d)
    return G.largest_cluster(G.clusters(n, G.components(n, e))).withColumn("average_size", F.round("average_size", 6))


@R.add("centralities", "G5 G6 G7 G8 G9")
def centralities(spark, d):
    found = G.centralities(*parts(spark, d))
    return found.select("query_id", "node_id", *[F.round(m, 6).alias(m) for m in G.METRICS])


BFS = "bfs AS (SELECT query_id, node_id AS start, node_id AS cur, 0 AS level FROM nodes UNION SELECT b.query_id, b.start, w.other, b.level + 1 FROM bfs b JOIN ways w ON w.query_id = b.query_id AND w.node_id = b.cur WHERE b.level < {0})"


@R.add("closeness", "G6", f"""WITH RECURSIVE {BASE}, {BFS.format(NODES)}, far AS (SELECT query_id, start, cur, min(level) AS level FROM bfs GROUP BY ALL),
s AS (SELECT query_id, start, count(*) - 1 AS r, sum(level) AS total FROM far GROUP BY ALL), n AS (SELECT query_id, count(*) AS n FROM nodes GROUP BY 1)
SELECT query_id, start AS node_id, round(CASE WHEN total > 0 THEN r / total * r / (n - 1) ELSE 0 END, 6)::DOUBLE AS closeness FROM s JOIN n USING (query_id)""")
def closeness(spark, d):
    return G.centralities(*parts(spark, d), metrics=("closeness",)).select("query_id", "node_id", F.round("closeness", 6).alias("closeness"))


def starts(n):
    return n.groupBy("query_id").agg(F.min("node_id").alias("node_id"))


FROM_FIRST = f"{BASE}, {BFS}, far AS (SELECT query_id, cur AS node_id, min(level) AS level FROM bfs b WHERE start = (SELECT min(node_id) FROM nodes n WHERE n.query_id = b.query_id) GROUP BY ALL)"


@R.add("bfs_levels", "G14", f"WITH RECURSIVE {FROM_FIRST.replace('{0}', str(NODES))} SELECT query_id, node_id, level FROM far")
def bfs_levels(spark, d):
    n, e = parts(spark, d)
    return G.levels(e, starts(n), NODES)


@R.add("k_hop_neighbors", "G14", f"WITH RECURSIVE {FROM_FIRST.replace('{0}', '2')} SELECT query_id, node_id, level FROM far WHERE level > 0")
def k_hop_neighbors(spark, d):
    n, e = parts(spark, d)
    return G.levels(e, starts(n), 2).filter("level > 0")


@R.add("shortest_path", "G14", f"WITH RECURSIVE {FROM_FIRST.replace('{0}', str(NODES))} SELECT n.query_id, CAST(max(level) AS INT) AS length FROM (SELECT query_id, max(node_id) AS t FROM nodes GROUP BY 1) n LEFT JOIN far ON far.query_id = n.query_id AND far.node_id = n.t GROUP BY ALL")
def shortest_path(spark, d):
    n, e = parts(spark, d)
    ends = n.groupBy("query_id").agg(F.min("node_id").alias("source"), F.max("node_id").alias("target"))
    return G.shortest_paths(e, ends).select("query_id", (F.size("path") - 1).alias("length")).withColumn("length", F.when(F.col("length") >= 0, F.col("length")))


@R.add("support_chain", "G14")
def support_chain(spark, d):
    n, e = parts(spark, d)
    ends = n.groupBy("query_id").agg(F.min("node_id").alias("source"), F.max("node_id").alias("target"))
    return G.shortest_paths(e, ends)


def analysed(spark, d):
    n, e = parts(spark, d)
    labels = G.components(n, e)
    stats = G.statistics(n, e, labels)
    mean = G.clusters(n, labels).groupBy("query_id").agg(F.avg("score").alias("cluster_score"))
    rows = G.importance(n.drop("vector").join(G.centralities(n, e), ["query_id", "node_id"]))
    whole = stats.join(mean, "query_id").withColumn("coherence", G.coherence(F.col("average_weight"), F.col("n_components"), F.col("cluster_score")))
    return n, e, labels, rows.join(whole.select("query_id", "coherence"), "query_id"), whole


@R.add("node_importance", "G10 G9")
def node_importance(spark, d):
    rows = analysed(spark, d)[3]
    return rows.select("query_id", "node_id", F.round("importance", 6).alias("importance"), F.round("quick_importance", 6).alias("quick_importance"))


COH = f"""{STATS}, cl AS (SELECT l.query_id, component, avg(rerank_score) AS score FROM labels l JOIN nodes n ON n.query_id = l.query_id AND n.node_id = l.node_id GROUP BY ALL),
co AS (SELECT st.*, greatest(0, least(1, 0.4 * average_weight + 0.3 / greatest(n_components, 1) + 0.3 * cs))::DOUBLE AS coherence FROM st JOIN (SELECT query_id, avg(score) AS cs FROM cl GROUP BY 1) USING (query_id))"""


@R.add("graph_coherence", "G11", f"WITH RECURSIVE {COH} SELECT query_id, round(coherence, 6) AS coherence FROM co")
def graph_coherence(spark, d):
    return analysed(spark, d)[4].select("query_id", F.round("coherence", 6).alias("coherence"))


@R.add("evidence_quality", "G12", f"WITH RECURSIVE {COH} SELECT query_id, round(0.4 * (query_id % 11) / 10.0 + 0.3 * coherence, 6)::DOUBLE AS quality FROM co")
def evidence_quality(spark, d):
    whole = analysed(spark, d)[4]
    return whole.select("query_id", F.round(G.evidence_quality(F.col("query_id") % 11 / 10.0, F.col("coherence")), 6).alias("quality"))


@R.add("ranking_statistics", "A26", """
WITH v AS (SELECT doc_id // 8 AS query_id, ((doc_id * 7) % 31 - 15)::DOUBLE AS rerank, (doc_id % 13) / 12.0::DOUBLE AS importance, (doc_id % 17) / 16.0::DOUBLE AS pagerank, (doc_id % 11) / 10.0::DOUBLE AS coherence FROM documents),
s AS (SELECT query_id, 0.45 * greatest(0, least(1, (rerank + 15) / 15)) + 0.25 * importance + 0.2 * pagerank + 0.1 * coherence AS s FROM v) SELECT query_id, round(avg(s) + 1e-9, 6)::DOUBLE AS average, round(max(s) + 1e-9, 6)::DOUBLE AS highest, round(min(s) + 1e-9, 6)::DOUBLE AS lowest FROM s GROUP BY query_id""")
def ranking_statistics(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.expr("doc_id div 8").alias("query_id"), i.alias("node_id"), (i * 7 % 31 - 15).cast("double").alias("rerank_score"), (i % 13 / 12.0).alias("importance"), (i % 17 / 16.0).alias("pagerank"), (i % 11 / 10.0).alias("coherence"))
    return G.ranking_statistics(G.ranking(rows)).select("query_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("average", "highest", "lowest")])


@R.add("graph_score", "G13")
def graph_score(spark, d):
    _, _, _, rows, whole = analysed(spark, d)
    mean = rows.groupBy("query_id").agg(F.avg("importance").alias("importance"))
    q = G.evidence_quality(F.col("query_id") % 11 / 10.0, F.col("coherence"))
    return whole.join(mean, "query_id").select("query_id", G.graph_score(F.col("density"), F.col("n_components"), F.col("coherence"), q, F.col("importance")).alias("graph_score"))


@R.add("graph_ranking", "W4")
def graph_ranking(spark, d):
    return G.ranking(analysed(spark, d)[3]).select("query_id", "node_id", F.round("node_score", 6).alias("node_score"), "rank")


@R.add("graph_consensus", "W5")
def graph_consensus(spark, d):
    return G.consensus(G.ranking(analysed(spark, d)[3]))


@R.add("graph_sufficiency", "P6", f"WITH RECURSIVE {STATS} SELECT query_id, n_nodes <= 1 OR ((query_id % 11) / 10.0 >= 0.9 AND n_edges >= 1 AND n_components = 1) AS sufficient FROM st")
def graph_sufficiency(spark, d):
    n, e = parts(spark, d)
    s = G.statistics(n, e, G.components(n, e))
    return s.select("query_id", G.sufficient(F.col("n_nodes"), F.col("n_edges"), F.col("n_components"), F.col("query_id") % 11 / 10.0).alias("sufficient"))


@R.add("validate_edges", "J9", f"WITH {BASE} SELECT query_id, src, dst FROM edges e WHERE src NOT IN (SELECT node_id FROM nodes n WHERE n.query_id = e.query_id AND node_id % 3 <> 0) OR dst NOT IN (SELECT node_id FROM nodes n WHERE n.query_id = e.query_id AND node_id % 3 <> 0)")
def validate_edges(spark, d):
    n, e = parts(spark, d)
    return G.dangling(n.filter("node_id % 3 <> 0"), e).select("query_id", "src", "dst")


BAD = "bn AS (SELECT query_id, node_id FROM nodes UNION ALL SELECT query_id, min(node_id) FROM nodes WHERE query_id % 3 = 0 GROUP BY 1), be AS (SELECT query_id, src, dst, CASE WHEN query_id % 5 = 0 THEN 1.5 ELSE weight END AS weight FROM edges UNION ALL SELECT query_id, min(node_id), min(node_id), 0.9 FROM nodes WHERE query_id % 4 = 1 GROUP BY 1 UNION ALL SELECT query_id, -1, max(node_id), 0.7 FROM nodes WHERE query_id % 2 = 1 GROUP BY 1)"


@R.add("graph_validation", "A27", f"""WITH RECURSIVE {LABELS}, {BAD}, r AS (SELECT q.query_id,
 (SELECT count(*) = count(DISTINCT node_id) FROM bn WHERE bn.query_id = q.query_id) AS a, NOT EXISTS (SELECT 1 FROM be WHERE be.query_id = q.query_id AND (src = dst OR weight NOT BETWEEN -1 AND 1)) AS b,
 NOT EXISTS (SELECT 1 FROM be WHERE be.query_id = q.query_id AND (src NOT IN (SELECT node_id FROM bn WHERE bn.query_id = q.query_id) OR dst NOT IN (SELECT node_id FROM bn WHERE bn.query_id = q.query_id))) AS c,
 (SELECT count(*) FROM labels WHERE labels.query_id = q.query_id AND (q.query_id % 7 <> 0 OR node_id <> component)) = (SELECT count(DISTINCT node_id) FROM bn WHERE bn.query_id = q.query_id) AS e FROM (SELECT DISTINCT query_id FROM nodes) q),
s AS (SELECT query_id, 1 + a::INT + b::INT + c::INT + e::INT AS n FROM r) SELECT query_id, CAST(n AS BIGINT) AS passed, CAST(5 - n AS BIGINT) AS failed, round(n / 5.0, 6)::DOUBLE AS share FROM s""")
def graph_validation(spark, d):
    """Graphs with faults put in: nodes twice, loops, weights out of bounds, edges without an end, nodes without a label."""
    n, e = parts(spark, d)
    q, labels = F.col("query_id"), G.components(n, e)
    least = n.groupBy("query_id").agg(F.min("node_id").alias("least"), F.max("node_id").alias("most"))
    n = n.select("query_id", "node_id")
    n = n.union(least.filter(q % 3 == 0).select("query_id", "least"))
    e = e.select("query_id", "src", "dst", F.when(q % 5 == 0, 1.5).otherwise(F.col("weight")).alias("weight"))
    e = e.union(least.filter(q % 4 == 1).select("query_id", "least", "least", F.lit(0.9))).union(least.filter(q % 2 == 1).select("query_id", F.lit(-1), "most", F.lit(0.7)))
    out = G.validation(n, e, labels.filter((q % 7 != 0) | (F.col("node_id") != F.col("component"))))
    return out.withColumn("share", F.round("share", 6))


@R.add("graph_snapshot_roundtrip", "S23", f"WITH {BASE} SELECT query_id, src, dst, round(weight, 6) AS weight FROM edges")
def graph_snapshot_roundtrip(spark, d):
    n, e = parts(spark, d)
    return G.restored(G.snapshot(n, e))[1]
