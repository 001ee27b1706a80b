"""Retrieval, graphs, evidence and the controller on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import answers as A, evaluation as V, evidence as E, graph as G, retrieval as O


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat fish"), (3, "bird"), (4, "")], "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in O.bm25(docs, spark.createDataFrame([(7, "dog dog unicorn")], "query_id long, query string")).collect()}
    mean = 6 / 4
    want = 2 * math.log((4 - 1 + 0.5) / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean))
    assert set(got) == {(7, 1)} and math.isclose(got[7, 1], want)


def test_knn_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 50)
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(230, 8)), rng.normal(size=(60, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, vector array<double>")
    got = {(r.query_id, r.rank): r.doc_id for r in O.knn(v, asked, 5).collect()}
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert got == {(i, k + 1): best[i, k] for i in range(60) for k in range(5)}


def test_index_recall(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(0, 20, 2000)] + 0.4 * rng.normal(size=(2000, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, vector array<double>")
    asked = v.filter("doc_id % 100 = 0").toDF("query_id", "vector")
    index, c = O.ivf(v)
    assert index.count() == 2000
    exact = {(r.query_id, r.doc_id) for r in O.knn(v, asked, 10).collect()}
    found = {(r.query_id, r.doc_id) for r in O.search_ivf(index, c, asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_fusion(spark):
    d = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "query_id long, doc_id long, score double, rank int")
    s = spark.createDataFrame([(1, 11, 7.0, 1), (1, 12, 3.0, 2)], "query_id long, doc_id long, score double, rank int")
    both = O.outer(d, s)
    assert {(r.doc_id, round(r.fusion_score, 6)) for r in O.minmax_fusion(both, 9).collect()} == {(10, 0.6), (11, 0.4), (12, 0.0)}
    assert [r.doc_id for r in O.rrf(both, 9).orderBy("rank").collect()] == [11, 10, 12]
    x = O.agreement(both).first()
    assert (x.n_both, x.n_any) == (1, 3) and math.isclose(x.agreement, 1.0 / 2.0)
    with pytest.raises(ValueError):
        O.minmax_fusion(both, 3, 0, 0)
    with pytest.raises(ValueError):
        O.hybrid(both, d, d, 3, "other")


def test_repeated_places_use_up_ranks(spark):
    rows = [(1, 5, 0.9, 1), (1, None, 0.8, 2), (1, 5, 0.7, 3), (1, 6, 0.6, 4)]
    got = O.prepared(spark.createDataFrame(rows, "query_id long, doc_id long, score double, position int")).collect()
    assert {(r.doc_id, r.rank) for r in got} == {(5, 1), (6, 4)}


@pytest.fixture(scope="module")
def path_graph(spark):
    nodes = spark.createDataFrame([(1, i, float(i)) for i in range(5)] + [(2, 9, 1.0)], "query_id long, node_id long, rerank_score double")
    edges = spark.createDataFrame([(1, 0, 1, 0.6), (1, 1, 2, 0.7), (1, 3, 4, 0.8)], "query_id long, src long, dst long, weight double")
    return nodes, edges


def test_graphs(path_graph):
    nodes, edges = path_graph
    labels = G.components(nodes, edges)
    assert {(r.query_id, r.node_id): r.component for r in labels.collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (1, 4): 3, (2, 9): 9}
    s = {r.query_id: r for r in G.statistics(nodes, edges, labels).collect()}
    assert (s[1].n_nodes, s[1].n_edges, s[1].n_components) == (5, 3, 2) and math.isclose(s[1].density, 0.3) and s[2].density == 0
    c = {(r.query_id, r.node_id): r for r in G.centralities(nodes, edges).collect()}
    assert math.isclose(c[1, 1].betweenness, 1 / 6) and math.isclose(c[1, 1].closeness, 2 / 2 * 2 / 4) and math.isclose(sum(c[1, i].pagerank for i in range(5)), 1, abs_tol=1e-4)
    assert {r.node_id: r.level for r in G.levels(edges, nodes.filter("node_id = 0").select("query_id", "node_id"), 5).collect()} == {0: 0, 1: 1, 2: 2}
    pairs = nodes.filter("query_id = 1").select("query_id", F.lit(0).cast("long").alias("source"), F.col("node_id").alias("target"))
    assert {r.target: r.path for r in G.shortest_paths(edges, pairs).collect()} == {0: [0], 1: [0, 1], 2: [0, 1, 2], 3: None, 4: None}
    assert [(r.size, r.centroid) for r in G.cluster_of(G.clusters(nodes, labels), 2).collect()] == [(3, 2)]
    assert {r.share for r in G.validation(nodes, edges, labels).collect()} == {1.0}
    assert sorted(map(tuple, G.restored(G.snapshot(nodes, edges))[1].collect())) == sorted(map(tuple, edges.collect()))
    with pytest.raises(ValueError):
        G.centralities(nodes, edges, ("other",))


def test_edges_once_and_few(spark):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(1, i, (np.ones(4) + 0.3 * rng.normal(size=4)).tolist()) for i in range(9)], "query_id long, node_id long, vector array<double>")
    edges = G.similarity_edges(nodes, 0.55)
    assert edges.count() == edges.select("src", "dst").distinct().count() and edges.filter("src >= dst or weight < 0.55").count() == 0
    assert G.knn_graph(edges, 2).count() <= 18


def test_features_keep_their_own_scale(spark):
    wide = spark.createDataFrame([(1, 5.0, 0.4, float("nan"))], "query_id long, recommended_topk double, quality__evidence_quality double, margin double")
    rows = {(r.source, r.name): r.normalized for r in E.normalized(E.features(wide)).collect()}
    assert len(rows) == 25 and math.isclose(rows["retrieval", "recommended_topk"], 4 / 9) and rows["quality", "evidence_quality"] == 0.4 and rows["retrieval", "evidence_quality"] == 0 and rows["retrieval", "margin"] == 0
    full, late = (E.state(E.features(wide), m).first() for m in ("full", "incremental"))
    assert full.evidence_score != late.evidence_score
    assert E.features(wide).filter("source = 'retrieval'").count() == 11


def test_tuned_weights_are_bounded():
    rng = np.random.default_rng(2)
    x = rng.random((60, 4))
    w = E.tuned(x, (x[:, 0] > 0.5).astype(float))
    assert math.isclose(w.mean(), 1, rel_tol=1e-6) and w.argmax() == 0 and w.min() >= 0.25 and w.max() <= 2.5


def test_measures(spark):
    results = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 6), (1, 8), (3, 1)], "query_id long, doc_id long")
    got = {r.query_id: (r.recall, r.precision, r.hit_rate, r.mrr) for r in V.measures(results, qrels, 3).collect()}
    assert got == {1: (0.5, 0.5, 1.0, 0.5), 3: (0.0, 0.0, 0.0, 0.0)}


def test_controller_goes_deeper_only_where_needed(spark):
    rows = [(q, 100 * q + i, 1.0 - i / (30 if q == 1 else 1000), i + 1) for q in (1, 2) for i in range(20)]
    dense = spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")
    sparse = dense.withColumn("doc_id", F.when(F.col("query_id") == 2, F.col("doc_id") + 50).otherwise(F.col("doc_id")))
    plans = spark.createDataFrame([(1, 5, 20), (2, 5, 20)], "query_id long, initial_k int, max_k int")
    history = V.adaptive(plans, dense, sparse).collect()
    assert [r.k for r in sorted(history, key=lambda r: (r.query_id, r.k)) if r.query_id == 1][0] == 5
    last = {r.query_id: r for r in V.last_rounds(V.adaptive(plans, dense, sparse)).collect()}
    assert all(r.stop for r in last.values()) and {r.stop_reason for r in last.values()} <= {"max_k_reached", "confidence_threshold", "confidence_converged"}
    assert V.adaptive(plans.limit(0), dense, sparse).count() == 0


def test_selection_prefers_what_is_new(spark):
    base = dict(evidence_score=0.9, anchor=0.5, semantic=0.5, target=0.0, quality=1.0)
    rows = [(1, 1, 0, "the cat sat on a mat"), (1, 1, 1, "the cat sat on a mat today"), (1, 2, 0, "engines burn fuel quickly")]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, pos int, sentence string")
    for k, v in base.items():
        df = df.withColumn(k, F.lit(v))
    got = [r.sentence for r in A.selected(df, most=2).orderBy("rank").collect()]
    assert got == ["the cat sat on a mat", "engines burn fuel quickly"]


def test_confidence_has_gates(spark):
    c = {k: F.lit(1.0) for k in A.WEIGHTS}
    one = lambda **x: spark.range(1).select(A.calibrated(**({"c": c, "contamination": F.lit(0.0), "count": F.lit(2), "valid": F.lit(True)} | x)).alias("x")).first().x
    assert one() == pytest.approx(0.96) and one(valid=F.lit(False)) == pytest.approx(0.22) and one(count=F.lit(0)) <= 0.45
    assert one(c=c | {"query_grounding": F.lit(0.2)}) <= 0.25


@pytest.mark.parametrize("plain", [False, True])
def test_best_by_products_are_the_first_of_all_scores(spark, monkeypatch, plain):
    monkeypatch.setattr(O, "QUERIES", 7)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Ä1", "the_x"]
    text = lambda n: " ".join(words[int(i)] for i in rng.zipf(1.3, n) % len(words))
    docs = spark.createDataFrame([(i * 3, None if i == 5 else text(int(rng.integers(0, 40)))) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, text(6) + " nowhere") for i in range(30)] + [(99, "nowhere"), (98, None)], "query_id long, query string")
    scores = O.bm25_plain(docs, asked) if plain else O.bm25(docs, asked)
    want = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in O.ranked(scores, 9).collect()}
    assert {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in O.bm25_best(docs, asked, 9, plain=plain).collect()} == want and len(want) > 200
    assert O.bm25_best(docs, asked.filter("query_id >= 98"), 9, plain=plain).count() == 0 and O.bm25_best(docs.limit(0), asked, 9, plain=plain).count() == 0


def test_each_phrase_is_looked_for_once(spark):
    docs = spark.createDataFrame([(i, f"The solar  panel {i} means power.") for i in range(6)] + [(9, "solar panels"), (10, None), (11, "a solar\npanel")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "What is solar panel?"), (2, "Explain 'solar panel' please")], "query_id long, query string")
    got = {(r.query_id, r.phrase, r.doc_id) for r in O.anchors(asked, docs).collect()}
    assert {x[2] for x in got if x[:2] == (1, "solar panel")} == {5, 4, 3, 2} == {x[2] for x in got if x[:2] == (2, "solar panel")}
