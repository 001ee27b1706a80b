"""The pipeline's stages against plain versions, and the registration of every corpus query."""

import random
import re

import corpus_pipeline
import pytest

import __spark_entry__
from granary.llm import queries

from test_operators import TONGUES, linked, repeats, sentence

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        tongue = rng.choice(list(TONGUES))
        rows.append((i, sentence(rng, tongue, rng.randint(10, 90)), tongue))
    passage = sentence(rng, "aa", 60)
    rows += [(200 + i, sentence(rng, "aa", 40) + " " + passage + " " + sentence(rng, "aa", 30), "aa") for i in range(6)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(10)]
    for i in range(10, 30):
        words = rows[i][1].split()
        words[-1] = "zzz"
        rows.append((300 + i, " ".join(words), rows[i][2]))
    rows += [(400, None, "aa"), (401, "12 34 ...", "bb"), (402, "", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, g, f"s{i % 3}", len(t or "")) for i, t, g in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "packing"]

    first = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert kept == {i: t for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)}

    second = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in kept.items()], COLUMNS), folder)
    want = linked(sorted(kept.items()), corpus_pipeline.SHINGLE, corpus_pipeline.LIKE, 100)
    left = {r.doc_id: r.text for r in second.collect()}
    assert set(left) == {i for i, (_, root) in want.items() if root == i} and not set(left) & set(range(300, 310))

    third = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in left.items()], COLUMNS), folder)
    plain = repeats(sorted(left.items()), 20)
    got = {r.doc_id: (r.text, r.n_chars) for r in third.collect()}
    assert got == {i: (x, len(x)) for i, (n, gone, x) in plain.items() if (gone == 0 or gone < n) for x in [left[i] if gone == 0 else x]}
    assert sum(gone for _, gone, _ in plain.values()) >= 5 * 60

    last = corpus_pipeline.STAGES[3][1](spark, third, folder).collect()
    assert {r.doc_id for r in last} == set(got)


def test_stages_take_odd_rows_and_keep_columns(spark, folder):
    """Nulls in any column, rows alike, a doc_id twice, a long text, and columns named like outputs of operators."""
    extra = "score string, lang_pred string, n_words string, n_removed string, kept_text string, component_id string, repeats string, `a b` string"
    rng = random.Random(3)
    long = sentence(rng, "aa", 30_000)
    passage = sentence(rng, "bb", 40)
    texts = [(1, sentence(rng, "aa", 50)), (1, sentence(rng, "bb", 50)), (2, long), (2, long), (None, sentence(rng, "cc", 50)), (4, None), (5, ""), (6, passage + " " + sentence(rng, "bb", 9)), (7, sentence(rng, "bb", 12) + " " + passage)]
    rows = [(i, t, None if k % 2 else "aa", None, None if k % 3 else 7, *[f"{c}{k}" for c in "stuvwxyz"]) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{COLUMNS}, {extra}").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert {tuple(r[5:]) for r in kept} <= {r[5:] for r in rows}, name
        if name == "language_id":
            assert {r.doc_id for r in kept} <= {1, 2, None, 6, 7} and {r.doc_id for r in kept} >= {2}
        else:
            assert {1, 2, None, 6, 7} <= {r.doc_id for r in kept}, name
    assert sum(r.text == long for r in kept) == 2 and any(r.doc_id == 7 and len(r.text.split()) == 12 for r in kept)
    last = corpus_pipeline.STAGES[3][1](spark, docs, folder).collect()
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in last}) == len(last) >= len(rows)


def test_stages_need_only_ids_and_texts_and_take_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    bare = spark.createDataFrame([(1, "one two three"), (2, "12 34"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, bare, "").collect()] == [1]
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, bare, "").collect()} == {1, 2, 3}


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_every_operator_has_a_query():
    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(queries.queries()) <= set(names)
