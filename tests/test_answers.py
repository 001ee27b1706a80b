"""Definitions, selection and answerability on cases by hand."""

import pytest
from pyspark.sql import functions as F

from granary.functions import definitions as D, matching as M, text as X
from granary.operators import answers as A, models
from granary.plans import registry


def sentences(spark, text, query):
    df = spark.createDataFrame([(1, text, query)], "doc_id long, text string, query string")
    return [r.sentence for r in A.answer_sentences(df, "doc_id", "text", "query").orderBy("pos").collect()]


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column.alias("v")).first().v


@pytest.mark.parametrize("query,focus", [
    ("What is vaccination?", "vaccination"), ("who were the Maya, please tell", "the Maya,"), ("Define  gravity!", "gravity"), ("meaning of risk in the document", "risk"), ("Why is it?", ""), ("How is steel made?", ""), (None, ""),
])
def test_focus_of_a_definition(spark, query, focus):
    row = spark.createDataFrame([(query,)], "q string").select(D.definition_focus("q").alias("v")).first()
    assert row.v.rstrip(",") == focus.rstrip(",")


@pytest.mark.parametrize("text,query,want", [
    ("Trust in vaccination matters here... Vaccination is the action of giving the vaccine to work and during a crisis.", "What is vaccination?", "Vaccination is the action of giving the vaccine to someone."),
    ("Immunization is the process whereby a person Online library of many documents becomes protected from a disease.", "What is immunization?", "Immunization is the process whereby a person becomes protected from a disease."),
    ("The hash-tag Definition of risk perception helps readers to Risk is the possibility of a negative future outcome (3, 4).", "What is risk perception?", "Risk is the possibility of a negative future outcome."),
    ("A group of the SAGE has defined vaccine hesitancy as a delay lack of confidence (7).", "Define vaccine hesitancy", "The SAGE Working Group has defined vaccine hesitancy as a delay in acceptance or refusal of vaccines despite availability of vaccination services."),
    ("See page two. A glacier is a mass of ice that moves KEY POINT it melts in summer.", "What is a glacier?", None),
    ("In brief a tundra is the cold plain of the north Figs 3 and more", "What is a tundra?", None),
    ("In brief tundra is the cold plain of the north KEY POINT and more here", "What is tundra?", "tundra is the cold plain of the north."),
    ("Before it. Soil erosion refers to the loss of the upper layer to wind the current edition", "Why does soil vanish?", "Soil erosion refers to the loss of the upper layer to wind."),
])
def test_definitions_are_recovered(spark, text, query, want):
    got = sentences(spark, text, query)
    assert want is None or want in got


def test_plain_sentences_headings_and_fragments(spark):
    text = "The first sentence has six words. And of the. And article 12 defines the whole State. Too short here. The second one is long enough as well."
    assert sentences(spark, text, "What does article 12 say?")[0] == "The first sentence has six words."
    assert any("article 12" in s for s in sentences(spark, text, "What does article 12 say?"))
    assert not any("article 12" in s for s in sentences(spark, text, "why is it"))
    long = "Word " + "and more words follow in this one " * 14 + "KEY POINT the next part starts at its own heading now."
    parts = sentences(spark, long, "why so")
    assert len(parts) == 2 and parts[1].startswith("KEY POINT")
    assert sentences(spark, None, "why") == [] and sentences(spark, "", None) == []


@pytest.mark.parametrize("text,score", [("Vaccination is discussed in this section.", 0.0), ("Guidance on building trust in vaccination.", 0.0), ("Vaccination is the action of giving a vaccine.", 0.97), (None, 0.0)])
def test_mentions_are_no_identity(spark, text, score):
    df = spark.createDataFrame([("What is vaccination?", text)], "q string, t string").withColumns({"a": M.anchor_score("q", "t"), "s": M.answer_shape("q", "t"), "f": D.definition_focus("q")})
    got = df.select(D.identity_score("q", "t", F.col("f"), F.col("a"), F.col("s")).alias("v")).first().v
    assert abs((got or 0.0) - score) < 1e-9


SCORED = "query_id long, doc_id long, pos int, sentence string, identity double, anchor double, evidence_score double, semantic double, lexical double, target double, quality double, contamination double, covers boolean, wants_identity boolean"


def chosen(spark, rows):
    df = spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], SCORED)
    return [(r.sentence, r["rank"]) for r in A.selected(df).orderBy("rank").collect()]


def test_a_direct_definition_is_the_whole_answer(spark):
    topic = ("On trust in vaccination.", 0.0, 1.0, 0.70, 0.90, 0.5, 0.0, 1.0, 0.0, False, True)
    direct = ("Vaccination is the act.", 0.97, 1.0, 0.82, 0.80, 1.0, 1.0, 1.0, 0.0, True, True)
    alias = ("Risk is the possibility.", 0.97, 0.0, 0.70, 0.67, 0.0, 0.0, 1.0, 0.0, False, True)
    assert chosen(spark, [topic, direct]) == [("Vaccination is the act.", 1)]
    assert chosen(spark, [topic, alias]) == [("Risk is the possibility.", 1)]


def test_selection_prefers_what_is_asked_and_new(spark):
    a = ("red green blue", 0.0, 0.5, 0.60, 0.6, 0.5, 0.5, 1.0, 0.0, False, False)
    b = ("red green blue too", 0.0, 0.5, 0.59, 0.6, 0.5, 0.5, 1.0, 0.0, False, False)
    c = ("one two three", 0.0, 0.5, 0.50, 0.6, 0.5, 0.5, 1.0, 0.0, True, False)
    dirty = ("not this", 0.0, 1.0, 0.99, 0.9, 0.9, 0.9, 1.0, 0.6, True, False)
    low = ("nor this", 0.0, 1.0, 0.99, 0.9, 0.9, 0.9, 0.3, 0.0, True, False)
    got = [s for s, _ in chosen(spark, [a, b, c, dirty, low])]
    assert got == ["one two three", "red green blue", "red green blue too"]


def test_definitions_survive_where_nothing_is_grounded(spark):
    weak = ("Ore is the rock.", 0.60, 0.4, 0.40, 0.30, 0.2, 0.5, 0.9, 0.0, True, True)
    other = ("Ore is used.", 0.0, 0.4, 0.40, 0.30, 0.2, 0.5, 0.9, 0.0, False, True)
    assert chosen(spark, [weak, other]) == [("Ore is the rock.", 1)]


@pytest.mark.parametrize("query,text,ok", [
    ("Who is Narendra Modi?", "MODIS observations show an average reduction in aerosol loading.", False),
    ("What is vaccination?", "Vaccination is the action of giving the vaccine.", True),
    ("Compare Mars Orbiter Mission and Chandrayaan-2.", "The Mars Orbiter Mission was an Indian mission to Mars.", False),
    ("What is vaccination?", "Vaccination services refers to where, when, how and by whom vaccines are given in a particular country.", False),
])
def test_answerability(spark, query, text, ok):
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    e = spark.createDataFrame([(1, 1, text)], "query_id long, doc_id long, text string")
    assert A.answerability(q, e).first().answerable is ok


def test_matches_of_names_and_references(spark):
    t = spark.createDataFrame([("MODIS over India", "12. Definition.—In this Part. 124. Establishment of a court.", "124. Establishment of a court.")], "a string, b string, c string")
    r = t.select(M.phrase_present("a", F.lit("modis")).alias("x"), M.phrase_present("a", F.lit("modi")).alias("y"), M.reference_present("b", F.lit("Article 12")).alias("u"), M.reference_present("c", F.lit("Article 12")).alias("v")).first()
    assert (r.x, r.y, r.u, r.v) == (True, False, True, False)


def test_second_answerability(spark):
    q = spark.createDataFrame([(1, "What is rain?"), (2, "Why rain"), (3, "What is snow?"), (4, "What is hail?")], "query_id long, query string")
    rows = [(1, "Rain is the water that falls.", 0.9, 0.9, 0.9, 0.9, 0.9), (1, "other", 0.1, 0.1, 0.1, 0.1, 0.1), (2, "It rains.", 0.5, 0.5, 0.5, 0.5, 0.5), (3, "Snow is discussed.", 1.0, 1.0, 1.0, 1.0, 1.0)]
    e = spark.createDataFrame(rows, "query_id long, text string, anchor double, target double, semantic double, quality double, evidence_score double")
    got = {r.query_id: (round(r.score, 6), r.reason, r.answerable) for r in A.selected_answerability(q, e).collect()}
    assert got == {1: (0.9, "evidence_supported", True), 2: (0.5, "evidence_supported", True), 3: (0.35, "identity_definition_required", False), 4: (0.0, "no_selected_evidence", False)}


def test_topics_contaminate(spark):
    df = spark.createDataFrame([("What did MOM find on Mars?", "Chandrayaan saw the lunar soil."), ("Chandrayaan news", "Chandrayaan flew."), ("any", "Gaganyaan flies.")], "q string, s string")
    assert [round(r.v, 6) for r in df.select(A.contamination("q", "s").alias("v")).collect()] == [1.0, 0.0, 0.4]


def test_hooks_are_asked_for_distinct_texts(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def make():
        def encode(texts):
            with open(asked, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[len(t), 1.0] for t in texts]

        return encode

    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "i long, t string")
    got = {r.i: r.vector for r in models.encoded(df, "t", make, "test-encoder").collect()}
    assert got[4] is None and got[1] == got[2] and abs(sum(x * x for x in got[3]) - 1) < 1e-6
    assert sorted(open(asked).read().split()) == ["aa", "b"]
    with pytest.raises(Exception, match="not finite"):
        models.encoded(df, "t", lambda: lambda texts: [[float("nan")]] * len(texts), "bad-encoder").collect()
    pairs = spark.createDataFrame([(1, 1, "q", "x"), (1, 2, "q", None)], "query_id long, doc_id long, query string, text string")
    seen = spark.createDataFrame([(1, 1, 5.0), (9, 9, 1.0)], "query_id long, doc_id long, rerank_score double")
    got = {(r.query_id, r.doc_id): r.rerank_score for r in models.reranked(pairs, lambda: lambda a, b: [float(len(x + y)) for x, y in zip(a, b)], seen, "test-scorer").collect()}
    assert got == {(1, 1): 5.0, (1, 2): 1.0}
    names = {r.t: r.names for r in models.with_names(df.filter("t is not null"), "t", lambda: lambda t: [t.upper()], "test-names").collect()}
    assert names == {"aa": ["AA"], "b": ["B"]}
    one = models.planned(spark.createDataFrame([(1, " a? b? a? c? d? "), (2, None)], "query_id long, query string"), lambda c: F.split(c, r"(?<=\\?) ")).collect()
    assert [(r.query_id, r.part, r.search) for r in sorted(one)] == [(1, 1, "a?"), (1, 2, "b?"), (1, 3, "c?"), (2, 1, "")]


def test_encoded_vectors_are_double(spark):
    df = spark.createDataFrame([("a",)], "t string")
    got = models.encoded(df, "t", lambda: lambda texts: [[1, 2, 3]] * len(texts), "double-encoder").first().vector
    assert got == pytest.approx([x / 14**0.5 for x in (1, 2, 3)], rel=1e-15)


def test_near_sets_equal_all_pairs():
    import random

    r = random.Random(4)
    words = [sorted({f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(1, 9))}) for _ in range(120)]
    places = [i // 2 for i in range(120)]
    cosine = lambda a, b: len({*a} & {*b}) / (len(a) * len(b)) ** 0.5
    want = {(i, j) for j in range(120) for i in range(j) if places[i] != places[j] and round(cosine(words[i], words[j]), 9) > 0.45}
    got = list(A.near_sets(places, words, 0.45))
    assert {(i, j) for i, j, _ in got} == want and len(got) == len(want) > 50
    assert all(x == pytest.approx(cosine(words[i], words[j])) for i, j, x in got)


def test_sentence_edges_shuffle_once(spark):
    rows = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "b c d"), (2, 0, "a b c")], "doc_id long, pos int, line string")
    edges = A.sentence_edges(rows, "doc_id", "pos", "line")
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r)[:3] for r in edges.collect()] == [(1, 0, 1)]


def test_sentences_are_settled_without_a_shuffle_unless_documents_share_an_id(spark, tmp_path):
    one, two = "The first sentence has six words. And the FIRST sentence has, six words!", "Another sentence is here for all."
    odd = [(1, f"See www.a.org/x?y now , {one}\r\n\t{two} {two}"), (2, f"{two}• {one}"), (3, None), (4, ""), (None, two)]
    again = [(None, two.upper()), (2, f"{one} {two}"), (2, two)]

    def run(rows):
        where = str(tmp_path / str(len(rows)))
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{where}/documents.parquet")
        return registry.queries()["answer_sentences"](spark, where)

    first = run(odd)
    assert "Exchange" not in first._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, first.collect()), key=str)
    assert got == sorted([(1, 0, "See now, The first sentence has six words."), (1, 200, two), (2, 0, two), (2, 100, one[:33]), (None, 0, two)], key=str)
    both = run(odd + again).collect()
    assert len(both) == len({(r.doc_id, r.sentence.lower()) for r in both}) == len(got)


@pytest.mark.parametrize("text", ["this is the story of the", "this is the story of the.", "this is the story of the \n", "this is the story of the.\r\n", "this is the story of the! ", "this is the story of the.\n\r", "this is the story of bathe", "five words are all here", "a b c d", "who knows where it goes", "where who knows it goes"])
def test_fragments_are_told_from_their_ends(spark, text):
    before = r"(?:^|[^\p{L}\p{N}_])(?:and|or|to|of|for|with|from|by|in|on|the)\s*[.!?]?$"
    df = spark.createDataFrame([(text,)], "t string")
    old = (F.size(X.words_of("t")) < 5) | F.col("t").rlike(before) | F.col("t").rlike(r"^(?:and|or|but|because|while|where|when|how|which|that)(?:[^\p{L}\p{N}_]|$)")
    row = df.select(old.alias("old"), X.broken_fragment("t").alias("new")).first()
    assert row.old == row.new
