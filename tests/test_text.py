"""Text functions on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from granary.functions import matching as M, text as X
from granary.operators import chunking


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("line,junk", [("", True), ("7", True), ("Page 3 of 9", True), ("IV", False), ("xxviii", True), ("---", True), ("aaaa", True), ("iiii iii", True), ("A normal line", False), (None, None)])
def test_junk_lines(spark, line, junk):
    assert one(spark, X.junk_line, line) is junk


@pytest.mark.parametrize("text,want", [("a a a", "a a"), ("The the end", "The end"), ("x", "x"), ("a a b b b c", "a b b c"), ("né Né\nz", "né z")])
def test_neighbours_go_in_pairs(spark, text, want):
    assert one(spark, X.deduped_words, text) == want


def test_hyphens_join_one_line_only(spark):
    got = spark.sql("SELECT array('some-', 'thing else-', 'where', 'X-', 'y') AS l").select(X.repaired_hyphens(F.col("l")).alias("x")).first().x
    assert got == ["something else-", "where", "X-", "y"]


def test_sentences_keep_abbreviations_and_join_short_parts(spark):
    got = one(spark, X.sentences, "We saw Dr. Smith there. It was fine, e.g. Good. No. He left the old house.\n\nNew paragraph is here now.")
    assert got[0].startswith("We saw dr. Smith there.") and got[-1] == "New paragraph is here now."


def test_nfkc_and_invisible_characters(spark):
    assert one(spark, X.normalized_line, "ﬁn​e­ \t x\x07") == "fine x"
    assert one(spark, X.normalized_line, None) is None


def test_quality(spark):
    assert one(spark, X.text_quality, "") == 0 and one(spark, X.text_quality, "few words here") == 0.75
    assert one(spark, X.chunk_quality, "word " * 50) == 1.0 and one(spark, X.chunk_quality, "word") == 0.4 and one(spark, X.chunk_quality, "") == 0.0


@pytest.mark.parametrize("text,phrase,want", [("the modis sensor", "modi", False), ("MODIS  sensor.", "modis sensor", True), ("x", "", False), ("a (b) c+", "(b) c+", True)])
def test_phrases_have_edges(spark, text, phrase, want):
    assert spark.createDataFrame([(text, phrase)], "t string, p string").select(M.phrase_present("t", "p").alias("x")).first().x is want


@pytest.mark.parametrize("text,want", [("12. Definition", True), ("124. Definition", False), ("see Article 12 now", True), ("article 124", False)])
def test_references(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(M.reference_present("t", F.lit("article 12")).alias("x")).first().x is want


def test_questions(spark):
    assert one(spark, M.references, "Articles 12 and section 7B, Article 12") == ["article 12", "section 7b"]
    assert one(spark, M.intents, "What does it do?") == ["what", "how"] and one(spark, M.intents, "compare a and b") == ["compare"] and one(spark, M.intents, "vaccines") == ["what"]
    assert "machine learning" in one(spark, M.focus_phrases, "What is machine learning?")
    assert one(spark, M.comparison_sides, "difference between cats and dogs?") == ["cats", "dogs"]
    assert one(spark, M.capital_runs, "the Mars Orbiter Mission by India") == ["mars orbiter mission"]


def test_chunks_carry_whole_sentences():
    sentences = [(" ".join([f"w{i}"] * 20), i) for i in range(10)]
    out = chunking.assembled(sentences, 60, 25)
    assert [len(t.split()) for t, _, _ in out] == [60] * 4 + [60][:0] + [40][:0] or all(45 <= len(t.split()) <= 60 for t, _, _ in out)
    assert out[0][0].split()[-1] == out[1][0].split()[0] == "w2"  # one sentence of 20 words fits the overlap of 25
    assert chunking.assembled([("short one", 1)], 60, 0) == [] and chunking.assembled([("short one", 1)], 60, 0, strict=False) == [("short one", 1, 1)]
    long = chunking.assembled([(" ".join(map(str, range(150))), 3)], 60, 20)
    assert [t.split()[0] for t, _, _ in long] == ["0", "40", "80"] and long[-1][1:] == (3, 3)


def test_documents_are_rebuilt_from_chunks(spark):
    rows = [(1, 0, "a b c d e f g"), (1, 1, "c d e f g h i"), (1, 2, "x y"), (2, 0, "")]
    got = {r.k: r.text for r in chunking.reconstructed(spark.createDataFrame(rows, "k int, chunk_index int, text string"), "k").collect()}
    assert got == {1: "a b c d e f g h i x y"}


def test_lines_keep_digits_that_are_their_place(spark):
    docs = spark.createDataFrame([("zero 0\n  line 1 \nwell-\nknown 3\nend 4",)], "t string")
    got = docs.select(X.repaired_text(F.array_join(X.trimmed(F.split("t", "\n")), "\n")).alias("x")).first().x
    assert got == "zero 0\nline 1\nwellknown 3\nend 4"
    assert docs.select(X.repaired_hyphens(F.array().cast("array<string>")).alias("x")).first().x == []


def test_a_line_that_was_joined_joins_no_other(spark):
    assert one(spark, X.repaired_text, "ab-\ncd-\nef-\ngh\r-\nij") == "abcd-\nefgh\r-\nij"


def test_short_parts_join_in_one_pass(spark):
    got = one(spark, X.sentences, "No.\n\nOh no. \n\n \n\nThis one is long. Yes. So it is. Another long one is here.  ")
    assert got == ["no. Oh no.", "This one is long. Yes.", "So it is.", "Another long one is here."]
    assert one(spark, X.sentences, " \n\n ") == [] and one(spark, X.sentences, None) is None
    assert one(spark, X.sentences, "It is No. 5 of APPROX. Ten. e.G. this end.") == ["It is no. 5 of approx. Ten. e.g. this end."]


def test_chunks_of_pages_meet_in_order_with_their_words(spark):
    lines = [(1, p, " ".join(f"p{p}w{i}" for i in range(50)) + ".") for p in range(6)] + [(2, 0, None), (3, 0, "few words here")]
    rows = chunking.chunks(spark.createDataFrame(lines, "doc_id long, page long, text string").repartition(4, "page"), "doc_id", "text", "page", 120, 60).orderBy("doc_id", "chunk_index").collect()
    got = [(r.doc_id, r.chunk_index, r.page_start, r.page_end, r.word_count) for r in rows]
    assert got == [(1, 0, 0, 1, 100), (1, 1, 1, 2, 100), (1, 2, 2, 3, 100), (1, 3, 3, 4, 100), (1, 4, 4, 5, 100), (3, 0, 0, 0, 3)]
    assert all(r.word_count == len(r.text.split()) for r in rows)


def test_nfkc_needs_no_python_and_equals_it(spark):
    import unicodedata

    given = ["ﬁ ① Ａ é ½ ㎏ ĳ ẛ̣ 한글 plain", "plain", "", None, "ạ̀"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", X.nfkc("t").alias("x"))
    assert {r.i: r.x for r in rows.collect()} == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(given)}
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
