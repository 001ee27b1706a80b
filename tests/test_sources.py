"""Sources, sinks and streams with an effect: files in and out."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from granary.operators import corpus, retrieval
from granary.sources import pages as P, tables as T
from granary.streaming import ingest


def test_files_are_found_below_a_folder(spark, tmp_path):
    (tmp_path / "Health Care").mkdir()
    (tmp_path / "Health Care" / "B.txt").write_bytes(b"one\r\n\x00two\fpage  two\f")
    (tmp_path / "a.TXT").write_bytes(b"x")
    (tmp_path / "skip.bin").write_bytes(b"x")
    found = P.files(spark, str(tmp_path))
    rows = found.collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["a.TXT", "B.txt"] and [r.domain for r in rows] == ["general", "health_care"]
    pages = P.text_pages(found.filter("domain <> 'general'"))
    assert [(r.page_number, r.text) for r in pages.orderBy("page_number").collect()] == [(1, "one\ntwo"), (2, "page two"), (3, "")]
    assert P.plain_text(pages).first().text == "one\ntwo\n\npage two"
    with pytest.raises(NotImplementedError):
        P.pdf_pages(found)


def test_pages_come_from_any_reader(spark, tmp_path):
    (tmp_path / "Law").mkdir()
    (tmp_path / "Law" / "One.PDF").write_bytes(b"page one|page two")
    (tmp_path / "two.pdf").write_bytes(b"!")
    found = P.files(spark, str(tmp_path), P.PDF)
    assert [r.domain for r in found.collect()] == ["law", "general"]

    def reader(content, path):
        if content == b"!":
            raise ValueError("damaged")
        for text in content.decode().split("|"):
            yield 600, 800, [(text, 50, 10, 280, 20, 0, 0)]

    rows = P.pdf_pages(found, reader).orderBy("path", "page_number").collect()
    assert [(r.page_number, r.error) for r in rows] == [(1, None), (2, None), (None, "ValueError: damaged")]
    P.write_pages(P.pdf_pages(found, reader).filter("error is null").drop("error"), f"{tmp_path}/kept")
    back = P.reading_order(P.stored_pages(spark, f"{tmp_path}/kept")).orderBy("page_number").collect()
    assert [r.text for r in back] == ["page one", "page two"]


def test_results_are_kept_by_what_they_depend_on(spark, tmp_path):
    one, two = (spark.createDataFrame([(x,)], "x long") for x in (1, 2))
    assert T.cached(one, "k", f"{tmp_path}/c").first().x == 1 and T.cached(two, "k", f"{tmp_path}/c").first().x == 1
    assert T.cached(two, "k", f"{tmp_path}/c", ("v2",)).first().x == 2


def test_blocks_are_read_by_column(spark):
    b = lambda t, x0, y0, x1, y1, kind=0: (t, float(x0), float(y0), float(x1), float(y1), 0, kind)
    blocks = [b("right top", 330, 11, 560, 20), b("left low", 50, 60, 280, 70), b("left top", 50, 10, 280, 20), b("img", 0, 0, 90, 90, 1), b("x", 50, 90, 280, 99), b("right low", 331, 61, 560, 70)]
    out = P.reading_order(spark.createDataFrame([(600.0, blocks)], f"width double, blocks array<{P.BLOCK}>")).first()
    assert out.text == "left top\nleft low\nright top\nright low"
    assert len(P.columns_of([dict(x0=50, x1=500, y0=1, y1=2), dict(x0=70, x1=500, y0=3, y1=4)], 600)) == 1


def test_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [0.5, 1.5])], "vec_id long, domain string, embedding array<double>")
    T.write_by_domain(df, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").groupBy("domain").count().count() == 2
    T.write_json(df, f"{tmp_path}/j")
    assert T.read_json(spark, f"{tmp_path}/j", "vec_id long").count() >= 1
    T.write_vectors(df, f"{tmp_path}/v")
    assert T.read_vectors(spark, f"{tmp_path}/v").count() == 2
    T.write_vectors(df.union(spark.createDataFrame([(3, "c", [float("nan"), 1.0])], df.schema)), f"{tmp_path}/w")
    with pytest.raises(Exception, match="not finite"):
        T.read_vectors(spark, f"{tmp_path}/w").collect()


def test_an_index_is_kept_until_its_corpus_changes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    mark = corpus.fingerprint(docs, "doc_id", "text").first().fingerprint
    posted = retrieval.postings(docs)
    assert T.load_index(spark, mark, f"{tmp_path}/i") is None
    T.save_index(posted, retrieval.term_stats(posted, 2), mark, f"{tmp_path}/i")
    assert T.load_index(spark, mark, f"{tmp_path}/i")[0].count() == 4
    other = corpus.fingerprint(docs.withColumn("text", F.upper("text")), "doc_id", "text").first().fingerprint
    assert other != mark and T.load_index(spark, other, f"{tmp_path}/i") is None


def test_streams_write_postings_once(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta beta", "en", "s", 15), (2, "beta gamma", "en", "s", 10)], ingest.DOCUMENTS).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest.into_postings(ingest.documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {(r.doc_id, r.term, r.tf) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "alpha", 1), (1, "beta", 1), (2, "beta", 1), (2, "gamma", 1)}


def test_entry_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 100


def test_pages_are_held_until_their_file_is_read(spark, monkeypatch):
    monkeypatch.setattr(P, "PAGES", 3)
    files = spark.createDataFrame([("good", bytearray(b"a\nb\nc\nd\ne\nf\ng")), ("bad", bytearray(b"a\nb\nc\nd\n!")), ("none", bytearray(b"")), ("null", None)], "path string, content binary")

    def reader(content, name):
        for line in content.decode().split("\n") if content else ():
            if line == "!":
                raise ValueError("damaged")
            yield 10, 20, [(line, 1, 2, 3, 4, 0, 0)]

    pages = P.pdf_pages(files, reader)
    assert pages.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in ("1000", "500", "100")
    got = {(r.path, r.page_number, r.blocks[0].text if r.blocks else None, r.error) for r in pages.collect()}
    assert got == {("good", i + 1, c, None) for i, c in enumerate("abcdefg")} | {("bad", None, None, "ValueError: damaged")}
