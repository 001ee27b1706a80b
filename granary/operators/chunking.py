"""Chunks of documents: sentences gathered to a size with an overlap, small ones merged; and documents from chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from granary.functions import text as X
from granary.session import settled, small_batches

LEAST, MOST = 45, 600
#: Chunks that one task numbers.
NUMBERED = 50_000
#: Sizes and overlaps in use: of the library, of the corpus job, and of the comparison.
LIBRARY, CORPUS, VARIANTS = (500, 100), (300, 45), ((200, 40), (300, 60), (400, 80), (500, 100))


def assembled(sentences: list[tuple[str, int]], size: int, overlap: int, strict: bool = True) -> list[tuple[str, int, int]]:
    """(text, first page, last page) of chunks of (sentence, page).

    strict: chunks below LEAST words are dropped (text alone); otherwise they join the chunk before where that stays
    within MOST words, and a lone one stays (pages)."""
    return [(text, first, last) for text, first, last, _ in counted(sentences, size, overlap, strict)]


def counted(sentences: list[tuple[str, int]], size: int, overlap: int, strict: bool = True) -> list[tuple[str, int, int, int]]:
    """The chunks of ``assembled`` with their words."""
    size = max(LEAST, min(MOST, size))
    overlap = max(0, min(size // 2, overlap))
    out: list[tuple[str, int, int, int]] = []
    held: list[tuple[str, int, int]] = []  # sentence, page, words
    sum_held = 0

    def close() -> None:
        if held:
            out.append((" ".join(s for s, _, _ in held), min(p for _, p, _ in held), max(p for _, p, _ in held), sum_held))

    for s, page in sentences:
        words = s.split()
        n = len(words)
        if n > size:
            close()
            held.clear()
            sum_held = 0
            at = 0
            while True:
                piece = words[at : at + size]
                if len(piece) >= LEAST:
                    out.append((" ".join(piece), page, page, len(piece)))
                if at + size >= n:
                    break
                at = max(at + 1, at + size - overlap)
            continue
        if held and sum_held + n > size:
            close()
            carried, total = 0, 0
            while carried < len(held) and total + held[-1 - carried][2] <= overlap:
                total += held[-1 - carried][2]
                carried += 1
            held[:] = held[len(held) - carried :]
            sum_held = total
        held.append((s, page, n))
        sum_held += n
    close()
    if strict:
        return [c for c in out if c[3] >= LEAST]
    merged: list[tuple[str, int, int, int]] = []
    for text, first, last, n in out:
        if merged and n < LEAST and merged[-1][3] + n <= MOST:
            merged[-1] = (merged[-1][0] + " " + text, merged[-1][1], last, merged[-1][3] + n)
        else:
            merged.append((text, first, last, n))
    return merged


def chunks(pages: DataFrame, key: str, text: str, page: str | None = None, size: int = CORPUS[0], overlap: int = CORPUS[1]) -> DataFrame:
    """key, chunk_index, text, page_start, page_end, word_count.

    Sentences are split inside the JVM; only the assembly, which carries state from sentence to sentence, is Python.
    Without pages each row is a document of its own and needs no shuffle; with pages a document's rows meet, in order of
    their pages, as one row."""
    if page is None:
        return from_sentences(split(pages, key, text), key, size, overlap)
    rows = pages.select(key, F.col(page).cast("int").alias("page"), X.sentences(text).alias("sentences"))
    met = F.array_sort(F.collect_list(F.struct("page", F.coalesce("sentences", F.array().cast("array<string>")).alias("s"))))
    whole = rows.groupBy(key).agg(met.alias("x"))
    numbers = F.flatten(F.transform("x", lambda x: F.array_repeat(x["page"], F.size(x["s"]))))
    return from_sentences(whole.select(key, F.flatten(F.transform("x", lambda x: x["s"])).alias("sentences"), numbers.alias("pages")), key, size, overlap)


def split(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentences."""
    return docs.select(key, X.sentences(text).alias("sentences"))


def from_sentences(rows: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """The chunks of rows that have their sentences, and the page of each where there are pages."""
    small_batches(rows.sparkSession)
    paged = "pages" in rows.columns
    names = ["chunk_index", "text", "page_start", "page_end", "word_count"]
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, chunk_index int, text string, page_start int, page_end int, word_count int"

    def each(batches):
        for batch in batches:
            of, out = [], []
            pages = batch.column(2).to_pylist() if paged else None
            for at, found in enumerate(batch.column(1).to_pylist()):
                found = found or []
                for i, (t, first, last, n) in enumerate(counted(list(zip(found, pages[at] if paged else [0] * len(found))), size, overlap, not paged)):
                    of.append(at)
                    out.append((i, t, first, last, n) if paged else (i, t, None, None, n))
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], names=[key, *names])

    return rows.mapInArrow(each, schema)


def reconstructed(found: DataFrame, key: str, order: str = "chunk_index", text: str = "text", least: int = 5) -> DataFrame:
    """key, text: a document's tokens without what each chunk repeats of the one before (at least ``least`` tokens). Where two places
    cannot match at their ends, nothing is compared between."""
    tokens = found.select(key, order, X.tokens(text).alias("__t"))
    w = Window.partitionBy(key).orderBy(order)
    t, b = F.col("__t"), F.col("__b")
    n = F.least(F.size(t), F.size(b))
    sizes = F.filter(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: (k >= least) & (F.element_at(b, F.size(b) - k + 1) == t[0]) & (F.element_at(t, k) == F.element_at(b, -1)) & (F.slice(b, F.size(b) - k + 1, k) == F.slice(t, F.lit(1), k)))
    again = F.when(b.isNull() | (n < least), 0).otherwise(F.coalesce(F.try_element_at(sizes, F.lit(1)), F.lit(0)))
    rest = tokens.withColumn("__b", F.lag("__t").over(w)).withColumn("__k", again).filter(F.size(t) > F.col("__k")).select(key, order, F.slice(t, F.col("__k") + 1, F.size(t)).alias("__r"))
    parts = F.array_sort(F.collect_list(F.struct(order, "__r")))
    return rest.groupBy(key).agg(F.array_join(F.flatten(F.transform(parts, lambda p: p["__r"])), " ").alias("text"))


def records(found: DataFrame, key: str, domain: str, source: str) -> DataFrame:
    """Corpus rows: chunks with id (by document and place), document_id, quality, hash and kind; below the least quality
    they go. Ids count by document first, so that no task numbers all chunks."""
    from granary.functions.text import chunk_quality, document_type

    rows = found.withColumn("chunk_quality", F.round(chunk_quality("text"), 6)).filter("chunk_quality >= 0.3")
    rows = settled(rows)
    by = settled(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    # so many groups that each has some NUMBERED chunks, whatever the size of the corpus
    total = by.agg(F.sum("__n")).first()[0] or 0
    group = F.pmod(F.xxhash64(key), F.lit(1 + total // NUMBERED))
    totals = by.groupBy(group.alias("__g")).agg(F.sum("__n").alias("__t"))
    offset = totals.withColumn("__o", F.sum("__t").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1))).select("__g", F.coalesce("__o", F.lit(0)).alias("__o"))
    numbered = rows.withColumn("__g", group).join(F.broadcast(offset), "__g").withColumn("id", F.col("__o") + F.row_number().over(Window.partitionBy("__g").orderBy(key, "chunk_index")) - 1)
    return numbered.select("id", key, "chunk_index", "text", F.col(domain).alias("domain"), F.col(source).alias("source"), document_type(domain).alias("type"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16).alias("document_id"), "page_start", "page_end", "word_count", "chunk_quality", F.sha2("text", 256).alias("text_hash"))
