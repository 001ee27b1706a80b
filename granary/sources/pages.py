"""Page sources: files in a folder, text pages, page geometry (blocks), and HTML pages as blocks of text."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from granary.functions.text import block_text, domain_of
from granary.session import small_batches

BLOCK = "struct<text:string,x0:double,y0:double,x1:double,y1:double,block_no:int,block_type:int>"
# Tolerance of a left edge, least gap between columns, share of the width of a column, most columns.
EDGE, GAP, SHARE, COLUMNS = 18.0, 45.0, 0.20, 4


#: Pages of a file that are made Arrow values at once.
PAGES = 500
PDF, TEXT = "*.{pdf,PDF}", "*.{txt,TXT}"
#: Bytes of a file and its path -> its pages as (width, height, blocks), a block being (text, x0, y0, x1, y1, number,
#: kind: 1 for an image).
PageReader = Callable[[bytes, str], Iterable[tuple[float, float, list[tuple]]]]


def files(spark: SparkSession, root: str, pattern: str = TEXT) -> DataFrame:
    """path, domain, content, size, timestamp of every file below a folder, each path once, in order of lower case.

    A folder that isn't there is an error, as with any Spark source."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.regexp_replace(F.col("path"), F.lit("^.*?" + _quoted(root.rstrip("/").split("://")[-1]) + "/"), F.lit(""))
    out = found.select("path", domain_of(base).alias("domain"), "content", F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"))
    return out.dropDuplicates(["path"]).orderBy(F.lower("path"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|#& " else c for c in s)


def text_pages(found: DataFrame) -> DataFrame:
    """path, page_number (from 1), text: pages of text files, parted by form feeds; empty ones keep their number."""
    pages = F.split(F.decode("content", "UTF-8"), "\f")
    return found.select("path", F.posexplode(pages).alias("n", "raw")).select("path", (F.col("n") + 1).alias("page_number"), block_text("raw").alias("text"))


def plain_text(pages: DataFrame, key: str = "path") -> DataFrame:
    """A document's pages that aren't empty, joined by a blank line."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_number", "text"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def read_with_fitz(content: bytes, path: str) -> Iterable[tuple[float, float, list[tuple]]]:
    """A PageReader by PyMuPDF, where that is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        if doc.needs_pass:
            raise ValueError(f"{path} is locked by a password")
        for page in doc:
            yield page.rect.width, page.rect.height, [(b[4], *b[:4], b[5], b[6]) for b in page.get_text("blocks")]


def pdf_pages(found: DataFrame, reader: PageReader | None = None) -> DataFrame:
    """path, page_number, width, height, blocks, error of PDF files (path, content). Any reader of pages can be given;
    the default needs a PDF library on the workers, and an environment without one is told so. A file that cannot be
    read gives one row with its error and no page, and the others are read. A worker holds one file at a time."""
    if reader is None:
        if importlib.util.find_spec("fitz") is None:
            raise NotImplementedError("reading PDF needs PyMuPDF (module fitz) on driver and workers, or a reader of your own")
        reader = read_with_fitz
    small_batches(found.sparkSession)
    names = ("text", "x0", "y0", "x1", "y1", "block_no", "block_type")
    block = pa.list_(pa.struct([(n, t) for n, t in zip(names, (pa.string(), *[pa.float64()] * 4, pa.int32(), pa.int32()))]))
    types = (pa.string(), pa.int32(), pa.float64(), pa.float64(), block, pa.string())
    columns = ("path", "page_number", "width", "height", "blocks", "error")

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

    def read_one(path: str, content: bytes) -> list[pa.RecordBatch]:
        """A file's pages, PAGES a batch: until its last page is read, they are held as Arrow values."""
        made, rows = [], []
        for n, (w, h, blocks) in enumerate(reader(content, path), 1):
            rows.append((path, n, float(w), float(h), [dict(zip(names, b)) for b in blocks], None))
            if len(rows) == PAGES:
                made.append(packed(rows))
                rows = []
        return made + [packed(rows)] if rows else made

    def read(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                path = batch.column(0)[at].as_py()
                try:
                    made = read_one(path, batch.column(1)[at].as_py())
                except Exception as e:  # noqa: BLE001  # whatever a reader raises is of this file alone
                    made = [packed([(path, None, None, None, None, f"{type(e).__name__}: {e}")])]
                while made:
                    yield made.pop(0)

    return found.select("path", "content").mapInArrow(read, f"path string, page_number int, width double, height double, blocks array<{BLOCK}>, error string")


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages with their blocks as JSON, a row a page: for geometry that another program has extracted."""
    pages.write.mode("overwrite").json(path)


def stored_pages(spark: SparkSession, path: str, key: str = "path string, page_number int") -> DataFrame:
    """Pages kept by write_pages: key, width, height, blocks."""
    return spark.read.schema(f"{key}, width double, height double, blocks array<{BLOCK}>").json(path)


def usable_blocks(blocks: Column | str) -> Column:
    """Blocks of text (no images) of at least two characters, 4 wide and 3 high, with their text normalised."""
    clean = F.transform(blocks, lambda b: b.withField("text", block_text(b["text"])))
    return F.filter(clean, lambda b: (b["block_type"] != 1) & (F.length(b["text"]) >= 2) & (b["x1"] - b["x0"] >= 4) & (b["y1"] - b["y0"] >= 3))


def overlap_ratio(a: Column, b: Column) -> Column:
    """How much two blocks share from left to right, of the narrower."""
    width = F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return F.when(width <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) / width)


def columns_of(blocks: list[dict], width: float) -> list[list[dict]]:
    """Blocks by column. Left edges are gathered greedily around their means; one or more than COLUMNS clusters are one
    column, and so are clusters without a gap between, and two of which one is narrow."""
    groups: list[list[dict]] = []
    for b in sorted(blocks, key=lambda b: (b["x0"], b["y0"])):
        near = next((g for g in groups if abs(b["x0"] - sum(x["x0"] for x in g) / len(g)) <= EDGE), None)
        groups.append([b]) if near is None else near.append(b)
    if not 1 < len(groups) <= COLUMNS:
        return [list(blocks)]
    out: list[list[dict]] = []
    for g in sorted(groups, key=lambda g: min(b["x0"] for b in g)):
        if out and min(b["x0"] for b in g) - max(b["x1"] for b in out[-1]) < GAP:
            out[-1] += g
        else:
            out.append(g)
    if len(out) == 2 and any(max(b["x1"] for b in g) - min(b["x0"] for b in g) < SHARE * width for g in out):
        return [list(blocks)]
    return out


def reading_order(pages: DataFrame) -> DataFrame:
    """Pages with their usable blocks in reading order (column by column, lines of 4 points, left to right) and the
    text that they make. Rows are independent, so nothing is shuffled."""
    rows = pages.withColumn("blocks", usable_blocks("blocks"))

    def order(batches):
        for pdf in batches:
            placed = []
            for blocks, width in zip(pdf["blocks"], pdf["width"]):
                found = [b if isinstance(b, dict) else b.asDict() for b in (blocks if blocks is not None else [])]
                placed.append([b for column in columns_of(found, width) for b in sorted(column, key=lambda b: (round(b["y0"] / 4.0), b["x0"], b["y1"]))])
            yield pdf.assign(blocks=placed)

    out = rows.mapInPandas(order, rows.schema)
    return out.withColumn("text", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"))


def html_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text: the text of HTML pages without scripts, styles and tags, a line for each block; what stands in for
    PDF pages where only web pages are at hand."""
    t = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(?:br|/p|/h[1-6]|/li|/div|p|h[1-6]|li|div)\b[^>]*>", "\n"), r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return pages.select(key, block_text(t).alias("text"))
