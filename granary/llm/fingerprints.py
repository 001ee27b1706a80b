"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's shingles are the runs of five of its lower-cased words (one shingle if it has fewer, none without words). Its
sketch holds the K least distinct 64-bit hashes, sorted. Sketches merge: the K least of two sketches' union are the
sketch of both texts together. From sketches come resemblance, containment and the number of distinct shingles; all are
exact where a sketch isn't full.

Null text counts as empty: an empty sketch. Two empty sketches have resemblance 1, an empty and another 0. Repeated rows
have equal sketches. In the order of documents null ids come first, and rows that share an id are tied by a hash of text
and sketch (rows alike may change places, which shows nowhere); a single document is followed by itself. Texts of any
length are taken whole. An empty table gives an empty result. Extra columns are not returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.llm.common import width

#: Hashes of a sketch, words of a shingle.
K, SHINGLE = 128, 5
#: Tells the single shingle of a short text from others.
_SEED = 4099


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """Adds the sketch (array of longs) of a text column.

    Word hashes are a column of their own before the shingles, so that no expression is evaluated for each shingle
    but the hash of n numbers."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = df.withColumn("__words", F.transform(words, lambda w: F.xxhash64(w)))
    size = F.size("__words")
    at = lambda i, j: F.element_at("__words", i + j)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.xxhash64(*(at(i, j) for j in range(n))))
    few = F.array(F.xxhash64(F.col("__words").cast("string"), F.lit(_SEED)))
    all_ = F.when(size >= n, many).when(size > 0, few).otherwise(F.array().cast("array<bigint>"))
    return hashes.withColumn(out, F.slice(F.sort_array(F.array_distinct(all_)), 1, k)).drop("__words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the two sets of shingles, 0 to 1."""
    least = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(least))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th least hash."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b, 0 to 1; 1 for an empty a."""
    r = resemblance(a, b, k)
    both = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string of hexadecimal numbers, 16 digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(df: DataFrame, id_col: str, columns: dict[str, str], buckets: int) -> DataFrame:
    """Adds columns of the next row by ascending id (null first), after the last the first's. columns: name -> new name.

    Rows are dealt into ranges of ids between quantiles (``buckets - 1`` numbers on the driver). The first row of each
    range is also given, as a sentinel at the end, to the range before, so that each range is looked at alone."""
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    cuts = ids.select(F.percentile_approx("i", [x / buckets for x in range(1, buckets)], 10_000).alias("q")).first()[0] if buckets > 1 else []
    edges = F.lit(sorted(set(cuts or []))).cast("array<bigint>")
    key = F.col(id_col).cast("long")
    place = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.size(F.filter(edges, lambda e: e < c)))
    dealt = df.withColumns({"__range": place(key), "__last": F.lit(0), "__tie": F.xxhash64(*[F.col(c) for c in columns])})
    order = [F.asc_nulls_first(key), F.col("__tie")]
    # the first id of each range in use; the range in use before it (before the first: the last) gets that row too
    firsts = ids.withColumn("r", place(F.col("i"))).groupBy("r").agg(F.min(F.struct(F.col("i").isNotNull(), "i")).alias("m")).orderBy("r").collect()
    used = [r.r for r in firsts]
    before = {r: used[k - 1] for k, r in enumerate(used)}
    told = F.lit([before.get(r, 0) for r in range(max(used, default=0) + 1)]).cast("array<int>")
    starts = F.lit([r.m.i for r in firsts if r.m.i is not None]).cast("array<bigint>")
    lead = dealt.filter(F.array_contains(starts, key) | key.isNull())
    lead = lead.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(*order))).filter("__k = 1").drop("__k")
    lead = lead.withColumns({"__range": F.element_at(told, F.col("__range") + 1), "__last": F.lit(1)})
    w = Window.partitionBy("__range").orderBy("__last", *order)
    out = dealt.union(lead.select(dealt.columns)).select("*", *[F.lead(name).over(w).alias(new) for name, new in columns.items()])
    return out.filter("__last = 0").drop("__range", "__last", "__tie")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_chars, sketch, edited_text, edited_sketch, next_sketch: each text, and the text whose last
    floor(n_chars / 2) characters give way to the first as many of the next document."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketched = with_sketch(base, "text", "sketch", k)
    told = with_next(sketched, "doc_id", {"text": "__text", "sketch": "next_sketch"}, max(1, width(df.sparkSession)))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = told.withColumn("n_chars", n.cast("long")).withColumn("edited_text", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("__text", F.lit(1), half)))
    return with_sketch(edited.drop("text", "__text"), "edited_text", "edited_sketch", k)
