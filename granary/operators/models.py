"""Models as hooks: encoders, scorers, recognisers of names and splitters of questions. Each has a default without a trained
model; whatever is given instead is asked for distinct texts only, and loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from granary.functions import text as X

#: Texts -> a row of numbers for each; pairs of texts -> a number for each; a text -> names in it.
Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]
Recogniser = Callable[[str], list[str]]

_LOADED: dict[str, object] = {}


def loaded(name: str, make: Callable[[], object]) -> object:
    """This process's one model of a name, made when it is first asked for."""
    if name not in _LOADED:
        _LOADED[name] = make()
    return _LOADED[name]


def forget(name: str | None = None) -> None:
    """Drops a model, or all of them."""
    if name is None:
        _LOADED.clear()
    else:
        _LOADED.pop(name, None)


def encoded(texts: DataFrame, text: str, make: Callable[[], Encoder], name: str = "encoder", vector: str = "vector") -> DataFrame:
    """Adds a text's vector of length one, in double precision (zeros stay zeros; null for a null text). Equal texts are encoded once: distinct
    texts go to the encoder and the vectors are joined back."""
    distinct = texts.select(F.col(text).alias("__t")).filter("__t is not null").distinct()

    def work(batches):
        encode = loaded(name, make)
        for batch in batches:
            given = batch.column(0).to_pylist()
            x = np.asarray(encode(given), np.float64) if given else np.zeros((0, 1))
            if x.ndim != 2 or len(x) != len(given) or not np.isfinite(x).all():
                raise ValueError(f"the encoder gave {x.shape} for {len(given)} texts, or numbers that are not finite")
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["__t", vector])

    made = distinct.mapInArrow(work, f"__t string, {vector} array<double>")
    return texts.join(made, F.col(text) == F.col("__t"), "left").drop("__t")


def reranked(pairs: DataFrame, make: Callable[[], Scorer], seen: DataFrame | None = None, name: str = "scorer", query: str = "query", text: str = "text") -> DataFrame:
    """query_id, doc_id, rerank_score of pairs (query_id, doc_id, query, text). Pairs that ``seen`` (query_id, doc_id,
    rerank_score) has are not scored again."""
    keys = ["query_id", "doc_id"]
    new = pairs if seen is None else pairs.join(seen.select(*keys), keys, "left_anti")

    def work(batches):
        score = loaded(name, make)
        for batch in batches:
            x = np.asarray(score(batch.column(2).to_pylist(), batch.column(3).to_pylist()), np.float64) if batch.num_rows else np.zeros(0)
            if x.shape != (batch.num_rows,):
                raise ValueError(f"the scorer gave {x.shape} for {batch.num_rows} pairs")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x)], names=[*keys, "rerank_score"])

    made = new.select(*[F.col(k).cast("long") for k in keys], F.coalesce(query, F.lit("")), F.coalesce(text, F.lit(""))).mapInArrow(work, "query_id long, doc_id long, rerank_score double")
    return made if seen is None else made.unionByName(seen.join(pairs.select(*keys), keys, "left_semi").select(*keys, "rerank_score"))


def names(c: Column) -> Column:
    """The default recogniser: acronyms and runs of capitalised words, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])(?:[A-Z]{2,}|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?![\p{L}\p{N}_])"), F.lit(0)))


def with_names(texts: DataFrame, text: str, make: Callable[[], Recogniser] | None = None, name: str = "recogniser") -> DataFrame:
    """Adds ``names``, by the default or by a recogniser of one's own (asked for distinct texts)."""
    if make is None:
        return texts.withColumn("names", names(F.col(text)))
    distinct = texts.select(F.col(text).alias("__t")).filter("__t is not null").distinct()

    def work(batches):
        find = loaded(name, make)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(find(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["__t", "names"])

    made = distinct.mapInArrow(work, "__t string, names array<string>")
    return texts.join(made, F.col(text) == F.col("__t"), "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).drop("__t")


def planned(queries: DataFrame, split: Callable[[Column], Column] | None = None, most: int = 3) -> DataFrame:
    """query_id, part, search: what to search for each question. A splitter (query -> array of questions) may part it in
    up to ``most``; blank parts go, and where none is left, or without a splitter, the question itself is searched."""
    whole = F.trim(F.coalesce("query", F.lit("")))
    parts = F.array(whole) if split is None else split(F.col("query"))
    kept = F.slice(F.array_distinct(F.filter(X.trimmed(F.coalesce(parts, F.array().cast("array<string>"))), lambda x: x != "")), 1, most)
    return queries.select("query_id", F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(F.array(whole))).alias("part", "search")).withColumn("part", F.col("part") + 1)


def checked_requests(requests: DataFrame) -> DataFrame:
    """Adds valid and problem to requests (query, top_k_documents, max_sentences): a question that isn't blank, and
    numbers from 1 to 20, which are 3 where they are missing."""
    out = requests.withColumns({c: F.coalesce(c, F.lit(3)) for c in ("top_k_documents", "max_sentences")})
    problem = F.when(F.length(F.coalesce("query", F.lit(""))) < 1, "query is empty")
    for c in ("top_k_documents", "max_sentences"):
        problem = problem.when(~F.col(c).between(1, 20), f"{c} is not within 1 and 20")
    return out.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull())
