"""Sources and sinks of corpora, vectors and indexes. Writers go through Spark's commit protocol: a failed job leaves no
half table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A corpus kept as one JSON array (or a folder of such files), or as JSON lines where ``lines`` says so."""
    reader = spark.read.option("multiLine", "false" if lines else "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_domain(df: DataFrame, path: str, domain: str = "domain") -> None:
    """One folder for each domain; rows of a domain meet, so that each has few files, and large ones are split."""
    df.hint("rebalance", domain).write.mode("overwrite").partitionBy(domain).parquet(path)


def write_vectors(df: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vectors that are there and finite, and of one dimension; else an error where they are read."""
    df = spark.read.parquet(path)
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    first = df.select(F.size(vector)).first()
    same = F.size(vector) == (first[0] if first else 0)
    return df.select(key, vector).filter(F.assert_true(ok & same, F.lit("a vector is missing, not finite or of another dimension")).isNull())


def save_index(postings: DataFrame, stats: DataFrame, fingerprint: str, path: str) -> None:
    """Postings and term statistics with the fingerprint of the corpus that they are of."""
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    postings.sparkSession.createDataFrame([(fingerprint,)], "fingerprint string").write.mode("overwrite").json(f"{path}/fingerprint")


def load_index(spark: SparkSession, fingerprint: str, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The index kept at a path, or None if there is none or it is of another corpus."""
    from pyspark.errors import AnalysisException

    try:
        if spark.read.json(f"{path}/fingerprint").first()[0] != fingerprint:
            return None
        return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
    except AnalysisException:
        return None


def cached(df: DataFrame, key: str, path: str, versions: tuple[str, ...] = ()) -> DataFrame:
    """A result kept under a name made of all that it depends on (``key`` and versions): read if it is there whole, else
    made and written. Clearing the cache is deleting the folder."""
    import hashlib

    from pyspark.errors import AnalysisException

    at = f"{path}/{hashlib.sha256('|'.join((key, *versions)).encode()).hexdigest()[:32]}"
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(at)
    try:
        return spark.read.schema(df.schema).parquet(at)
    except AnalysisException:  # written by a job that kept no rows
        return df.limit(0)
