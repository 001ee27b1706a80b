"""Session helpers: a place for intermediate tables, and the settings that the operators are written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(name: str = "granary", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir. Where that is unset, a session in one process (tests) gets a
    temporary folder of this machine; on a cluster that is an error, for executors would not see it."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        top = getattr(sc, "_granary_top", None) or tempfile.mkdtemp(prefix="granary-")
        sc._granary_top = top
    return f"{top.rstrip('/')}/granary-{sc.applicationId}"


#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and some BATCH_BYTES, so that what a Python worker holds doesn't grow with
    the input; what is lower already stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = re.fullmatch(r"([0-9]+)b?", spark.conf.get(key))
        if not (found and 0 < int(found[1]) <= most):
            spark.conf.set(key, str(most))


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives the loss of any executor, computed once."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession, df: DataFrame | None = None) -> None:
    """Deletes the intermediate tables that df reads, or all of this application: for tables whose readers are done."""
    paths = df.inputFiles() if df is not None else [shared_folder(spark)]
    folders = {x.rsplit("/", 1)[0] if df is not None else x for x in paths}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
