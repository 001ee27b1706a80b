"""What the corpus operators share: bounded Arrow batches, word hashing, tables in the shared folder, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch; with texts of some 100 KB a batch stays in the hundreds of MB at worst.
BATCH_ROWS = 1000
#: Bytes of such a batch; a row that has more is a batch of its own.
BATCH_BYTES = 8 << 20
#: Entries that a per-worker cache may hold before it starts anew.
CACHE_ENTRIES = 400_000
#: Bytes of an input table for each partition of a shuffle that holds numbers for each of its words.
PART_BYTES = 24 << 20

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
ODD = np.uint64(0x9E3779B97F4A7C15)
S33 = np.uint64(33)


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_ROWS rows and some BATCH_BYTES; what is lower already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"([0-9]+)b?", spark.conf.get(key))
    if not (found and 0 < int(found[1]) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def width(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(df: DataFrame, each: int = PART_BYTES) -> int:
    """Partitions for work on all of df: one for ``each`` bytes of its estimated size, at least twice what the session
    asks for. Sizes that Spark cannot estimate (tables made on the driver) count as small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * width(df.sparkSession), -(-size // each) if size < 1 << 56 else 0)


def by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group, one table a group, of batches that are sorted by the keys (integers)."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = np.stack([table.column(k).to_numpy().astype(np.int64) for k in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = key[:, a].tolist()
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_tables(held)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session in one process (tests) gets a temporary folder
    of this machine; on a cluster that is an error, for executors would not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = getattr(spark.sparkContext, "_granary_folder", None) or tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext._granary_folder = found
    return found


def extended(df: DataFrame, columns: str) -> StructType:
    """The schema of df with further columns (a DDL string); df's own is left as it is."""
    return StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Like settle, dealt by key into as many buckets: a join by that key reads them where they are and moves nothing.
    Only a table of the catalog can have buckets; this one leaves the catalog at once and its files stay."""
    spark = df.sparkSession
    name = f"granary-{uuid.uuid4().hex}"
    table = name.replace("-", "_")
    parts = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.format("parquet").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").bucketBy(parts, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def discard(df: DataFrame) -> None:
    """Deletes a settled table that nothing reads any more: what was made of it is settled itself."""
    spark = df.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("granary-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """This worker's one cache. Workers go from stage to stage, so what another operator has left is dropped first."""
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        trim_memory()
        _HELD[name] = make()
    return _HELD[name]


def trim_memory() -> None:
    """Gives freed memory of this worker back to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each element."""
    x = x ^ (x >> S33)
    x = x * M1
    x = x ^ (x >> S33)
    x = x * M2
    return x ^ (x >> S33)


class WordHashes(dict):
    """bytes of a word -> 64-bit hash; starts anew when full, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES // 2:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def hashed_words(texts: list, lower: bool = False):
    """Words (runs of anything but \\x20, \\x09-\\x0D) of every text (bytes or None), hashed.

    Returns the hashes of all words one after the other, the count of each text, and the words themselves."""
    cache = held("words", WordHashes)
    words = [(t.lower() if lower else t).split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    flat = np.fromiter((h for w in words for h in map(cache.__getitem__, w)), np.uint64, total)
    return flat, counts, words


def as_bytes(column) -> list:
    """The texts of an Arrow column as UTF-8 bytes, None for null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n elements, by doubling; one number for each start, len(h) - n + 1 in all."""
    out, have, power, at = None, 0, h, 1
    step = ODD
    with np.errstate(over="ignore"):
        while True:
            if n & at:
                m = len(h) - (have + at) + 1
                if m <= 0:
                    return np.empty(0, np.uint64)
                out = power[:m].copy() if out is None else fmix(out[:m] * M2 + power[have : have + m])
                have += at
            if have == n:
                return out
            m = len(power) - at
            if m <= 0:
                return np.empty(0, np.uint64)
            power = fmix(power[:m] * step + power[at : at + m])
            step = step * M1 | np.uint64(1)
            at *= 2


def packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, root), root being the smallest node reached; nodes without an
    edge to another node are left out. Large-star and small-star rounds, each a min aggregation and a join, until no
    edge changes; each round is written to the shared folder. Rounds grow with the logarithm of the longest chain."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    e, before = settle(e), None
    while True:
        now = e.select(mark.alias("m")).first()[0]
        if now == before or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = settle(small.filter("a <> b").distinct())
        discard(e)
        e = after
