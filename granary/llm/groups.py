"""Comparison within groups of any size, in blocks, without a row for a pair.

A group's documents (or images) fall into blocks of BLOCK. All pairs of a block are compared, and the group's hub (its
smallest document) with each document of each block. Documents that this connects with the hub are done, for a link
among them changes no component. Only the others meet the documents of all blocks. A large group of copies thus costs a
row a document. No link between documents of different components is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import by_group, components, settle, trim_memory

#: Documents that are compared with each other in one piece of work.
BLOCK = 1000
#: Of the rows of a group's documents: their ids, and a boolean matrix of what is linked.
Relate = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency matrix, (node, root)."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            new = np.flatnonzero(linked[front.pop()] & left)
            left[new] = False
            front += new.tolist()
            out += [(i, root) for i in new.tolist()]
    return out


def _forests(batches: Iterator[pa.RecordBatch], relate: Relate) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the related pairs of each group (cluster, i, j) of rows, which come sorted by it."""
    for table in by_group(batches, ("cluster", "i", "j")):
        ids, linked = relate(table)
        edges = [(int(ids[a]), int(ids[b])) for a, b in spanning(linked) if ids[a] != ids[b]]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])
    trim_memory()


def _compared(dealt: DataFrame, payload: DataFrame, relate: Relate, parts: int) -> DataFrame:
    """Edges (a, b) within the groups (cluster, i, j) of dealt documents, by what payload says of each."""
    rows = dealt.join(payload.hint("merge"), "doc_id").repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    return rows.mapInArrow(functools.partial(_forests, relate=relate), "a long, b long")


def linked_in_groups(members: DataFrame, payload: DataFrame, relate: Relate, parts: int) -> DataFrame:
    """Edges (a, b) that connect what ``relate`` connects within groups of documents, members (cluster, doc_id) being
    distinct: all pairs within a block, the hub (smallest document) being in each, then those that this leaves apart
    from the hub against all blocks."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("doc_id").alias("hub"))
    own = members.join(sizes.hint("merge"), "cluster").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    hubs = sizes.filter("blocks > 1").select("cluster", F.col("hub").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    dealt = own.select("cluster", "doc_id", "i").union(hubs).distinct().withColumn("j", F.lit(-1))
    within = settle(_compared(dealt, payload, relate, parts))
    large = own.filter("blocks > 1")
    if large.isEmpty():
        return within
    large = settle(large)
    roots = components(within).toDF("node", "root")
    of_hub = roots.toDF("hub", "hub_root")
    told = large.join(roots.hint("merge"), F.col("doc_id") == F.col("node"), "left").join(of_hub.hint("merge"), "hub", "left")
    apart = settle(told.filter(F.coalesce("root", "doc_id") != F.coalesce("hub_root", "hub")).select("cluster", "doc_id"))
    left = apart.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("left"))
    all_ = large.join(left.hint("merge"), "cluster")
    each = all_.join(apart.hint("merge"), ["cluster", "doc_id"], "left_semi")
    wide = each.select("cluster", "doc_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("doc_id"), F.col("left")).cast("int").alias("j"))
    tall = all_.select("cluster", "doc_id", "i", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("j"))
    return within.union(_compared(wide.union(tall).distinct(), payload, relate, parts))
