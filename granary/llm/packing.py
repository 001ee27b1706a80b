"""Best-fit packing of documents into token sequences by linear grouping.

Tokenizing gives each document's length; only the counts of documents by length (at most ``capacity`` numbers, however
many documents there are) reach the driver, which plans:

1. Pieces of full capacity stand alone.
2. Large lengths (over capacity / SMALL) are sorted and cut into GROUPS groups of equal cardinality; each group's
   lengths are rounded up to its largest. Configurations of the few rounded sizes are then optimised: again and again
   the fullest configuration, found by dynamic programming over capacity, is used as often as the groups allow.
3. The actual lengths take the places of the rounded ones. Counts are runs, so bins alike stay one row of the plan.
4. Small lengths, longest first, go by best fit to the bins with least room that suffices; new bins open when none has.

The plan is a table of runs (length, first rank, sequence, offset), its size bounded by the number of lengths, not of
documents. Documents find their run by their rank among those of their length, which is counted by buckets of doc_id, so
that a length that a third of all documents have is no task of its own.

Null text counts as empty: only the end token. Rows that share a doc_id, equal ones too, are packed one by one. A null
doc_id is packed like any other. Documents of one length are tied by a hash of id and text, then doc_id and piece; equal
rows may change places. An empty table gives an empty result. The end token is id 0. Extra columns are not returned,
whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from granary.llm.common import CACHE_ENTRIES, as_bytes, held, settle, tuned, width

SMALL, GROUPS = 3, 1000
_PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
#: Marks (no apostrophe, which may begin a pre-token of letters) that end a run of non-space bytes: after a letter or
#: digit they are a pre-token of their own.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'"))
_MARK = re.compile(rb"[%b](?<=[0-9A-Za-z].)[%b]*+(?!\S)" % (re.escape(_MARKS), re.escape(_MARKS)))
#: Runs that a worker remembers, of at most 64 bytes each.
_REMEMBERED = 2 * CACHE_ENTRIES


class ChunkIds(dict):
    """A run of non-space bytes -> its ids as little-endian 32-bit numbers. The tokenizer's pre-tokens never hold
    white space and its normaliser composes no character with white space, so runs are encoded apart. Special tokens
    (which stand as they are, before anything is normalised) and letters beyond ASCII are left to the tokenizer: lower
    letters may compose where capitals do not."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.model = self.tokenizer.model

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        if chunk.isalpha() and chunk.islower():
            ids = [t.id for t in self.model.tokenize(chunk.decode())]  # letters of ASCII stand for themselves
            out = struct.pack(f"<{len(ids)}I", *ids)
        elif chunk.isascii() and b"<|" not in chunk and (small := chunk.lower()) != chunk:
            out = self[small]  # the normaliser does as much
        elif b"<|" not in chunk and (base := chunk.rstrip(_MARKS)) and base != chunk and (word := base.decode())[-1].lower().isalnum() and unicodedata.is_normalized("NFC", word):
            # a letter or digit stays one before the marks, so that they are a pre-token
            out = self[base] + self[chunk[len(base) :]]
        elif (word := chunk.decode()).isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word) and (small := word.lower()).isalpha():
            # letters that the normaliser only lowers: one pre-token, so the merges alone are left to do
            ids = [t.id for t in self.model.tokenize(small.encode().decode("latin-1").translate(BYTE_LETTERS))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = out
        return out


def packed_ids(text: bytes | None, ids: ChunkIds) -> bytes:
    """A document's ids with the end id 0, as little-endian 32-bit numbers. Marks at the ends of words are parted and
    letters of ASCII lowered in the whole text, so that a word has one entry however it is written; not where the text may
    hold special tokens, nor letters lowered where a combining mark (from \\xcc or \\xcd on) may follow one."""
    text = text or b""
    if b"<|" not in text:
        text = _MARK.sub(rb" \g<0>", text)
        if b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
    return b"".join(map(ids.__getitem__, text.split())) + b"\0\0\0\0"


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    ids = held(f"packing {path}", lambda: ChunkIds(path))
    for batch in batches:
        keys, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple] = []
        for key, doc, text in zip(keys, docs, as_bytes(batch.column(2))):
            found = packed_ids(text, ids)
            for k, at in enumerate(range(0, len(found), 4 * capacity)):
                part = found[at : at + 4 * capacity]
                out.append((key, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*out)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["row_key", "doc_id", "piece", "start", "length", "ids_crc32"])


def plan(counts: dict[int, int], capacity: int, small: int = SMALL, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences.

    counts: pieces by length. Piece ``first rank + i`` of a run lies in sequence ``first sequence + i`` at ``offset``."""
    runs: list[tuple[int, int, int, int, int]] = []
    used = {length: 0 for length in counts}
    bins = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used[length], count, first, offset))
        used[length] += count

    if counts.get(capacity):
        place(capacity, counts[capacity], 0, 0)
        bins = counts[capacity]
    large = sorted((x for x in counts if capacity // small < x < capacity and counts[x]), reverse=True)
    total = sum(counts[x] for x in large)
    #: Room left -> runs of bins (first sequence, count).
    room: dict[int, list[tuple[int, int]]] = {}
    if total:
        per = -(-total // groups)
        members: list[list[list[int]]] = []  # each group's (length, count), longest first
        left = per
        members.append([])
        for x in large:
            n = counts[x]
            while n:
                if not left:
                    members.append([])
                    left = per
                take = min(n, left)
                members[-1].append([x, take])
                n -= take
                left -= take
        size = [m[0][0] for m in members]
        stock = [sum(n for _, n in m) for m in members]
        while any(stock):
            config = _fullest(size, stock, capacity)
            times = min(stock[g] // k for g, k in config.items())
            for g, k in config.items():
                stock[g] -= k * times
            slots = [g for g, k in sorted(config.items()) for _ in range(k)]
            # the groups' actual lengths, in runs of bins alike
            queues = []
            for g in slots:
                taken, need = [], times
                while need:
                    x, n = members[g][0]
                    t = min(n, need)
                    taken.append((x, t))
                    members[g][0][1] -= t
                    need -= t
                    if not members[g][0][1]:
                        members[g].pop(0)
                queues.append(taken)
            edges = sorted({0, times, *(e for q in queues for e in np.cumsum([n for _, n in q]).tolist())})
            at = [0] * len(queues)
            done = [0] * len(queues)
            for a, b in zip(edges, edges[1:]):
                offset = 0
                for s, q in enumerate(queues):
                    x = q[at[s]][0]
                    place(x, b - a, bins + a, offset)
                    offset += x
                    done[s] += b - a
                    if done[s] == q[at[s]][1]:
                        at[s], done[s] = at[s] + 1, 0
                room.setdefault(capacity - offset, []).append((bins + a, b - a))
            bins += times
    for x in sorted((x for x in counts if x <= capacity // small and x < capacity and counts[x]), reverse=True):
        n = counts[x]
        while n:
            fits = min((r for r in room if r >= x), default=None)
            if fits is None:
                fits = capacity
                count = -(-n // (capacity // x))
                room[fits] = [(bins, count)]
                bins += count
            first, count = room[fits].pop()
            if not room[fits]:
                del room[fits]
            take = min(n, count)
            place(x, take, first, capacity - fits)
            n -= take
            if take < count:
                room.setdefault(fits, []).append((first + take, count - take))
            if fits > x:
                room.setdefault(fits - x, []).append((first, take))
    return runs, bins


def _fullest(size: list[int], stock: list[int], capacity: int) -> dict[int, int]:
    """The configuration (group -> number) that fills most of the capacity; it holds the largest group in stock."""
    start = next(g for g, n in enumerate(stock) if n)
    space = capacity - size[start]
    best = np.full(space + 1, -1, np.int64)  # the last group that reaches a sum
    before = np.zeros(space + 1, np.int64)
    reached = np.zeros(space + 1, bool)
    reached[0] = True
    for g in range(start, len(size)):
        have = stock[g] - (g == start)
        if have <= 0 or size[g] > space:
            continue
        front = reached.copy()
        for _ in range(min(have, space // size[g])):
            new = np.zeros_like(front)
            new[size[g] :] = front[: space + 1 - size[g]]
            new &= ~reached
            if not new.any():
                break
            at = np.flatnonzero(new)
            best[at], before[at] = g, at - size[g]
            reached |= new
            front = new
        if reached[space]:
            break
    at = int(np.flatnonzero(reached)[-1])
    out = {start: 1}
    while at:
        g = int(best[at])
        out[g] = out.get(g, 0) + 1
        at = int(before[at])
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = tuned(df.sparkSession)
    buckets = width(spark)
    key = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(text, F.lit("")))
    slim = df.select(key.alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = settle(slim.mapInArrow(functools.partial(_cut, path=tokenizer_path, capacity=capacity), _PIECES))
    pieces = pieces.withColumn("bucket", F.pmod("row_key", F.lit(buckets)).cast("int"))
    by = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {x: n for x, n in by.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = plan(counts, capacity)
    before = by.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0).cast("long")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_key", "doc_id", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, first long, count long, sequence long, offset long")
    # runs of one length in order of rank: an array for each length, searched by rank
    lists = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "count", "sequence", "offset"))).alias("runs"))
    hit = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["count"]))[0]
    found = ranked.join(F.broadcast(lists), "length").withColumn("hit", hit)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("hit.sequence") + F.col("rank") - F.col("hit.first")).alias("sequence_id"), F.col("hit.offset").alias("offset"))
