"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage is repeated if a window of 20 words has an earlier copy. In each window the 10-word run with the least hash is
its anchor, so equal windows have equal anchors in the same place. The suffixes that start at anchors, with the words
before them, hold every window: they are the leaves (a sparse suffix tree). A first pass (16 bytes for each anchor) finds
the anchors that occur again; windows of others have no copy and are left alone.

Leaves are split into groups by a prefix of variable length: the anchor's 10 words, or, where more than GROUP suffixes
begin with those, the whole window. A leaf carries its words themselves, cut to the windows that it stands for. A task
takes the groups of one part, whose number follows the bytes of the input: it numbers the words, sorts the suffixes
and takes the common prefix of neighbours (LCP), which gives the inner nodes of all its subtrees: at depth d, runs of
neighbours with an LCP of d and more. The words before the anchors are sorted likewise, backwards. A node at depth 20 - o
forwards and one at depth o backwards are together the occurrences of one window, o words of which stand before the
anchor; the earliest stays and the windows of the others are marked. Marked windows in a row make up a maximal repeat:
its span is given with the document, all but the first occurrence of its words is removed.

A group that outgrows HELD_WORDS words in memory is cut at once, and of its leaves only those go on that still have a
window without an earlier copy; what is marked then is what would be marked later. Before they are shuffled, each batch
keeps one window, the earliest, of those that are equal in it (compared word by word, 64 bits each), and marks its own
others; a passage that a third of all documents share thus sends one row a batch, not one a document.

Order is doc_id (null first), then the text's hash, then place. Rows alike in doc_id and text are one document: neither
is earlier, each gets the same result. Null, empty and blank texts have no words. An empty table gives an empty result.
Extra columns pass through; a column named like an output is replaced.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import as_bytes, extended, fmix, hashed_words, parts_for, rolling, settle, trim_memory, tuned, width

#: Words of an anchor; suffixes with one anchor from which the prefix is the whole window.
ANCHOR, GROUP = 10, 100_000
#: Words of leaves that a task holds before it cuts their trees.
HELD_WORDS = 12_000_000
#: Text that a worker looks at together.
BLOCK_BYTES = 3 << 20
NULL_ID = -(2**63)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
_ROW = "part int, kind int, a binary, b binary, c binary, d binary"
#: Kinds of rows: anchors of a batch, places of words by chunk, hashes of anchors that occur often, leaves of trees.
ANCHORS, PLACES, HOT, LEAVES = 0, 1, 2, 3
#: With a count: the batch has told the places of this anchor.
PLACED = np.uint32(1 << 31)


class _Batch:
    """All words of some documents, one after the other, in the order of (doc_id, hash of the text)."""

    def __init__(self, ids: list, texts: list, window: int):
        ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        ties = np.fromiter((xxhash.xxh3_64_intdigest(t or b"") >> 1 for t in texts), np.int64, len(texts))
        self.order = np.lexsort((ties, ids))
        self.ids, self.ties = ids[self.order], ties[self.order]
        self.h, self.counts, self.words = hashed_words([texts[i] for i in self.order])
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), self.counts)
        new = np.ones(len(ids), bool)
        new[1:] = (self.ids[1:] != self.ids[:-1]) | (self.ties[1:] != self.ties[:-1])
        self.same = np.flatnonzero(new)[np.cumsum(new) - 1].astype(np.int32) if len(ids) else np.zeros(0, np.int32)
        n = len(self.h) - window + 1
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of each window's anchor, and the hash of the anchor at every place."""
        if not len(self.at):
            return self.at, np.zeros(0, np.uint64)
        size = min(ANCHOR, window)
        g = rolling(self.h, size)
        out = np.empty(len(self.at), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(g, window - size + 1)
        for i in range(0, len(out), 1 << 18):
            part = self.at[i : i + (1 << 18)]
            out[i : i + (1 << 18)] = part + view[part].argmin(axis=1)
        return out, g

    def place(self, at: np.ndarray) -> np.ndarray:
        return (at - self.starts[self.doc[at]]).astype(np.int32)


def _parts(h: np.ndarray, n: int) -> np.ndarray:
    """0 to n - 1 by the high bits, so that sorting by hash sorts by part."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["part", "kind", "a", "b", "c", "d"])


def _located(kind: int, part_of: np.ndarray, batch: _Batch, at: np.ndarray) -> list[tuple]:
    """Places by part: rows of (doc_id, tie, place) arrays."""
    order = np.argsort(part_of, kind="stable")
    part_of, at = part_of[order], at[order]
    cuts = np.flatnonzero(np.diff(part_of)) + 1
    out = []
    for p, x in zip(part_of[np.concatenate([[0], cuts])] if len(at) else [], np.split(at, cuts)):
        d = batch.doc[x]
        out.append((int(p), kind, batch.ids[d].tobytes(), batch.ties[d].tobytes(), batch.place(x).tobytes(), b""))
    return out


def _chunk_of(ids: np.ndarray, chunks: int) -> np.ndarray:
    each, index = np.unique(ids, return_inverse=True)
    return np.fromiter((zlib.crc32(b"%d" % i) % chunks for i in each.tolist()), np.int32, len(each))[index]


def _anchored(part_of: np.ndarray, batch: _Batch, at: np.ndarray, key: np.ndarray, count: np.ndarray) -> list[tuple]:
    """Anchors by part: hash, occurrences in a chunk of the batch, and the place of the first. Documents stand once in a row."""
    order = np.argsort(part_of, kind="stable")
    part_of, at, key, count = part_of[order], at[order], key[order], count[order]
    cuts = np.flatnonzero(np.diff(part_of)) + 1
    out = []
    for p, x, k, n in zip(part_of[np.concatenate([[0], cuts])] if len(at) else [], np.split(at, cuts), np.split(key, cuts), np.split(count, cuts)):
        docs, index = np.unique(batch.doc[x], return_inverse=True)
        where = np.empty((len(x), 2), np.int32)
        where[:, 0], where[:, 1] = index, batch.place(x)
        out.append((int(p), ANCHORS, k.tobytes(), n.astype(np.uint32).tobytes(), where.tobytes(), np.stack([batch.ids[docs], batch.ties[docs]]).tobytes()))
    return out


def _gathered(rows: list[tuple]):
    """Hash, occurrences, doc_id, tie, place of all anchors in some rows."""
    key = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
    count = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
    ids, ties, place = [], [], []
    for r in rows:
        where, docs = np.frombuffer(r[2], np.int32).reshape(-1, 2), np.frombuffer(r[3], np.int64).reshape(2, -1)
        ids.append(docs[0][where[:, 0]])
        ties.append(docs[1][where[:, 0]])
        place.append(where[:, 1])
    return key, count, np.concatenate(ids), np.concatenate(ties), np.concatenate(place)


def _by_chunk(kind: int, ids: np.ndarray, ties: np.ndarray, place: np.ndarray, chunks: int) -> list[tuple]:
    part = _chunk_of(ids, chunks)
    order = np.argsort(part, kind="stable")
    part, ids, ties, place = part[order], ids[order], ties[order], place[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    return [(int(p), kind, i.tobytes(), t.tobytes(), x.tobytes(), b"") for p, i, t, x in zip(part[np.concatenate([[0], cuts])] if len(ids) else [], np.split(ids, cuts), np.split(ties, cuts), np.split(place, cuts))]


def _find_anchors(batches: Iterator[pa.RecordBatch], window: int, parts: int, chunks: int) -> Iterator[pa.RecordBatch]:
    """For each batch its anchors by chunk (ANCHORS), and the places of those that it has more than once (PLACES)."""

    def done(ids: list, texts: list) -> pa.RecordBatch:
        b = _Batch(ids, texts, window)
        of, g = b.anchors(window)
        if not len(of):
            return _rows([])
        at = of[np.concatenate([[True], of[1:] != of[:-1]])]
        key, chunk = g[at], _chunk_of(b.ids[b.doc[at]], chunks)
        order = np.lexsort((at, chunk, key))
        at, key, chunk = at[order], key[order], chunk[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        again = (np.bincount(np.cumsum(new) - 1) > 1)[np.cumsum(new) - 1]
        # one row for each chunk that an anchor is in, for what is said of the anchor must reach all of them
        first = np.flatnonzero(new | np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        count = np.diff(np.append(first, len(at))).astype(np.uint32) | (again[first].astype(np.uint32) << np.uint32(31))
        return _rows(_anchored(_parts(key[first], parts), b, at[first], key[first], count) + _located(PLACES, chunk[again], b, at[again]))

    yield from _in_blocks(batches, done)


def _in_blocks(batches: Iterator[pa.RecordBatch], done, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Calls done(ids, texts) for documents of some block_bytes at a time."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            ids.append(i)
            texts.append(t)
            size += len(t or b"")
            if size >= block_bytes:
                yield done(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield done(ids, texts)


def _meet_anchors(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """Places of anchors that occur again in another batch (PLACES), by chunk of their document, and to each chunk the
    hashes of its anchors that occur more than GROUP times (HOT). What batches have found for themselves passes."""
    held = []
    for batch in batches:
        passed = []
        for part, kind, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == ANCHORS:
                held.append(blobs)
            else:
                passed.append((part, kind, *blobs))
        if passed:
            yield _rows(passed)
    if held:
        key, count, ids, ties, place = _gathered(held)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        hot = np.bincount(run, count & ~PLACED)[run] > GROUP
        keep = order[(np.bincount(run)[run] > 1) & (count & PLACED == 0) & ~hot]
        yield _rows(_by_chunk(PLACES, ids[keep], ties[keep], place[keep], chunks))
        if hot.any():
            told = np.unique(np.stack([_chunk_of(ids[order[hot]], chunks).astype(np.uint64), key[hot]]), axis=1)
            cuts = np.flatnonzero(np.diff(told[0])) + 1
            yield _rows([(int(c[0]), HOT, k.tobytes(), b"", b"", b"") for c, k in zip(np.split(told[0], cuts), np.split(told[1], cuts))])


def _lookup(batch: _Batch, rows: list[tuple]) -> np.ndarray:
    """Places in the batch of all words that (doc_id, tie, place) rows name, in each of equal documents."""
    if not rows or not len(batch.ids):
        return np.zeros(0, np.int64)
    ids = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
    ties = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows])
    place = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
    where = {k: i for i, k in zip(range(len(batch.ids) - 1, -1, -1), zip(batch.ids[::-1].tolist(), batch.ties[::-1].tolist()))}
    doc = np.fromiter((where.get(k, -1) for k in zip(ids.tolist(), ties.tolist())), np.int64, len(ids))
    doc, place = doc[doc >= 0], place[doc >= 0]
    return batch.starts[doc] + place


def _like_first(batch: _Batch, mark: np.ndarray) -> None:
    """Equal documents get the marks of the first of them."""
    for i in np.flatnonzero(batch.same != np.arange(len(batch.same))):
        j = batch.same[i]
        mark[batch.starts[i] : batch.starts[i + 1]] = mark[batch.starts[j] : batch.starts[j + 1]]


def _equal_windows(batch: _Batch, at: np.ndarray, window: int) -> np.ndarray:
    """Whether a window of the batch (at, ascending) equals an earlier one of them, compared word by word."""
    key = rolling(batch.h, window)[at]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    head = order[new][np.cumsum(new) - 1]
    later, head = order[~new], head[~new]
    same = np.ones(len(later), bool)
    for j in range(window):
        same &= batch.h[at[later] + j] == batch.h[at[head] + j]
    out = np.zeros(len(at), bool)
    out[later[same]] = True
    return out


def _grow(docs: pa.Table, marks: pa.Table, window: int, parts: int, chunks: int) -> pa.Table:
    """The leaves (LEAVES) of windows whose anchor repeats, dealt out by prefix, each with its words; and the places of
    windows that the batch has already (PLACES)."""
    if not marks.num_rows:
        return pa.Table.from_batches([_rows([])])
    b = _Batch(docs.column("doc_id").to_pylist(), as_bytes(docs.column("text")), window)
    of, g = b.anchors(window)
    if not len(of):
        return pa.Table.from_batches([_rows([])])
    rows = list(zip(*(marks.column(c).to_pylist() for c in ("kind", "a", "b", "c"))))
    known = np.zeros(len(b.h), bool)
    known[_lookup(b, [r[1:] for r in rows if r[0] == PLACES])] = True
    hot = np.unique(np.frombuffer(b"".join(r[1] for r in rows if r[0] == HOT), np.uint64))
    if len(hot):
        known[of[hot[np.minimum(np.searchsorted(hot, g[of]), len(hot) - 1)] == g[of]]] = True
    _like_first(b, known)
    use = np.flatnonzero(known[of] & (b.same[b.doc[b.at]] == b.doc[b.at]))
    at, of = b.at[use], of[use]
    if not len(at):
        return pa.Table.from_batches([_rows([])])
    later = _equal_windows(b, at, window)
    gone = at[later]
    at, of = at[~later], of[~later]
    anchor = g[of]
    single = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor if len(hot) else np.zeros(len(at), bool)
    # windows in a row with one anchor are one leaf
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]) | single[1:]])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(at)))
    start, before = at[first], of[first] - at[first]
    prefix = np.where(single[first], rolling(b.h, window)[start], anchor[first])
    part = _parts(fmix(prefix ^ np.uint64(0x7265657)), parts)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    flat = list(itertools.chain.from_iterable(b.words))
    out = _located(PLACES, _chunk_of(b.ids[b.doc[gone]], chunks), b, gone)
    for some in np.split(order, cuts):
        lo = start[some]
        docs_, index = np.unique(b.doc[lo], return_inverse=True)
        leaf = np.stack([index, b.place(lo), many[some], before[some]], axis=1).astype(np.int32)
        text = b" ".join(itertools.chain.from_iterable(flat[x:y] for x, y in zip(lo.tolist(), (lo + many[some] + window - 1).tolist())))
        out.append((int(part[some[0]]), LEAVES, leaf.tobytes(), np.stack([b.ids[docs_], b.ties[docs_]]).tobytes(), text, b""))
    return pa.Table.from_batches([_rows(out)])


def _depths(columns: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of sequences (columns: places by sequences) and the common prefix of neighbours in it; places that are
    not valid end a sequence."""
    order = np.lexsort(columns[::-1]) if len(columns) else np.arange(columns.shape[1])
    sorted_ = columns[:, order]
    differ = (sorted_[:, 1:] != sorted_[:, :-1]) | ~valid[:, order][:, 1:]
    common = np.where(differ.any(axis=0), differ.argmax(axis=0), len(columns)) if len(columns) else np.zeros(max(0, columns.shape[1] - 1), np.int64)
    return order, common


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Each sequence's node at a depth: neighbours with at least so long a common prefix share one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], common < depth]))
    return out


def repeated_windows(words: np.ndarray, begin: np.ndarray, many: np.ndarray, before: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of leaves (numbered words from ``begin`` on, ``many`` windows, ``before`` words in front of the anchor, ``rank``
    in the order of documents and anchors): (leaf, window) of all windows that an earlier leaf has too."""
    reach = window - min(ANCHOR, window)
    end = begin + many + window - 1
    anchor = begin + before
    ahead = anchor + np.arange(window)[:, None]
    behind = anchor - 1 - np.arange(reach)[:, None]
    on, back = ahead < end, behind >= begin
    order, common = _depths(np.where(on, words[np.minimum(ahead, len(words) - 1)], -1), on)
    order_b, common_b = _depths(np.where(back, words[np.maximum(behind, 0)], -1), back)
    leaves, windows = [], []
    for o in range(reach + 1):
        some = np.flatnonzero((o <= before) & (o > before - many))
        if len(some) < 2:
            continue
        key = _nodes(order, common, window - o)[some] * (len(begin) + 1) + _nodes(order_b, common_b, o)[some]
        each, index = np.unique(key, return_inverse=True)
        least = np.full(len(each), np.iinfo(np.int64).max)
        np.minimum.at(least, index, rank[some])
        gone = some[rank[some] != least[index]]
        leaves.append(gone)
        windows.append(before[gone] - o)
    return (np.concatenate(leaves), np.concatenate(windows)) if leaves else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Forest:
    """The leaves of a task's groups."""

    def __init__(self, window: int):
        self.window, self.number, self.words, self.leaves, self.held = window, defaultdict(itertools.count().__next__), [], [], 0

    def add(self, leaf: bytes, docs: bytes, text: bytes) -> None:
        self.words.append(np.fromiter(map(self.number.__getitem__, text.split()), np.int32))
        x, d = np.frombuffer(leaf, np.int32).reshape(-1, 4).astype(np.int64), np.frombuffer(docs, np.int64).reshape(2, -1)
        self.leaves.append(np.stack([d[0][x[:, 0]], d[1][x[:, 0]], x[:, 1], x[:, 2], x[:, 3]]))
        self.held += len(self.words[-1])

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, tie and place of the windows that an earlier leaf has too; leaves without another window go."""
        words, leaves = np.concatenate(self.words), np.concatenate(self.leaves, axis=1)
        ids, ties, place, many, before = leaves
        length = many + self.window - 1
        begin = np.cumsum(length) - length
        order = np.lexsort((place + before, ties, ids))
        new = np.zeros(len(order), np.int64)
        a, b = order[1:], order[:-1]
        new[1:] = (ids[a] != ids[b]) | (ties[a] != ties[b]) | (place[a] + before[a] != place[b] + before[b])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        leaf, at = repeated_windows(words, begin, many, before, rank, self.window)
        keep = np.bincount(leaf, minlength=len(ids)) < many
        self.words, self.leaves = [words[np.repeat(keep, length)]], [leaves[:, keep]]
        self.held = len(self.words[0])
        return ids[leaf], ties[leaf], (place[leaf] + at).astype(np.int32)


def _cut(batches: Iterator[pa.RecordBatch], window: int, chunks: int) -> Iterator[pa.RecordBatch]:
    """Places of windows that an earlier leaf has too, by chunk of their document. Rows alike that were looked at apart
    (in other slices or tasks) send the same leaf; all of them are the earliest, or none."""
    forest, most = _Forest(window), HELD_WORDS
    for batch in batches:
        passed = []
        for part, kind, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            if kind != LEAVES:
                passed.append((part, kind, *blobs))
                continue
            forest.add(*blobs[:3])
            if forest.held > most:
                yield _rows(_by_chunk(PLACES, *forest.cut(), chunks))
                most = max(HELD_WORDS, 2 * forest.held)
        if passed:
            yield _rows(passed)
    if forest.leaves:
        yield _rows(_by_chunk(PLACES, *forest.cut(), chunks))
    del forest
    trim_memory()


def _removed(docs: pa.Table, marks: pa.Table, window: int, names: list[str], id_at: int, text_at: int) -> pa.Table:
    texts = as_bytes(docs.column(text_at))
    b = _Batch(docs.column(id_at).to_pylist(), texts, window)
    gone = np.zeros(len(b.h) + 1, np.int64)
    at = _lookup(b, list(zip(*(marks.column(c).to_pylist() for c in "abc"))))
    np.add.at(gone, at, 1)
    np.add.at(gone, at + window, -1)
    gone = np.cumsum(gone)[:-1] > 0
    _like_first(b, gone)
    n = len(texts)
    kept, removed, spans = [b""] * n, [0] * n, [[]] * n
    for k, i in enumerate(b.order.tolist()):
        mask = gone[b.starts[k] : b.starts[k + 1]]
        removed[i] = int(mask.sum())
        if removed[i]:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            spans[i] = [{"start": x, "length": y - x} for x, y in edge.reshape(-1, 2).tolist()]
        kept[i] = b" ".join(w for w, g in zip(b.words[k], mask.tolist()) if not g) if removed[i] else b" ".join(b.words[k])
    counts = np.empty(n, np.int64)
    counts[b.order] = b.counts
    docs = docs.select(range(len(names)))
    return pa.table([*docs.columns, pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, _SPANS)], names=[*names, "n_words", "n_removed", "kept_text", "repeats"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Adds n_words, n_removed, kept_text (the words in no window of ``window`` words that also starts earlier, joined
    by one space) and repeats (the spans of words that are removed). Nothing is read on the driver."""
    tuned(df.sparkSession)
    new = ("n_words", "n_removed", "kept_text", "repeats")
    names = [c for c in df.columns if c not in new]
    base = df.select(*names)
    slim = base.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts, block = max(width(df.sparkSession), parts_for(slim) // 2), BLOCK_BYTES
    chunks = 2 * parts
    found = slim.mapInArrow(functools.partial(_find_anchors, window=window, parts=parts, chunks=chunks), _ROW)
    met = settle(found.repartition(parts, "part").mapInArrow(functools.partial(_meet_anchors, chunks=chunks), _ROW))
    chunk = functools.partial(_chunk_column, chunks=chunks)
    marks = met.select(F.col("part").alias("__chunk"), "kind", "a", "b", "c")
    grown = slim.withColumn("__chunk", chunk("doc_id")).groupBy("__chunk").cogroup(marks.groupBy("__chunk")).applyInArrow(lambda d, m: _sliced(d, "text", lambda x: _grow(x, m, window, parts, chunks), block), _ROW)
    cut = grown.repartition(parts, "part").mapInArrow(functools.partial(_cut, window=window, chunks=chunks), _ROW)
    gone = cut.select(F.col("part").alias("__chunk"), "a", "b", "c")
    i, t = names.index(id_col), names.index(text)
    schema = extended(base, "n_words long, n_removed long, kept_text string, repeats array<struct<start: int, length: int>>")
    return base.withColumn("__chunk", chunk(id_col)).groupBy("__chunk").cogroup(gone.groupBy("__chunk")).applyInArrow(lambda d, m: _sliced(d, t, lambda x: _removed(x, m, window, names, i, t), block), schema)


def _sliced(docs: pa.Table, text: str | int, work, block_bytes: int) -> pa.Table:
    """work(documents) for some block_bytes of a chunk at a time."""
    sizes = np.cumsum([len(t or b"") for t in as_bytes(docs.column(text))])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // block_bytes)) + 1).tolist(), docs.num_rows]
    found = [work(docs.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a] or [work(docs)]
    trim_memory()
    return pa.concat_tables(found)


def _chunk_column(name: str, chunks: int):
    """_chunk_of as a column."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).cast("string").cast("binary")), F.lit(chunks)).cast("int")
