"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct n-word shingles. Sizes fall into bands [l, l / threshold]; sets similar enough lie
in one band or in neighbours, so each set signs for its own band and the next. In a band whose largest size is r, two
similar sets differ in at most k = 2 r (1 - t) / (1 + t) elements. The feature domain (shingle hashes) is cut on two
levels. With FEW differences allowed in a first-level partition, ceil((k + 1) / (FEW + 1)) partitions make sure that in
one of them similar sets differ in at most FEW elements. It is cut into SECOND parts, and every subset of SECOND - FEW
parts is a signature of its own: similar sets agree on at least one. Bands with k < FEW use one partition and compare it
whole.

A subset without elements doesn't sign, or small sets with nothing in common would meet. A first-level partition with
such a subset is weak. A sixteenth of partitions on top (at least one of which holds too many differences less) let sets
with no more weak partitions than that do without; a set with more (a small one) also signs by its s - ceil(t s) + 1
first elements in a fixed order, of which two such similar sets share one.

Shingles that many documents share (a passage, a licence) would make unrelated documents meet wherever they fill a
subset alone. HEAVY finds them in a bounded sample of documents, and partitions leave them out. Any fixed choice of them
is exact: similar sets differ in at most k of the other elements too. Sizes, bands and the final check take whole sets;
in the fixed order they come last.

Sets equal element by element are one class from the start, within a batch before anything is shuffled and across
batches where their signatures meet; only the class's smallest document goes on. Rows with one signature are a group,
and its smallest document is its pivot. Groups with one pivot are merged: near copies make a group for nearly every
subset, each with other members, but few pivots, so a document is a row for each of its pivots, not of its subsets.

Merged groups, and after them clusters (components of what the first leaves), are compared in blocks of BLOCK documents,
the group's hub (its smallest document) with each. Documents that this connects with the hub are done. Only the others
meet the documents of all blocks, so a large group of near copies costs a row a document, not one a pair of blocks. The
first comparison takes digests, a byte for each partition of the set, which for similar sets differ in at most k bytes;
the second takes whole sets, by matrix products over the shingles that two documents share. No pair of documents is ever
a row, and no link between different sets is lost.

A document with fewer than n words is one shingle, the whole sequence; one without words, or a null text, has an empty
set and no links. Rows that share a doc_id are one node. A null doc_id has no links and a null component. Equal sets are
tied by the smallest doc_id. An empty table gives an empty result. Extra columns pass through in jaccard_components; a
column named like an output is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import as_bytes, components, fmix, hashed_words, parts_for, rolling, settle, trim_memory, tuned
from granary.llm.groups import linked_in_groups

#: Differences allowed in a first-level partition; its second-level parts.
FEW, SECOND = 1, 4
#: Documents in the sample (least by a hash of doc_id), how many of them hold a shingle that counts as heavy, and the
#: number of heavy shingles at most (the most frequent ones). The result is the same for any choice.
HEAVY = (20_000, 12, 1 << 18)
#: Text, and documents, that are signed together.
SLICE_BYTES, SLICE_DOCS = 2 << 20, 1 << 15
#: Shares in which the signatures of a part are sorted.
RANGES = 8
_ROW = "part int, kind int, a binary, b binary, c binary, d binary"
_OUT = "kind int, a long, b long, v binary"
#: Kinds of rows: links of equal sets, signatures, (doc_id, size of the set), (pivot, doc_id), (doc_id, band, digest).
LINK, SIGNED, SIZE, MEMBER, DIGEST = 0, 1, 2, 3, 4


def sets_of(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within a text: their hashes, and where each text's begin."""
    h, counts, _ = hashed_words(texts, lower=True)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    m = len(h) - n + 1
    at = np.flatnonzero(doc[:m] == doc[n - 1 :]) if m > 0 else np.zeros(0, np.int64)
    shingle, owner = rolling(h, n)[at] if len(at) else np.zeros(0, np.uint64), doc[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.array([fmix(rolling(h[starts[i] : starts[i + 1]], int(counts[i])) + np.uint64(counts[i]))[0] for i in short], np.uint64)
        shingle, owner = np.concatenate([shingle, whole]), np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    return shingle, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


@functools.lru_cache(maxsize=None)
def _bands(num: int, den: int, up_to: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band for the threshold num / den."""
    first, last = [1], [den // num]
    while last[-1] < up_to:
        first.append(last[-1] + 1)
        last.append(max(first[-1], first[-1] * den // num))
    return np.array(first), np.array(last)


def most_different(band: int, num: int, den: int) -> int:
    """How many elements two similar sets of a band differ in at most."""
    size = 1 << 10
    _, last = _bands(num, den, size)
    while band >= len(last):
        size *= 4
        _, last = _bands(num, den, size)
    return 2 * int(last[band]) * (den - num) // (den + num)


def _digests(mixed: np.ndarray, content: np.ndarray, owner: np.ndarray, k: np.ndarray) -> list[bytes]:
    """A byte for each of k + 1 + k / 16 partitions of each set, 0 for an empty one."""
    n = k + 1 + k // 16
    end = np.cumsum(n)
    cell = (end - n)[owner] + ((mixed >> np.uint64(32)) * n[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    total = int(end[-1]) if len(end) else 0
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, cell, content)
    out = np.where(np.bincount(cell, minlength=total) > 0, 1 + (fmix(sums) % np.uint64(255)), 0).astype(np.uint8)
    return [x.tobytes() for x in np.split(out, end[:-1])] if total else []


def signatures(elements: np.ndarray, starts: np.ndarray, num: int, den: int, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, bytes]]]:
    """Signatures of sets (``elements`` from ``starts`` on, none empty), the index of each one's set, and digests as
    (index, band, bytes). A set's signatures are in its own band, in the next, and of its first elements if it is
    sparse."""
    sizes = np.diff(starts)
    count = len(sizes)
    if not count:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), []
    _, last = _bands(num, den, 1 << max(10, (int(sizes.max()) * den // num + 2).bit_length()))
    own_band = np.searchsorted(last, sizes)
    owner = np.repeat(np.arange(count), sizes)
    found, who, digests = [], [], []
    sparse = np.zeros(count, bool)
    with np.errstate(over="ignore"):
        mixed, content = fmix(elements + np.uint64(0xA5A5A5A5)), fmix(elements)
        common = np.zeros(len(elements), bool)
        if heavy is not None and len(heavy):
            at = np.searchsorted(heavy, elements)
            common = heavy[np.minimum(at, len(heavy) - 1)] == elements
        rare = ~common
        of, high, second, value = owner[rare], mixed[rare] >> np.uint64(32), (mixed[rare] >> np.uint64(16)).astype(np.int64) % SECOND, content[rare]
        for step in (0, 1):
            band = own_band + step
            k = 2 * last[band] * (den - num) // (den + num)
            few = np.minimum(FEW, k)
            least = -(-(k + 1) // (few + 1))
            spare = least // 16
            n = least + spare
            begin = np.cumsum(n) - n
            row = begin[of] + (high * n[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            total = int(n.sum())
            sums, held = np.zeros(total * SECOND, np.uint64), np.bincount(row * SECOND + second, minlength=total * SECOND).reshape(total, SECOND)
            np.add.at(sums, row * SECOND + second, value)
            sums = sums.reshape(total, SECOND)
            set_of = np.repeat(np.arange(count), n)
            place = np.arange(total) - begin[set_of]
            name = fmix((band[set_of].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) * np.uint64(64))
            weak = np.zeros(total, bool)
            whole = few[set_of] == 0
            for left in range(-1, SECOND):  # the part that is left out; none in bands that compare partitions whole
                rows = whole if left < 0 else ~whole
                many = held.sum(1) - (held[:, left] if left >= 0 else 0)
                weak |= rows & (many == 0)
                rows = np.flatnonzero(rows & (many > 0))
                told = sums[rows].sum(1, dtype=np.uint64) - (sums[rows, left] if left >= 0 else np.uint64(0))
                found.append(fmix(told + fmix(name[rows] + np.uint64(left + 1))))
                who.append(set_of[rows])
            sparse |= np.add.reduceat(weak.astype(np.int64), begin) > spare
            digests += [(i, int(b), v) for i, (b, v) in enumerate(zip(band, _digests(mixed, content, owner, k)))]
        for i in np.flatnonzero(sparse).tolist():
            x, size = slice(int(starts[i]), int(starts[i + 1])), int(sizes[i])
            order = np.lexsort((mixed[x], common[x]))
            found.append(fmix(mixed[x][order[: size + (-size * num // den) + 1]] ^ np.uint64(0x70726566)))
            who.append(np.full(len(found[-1]), i))
    return np.concatenate(found), np.concatenate(who).astype(np.int32), digests


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["part", "kind", "a", "b", "c", "d"])


def heavy_shingles(slim: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of the shingles that at least HEAVY[1] of HEAVY[0] documents hold, the HEAVY[2] most frequent."""
    ids = slim.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(HEAVY[0]).distinct()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, _ = sets_of(as_bytes(batch.column(0)), n)
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64))], names=["e"])

    found = slim.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(each, "e long")
    often = found.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HEAVY[1])
    rows = often.orderBy(F.desc("n"), "e").limit(HEAVY[2]).select("e").collect()
    return np.sort(np.array([r.e for r in rows], np.int64).view(np.uint64))


def _sign(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, parts: int, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signatures dealt out by their high bits, the classes found in a batch, and the sizes of the sets."""
    ids, texts, size = [], [], 0

    def done() -> pa.RecordBatch:
        e, starts = sets_of(texts, n)
        counts = np.diff(starts)
        rows = []
        known = np.array([i is not None for i in ids])
        id_ = np.array([0 if i is None else i for i in ids], np.int64)
        if known.any():
            rows.append((int(id_[known][0]) % parts, SIZE, id_[known].tobytes(), counts[known].tobytes(), b"", b""))
        full = np.flatnonzero((counts > 0) & known)
        if len(full):
            with np.errstate(over="ignore"):
                s1, s2 = (np.add.reduceat(fmix(e ^ np.uint64(x)), starts[:-1][counts > 0]) for x in (0x1234567, 0x89ABCDEF01))
            s = np.zeros((2, len(ids)), np.uint64)
            s[0, counts > 0], s[1, counts > 0] = s1, s2
            order = full[np.lexsort((id_[full], counts[full], s[1, full], s[0, full]))]
            new = np.ones(len(order), bool)
            a, b = order[1:], order[:-1]
            new[1:] = (s[0, a] != s[0, b]) | (s[1, a] != s[1, b]) | (counts[a] != counts[b])
            reps = order[new]
            of = reps[np.cumsum(new) - 1]
            if (~new).any():
                rows.append((int(id_[of[0]]) % parts, LINK, id_[order[~new]].tobytes(), id_[of[~new]].tobytes(), b"", b""))
            take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in reps.tolist()])
            sig, who, told = signatures(e[take], np.concatenate([[0], np.cumsum(counts[reps])]), num, den, heavy)
            del take, e
            # a set's first signature also tells equal sets of other batches
            first = np.zeros(len(sig), bool)
            first[np.unique(who, return_index=True)[1]] = True
            order = np.argsort(sig, kind="stable")
            sig, who, first = sig[order], who[order], first[order]
            part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            key = np.array([(id_[reps[i]], b) for i, b, _ in told], np.int64)
            rows.append((int(key[0, 0]) % parts, DIGEST, key.tobytes(), np.array([len(v) for _, _, v in told], np.int64).tobytes(), b"".join(v for _, _, v in told), b""))
            with np.errstate(over="ignore"):  # equal sets have equal classes; with a signature in common, only they
                table = np.stack([id_[reps].view(np.uint64), fmix(s[0, reps] + fmix(s[1, reps] + counts[reps].astype(np.uint64)))])
            for p, x, w, f in zip(part[np.concatenate([[0], cuts])], np.split(sig, cuts), np.split(who, cuts), np.split(first, cuts)):
                docs, index = np.unique(w, return_inverse=True)
                # the part holds the high bits, so 48 bits of a signature are enough; sets are numbered within the row
                low = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6])
                rows.append((int(p), SIGNED, low.tobytes(), index.astype(np.uint16).tobytes(), np.flatnonzero(f).astype(np.int32).tobytes(), table[:, docs].tobytes()))
        trim_memory()
        return _rows(rows)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            ids.append(i)
            texts.append(t)
            size += len(t or b"")
            if size >= SLICE_BYTES or len(ids) >= SLICE_DOCS:
                yield done()
                ids, texts, size = [], [], 0
    if ids:
        yield done()


def _out(kind: int, a: np.ndarray, b: np.ndarray, v: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(v if v is not None else [None] * len(a), pa.binary())], names=["kind", "a", "b", "v"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal sets among rows with one signature, and (pivot, document) of the groups that are left. What is held are the
    rows as they came; signatures are laid out and sorted a share of RANGES at a time."""
    rows, cols, total = [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            _, kind, a, b, c, d = (x[i].as_py() for x in batch.columns)
            if kind == DIGEST:
                key, ends = np.frombuffer(a, np.int64).reshape(-1, 2), np.cumsum(np.frombuffer(b, np.int64))
                yield _out(kind, key[:, 0].copy(), key[:, 1].copy(), [c[x:y] for x, y in zip([0, *ends.tolist()], ends.tolist())])
            elif kind != SIGNED:
                yield _out(kind, np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))
            else:
                cols.append(np.frombuffer(d, np.uint64).reshape(2, -1))
                rows.append((a, b, c, total))
                total += cols[-1].shape[1]
    if not rows:
        return
    docs = np.concatenate(cols, axis=1)
    cols.clear()
    members: list[np.ndarray] = []
    for share in range(RANGES):
        yield from _met(rows, docs, share, members)
    if members:
        found = np.unique(np.concatenate(members, axis=1), axis=1)
        yield _out(MEMBER, found[0].copy(), found[1].copy())
    trim_memory()


def _met(rows: list[tuple[bytes, bytes, bytes, int]], docs: np.ndarray, share: int, members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The links of one share; its (pivot, document) pairs are added to members."""
    sig, who, marked = [], [], []
    for a, b, c, at in rows:
        low = np.frombuffer(a, np.uint8).reshape(-1, 6)
        own = low[:, 5] % RANGES == share
        key = np.zeros((int(own.sum()), 8), np.uint8)
        key[:, :6] = low[own]
        first = np.zeros(len(low), bool)
        first[np.frombuffer(c, np.int32)] = True
        sig.append(key.view(np.uint64).ravel())
        who.append(np.frombuffer(b, np.uint16)[own].astype(np.int32) + at)
        marked.append(first[own])
    sig, who, marked = np.concatenate(sig), np.concatenate(who), np.concatenate(marked)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    many = np.zeros(len(sig), bool)
    many[1:] |= same
    many[:-1] |= same
    order, sig = order[many], sig[many]
    if not len(order):
        return
    run = np.cumsum(np.concatenate([[True], sig[1:] != sig[:-1]])) - 1
    ids = docs[0].view(np.int64)
    d = who[order]
    # equal sets in one run: the smallest document stands for them
    o = np.lexsort((ids[d], docs[1, d], run))
    d, run, f = d[o], run[o], marked[order][o]
    new = np.ones(len(d), bool)
    a, b = d[1:], d[:-1]
    new[1:] = (run[1:] != run[:-1]) | (docs[1, a] != docs[1, b])
    rep = d[new][np.cumsum(new) - 1]
    equal = ~new & f & (ids[d] != ids[rep])
    if equal.any():
        yield _out(LINK, ids[d[equal]], ids[rep[equal]])
    d, run = ids[d[new]], run[new]
    o = np.lexsort((d, run))
    d, run = d[o], run[o]
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(begin, len(d)))
    pivot, more = np.repeat(d[begin], sizes), np.repeat(sizes > 1, sizes)
    if more.any():
        members.append(np.unique(np.stack([pivot[more], d[more]]), axis=1))


def _similar(table: pa.Table, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, and which pairs of them are linked, by whole sets."""
    ids = table.column("doc_id").to_numpy()
    e, starts = sets_of(as_bytes(table.column("text")), n)
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(ids)), counts)
    order = np.argsort(e, kind="stable")
    key, owner = e[order], owner[order]
    col = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if len(key) else np.zeros(0, np.int64)
    shared = np.bincount(col)[col] > 1 if len(col) else np.zeros(0, bool)
    col, owner = col[shared], owner[shared]
    col = np.unique(col, return_inverse=True)[1]
    both = np.zeros((len(ids), len(ids)), np.float32)
    for c in range(0, int(col.max()) + 1 if len(col) else 0, 2048):
        a, b = np.searchsorted(col, [c, c + 2048])
        m = np.zeros((len(ids), 2048), np.float32)
        m[owner[a:b], col[a:b] - c] = 1
        both += m @ m.T
    # counts stay below 2**24, so that they are exact
    union = counts[:, None] + counts[None, :] - both
    return ids, (den * both.astype(np.float64) >= num * union.astype(np.float64)) & (counts[:, None] > 0) & (counts[None, :] > 0)


def _alike(table: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, and which pairs of them have digests of one band that differ in no more bytes than similar sets can."""
    ids, index = np.unique(table.column("doc_id").to_numpy(), return_inverse=True)
    band, digests = table.column("band").to_numpy(), table.column("v").to_pylist()
    out = np.zeros((len(ids), len(ids)), bool)
    for b in np.unique(band).tolist():
        some = np.flatnonzero(band == b)
        v = np.frombuffer(b"".join(digests[x] for x in some), np.uint8).reshape(len(some), -1)
        most = most_different(b, num, den)
        for x in range(len(some)):
            out[index[some[x]], index[some[(v != v[x]).sum(1) <= most]]] = True
    return ids, out


def shingle_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document with a doc_id: doc_id, n_shingles, component_id (smallest doc_id that links of Jaccard >=
    num / den reach)."""
    spark = tuned(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = parts_for(slim)
    signed = slim.mapInArrow(functools.partial(_sign, n=n, num=num, den=den, parts=parts, heavy=heavy_shingles(slim, n)), _ROW)
    met = settle(signed.repartition(parts, "part").mapInArrow(_meet, _OUT))
    groups = met.filter(F.col("kind") == MEMBER).select(F.col("a").alias("cluster"), F.col("b").alias("doc_id")).distinct()
    digests = met.filter(F.col("kind") == DIGEST).select(F.col("a").alias("doc_id"), F.col("b").alias("band"), "v").distinct()
    found = components(linked_in_groups(groups, digests, functools.partial(_alike, num=num, den=den), parts))
    members = found.select(F.col("root").alias("cluster"), F.col("node").alias("doc_id")).union(found.select("root", "root").distinct())
    checked = linked_in_groups(members, slim, functools.partial(_similar, n=n, num=num, den=den), parts)
    roots = components(met.filter(F.col("kind") == LINK).select("a", "b").union(checked))
    named = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    sized = met.filter(F.col("kind") == SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return sized.join(named, F.col("doc_id") == F.col("__node"), "left").select("doc_id", "n_shingles", F.coalesce("__root", "doc_id").alias("component_id"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The rows of df with n_shingles (0 for a null doc_id) and component_id. Rows that share a doc_id get the size of
    the largest set among them."""
    new = ("n_shingles", "component_id")
    base = df.select(*[c for c in df.columns if c not in new])
    found = shingle_components(base, id_col, text, n, num, den)
    told = found.groupBy(F.col("doc_id").alias("__doc")).agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return base.join(told, F.col(id_col).cast("long") == F.col("__doc"), "left").select(*base.columns, F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), "component_id")
