"""Language-model scores from a log-frequency Bloom filter.

Documents are dealt into chunks by doc_id. Each chunk is counted once: its distinct tokens and word pairs, with their
counts in training documents, go to the workers by hash. There the counts of all chunks meet. Token counts are exact
and go back to the chunks that asked. Pair counts are quantised: level q stands for counts from STEPS[q - 1] up to the
next of STEPS, two steps a doubling. Each pair enters a Bloom filter q times, as (pair, 1) to (pair, q); what a pair's
count is, is found by probing level after level until one is missing. An exact check follows, where the counts still
are: an answer above the true level (a false positive) is lowered to it, so that probabilities stay probabilities. The
filter stays sharded by hash: each shard is built and probed where its pairs meet, and only the levels of the pairs that
a chunk asked for go back to it, a byte each. So every training pair counts at any size, and nothing of the filter is
gathered or broadcast.

P(w | h) = l * max(q(h, w) - d, 0) / c(h) + (1 - l) * (c(w) + 1) / (N + V + 1), l = a * c(h) / (c(h) + b), with
(a, b, d) from GRID and q(h, w) the lower end of the pair's level. The sum of q(h, w) over all w is at most c(h), and
that of the other term is 1 with one unknown word, so P sums to at most 1 for each h: scores are log-probabilities.
All of GRID is scored in one pass, and the entry is taken that gives the training documents, each pair of words held
out of its own count, the best likelihood over the whole corpus.

Tokens: ASCII lower-case words, then one end token a text. Null text counts as empty. A document trains unless
crc32(doc_id) mod ``folds`` is ``held``; a null doc_id has the text ''. Extra columns are not returned, whatever their
names. Repeated rows, and rows that share a doc_id, train as often as they stand there, and each has a row in the result.
Without training documents every text has the scores of N = V = 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import as_bytes, fmix, hashed_words, parts_for, settle, trim_memory, tuned, width

END = np.uint64(0x0E0D)
#: a, b and d of the formula.
GRID = ((0.02, 100.0, 0.0), (0.1, 20.0, 0.0), (0.35, 5.0, 0.0), (0.6, 2.0, 0.0), (0.3, 5.0, 0.75), (0.6, 2.0, 0.75), (0.9, 0.5, 0.75), (0.98, 0.1, 0.9))
PROBES, BITS = 4, 6
SLICE = 1 << 17
#: The least count of each level: powers of two and, from 3 on, the numbers half-way between them.
STEPS = np.array([1, *(x for k in range(1, 48) for x in (2**k, 3 * 2 ** (k - 1)))], np.int64)
#: The count that a level stands for.
LOWER = np.array([0, *STEPS], np.float64)
_ROW = "part int, kind int, chunk int, a binary, b binary, c binary, d binary"
#: Kinds of rows: of a chunk for a part, or the part's answers to it; sums.
TOKENS, SUMS = 0, 2


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end tokens, and the count of each text."""
    h, counts, _ = hashed_words(texts, lower=True)
    return np.insert(h, np.cumsum(counts), END), counts + 1


def _pairs(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash for each token and the one before it; a text starts after an end token."""
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        return fmix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _parts(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def trains(ids: list, folds: int, held: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else b"%d" % i) % folds != held for i in ids], bool)


def _rows(rows: list[tuple]) -> pa.Table:
    """Of (part, kind, chunk, a, b, c, d)."""
    cols = list(zip(*rows)) if rows else [()] * 7
    return pa.table([*(pa.array(x, pa.int32()) for x in cols[:3]), *(pa.array(x, pa.binary()) for x in cols[3:])], names=["part", "kind", "chunk", "a", "b", "c", "d"])


def _count(table: pa.Table, parts: int, folds: int, held: int) -> pa.Table:
    tokens, counts = _tokens(as_bytes(table.column("text")))
    learn = np.repeat(trains(table.column("doc_id").to_pylist(), folds, held), counts)
    chunk = table.column("chunk")[0].as_py()
    rows: dict[int, list[bytes]] = {}
    for place, hashes in ((0, tokens), (2, _pairs(tokens, counts))):
        key, index = np.unique(hashes, return_inverse=True)
        count = np.bincount(index, weights=learn, minlength=len(key))
        part = _parts(key, parts)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for p, k, c in zip(part[np.concatenate([[0], cuts])].tolist(), np.split(key, cuts), np.split(count, cuts)):
            if place:  # the part holds the high bits, and 48 bits tell pairs apart in a filter
                k = np.ascontiguousarray((k << np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, 2:])
            rows.setdefault(p, [b""] * 4)[place : place + 2] = [k.tobytes(), c.astype(np.uint32).tobytes()]
    trim_memory()
    return _rows([(p, TOKENS, chunk, *blobs) for p, blobs in rows.items()])


def _bits(keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
    x = fmix(keys + np.uint64(level) * np.uint64(0xC4CEB9FE1A85EC53))
    y = fmix(x ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    for i in range(PROBES):
        yield x + np.uint64(i) * y


def _levels(counts: np.ndarray) -> np.ndarray:
    """Of counts; 0 for none."""
    return np.searchsorted(STEPS, counts, "right")


def _filter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A Bloom filter of BITS bits for each (pair, level)."""
    level = _levels(counts)
    size = np.uint64(max(64, int(level.sum()) * BITS // 64 * 64 + 64))
    bits = np.zeros(int(size), np.uint8)
    with np.errstate(over="ignore"):
        for q in range(1, int(level.max(initial=0)) + 1):
            for x in _bits(keys[level >= q], q):
                bits[(x % size).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for each chunk's tokens (counts) and pairs (levels by this part's filter), a row a chunk and part
    (TOKENS), and sums of N and V (SUMS)."""
    rows: dict[int, list] = {}
    for batch in batches:
        for part, _, chunk, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            rows.setdefault(part, []).append((chunk, *blobs))
    for part in sorted(rows):
        own = rows.pop(part)
        key = np.concatenate([np.frombuffer(r[1], np.uint64) for r in own])
        n = np.concatenate([np.frombuffer(r[2], np.uint32) for r in own])
        each, index = np.unique(key, return_inverse=True)
        total = np.bincount(index, weights=n, minlength=len(each)).astype(np.int64)
        sums = np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()
        told = _split(total[index], [len(r[1]) // 8 for r in own])
        raw = np.concatenate([np.frombuffer(r[3], np.uint8).reshape(-1, 6) for r in own])
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :6] = raw
        key = key.view(np.uint64).ravel()
        n = np.concatenate([np.frombuffer(r[4], np.uint32) for r in own])
        each, index = np.unique(key, return_inverse=True)
        total = np.bincount(index, weights=n, minlength=len(each)).astype(np.int64)
        shard = Shards({0: _filter(each[total > 0], total[total > 0])}, 1)
        found = np.minimum(shard.levels(np.zeros(len(each), np.int64), each), _levels(total)).astype(np.uint8)
        levels = _split(found[index], [len(r[3]) // 6 for r in own])
        yield from _rows([(part, SUMS, -1, sums, b"", b"", b""), *((part, TOKENS, r[0], a, b, b"", b"") for r, a, b in zip(own, told, levels))]).to_batches()


def _split(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])]


class Shards:
    """Answers with a pair's quantised count."""

    def __init__(self, filters: dict[int, bytes], parts: int):
        self.parts = parts
        self.size = np.zeros(parts, np.uint64)
        self.start = np.zeros(parts, np.uint64)
        whole, at = [], 0
        for p in range(parts):
            f = filters.get(p, b"\0" * 8)
            self.size[p], self.start[p] = len(f) * 8, at * 8
            whole.append(f)
            at += len(f)
        self.bits = np.frombuffer(b"".join(whole), np.uint8)

    def levels(self, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The highest level of each key that its part's filter holds, level after level; 0 for none."""
        size, start = self.size[part], self.start[part]
        out = np.zeros(len(key), np.uint8)
        at, q = np.arange(len(key)), 1
        with np.errstate(over="ignore"):
            while len(at) and q <= len(STEPS):
                hit = np.ones(len(at), bool)
                for x in _bits(key[at], q):
                    b = start[at] + x % size[at]
                    hit &= (self.bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
                at = at[hit]
                out[at] = q
                q += 1
        return out

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        return LOWER[self.levels(_parts(pairs, self.parts), (pairs << np.uint64(8)) >> np.uint64(16))]


def _answered(answers: pa.Table, column: str, dtype: type, n: int) -> np.ndarray:
    """What the parts say of a chunk's n distinct tokens or pairs, in the order of their hashes."""
    told = sorted(zip(answers.column("part").to_pylist(), answers.column(column).to_pylist()))
    out = np.concatenate([np.frombuffer(a, dtype) for _, a in told]) if told else np.zeros(0, dtype)
    if len(out) != n:
        raise ValueError(f"a chunk asked for {n} counts and got {len(out)}")
    return out


def _score(docs: pa.Table, answers: pa.Table, total: int, kinds: int, folds: int, held: int) -> pa.Table:
    tokens, counts = _tokens(as_bytes(docs.column("text")))
    ids = docs.column("doc_id").to_pylist()
    each, index = np.unique(tokens, return_inverse=True)
    c = _answered(answers, "a", np.int64, len(each))[index].astype(np.float64)
    each, index = np.unique(_pairs(tokens, counts), return_inverse=True)
    level = _answered(answers, "b", np.uint8, len(each))[index]
    learn = trains(ids, folds, held)
    end = c[np.cumsum(counts)[0] - 1]  # the first text's end token
    del tokens, index, each
    known, base, scores, fits = [], [], [], np.zeros(len(GRID))
    # texts in slices of some SLICE tokens, so that what is held for each token stays small
    stops = np.cumsum(counts)
    first = 0
    while first < len(ids):
        at = int(stops[first] - counts[first])
        last = max(first + 1, int(np.searchsorted(stops, at + SLICE, "right")))
        n = slice(at, int(stops[last - 1]))
        before = c[at - 1] if at else end
        k, b, s, f = _score_slice(c[n], before, end, level[n], counts[first:last], learn[first:last], total, kinds)
        known.append(k)
        base.append(b)
        scores.append(s)
        fits += f
        first = last
    fit = np.zeros((len(ids), len(GRID)))
    fit[0] = fits
    trim_memory()
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(~learn), "n_tokens": pa.array(counts), "n_known": pa.array(np.concatenate(known)),
            "train_tokens": pa.array(np.full(len(ids), total, np.int64)), "base_score": pa.array(np.concatenate(base)),
            "scores": pa.array(np.concatenate(scores).tolist(), pa.list_(pa.float64())), "fits": pa.array(fit.tolist(), pa.list_(pa.float64())),
        }
    )


def probability(pair: np.ndarray, history: np.ndarray, single: np.ndarray, a: float, b: float, d: float) -> np.ndarray:
    """P(w | h) from the quantised count of (h, w), the count of h and the unigram probability of w."""
    lam = a * history / (history + b)
    return lam * np.maximum(pair - d, 0) / np.maximum(history, 1) + (1 - lam) * single


def _score_slice(c: np.ndarray, before: float, end: float, level: np.ndarray, counts: np.ndarray, learn: np.ndarray, total: int, kinds: int):
    """n_known, base score and scores of GRID of some texts, and the likelihoods of GRID over those that train."""
    begin = np.cumsum(counts) - counts
    single = (c + 1) / (total + kinds + 1)
    history = np.concatenate([[before], c[:-1]])
    history[begin] = end
    pair = LOWER[level]
    own = np.repeat(learn, counts)
    less_pair, less_h, less_single = np.maximum(pair[own] - 1, 0), np.maximum(history[own] - 1, 0), np.maximum(c[own], 1) / (total + kinds)
    scores, fits = [], np.zeros(len(GRID))
    for g, way in enumerate(GRID):
        scores.append(np.add.reduceat(np.log10(probability(pair, history, single, *way)), begin))
        fits[g] = np.log10(probability(less_pair, less_h, less_single, *way)).sum()
    return np.add.reduceat((c > 0).astype(np.int64), begin), np.add.reduceat(np.log10(single), begin), np.stack(scores, axis=1), fits


def score_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The driver holds two numbers a part."""
    tuned(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(width(df.sparkSession), parts_for(slim) // 2)
    chunks = 4 * parts
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")
    slim = slim.withColumn("chunk", chunk)
    counted = slim.groupBy("chunk").applyInArrow(lambda t: _count(t, parts, folds, held), _ROW)
    met = settle(counted.repartition(parts, "part").mapInArrow(_meet, _ROW))
    total = kinds = 0
    for (a,) in met.filter(F.col("kind") == SUMS).select("a").collect():  # two numbers a part
        n, v = np.frombuffer(a, np.int64).tolist()
        total, kinds = total + n, kinds + v
    answers = met.filter(F.col("kind") == TOKENS).select("chunk", "part", "a", "b")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, fits array<double>"

    def score(d: pa.Table, a: pa.Table) -> pa.Table:
        return _score(d, a, total, kinds, folds, held)

    scored = settle(slim.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema))
    fits = scored.agg(*(F.sum(F.col("fits")[g]).alias(f"g{g}") for g in range(len(GRID)))).first()
    best = max(range(len(GRID)), key=lambda g: -math.inf if fits[g] is None else fits[g])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("scores")[best].alias("score"))
