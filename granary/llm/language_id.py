"""Language of documents, word by word, with a linear-chain conditional random field.

A document is a chain of words (runs of letters, lower case; runs of over 40 letters in pieces of 40). A word's features:
the word, its prefixes and suffixes of 1 to 4 letters, its inner pairs and triples of letters, and for each language
whether the word is in that language's lexicon (its most frequent words in the fitted sample). Features are hashed into a
table of fixed size, so the model has a fixed size too. Labels are languages; start and transitions are learned.
Forward-backward gives each word's probability of each language, so parts in another language are told apart
(``Model.words``); the document's language is the one with the largest mean, the score is that mean.

Fitting takes the whole text and the language of at most DOCS documents of each language, the least by a hash of doc_id:
a bounded sample, on the driver. Every language is learned; with more than SAMPLE / DOCS of them each has fewer
documents, and with more than LANGUAGES fitting raises an error. Texts are cut into chains of PIECE words. Since a label
is of a document, those chains hold no switch; so as many again are spliced from pieces of documents in two languages,
each word with the label of its own document, and from these the chain learns how languages follow each other.

``und`` with score 0 is given to a null text, and to one without letters. Without any labelled row every document is
``und``. Languages equally likely are tied by name. Extra columns pass through; a column named like an output is
replaced. Repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from granary.llm.common import extended, held, tuned

#: Fitting: documents of a language, words of a chain, rounds, chains in a step, weight of the squared norm.
DOCS, PIECE, ROUNDS, STEP, NORM = 200, 200, 5, 64, 1e-4
SLOTS, LEXICON = 1 << 17, 300
#: Languages at most (weights are SLOTS a language); documents of all languages together.
LANGUAGES, SAMPLE = 256, 64 * DOCS
#: Words that a worker remembers, and words whose features are looked up together.
CACHE_WORDS, STEP_WORDS = 200_000, 4096
_LETTERS = re.compile(r"[^\W\d_]{1,40}")


def features(word: str) -> list[int]:
    w = f"^{word}$".encode()
    n = len(w)
    parts = [b"w" + w]
    for k in range(2, min(6, n)):
        parts += [b"p" + w[:k], b"s" + w[-k:]]
    parts += [b"2" + w[i : i + 2] for i in range(1, n - 2)] + [b"3" + w[i : i + 3] for i in range(n - 2)]
    return [zlib.crc32(p) % SLOTS for p in parts]


def forward_backward(emission: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each label at each place of padded chains (n, t, l), and expected moves (l, l) of all chains."""
    n, t, labels = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    a = np.exp(move)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    x = e[:, 0] * np.exp(start)
    alpha[:, 0] = x / x.sum(1, keepdims=True)
    for i in range(1, t):
        x = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = x / x.sum(1, keepdims=True)
    last = lengths - 1
    x = np.ones((n, labels))
    beta[:, t - 1] = 1
    moves = np.zeros((labels, labels))
    for i in range(t - 2, -1, -1):
        y = beta[:, i + 1] * e[:, i + 1]
        x = y @ a.T
        inside = (i < last)[:, None]
        moves += a * ((alpha[:, i] * inside / (alpha[:, i] * x).sum(1, keepdims=True)).T @ y)
        x = x / x.sum(1, keepdims=True)
        beta[:, i] = np.where(inside, x, 1)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    return post, moves


def marginals(emission: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """As forward_backward, without the moves; in single precision."""
    n, t, labels = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True)).transpose(1, 0, 2).astype(np.float32).copy()
    a, b = np.exp(move).astype(np.float32), np.exp(move).T.astype(np.float32).copy()
    ones = np.ones((labels, labels), np.float32)
    alpha = np.empty_like(e)
    x = e[0] * np.exp(start).astype(np.float32)
    alpha[0] = x / (x @ ones)
    for i in range(1, t):
        x = (alpha[i - 1] @ a) * e[i]
        alpha[i] = x / (x @ ones)
    beta = np.ones((n, labels), np.float32)
    done = lengths - 1
    for i in range(t - 2, -1, -1):
        x = (beta * e[i + 1]) @ b
        beta = np.where((i < done)[:, None], x / (x @ ones), np.float32(1))
        alpha[i] *= beta
    alpha /= alpha.sum(2, keepdims=True)
    return alpha.transpose(1, 0, 2)


class Model:
    """Weights by hashed feature and label, lexicons, transitions."""

    def __init__(self, labels: list[str], lexicons: list[set[str]]):
        self.labels, self.lexicons = labels, lexicons
        self.weight = np.zeros((SLOTS + len(labels), len(labels)), np.float32)
        self.move = np.zeros((len(labels), len(labels)))
        self.start = np.zeros(len(labels))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(self.labels)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def features(self, word: str) -> list[int]:
        return features(word) + [SLOTS + k for k, lexicon in enumerate(self.lexicons) if word in lexicon]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Of each word, from a bounded table of words met before."""
        if len(self.place) > min(CACHE_WORDS, 64 * CACHE_WORDS // len(self.labels)):
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        values = [self.known] if len(self.known) else []
        for at in range(0, len(new), STEP_WORDS):
            found = [self.features(w) for w in new[at : at + STEP_WORDS]]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((f for x in found for f in x), np.int64, int(counts.sum()))
            values.append(np.add.reduceat(self.weight[flat], np.cumsum(counts) - counts, axis=0))
        if new:
            self.place.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.known = np.concatenate(values)
        return self.known[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def fit(self, chains: list[tuple[list[str], list[int]]], rounds: int = ROUNDS) -> None:
        """From chains of words, each word with the index of its label."""
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c, _ in chains for w in c))}
        found = [self.features(w) for w in vocabulary]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((f for x in found for f in x), np.int64, int(counts.sum()))
        begin = np.cumsum(counts) - counts
        coded = [(np.array([vocabulary[w] for w in c]), np.array(y)) for c, y in chains]
        square, square_move, square_start = np.full(self.weight.shape, 1e-6, np.float32), np.full(self.move.shape, 1e-6), np.full(self.start.shape, 1e-6)
        labels = len(self.labels)
        rng = np.random.default_rng(7)
        for _ in range(rounds):
            for some in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // STEP)):
                lengths = np.array([len(coded[i][0]) for i in some])
                used, index = np.unique(np.concatenate([coded[i][0] for i in some]), return_inverse=True)
                slots = np.concatenate([flat[begin[u] : begin[u] + counts[u]] for u in used])
                owner = np.repeat(np.arange(len(used)), counts[used])
                value = np.stack([np.bincount(owner, self.weight[slots, k], len(used)) for k in range(labels)], axis=1)
                mask = np.arange(lengths.max())[None] < lengths[:, None]
                e = np.zeros((*mask.shape, labels))
                e[mask] = value[index]
                post, moves = forward_backward(e, lengths, self.move, self.start)
                truth = np.zeros(mask.shape, np.int64)
                truth[mask] = np.concatenate([coded[i][1] for i in some])
                off = post[mask]
                off[np.arange(len(off)), truth[mask]] -= 1
                by_word = np.stack([np.bincount(index, off[:, k], len(used)) for k in range(labels)], axis=1)
                each, at = np.unique(slots, return_inverse=True)
                g = np.stack([np.bincount(at, by_word[owner, k], len(each)) for k in range(labels)], axis=1) / len(some) + NORM * self.weight[each]
                square[each] += g**2
                self.weight[each] -= 0.1 * g / np.sqrt(square[each])
                seen, inner = np.zeros_like(self.move), mask[:, 1:]
                np.add.at(seen, (truth[:, :-1][inner], truth[:, 1:][inner]), 1)
                g = (moves - seen) / len(some) + 0.01 * self.move
                square_move += g**2
                self.move -= 0.1 * g / np.sqrt(square_move)
                g = (post[:, 0].sum(0) - np.bincount(truth[:, 0], minlength=labels)) / len(some) + 0.01 * self.start
                square_start += g**2
                self.start -= 0.1 * g / np.sqrt(square_start)
        self.clear()

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its most likely language and that one's probability."""
        chain = _LETTERS.findall(text.lower())
        if not chain or not self.labels:
            return [(w, "und", 0.0) for w in chain]
        post = marginals(self.emissions(chain)[None], np.array([len(chain)]), self.move, self.start)[0]
        return [(w, self.labels[k], float(p[k])) for w, p, k in zip(chain, post, post.argmax(1).tolist())]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        chains = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.labels:
            return out
        lengths = np.fromiter(map(len, chains), np.int64, len(chains))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        at, most = 0, min(400_000, 64 * 400_000 // len(self.labels))
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 256 and (end + 1 - at) * lengths[order[end]] <= most:
                end += 1
            some = order[at:end]
            e = np.zeros((len(some), int(lengths[some[-1]]), len(self.labels)), np.float32)
            mask = np.arange(e.shape[1])[None] < lengths[some][:, None]
            e[mask] = self.emissions([w for i in some for w in chains[i]])
            post = marginals(e, lengths[some], self.move, self.start)
            mean = (post * mask[:, :, None]).sum(1, dtype=np.float64) / lengths[some][:, None]
            for i, m in zip(some.tolist(), mean):
                k = int(m.argmax())
                out[i] = (self.labels[k], min(1.0, float(m[k])))
            at = end
        return out


def spliced(pieces: list[tuple[list[str], int]]) -> list[tuple[list[str], list[int]]]:
    """Chains with a label for each word: the pieces as they are, and for each piece one that goes over into, and maybe
    back from, a piece in another language."""
    rng = np.random.default_rng(13)
    out = [(c, [y] * len(c)) for c, y in pieces]
    others = {k: [i for i, (_, y) in enumerate(pieces) if y != k] for k in {y for _, y in pieces}}
    for c, y in pieces:
        if not others[y]:
            continue
        d, z = pieces[others[y][rng.integers(len(others[y]))]]
        a, b = np.sort(rng.integers(0, len(c) + 1, 2)).tolist()
        begin = int(rng.integers(len(d)))
        inner = d[begin : begin + 1 + int(rng.integers(PIECE // 2))]
        tail = c[b:] if rng.random() < 0.5 else []
        out.append(((c[:a] + inner + tail)[:PIECE], ([y] * a + [z] * len(inner) + [y] * len(tail))[:PIECE]))
    return out


def fit_model(df: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", docs: int = DOCS) -> Model:
    """From at most ``docs`` labelled documents of each language, at most SAMPLE in all."""
    ok = F.col(label).isNotNull() & F.col(text).isNotNull()
    labelled = df.filter(ok).select(F.col(id_col).cast("long").alias("i"), F.col(label).alias("l"), F.col(text).alias("t"))
    least = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    names = [r[0] for r in labelled.select("l").distinct().limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of {label}: the classifier has no room for all of them")
    docs = min(docs, max(1, SAMPLE // max(1, len(names))))
    chosen = labelled.select("i", "l").withColumn("k", F.row_number().over(least)).filter(F.col("k") <= docs).select("i").distinct()
    rows = labelled.join(F.broadcast(chosen), "i").select("l", "t").collect()
    labels = sorted({r.l for r in rows})
    texts = [(c, labels.index(r.l)) for r in sorted(rows) if (c := _LETTERS.findall(r.t.lower()))]
    lexicons = []
    for k in range(len(labels)):
        count = Counter(w for c, y in texts if y == k for w in c)
        lexicons.append({w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]})
    chains = spliced([(c[at : at + PIECE], y) for c, y in texts for at in range(0, len(c), PIECE)])
    model = Model(labels, lexicons)
    if chains:
        model.fit(chains)
    return model


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score. The model has a fixed size (SLOTS weights a language) and is broadcast."""
    spark = tuned(df.sparkSession)
    sent, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    base = df.select(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(f"language_id {token}", lambda: sent.value)
        for batch in batches:
            found = m.predict(batch.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return base.mapInArrow(work, extended(base, "lang_pred string, score double"))
