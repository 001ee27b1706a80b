"""Each corpus operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import math
import os
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from granary.llm import common, fingerprints, groups, html_extraction, jaccard_join, language_id, language_model, media, packing, sentencepiece_codec, substring_dedup, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
EDGES = "doc_id long, text string, n_words string, component_id string, score string, n_tokens string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with exact and near copies, shared passages, empty and null texts."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 120))) for i in range(120)]
    passage = prose(rng, 40)
    rows += [(200 + i, prose(rng, 15) + "\n" + passage + " " + prose(rng, 10)) for i in range(25)]
    for i in range(40):
        words = rows[i][1].split()
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
        rows.append((300 + i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "One"), (404, "one"), (405, rows[0][1].upper()), (406, "x " * 30000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows alike, a doc_id twice, a null doc_id, and columns named like outputs."""
    long = "a b c d e f " * 9
    rows = [(1, long, "p", "q", "r", "s"), (1, long, "p", "q", "r", "s"), (2, None, None, None, None, None), (None, long, "p", None, "r", "s"), (4, "", "x", "y", "z", "s"), (5, "Ünïcode ​ 文 \x00", "x", "y", "z", "s")]
    return spark.createDataFrame(rows, EDGES)


# --- 1 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return sentencepiece_codec.Codec(f.read())


def test_encoding_and_decoding_equal_the_library(codec):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    letters = " " * 6 + "\t\n" + "etaoinshrdlu" * 3 + "ABC0123.,;:!?-_=*#<>/éèçßüñ▁中文日本🤖\x00\x7f̀�"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text, ends=True) == ids
        assert codec.decode(ids) == library.decode(ids)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_compatible_neighbours_are_those_that_merge_so(codec):
    assert codec.merged("▁the") == ["▁the"]
    assert codec.compatible("▁hello"[:3], "llo") == (codec.merged("▁hello") == ["▁he", "llo"])
    assert codec.backtracked("▁hello") == codec.merged("▁hello")


def test_encoded_documents(spark, odd):
    out = sentencepiece_codec.encode_documents(odd, public_tokenizers.path("piece_bpe_32k.model"))
    rows = out.collect()
    assert len(rows) == 6 and out.columns.count("n_tokens") == 1
    assert [r.n_tokens for r in rows if r.text is None] == [2]
    assert all(r.decoded_text == (r.text or "") for r in rows)
    assert sentencepiece_codec.encode_documents(odd.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# --- 2 -------------------------------------------------------------------------------------------------------------


def repeats(rows, w):
    first, out = {}, {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        for p in range(len(words) - w + 1):
            first.setdefault(tuple(words[p : p + w]), (i, p))
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - w + 1):
            if first[tuple(words[p : p + w])] < (i, p):
                gone[p : p + w] = [True] * w
        out[i] = (len(words), sum(gone), b" ".join(x for x, g in zip(words, gone) if not g).decode())
    return out


@pytest.mark.parametrize("window", [20, 4])
def test_repeats_equal_brute_force(docs, corpus, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, window=window).collect()}
    assert got == repeats(corpus, window)


@pytest.mark.parametrize("group,held,block", [(3, 12_000_000, 3 << 20), (3, 400, 300), (100_000, 400, 300), (0, 50, 2000)])
def test_long_prefixes_split_groups(docs, corpus, monkeypatch, group, held, block):
    for name, value in (("GROUP", group), ("HELD_WORDS", held), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(substring_dedup, name, value)
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {i: v[1:] for i, v in repeats(corpus, 20).items()}


def test_nodes_of_a_tree_are_the_equal_windows():
    rng = np.random.default_rng(3)
    window, many = 12, rng.integers(1, 4, 60)
    before = np.array([rng.integers(n - 1, 3) for n in many])
    length = many + window - 1
    begin = np.cumsum(length) - length
    words = rng.integers(0, 2, length.sum()).astype(np.int32)
    anchor = np.array([1, 0] * 5)
    for b, n in zip(begin, before):
        words[b + n : b + n + 10] = anchor
    leaf, at = substring_dedup.repeated_windows(words, begin, many, before, np.arange(60), window)
    seen, want = {}, set()
    for i in range(60):
        for w in range(many[i]):
            key = (before[i] - w, *words[begin[i] + w : begin[i] + w + window].tolist())
            if seen.setdefault(key, i) != i:
                want.add((i, w))
    assert set(zip(leaf.tolist(), at.tolist())) == want and want


def test_repeats_are_the_spans_of_what_is_removed(docs, corpus):
    words = {i: (t or "").encode().split() for i, t in corpus}
    for r in substring_dedup.remove_repeats(docs).collect():
        kept = list(words[r.doc_id])
        for x in reversed(r.repeats):
            del kept[x.start : x.start + x.length]
        assert b" ".join(kept).decode() == r.kept_text and sum(x.length for x in r.repeats) == r.n_removed


@pytest.mark.parametrize("block", [7, 3 << 20])
def test_rows_alike_in_other_slices_are_one_document(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rng = random.Random(12)
    once, twice = prose(rng, 50), " ".join([prose(rng, 25)] * 2)
    rows = [(1, once), (1, once), (1, once), (2, prose(rng, 30)), (3, twice), (3, twice), (4, once), (4, once)]
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (1, 0), (2, 0), (3, 25), (3, 25), (4, 50), (4, 50)]


def test_long_rows_alike_keep_their_words(spark):
    """Each fills a slice of its own."""
    rng = random.Random(13)
    long = " ".join(f"w{rng.randrange(10**6):06d}" for _ in range(450_000))
    rows = [(1, long), (1, long), (2, prose(rng, 30))]
    assert len(long) > substring_dedup.BLOCK_BYTES
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 450_000, 0), (1, 450_000, 0), (2, 30, 0)]


def test_repeats_of_odd_rows(odd):
    rows = substring_dedup.remove_repeats(odd, window=6).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert by[None].n_removed == 48 and by[None].kept_text == "a b c d e f"  # null comes first, so it keeps one round
    assert by[1].n_removed == 54 and [r.n_removed for r in rows if r.doc_id == 1] == [54, 54]
    assert by[2].n_words == 0 and by[2].kept_text == "" and by[4].n_words == 0
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


# --- 3 -------------------------------------------------------------------------------------------------------------


def linked(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    full = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(full):
        for b in full[:k]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,num,heavy,block", [(3, 90, 15, 1000), (5, 80, 15, 1000), (5, 80, 3, 7), (1, 70, 4, 1000)])
def test_components_equal_brute_force(docs, corpus, monkeypatch, n, num, heavy, block):
    monkeypatch.setattr(jaccard_join, "HEAVY", (3000, heavy, 40))
    monkeypatch.setattr(groups, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.shingle_components(docs, n=n, num=num).collect()}
    assert got == linked(corpus, n, num, 100)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        for size in (1, 2, 5, 9, 10, 19, 37, 120, 700):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            most = int((den - num) / (den + num) * 2 * len(a))
            for h in range(0, most // 2 + 1, max(1, most // 6)):
                b = np.unique(np.concatenate([a[h:], rng.integers(0, 2**63, h).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if den * both >= num * (len(a) + len(b) - both):
                    heavy = np.sort(rng.choice(a, len(a) // 2, replace=False))
                    x, y = (set(jaccard_join.signatures(s, np.array([0, len(s)]), num, den, heavy)[0].tolist()) for s in (a, b))
                    assert x & y


def test_sets_are_signed_alike_together_and_alone():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 8, 60, 61, 400)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig, who, digests = jaccard_join.signatures(np.concatenate(sets), starts, 80, 100)
    for i, s in enumerate(sets):
        one, _, told = jaccard_join.signatures(s, np.array([0, len(s)]), 80, 100)
        assert sorted(one.tolist()) == sorted(sig[who == i].tolist())
        assert [x[1:] for x in told] == [x[1:] for x in digests if x[0] == i]


def test_large_groups_are_compared_beyond_their_hub(spark, monkeypatch):
    """A chain of near copies: hardly any is like the hub, and blocks hold a few documents each."""
    monkeypatch.setattr(groups, "BLOCK", 3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(24):
        rows.append((i * 7 % 24, " ".join(words)))
        words[i * 2], words[i * 2 + 1] = f"x{i}", f"y{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.shingle_components(df, n=1, num=85).collect()}
    assert got == linked(sorted(rows), 1, 85, 100) and len({c for _, c in got.values()}) == 1


def test_components_of_odd_rows(odd):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == 6
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 2), (None, None), (4, 4), (5, 5)}
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# --- 4 -------------------------------------------------------------------------------------------------------------


def test_fingerprints_of_edits(docs, corpus):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    rows = [(i, t or "") for i, t in sorted(corpus)]
    near = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_text == t[: len(t) - half] + after[:half]
        assert got[i].sketch == sorted(set(got[i].sketch)) and got[i].next_sketch == got[rows[(k + 1) % len(rows)][0]].sketch
        near.append(len(got[i].sketch))
    assert max(near) <= fingerprints.K


def test_sketches_equal_brute_force(docs, corpus):
    def chained(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed=seed)
        return seed - 2**64 if seed >= 2**63 else seed

    def sketch(t):
        h = [chained([w.encode()]) for w in t.lower().split()]
        n = fingerprints.SHINGLE
        each = {chained(h[i : i + n]) for i in range(len(h) - n + 1)} if len(h) >= n else {few(h)} if h else set()
        return sorted(each)[: fingerprints.K]

    def few(h):
        seed = xxhash.xxh64_intdigest(("[" + ", ".join(map(str, h)) + "]").encode(), seed=42)
        seed = xxhash.xxh64_intdigest(struct.pack("<i", 4099), seed=seed)
        return seed - 2**64 if seed >= 2**63 else seed

    def near(a, b):
        least = sorted(set(a) | set(b))[: fingerprints.K]
        return 1.0 if not a and not b else len(set(a) & set(b) & set(least)) / len(least)

    rows = sorted((i, t or "") for i, t in corpus)
    own = {i: sketch(t) for i, t in rows}
    out = fingerprints.fingerprint_edits(docs)
    got = {r.doc_id: r for r in out.select("*", fingerprints.resemblance(out["sketch"], out["edited_sketch"]).alias("near_edited"), fingerprints.resemblance(out["sketch"], out["next_sketch"]).alias("near_next")).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        assert got[i].sketch == own[i]
        assert got[i].near_edited == near(own[i], sketch(t[: len(t) - half] + after[1][:half])) and got[i].near_next == near(own[i], own[after[0]])


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    left = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    right = left[:1000] + [f"v{rng.randrange(10**6)}" for _ in range(500)]
    df = spark.createDataFrame([(" ".join(left), " ".join(right), " ".join(left + ["#"] + right), "")], "a string, b string, c string, e string")
    for c in "abce":
        df = fingerprints.with_sketch(df, c, f"s{c}")
    x = df.select(
        fingerprints.resemblance(F.col("sa"), F.col("sb")).alias("r"), fingerprints.containment(F.col("sa"), F.col("sb")).alias("c"), fingerprints.distinct_shingles(F.col("sa")).alias("n"),
        fingerprints.resemblance(F.col("se"), F.col("se")).alias("e"), fingerprints.resemblance(F.col("se"), F.col("sa")).alias("z"),
        F.size(F.array_except(fingerprints.merged(F.col("sa"), F.col("sb")), F.array_union("sa", "sb"))).alias("m"), fingerprints.as_text(F.col("sa")).alias("t"),
    ).first()
    assert abs(x.r - 0.5) < 0.15 and abs(x.c - 0.667) < 0.2 and abs(x.n / 1496 - 1) < 0.3
    assert (x.e, x.z, x.m) == (1.0, 0.0, 0) and re.fullmatch("[0-9A-F]{2048}", x.t)


def test_fingerprints_are_native_and_take_odd_rows(odd):
    out = fingerprints.fingerprint_edits(odd)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    rows = out.collect()
    assert len(rows) == 6 and {r.n_chars for r in rows if r.doc_id in (2, 4)} == {0}
    assert out.limit(0).count() == 0 and fingerprints.fingerprint_edits(odd.limit(0)).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------------


def test_packing_fills_sequences(docs, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=128).collect()
    by, places = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in corpus:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in pieces] == [(a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes())) for a in range(0, len(ids), 128)]
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 128
    total = sum(r.length for r in rows)
    assert len(places) <= math.ceil(total / 128) * 1.03 + 1


def test_chunks_are_encoded_as_the_whole_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, chunks = Tokenizer.from_file(path), packing.ChunkIds(path)
    rng = random.Random(6)
    letters = [*"abcdefgh'strvemld ABCÉéß0123.,;!?-_<|endoftext|> ̀́ 　\t\nİΣς中文🤖ñn̈\x1c\x85 HTWŸ̱̊", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|", "|>", "J̌", "H̱."]
    for _ in range(10_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(packing.packed_ids(t.encode(), chunks), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids + [0]


def test_words_are_remembered_once_however_they_are_written():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, chunks = Tokenizer.from_file(path), packing.ChunkIds(path)
    t = "Word word, WORD. word*** (word) Word&&&, word 's Été, été*** été. "
    packing.packed_ids(t.encode(), chunks)
    assert not {b"word,", b"Word", b"WORD.", b"word***", b"word&&&,"} & set(chunks) and b"word" in chunks
    rng = random.Random(9)
    letters = [*"abHTIDLsé.,;!?*&_'0²½ΣİßÅ\u0958\u0931\u093c\u0301\u0331\u212a\u037e\u1161ᄀ… \n\t\x1c\x85", ",***", " ", " ", "'s", "'LL", "<|", "<|endoftext|>"]
    for _ in range(20_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        assert np.frombuffer(packing.packed_ids(t.encode(), chunks), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids + [0], ascii(t)


def test_plans_place_every_piece():
    rng = random.Random(8)
    for trial in range(40):
        counts = {rng.randint(1, 2048 if trial % 2 else 300): rng.randint(1, 60) for _ in range(rng.randint(1, 200))}
        runs, bins = packing.plan(counts, 2048)
        fill, placed = {}, Counter()
        for length, first, n, sequence, offset in runs:
            assert placed[length] == first
            placed[length] += n
            for i in range(n):
                fill.setdefault(sequence + i, []).append((offset, length))
        assert placed == Counter(counts) and set(fill) == set(range(bins))
        for spans in fill.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end
                end += length
            assert end <= 2048
    assert packing.plan({}, 2048) == ([], 0)


def test_packing_of_odd_rows(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path).collect()
    assert len(rows) == 6 and len({r.sequence_id for r in rows}) == 1
    assert packing.pack_documents(odd.limit(0), path).count() == 0


# --- 6 -------------------------------------------------------------------------------------------------------------


class PlainModel:
    """The model from counts that are held exactly, as the module's docstring states it."""

    def __init__(self, rows):
        self.tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
        self.learn = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in self.tokens}
        self.c = Counter(w for i, ws in self.tokens.items() if self.learn[i] for w in ws)
        self.pairs = Counter(x for i, ws in self.tokens.items() if self.learn[i] for x in zip([None, *ws], ws))
        self.n, self.v = sum(self.c.values()), len(self.c)
        fits = [sum(math.log10(self.p(h, w, way, 1)) for i, ws in self.tokens.items() if self.learn[i] for h, w in zip([None, *ws], ws)) for way in language_model.GRID]
        self.best = language_model.GRID[fits.index(max(fits))]

    def p(self, h, w, way, less=0, steps=True):
        a, b, d = way
        q = self.pairs[h, w]
        if steps and q:
            q = max(x for x in (1, *(x for k in range(1, 20) for x in (2**k, 3 * 2 ** (k - 1)))) if x <= q)
        history, q = max(self.c[h] - less, 0), max(q - less, 0)
        single = max(self.c[w], 1) / (self.n + self.v) if less else (self.c[w] + 1) / (self.n + self.v + 1)
        lam = a * history / (history + b)
        return lam * max(q - d, 0) / max(history, 1) + (1 - lam) * single

    def score(self, i, steps=True):
        return sum(math.log10(self.p(h, w, self.best, steps=steps)) for h, w in zip([None, *self.tokens[i]], self.tokens[i]))


def test_scores_equal_a_model_of_plain_counts(docs, corpus):
    m = PlainModel(corpus)
    got = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    assert set(got) == set(m.tokens)
    for i, ws in m.tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not m.learn[i], len(ws), sum(m.c[w] > 0 for w in ws), m.n)
        assert math.isclose(r.base_score, sum(math.log10((m.c[w] + 1) / (m.n + m.v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, m.score(i), rel_tol=1e-9)
        # a level stands for its least count, so a pair's share is lowered by a third at most
        assert m.score(i, steps=False) + len(ws) * math.log10(2 / 3) - 1e-9 <= r.score <= m.score(i, steps=False) + 1e-9


def test_probabilities_sum_to_at_most_one(corpus):
    m = PlainModel(corpus)
    for way in language_model.GRID:
        for h in m.c:
            assert sum(m.p(h, w, way) for w in [*m.c, "unknown"]) <= 1 + 1e-9
    pair, history, single = np.array([0.0, 3.0, 64.0]), np.array([0.0, 9.0, 100.0]), np.array([0.1, 0.2, 0.3])
    for a, b, d in language_model.GRID:
        lam = a * history / (history + b)
        want = lam * np.maximum(pair - d, 0) / np.maximum(history, 1) + (1 - lam) * single
        assert np.allclose(language_model.probability(pair, history, single, a, b, d), want)


def test_the_model_is_better_on_held_out_texts(spark):
    rng = random.Random(3)
    after = {w: rng.sample(WORDS, 4) for w in WORDS}
    rows = []
    for i in range(300):
        words = [rng.choice(WORDS)]
        while len(words) < 60:
            words.append(rng.choice(after[words[-1]]))
        rows.append((i, " ".join(words)))
    got = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


def test_filters_hold_quantised_counts():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.integers(1, 40, len(pairs))
    key = (pairs << np.uint64(8)) >> np.uint64(16)
    part = language_model._parts(pairs, 3)
    shards = language_model.Shards({p: language_model._filter(key[part == p], counts[part == p]) for p in range(3)}, 3)
    found = shards.counts(pairs)
    assert (found >= language_model.LOWER[language_model._levels(counts)]).all()
    assert (language_model.LOWER[language_model._levels(np.array([0, 1, 2, 3, 4, 5, 6, 7, 11, 12]))] == [0, 1, 2, 3, 4, 4, 6, 6, 8, 12]).all()
    assert (shards.counts(rng.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.12


def test_every_training_pair_is_answered_where_it_meets():
    """Shards answer for pairs of any count, with no bound over all of them, also for pairs of held out texts."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 40) + f" once{i} twice{i // 2}") for i in range(60)]
    tables = [pa.table({"doc_id": [i for i, _ in some], "text": [t for _, t in some], "chunk": pa.array([k] * len(some), pa.int32())}) for k, some in enumerate((rows[:25], rows[25:]))]
    sent = [language_model._count(t, 3, 7, 2) for t in tables]
    met = pa.Table.from_batches(list(language_model._meet(b for t in sent for b in t.to_batches())))
    true = Counter()
    for t in tables:
        tokens, counts = language_model._tokens(common.as_bytes(t.column("text")))
        learn = np.repeat(language_model.trains(t.column("doc_id").to_pylist(), 7, 2), counts)
        true.update(language_model._pairs(tokens, counts)[learn].tolist())
    assert 1 in true.values() and max(true.values()) > 3
    for k, t in enumerate(tables):
        pairs = np.unique(language_model._pairs(*language_model._tokens(common.as_bytes(t.column("text")))))
        got = language_model._answered(met.filter(pc.equal(met["chunk"], k)), "b", np.uint8, len(pairs))
        assert (got == language_model._levels(np.array([true[x] for x in pairs.tolist()]))).all()
        with pytest.raises(ValueError):
            language_model._answered(met.slice(0, 0), "b", np.uint8, len(pairs))


def test_scores_of_odd_rows(odd):
    rows = language_model.score_documents(odd).collect()
    assert len(rows) == 6 and {r.n_tokens for r in rows if r.doc_id in (2, 4)} == {1}
    assert language_model.score_documents(odd.limit(0)).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    rng = random.Random(2)
    html = [prose(rng, rng.randint(0, 400)) for _ in range(30)]
    rows = [(i, f"http://x.test/{i} y", html[i % 30]) for i in range(80)] + [(100, None, None), (101, "u", ""), (102, "u", "é" * 600), (103, "v", "é" * 600), (104, "w", "é" * 400), (105, "w", "é" * 400)]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), i)
    for i, u, h in rows:
        payload, r = (h or "").encode(), got[i]
        other = best[h or ""] if len(payload) >= 1000 and best[h or ""] != i else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), hashlib.sha1(payload).hexdigest(), "response" if other is None else "revisit", other)
        assert r.target_uri == warc._clean(u) and r.date == "2024-01-01T00:00:00Z"
        # what a revisit refers to is the id of a record that is there
        assert r.refers_to_id == (None if other is None else got[other].record_id)


def _exchanged(plan):
    """The columns that each exchange of a physical plan moves."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from _exchanged(plan.executedPlan())
        return
    if "Exchange" in plan.nodeName():
        yield [plan.output().apply(i).name() for i in range(plan.output().size())]
    for i in range(plan.children().size()):
        yield from _exchanged(plan.children().apply(i))


def test_archives_stay_where_they_are(spark, monkeypatch):
    """No content of an archive is shuffled, only what is known of records; what is superseded is deleted."""
    seen, settle = [], warc.settle
    monkeypatch.setattr(warc, "settle", lambda df: seen.append(df) or settle(df))
    tables = spark.catalog.listTables()
    rows = [(i, f"http://x.test/{i}", f"{i // 2} " * 600) for i in range(40)]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    moved = [names for df in (*seen, out) for names in _exchanged(df._jdf.queryExecution().executedPlan())]
    assert any("same" in names for names in moved) and not any("content" in names for names in moved)
    assert sorted((r.page_id, r.refers_to) for r in out.collect()) == [(i, None if i % 2 else i + 1) for i in range(40)]
    assert spark.catalog.listTables() == tables
    read = [x.rsplit("/", 1)[0] for df in seen for x in df.inputFiles()]
    assert read and not any(os.path.exists(x.removeprefix("file:")) for x in read)


def test_archives_of_odd_pages(spark):
    big, long = "x" * 1200, "y z " * 300_000
    rows = [(1, "u", big, "a"), (1, "u", big, "a"), (0, "v", big, None), (None, "w", big, "a"), (None, None, None, "a"), (9, "z", long, "b"), (8, None, long, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(df, strict=True).collect())
    want = [("1", 1200, "response", None)] * 2 + [("0", 1200, "revisit", 1), ("None", 1200, "response", None), ("None", 0, "response", None), ("9", len(long), "response", None), ("8", len(long), "revisit", 9)]
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], str(x[3])))


def test_damage_is_counted_and_reading_goes_on(spark):
    records = [warc.arc_record(1, f"http://a/{i}", "20240101000000", "text/html", warc.http_block(i, b"body %d" % i)) for i in range(4)]
    head = warc.version_block(1, "a.arc", "20240101000000")
    plain = head + records[0] + b"some garbage\n" + records[1] + records[2][:60] + b"\n" + records[3]
    gz = [warc.gzipped(x) for x in (head, *records)]
    broken = bytearray(gz[2])
    broken[len(broken) // 2] ^= 0xFF
    packed = gz[0] + gz[1] + bytes(broken) + gz[3] + gz[4][:-5]
    arcs = spark.createDataFrame([("p", bytearray(plain)), ("g", bytearray(packed))], "archive string, content binary")
    out = {r.archive: r for r in warc.arc_to_warc(arcs).collect()}
    assert out["p.warc.gz"].damaged >= len(b"some garbage\n") and out["g.warc.gz"].damaged >= len(broken)
    back = warc.read_warc(spark.createDataFrame(list(out.values()))).collect()
    assert {(r.archive, r.page_id) for r in back} >= {("p.warc.gz", 0), ("p.warc.gz", 1), ("g.warc.gz", 0), ("g.warc.gz", 2)}
    whole = bytearray(out["g.warc.gz"].content)
    whole[-20:] = b"?" * 20
    df = spark.createDataFrame([("w", whole)], "archive string, content binary")
    rows = warc.read_warc(df).collect()
    assert [r.page_id for r in rows if not r.damaged] == [0] and sum(r.damaged for r in rows) > 0
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(df, strict=True).collect()


def test_foreign_records_are_read(spark):
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: none\r\n\r\n"
    data = warc.warc_record({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Payload-Digest": "md5:abc", "WARC-Refers-To": "<urn:uuid:2>"}, block)
    (r,) = warc.resolved(warc.read_warc(spark.createDataFrame([("f", bytearray(data))], "archive string, content binary"))).collect()
    assert (r.record_type, r.page_id, r.payload_bytes, r.payload_digest, r.refers_to_id, r.refers_to) == ("revisit", None, None, None, "<urn:uuid:2>", None)


def test_records_that_refer_to_none_are_dealt_out(spark):
    named = [("a", "response", str(i), None, None, i, 5, "d", None, 0, None) for i in range(400)]
    rows = [*named, ("a", "revisit", "r", None, None, 900, None, None, "7", 0, None), ("a", "revisit", "s", None, None, 901, 6, "e", "x", 0, None), ("a", *[None] * 8, 3, None)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        out = warc.resolved(spark.createDataFrame(rows, warc._RECORD)).selectExpr("*", "spark_partition_id() AS part").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    parts = [r.part for r in out if r.refers_to_id is None]
    assert len(out) == 403 and max(map(parts.count, set(parts))) < 200
    # none of their numbers is taken for the id of a record
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in out if r.refers_to_id or r.damaged} == {900: (5, "d", 7), 901: (6, "e", None), None: (None, None, None)}
    assert not any(r.refers_to for r in out if r.refers_to_id is None)


def test_both_arc_versions_convert():
    for version in (1, 2):
        block = warc.http_block(5, b"hello\r\n\r\nthere")
        data = warc.version_block(version, "a.arc", "20240203") + warc.arc_record(version, "http://a b/c", "20240203040506", "text/html", block) + warc.arc_record(version, "dns:x", "2023", "text/dns", b"1.2.3.4")
        found = [warc.convert(h, b) for h, b in warc.read_arc(data)]
        assert [f["WARC-Type"] for f, _ in found] == ["warcinfo", "response", "resource"]
        response, dns = found[1], found[2]
        assert response[1] == block and response[0]["WARC-Date"] == "2024-02-03T04:05:06Z" and dns[0]["WARC-Date"] == "2023-01-01T00:00:00Z"
        assert response[0]["WARC-Payload-Digest"] == warc.digest(b"hello\r\n\r\nthere") and dns[0]["WARC-Payload-Digest"] == warc.digest(b"1.2.3.4")
        assert found == [warc.convert(h, b) for h, b in warc.read_arc(data)]  # ids are the same again
        archive = b"".join(warc.gzipped(warc.warc_record(*f)) for f in found)
        assert [b for _, b in warc.read_records(archive)] == [b for _, b in found]
        assert [b for _, b in warc.read_records(b"".join(warc.warc_record(*f) for f in found))] == [b for _, b in found]
        assert list(warc.read_records(archive[:-9]))[-1][0] is None
        assert list(warc.read_arc(data[:-3]))[-1][0] is None


def test_an_url_with_blanks_is_read():
    data = b"http://a/b c d 1.1.1.1 20240101000000 text/html 2\nok\n"
    assert next(warc.read_arc(data)) == ({"URL": "http://a/b c d", "IP-address": "1.1.1.1", "Archive-date": "20240101000000", "Content-type": "text/html", "Archive-length": "2"}, b"ok")


def test_archives_of_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string, archive string")).count() == 0


# --- 8 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1000, 5])
def test_copies_are_found_and_others_left(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = []
    for i in range(28):
        image = media.drawn(rng.normal(size=64).tolist())
        rows += [(10 * i, media.write_pgm(image)), (10 * i + 1, media.write_pgm(media.edited(image, i % 7))), (10 * i + 2, media.write_pgm(image))]
    # many edited copies of one picture
    rows += [(500 + k, media.write_pgm(media.edited(media.drawn([k // 14]), k % 7))) for k in range(28)]
    rows += [(1000, None), (1001, None), (1002, b"junk"), (1003, b""), (1004, media.write_pgm(np.zeros((5, 5)))), (1004, b"junk"), (None, b"junk")]
    got = {r.media_id: r.group_id for r in media.copy_groups(spark.createDataFrame(rows, "media_id long, media binary").repartition(3)).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    assert all(got[10 * i + 2] == got[10 * i] for i in range(28))
    assert sum(got[10 * i + 1] == got[10 * i] for i in range(28)) >= 26
    assert all(g // 10 == i // 10 for i, g in got.items() if i < 500)
    assert sum(got[i] == (500 if i < 514 else 514) for i in range(500, 528)) >= 26
    assert [got[i] for i in range(1000, 1005)] == [1000, 1001, 1002, 1003, 1002]
    assert media.copy_groups(spark.createDataFrame([], "media_id long, media binary, n_corners string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_recall_against_the_check_of_all_pairs(spark):
    """Of the pairs that the check accepts: how many have a key in common, for each edit, over pictures of embeddings."""
    vectors = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").select("embedding").distinct().limit(40).collect()]
    of = [media.describe(media.read_pgm(media.write_pgm(media.drawn(v)))) for v in vectors]
    keys = [set(media.table_keys(*f).tolist()) for f in of]
    hit = total = 0
    for kind, name in enumerate(media.EDITS):
        edits = [media.describe(media.read_pgm(media.write_pgm(media.edited(media.drawn(v), kind)))) for v in vectors]
        mine = [set(media.table_keys(*f).tolist()) for f in edits]
        good = [(i, j) for i in range(len(of)) for j in (i, (i + 1) % len(of)) if media.consensus(*of[i], *edits[j]) >= media.INLIERS]
        assert {i for i, j in good if i == j} == {i for i, _ in good} and len(good) >= 0.8 * len(of), name
        found = sum(bool(keys[i] & mine[j]) for i, j in good)
        assert found >= 0.8 * len(good), name
        hit, total = hit + found, total + len(good)
    assert hit >= 0.95 * total


def test_parts_of_large_pictures_are_copies(monkeypatch):
    big = np.concatenate([np.concatenate([media.drawn([i, j], 200) for j in range(3)], axis=1) for i in range(3)])
    whole = media.describe(media.read_pgm(media.write_pgm(big)))
    part = media.describe(media.read_pgm(media.write_pgm(big[250:340, 330:430])))
    assert media.consensus(*part, *whole) >= media.INLIERS and set(media.table_keys(*whole)) & set(media.table_keys(*part))
    # tiles change nothing
    monkeypatch.setattr(media, "TILE", 4 * media.CELL)
    tiled = media.describe(media.read_pgm(media.write_pgm(big)))
    one, other = (sorted(zip(map(tuple, np.round(f[0], 3).tolist()), map(bytes, f[1]))) for f in (whole, tiled))
    assert len(one) == len(other) > 1000 and sum(a == b for a, b in zip(one, other)) >= 0.99 * len(one)


def test_pgm_reads_what_it_writes():
    image = np.arange(35, dtype=np.float32).reshape(5, 7)
    assert (media.read_pgm(media.write_pgm(image)) == image).all()
    assert media.read_pgm(b"P5 9 9 255\n123") is None and media.read_pgm(b"P5 0 9 255\n") is None


# --- 9 -------------------------------------------------------------------------------------------------------------

TONGUES = {"aa": "th he in er an re on at en nd ing ion".split(), "bb": "ê ç eau oux ille qué dré uin".split(), "cc": "sch ung ein ich ß äu ö zt".split()}


def sentence(rng, tongue, n):
    return " ".join("".join(rng.choice(TONGUES[tongue]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages_are_told_on_held_out_texts(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, t := rng.choice(list(TONGUES)), rng.randint(5, 60)), t) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_model(df.filter("doc_id < 400"))
    got = language_id.identify(df.filter("doc_id >= 400"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    mixed = sentence(rng, "aa", 30) + " " + sentence(rng, "bb", 60)
    (label, score), (none, zero), (empty, _) = model.predict([mixed, None, "123 ... !"])
    assert label == "bb" and 0.4 < score < 0.9 and (none, zero, empty) == ("und", 0.0, "und")


def test_switches_of_language_are_learned(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, t := list(TONGUES)[i % 3], 60), t) for i in range(240)]
    model = language_id.fit_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert (np.diag(model.move) > np.where(np.eye(3) > 0, -np.inf, model.move).max(1)).all()
    right = total = 0
    for _ in range(20):
        parts = [(t, sentence(rng, t, rng.randint(8, 25)).split()) for t in rng.sample(list(TONGUES), 3)]
        told = model.words(" ".join(" ".join(w) for _, w in parts))
        want = [t for t, w in parts for _ in w]
        assert len(told) == len(want) and all(0 <= p <= 1 for _, _, p in told)
        right += sum(k == t for (_, k, _), t in zip(told, want))
        total += len(want)
    assert right > 0.95 * total
    # a spliced chain has labels for each word, and whole texts are fitted
    chains = language_id.spliced([(["a"] * 9, 0), (["b"] * 7, 1)])
    assert len(chains) == 4 and all(len(c) == len(y) and all((w == "b") == k for w, k in zip(c, y)) for c, y in chains)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_languages_of_held_out_documents(spark):
    from granary.llm import queries

    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = [r for r in queries.op9_language_id(spark, "/root/testdata/sf0.001").collect() if r.held_out and true[r.doc_id] and r.lang_pred != "und"]
    assert got and sum(r.lang_pred == true[r.doc_id] for r in got) >= 0.98 * len(got)


def test_all_languages_are_learned(spark, monkeypatch):
    names = [f"l{k:02d}" for k in range(70)]
    monkeypatch.setattr(language_id, "SLOTS", 1 << 14)
    letters = {t: chr(0x4E00 + 2 * k) + chr(0x4E01 + 2 * k) for k, t in enumerate(names)}
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice(letters[t]) for _ in range(4)) for _ in range(12)), t) for i, t in enumerate(names * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_model(df)
    assert model.labels == names
    assert [x for x, _ in model.predict([t for _, t, _ in rows[:70]])] == names
    monkeypatch.setattr(language_id, "LANGUAGES", 69)
    with pytest.raises(ValueError):
        language_id.fit_model(df)


def test_long_runs_of_letters_count_whole(spark):
    rng = random.Random(10)
    rows = [(i, sentence(rng, t := ("aa", "cc")[i % 2], 40), t) for i in range(80)]
    model = language_id.fit_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    run = "thering" * 6 + "schungichein" * 40
    assert model.predict([run])[0][0] == "cc"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    e, move, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 2])
    post, _ = language_id.forward_backward(e, lengths, move, start)
    fast = language_id.marginals(e.astype(np.float32), lengths, move, start)
    for n in range(2):
        t = lengths[n]
        want = np.zeros((t, 3))
        for path in np.ndindex(*[3] * t):
            s = start[path[0]] + sum(e[n, i, path[i]] for i in range(t)) + sum(move[path[i], path[i + 1]] for i in range(t - 1))
            for i in range(t):
                want[i, path[i]] += np.exp(s)
        want /= want.sum(1, keepdims=True)
        assert np.allclose(post[n, :t], want) and np.allclose(fast[n, :t], want, atol=1e-4)


def test_languages_of_odd_rows(spark, odd):
    model = language_id.fit_model(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string"))
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == 6 and {r.lang_pred for r in rows} == {"und"} and {r.score for r in rows} == {0.0}


# --- 10 ------------------------------------------------------------------------------------------------------------

PAGES = {
    "article": ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=a>Home</a></li></ul></nav><div class='ad'>Buy, now.</div><article><h1>Head &amp; more</h1><p>First  line,\nwith text.<p>Second <b>bold</b> one.<br>After.</article><footer>&copy; x</footer></body></html>", ["Head & more", "First line, with text.", "Second bold one. After."]),
    "no article": ("<body><header><h1>Site</h1></header><div id=menu><ul><li><a>A</a><li><a>B</a></ul></div><div class='cookie-notice'>We use cookies, ok?</div><div class=content><h1>Title</h1><p>A first paragraph, with some words in it.<ul><li>one, two<li>three</ul><form>Name <input></form><div class=comments><p>A comment, long enough.</p></div></div><aside>Side</aside></body>", ["Title", "A first paragraph, with some words in it.", "one, two", "three"]),
    "script": ("<p>One, two.</p><script>var t='</p><p>no</p>';</script><!-- no --><p>Three &lt;b&gt; &#233;&eacute;.</p>", ["One, two.", "Three <b> éé."]),
    "plain": ("only text, no tags", ["only text, no tags"]),
    "broken": ("<div><p>Open <i>never closed<p>Next one, here.</div></div></span><p>Last, after.", ["Open never closed", "Next one, here.", "Last, after."]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html_extraction.main_text(page) == "\n\n".join(want)


LONG = "".join(f"<p>{'Some words, and more of them. ' * 20}</p>" for _ in range(30))


@pytest.mark.parametrize("page", [
    f"<body><div class=content><h1>Title</h1><p>A lead.</p><div class=body>{LONG}</div></div></body>",
    f"<body><div><h1>Title</h1><p>A lead.</p><ul><li>{LONG}</li></ul></div></body>",
    f"<body><main><h1>Title</h1><article>{LONG}</article><article>A lead.</article></main></body>",
    f"<body><form id=form1><h1><a>Title</a></h1><p>A lead.</p>{LONG}</form></body>",
    f"<body><div class='has sidebar'><h1>Title</h1><p>A lead.</p>{LONG}</div><div class=sidebar>No, not this.</div></body>",
])
def test_short_parts_beside_a_long_text_are_kept(page):
    got = html_extraction.main_text(page).split("\n\n")
    assert {"Title", "A lead."} < set(got) and len(got) == 32


@pytest.mark.parametrize("page,want", [
    ("<div class='legal-text'>This long sentence is the whole of the article, and it goes on, with commas, for quite a while.</div><div>Short.</div>", ["This long sentence is the whole of the article, and it goes on, with commas, for quite a while.", "Short."]),
    ("<xmp><b>raw</b> &amp; text</xmp><p>Some paragraph, here.</p>", ["<b>raw</b> &amp; text", "Some paragraph, here."]),
    (f"<div>{LONG}<ul><li><a>One link</a><li><a>Two link</a></ul></div>", LONG.replace("</p>", "").split("<p>")[1:]),
])
def test_paths_select_blocks(page, want):
    assert html_extraction.main_text(f"<body>{page}</body>").split("\n\n") == [x.strip() for x in want]


@pytest.mark.parametrize("piece", ["<b>", "<p>", "<div>x", "<div class=side>x", '<a "', "<a '\"", "</span>", "<script>", "</script", "<li><div>", "<td>", "<", "&", "<!--", "<b><div></b>"])
def test_reading_takes_linear_time(piece):
    def seconds(n):
        began = time.process_time()
        html_extraction.main_text("<p>Text, one.</p><b><i>" + piece * n)
        return time.process_time() - began

    seconds(100)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.01) and seconds(20_000) < 3


def test_extraction_finds_most_of_the_content_and_little_else():
    """Pages of several layouts with known content."""
    rng = random.Random(12)

    def text(least, most):
        return " ".join(sentence(rng, "aa", rng.randint(6, 14)).capitalize() + rng.choice([".", ", and.", "?"]) for _ in range(rng.randint(least, most)))

    kept = found = right = 0
    for k in range(120):
        title, paragraphs = f"Title {k} of it", [text(2, 6) for _ in range(rng.randint(3, 9))]
        menu = "<ul>" + "".join(f"<li><a href=/{i}>{sentence(rng, 'cc', 1)}</a></li>" for i in range(6)) + "</ul>"
        body = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs)
        around = [f"<nav>{menu}</nav>", f"<div class='menu'>{menu}</div>", f"<div class=x>{menu}</div>"][k % 3]
        extra = [f"<aside>{text(1, 2)}</aside>", f"<div class='cookie-notice'>{text(1, 1)}</div>", f"<div class=ad>{text(1, 1)}</div>", f"<section id=comments><p>{text(1, 4)}</p></section>"][k % 4]
        inner = [f"<article>{body}</article>", f"<div class=post>{body}</div>", f"<main>{body}</main>", f"<div><div class='legal-notes'>{body}</div></div>"][k // 3 % 4]
        got = html_extraction.main_text(f"<html><body><header><p>Site name</p></header>{around}{inner}{extra}<footer>{text(1, 1)}</footer></body></html>").split("\n\n")
        want = [title, *paragraphs]
        kept += len(want)
        found += len(got)
        right += len(set(got) & set(want))
    assert right >= 0.97 * kept and right >= 0.97 * found


def test_extraction_of_odd_pages(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "<p>" * 3000 + "deep", "y"), (4, "<" * 5000, "z"), (5, "<p>é</p>", None)], "page_id long, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extraction.extract(df).collect()]
    assert got[:3] == [(1, "", 0), (1, "", 0), (2, "", 0)] and got[3][1] == "deep" and got[5] == (5, "é", 1)
    assert html_extraction.extract(df.limit(0)).count() == 0
