"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly and without the library.

A unit of text is encoded by backtracking. An Aho-Corasick automaton gives, for each position, the pieces that start
there. The longest is tried first; it may follow the piece before it only if merging the two pieces' characters
afresh yields these two pieces again. A position from which no piece fits is remembered in a bitfield and the last
piece is taken back. A sequence in which all neighbours are compatible is the one that the merges produce.

Runs of the space symbol are apart: their pieces all have one score, the lowest, so they merge last, from the left.
Units are cut before a space symbol that follows another character; the model is checked to have no piece across such
a cut. Units repeat, so each worker keeps a bounded table of them.

Null texts count as empty. Extra columns pass through; a column named like an output is replaced. Repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import CACHE_ENTRIES, extended, held, tuned

#: Characters up to which merging looks at all neighbours anew; longer texts keep a heap.
SHORT = 48

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        elif kind == 5:
            value = struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            value = data[at : at + 8]
            at += 8
        yield key >> 3, value


class Units(dict):
    """Text unit -> ids as little-endian 32-bit numbers."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = np.array(self.codec.encode_unit(unit), "<u4").tobytes()
        if len(unit) <= 64:
            self[unit] = out
        return out


class Codec:
    """Reads a model file; encode() and decode() equal those of the library for models without a normaliser."""

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        normalizer: dict[int, object] = {}
        for n, value in _fields(model):
            if n == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif n == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or any(k in (USER,) for _, _, k in pieces):
            raise ValueError("models with a normaliser table or user-defined symbols are not handled")
        self.prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        if self.squeeze:
            raise ValueError("models that remove extra white space are not handled")
        self.score = {p: s for p, s, k in pieces if k == NORMAL}
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unk = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.bos, self.eos = (next((i for i, (p, _, k) in enumerate(pieces) if k == CONTROL and p == x), None) for x in ("<s>", "</s>"))
        runs = [p for p in self.score if len(p) > 1 and set(p) == {SPACE}]
        if any(SPACE in p[1:] for p in self.score if set(p) != {SPACE}):
            raise ValueError("a piece goes past a space symbol")
        top = max((self.score[p] for p in runs), default=None)
        if top is not None and top >= min((s for p, s in self.score.items() if len(p) > 1 and p not in set(runs)), default=0.0):
            raise ValueError("runs of the space symbol do not merge last")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if p not in set(runs):
                self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.alone: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text = [b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.is_byte = np.array([k == BYTE for _, _, k in pieces])
        self.kinds = [k for _, _, k in pieces]
        self.units = Units(self)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: best score first, then from the left."""
        n = len(text)
        if n <= SHORT:
            get, none = self.score.get, float("-inf")
            parts = list(text)
            scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            while scores and (best := max(scores)) != none:
                i = scores.index(best)
                parts[i] += parts.pop(i + 1)
                del scores[i]
                if i:
                    scores[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(scores):
                    scores[i] = get(parts[i] + parts[i + 1], none)
            return parts
        sym: list[str | None] = list(text)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n:
                s = self.score.get(both := sym[i] + sym[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, both, j))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if sym[i] is None or nxt[i] != j or j >= n or sym[j] is None or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(prv[i], i)
            push(i, nxt[i])
        return [s for s in sym if s is not None]

    def compatible(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= 2 * CACHE_ENTRIES:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def reachable(self, a: str) -> bool:
        found = self.alone.get(a)
        if found is None:
            found = self.alone[a] = self.merged(a) == [a]
        return found

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a text without runs of the space symbol; characters that no piece has stand alone."""
        n, score, pairs, alone = len(text), self.score, self.pairs, self.alone
        longest = [""] * n
        for end, (size, piece) in self.automaton.iter(text):  # matches come shortest first
            longest[end - size + 1] = piece
        out: list[str] = []
        failed = bytearray(n // 8 + 1)
        at, last = 0, None
        p: str | None = longest[0] if n else ""
        while at < n:
            found = None
            while p:
                end = at + len(p)
                if not failed[end >> 3] >> (end & 7) & 1 and p in score:
                    fits = True
                    if len(p) > 1:
                        fits = alone.get(p)
                        fits = self.reachable(p) if fits is None else fits
                    if fits and last is not None and last in score:
                        fits = pairs.get((last, p))
                        fits = self.compatible(last, p) if fits is None else fits
                    if fits:
                        found = p
                        break
                p = p[:-1]
            if found is None and p == "" and text[at] not in score:
                # a character that is no piece stands alone where no longer piece fits
                found = text[at]
            if found is not None:
                out.append(found)
                at, last = at + len(found), found
                p = longest[at] if at < n else ""
            else:
                failed[at >> 3] |= 1 << (at & 7)
                back = out.pop()
                at -= len(back)
                last = out[-1] if out else None
                p = back[:-1] if back in score else None
        return out

    @functools.lru_cache(maxsize=4096)
    def run(self, n: int) -> list[int]:
        """Ids of n space symbols in a row that no other piece takes."""
        return [self.id[p] for p in self.merged(SPACE * n)]

    def encode_unit(self, unit: str) -> list[int]:
        body = unit.lstrip(SPACE)
        k = len(unit) - len(body)
        pieces = self.backtracked((SPACE if k else "") + body) if body else []
        if body and k and pieces[0] != SPACE:
            k -= 1
        elif body and k:
            pieces = pieces[1:]
        ids = list(self.run(k)) if k else []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in p.encode()]
            else:
                ids.append(self.unk)
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.prefix:
            text = " " + text
        found = _UNIT.findall(text.replace(" ", SPACE))
        return b"".join(map(self.units.__getitem__, found))

    def encode(self, text: str, ends: bool = False) -> list[int]:
        ids = np.frombuffer(self.encode_packed(text), "<u4").tolist()
        return [self.bos, *ids, self.eos] if ends else ids

    def decode_packed(self, ids: bytes) -> str:
        """The text of packed ids: control ids give nothing, the space that encoding put in front goes again, runs of
        byte pieces are read as UTF-8, and each byte that isn't part of a character becomes U+FFFD."""
        flat = np.frombuffer(ids, "<u4")
        found = b"".join(map(self.text.__getitem__, flat.tolist()))
        lead = next((i for i in flat[:4].tolist() if self.kinds[i] != CONTROL), None)
        if self.prefix and lead is not None and self.kinds[lead] == NORMAL and found.startswith(b" "):
            found = found[1:]
        try:
            return found.decode()
        except UnicodeDecodeError:
            return self._decode_slowly(flat.tolist())

    def _decode_slowly(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.text[i]
                first = False
                continue
            flush()
            if self.kinds[i] == CONTROL:
                continue
            text = self.text[i].decode()
            out.append(text[1:] if first and self.prefix and self.kinds[i] == NORMAL and text.startswith(" ") else text)
            first = False
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.array(ids, "<u4").tobytes())


_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
def codec(model: bytes) -> Codec:
    """One codec in a worker."""
    return held(f"sentencepiece {hash(model)}", lambda: Codec(model))


def encode_documents(df: DataFrame, model_path: str, text: str = "text", ends: bool = True) -> DataFrame:
    """Adds ``ids_packed`` (binary: ids as little-endian unsigned 32-bit numbers, with begin and end ids if asked for),
    ``n_tokens`` and ``decoded_text``, which is decoded from those ids. The model file is read on the driver (half a
    MB) and goes out with the tasks."""
    tuned(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    sent = df.sparkSession.sparkContext.broadcast(model)
    new = ("ids_packed", "n_tokens", "decoded_text")
    names = [c for c in df.columns if c not in new]
    base = df.select(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        head, tail = (struct.pack("<I", i) if ends and i is not None else b"" for i in (c.bos, c.eos))
        for batch in batches:
            at = 0
            texts = batch.column(names.index(text))
            while at < batch.num_rows:
                ids, decoded, size, begin = [], [], 0, at
                while at < batch.num_rows and size < 1 << 23:
                    packed = head + c.encode_packed(texts[at].as_py() or "") + tail
                    ids.append(packed)
                    decoded.append(c.decode_packed(packed))
                    size += len(packed)
                    at += 1
                part = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())], names=[*names, *new])

    schema = extended(base, "ids_packed binary, n_tokens long, decoded_text string")
    return base.mapInArrow(work, schema)
