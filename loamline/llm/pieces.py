"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The model file is read here. A text is normalised, split where no piece can
reach across, and each part is merged by a score-ordered agenda of its adjacent
symbol pairs: the pair with the best score merges first, the leftmost of equal
ones, and the pairs around it enter the agenda. Parts of ordinary length are
merged many at a time, one agenda per row of a matrix; long parts have an agenda
on a heap. Symbols outside the vocabulary become bytes where the model says so.

In every Arrow batch the longest text and a share of the others, taken by a
hash of the text and whatever their length, are also given to the sentencepiece
library; where it differs, it encodes the slice of the batch.

Defined results: a null text is the empty one, which has no ids and decodes to
the empty text; rows that repeat anything are rows of their own; other columns
are ignored; an empty table gives an empty one. Memory is bounded by the longest text and ``CACHED`` parts.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import returning_memory

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Parts that a worker remembers, characters of parts that are merged in a matrix; one text in CHECKED is compared with the library.
CACHED, ROW, CHECKED = 300_000, 48, 64
NONE = np.iinfo(np.int32).max


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints, 4-byte floats and bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[tag & 7]
            value, i = struct.unpack("<d" if n == 8 else "<f", raw[i : i + n])[0], i + n
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model and what merges into what."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces, self.scores, self.types = [], [], []
        for message in (v for k, v in model if k == 1):
            piece = dict(_fields(message))
            self.pieces.append(piece[1].decode())
            self.scores.append(piece.get(2, 0.0))
            self.types.append(piece.get(3, NORMAL))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        rules = dict(_fields(next((v for k, v in model if k == 3), b"")))
        self.prefix = bool(rules.get(3, 1))
        if trainer.get(3, 1) != 2 or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only merge-type models without text normalisation are read")
        if set(self.types) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not read")
        self.unknown = self.types.index(UNKNOWN)
        self.normal = [t == NORMAL for t in self.types]
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.written = [str(i) for i in range(len(self.pieces))]
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.id = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        # single characters that are no pieces may still take part in merges
        single = {c for p in self.id for c in p} - set(self.id)
        self.symbols = self.pieces + sorted(single)
        symbol = self.id | {c: len(self.pieces) + i for i, c in enumerate(sorted(single))}
        self.symbol = symbol
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.id.values()}, reverse=True))}
        merges = [
            (symbol[p[:k]] * len(self.symbols) + symbol[p[k:]], order[self.scores[i]], i)
            for p, i in self.id.items()
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        ]
        merges.sort()
        keys, ranks, made = (np.array(x) for x in zip(*merges, strict=True))
        self.keys, self.ranks, self.made = keys.astype(np.int64), ranks.astype(np.int32), made.astype(np.int32)
        self.merge = {k: (r, m) for k, r, m in merges}
        chars = sorted((ord(c), s) for c, s in symbol.items() if len(c) == 1)
        self.chars, self.char_symbols = (np.array(x) for x in zip(*chars, strict=True))
        crossing = any(MARK in p.lstrip(MARK) for p in self.id)
        lone = "" if any("\n" in p for p in self.id) else "\n"
        self.parts = re.compile(r"(?s).+" if crossing else f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|{lone}" if lone else ""))

    # -- merging ----------------------------------------------------------

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of symbol pairs; rank NONE where nothing comes of them."""
        key = a.astype(np.int64) * len(self.symbols) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.ranks[at], NONE).astype(np.int32), self.made[at]

    def _rows(self, parts: list[str]) -> list[list[int]]:
        """Symbols of parts of up to ROW characters, all merged at once; characters without a symbol are -1 - code point."""
        lengths = np.array([len(p) for p in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == codes, self.char_symbols[at], -1 - codes)
        wide = int(lengths.max())
        ids = np.full((len(parts), wide + 1), np.iinfo(np.int32).min, dtype=np.int32)
        column = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids[np.repeat(np.arange(len(parts)), lengths), column] = symbols
        ranks, made = self._pairs(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * len(parts)
        rows, columns = np.arange(len(parts)), np.arange(wide)
        while len(rows):
            best = ranks.argmin(axis=1)
            alive = ranks[np.arange(len(rows)), best] < NONE
            if not alive.all():
                for r, line, n in zip(rows[~alive], ids[~alive].tolist(), lengths[~alive], strict=True):
                    out[r] = line[:n]
                rows, ids, ranks, made, lengths, best = (x[alive] for x in (rows, ids, ranks, made, lengths, best))
                if not len(rows):
                    break
            every = np.arange(len(rows))
            merged = made[every, best]
            after = columns[None, :] > best[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[every, best] = merged
            # what was right of the merged pair moves up; the two pairs around it are new
            after[every, best] = True
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            made[:, :-1] = np.where(after[:, :-1], made[:, 1:], made[:, :-1])
            ranks[:, -1] = NONE
            lengths = lengths - 1
            ranks[every, best], made[every, best] = self._pairs(merged, ids[every, best + 1])
            left = np.maximum(best - 1, 0)
            has = best > 0
            r, m = self._pairs(ids[every, left], merged)
            ranks[every[has], left[has]], made[every[has], left[has]] = r[has], m[has]
        return out

    def _agenda(self, part: str) -> list[int]:
        """Symbols of one part by an agenda on a heap."""
        ids = [self.symbol.get(c, -1 - ord(c)) for c in part]
        n, width = len(ids), len(self.symbols)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            if i >= 0 and j < n and ids[i] >= 0 and ids[j] >= 0 and (hit := self.merge.get(ids[i] * width + ids[j])):
                heapq.heappush(agenda, (hit[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            enter(i, i + 1)
        gone = [False] * n
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = behind[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], gone[j], behind[i] = self.merge[a * width + b][1], True, behind[j]
            if behind[j] < n:
                before[behind[j]] = i
            enter(before[i], i)
            enter(i, behind[i])
        return [s for s, g in zip(ids, gone, strict=True) if not g]

    def _ids(self, symbols: list[int]) -> list[int]:
        if min(symbols) >= 0 and max(symbols) < len(self.pieces):
            return symbols
        out = []
        for s in symbols:
            if 0 <= s < len(self.pieces):
                out.append(s)
            else:
                char = chr(-1 - s) if s < 0 else self.symbols[s]
                out += [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]
        return out

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for low, top in ((0, 8), (8, 12), (12, 20), (20, ROW)):  # rows of a matrix are of like length
            some = [i for i, p in enumerate(parts) if low < len(p) <= top]
            for at in range(0, len(some), 20_000):
                out |= zip(some[at : at + 20_000], self._rows([parts[i] for i in some[at : at + 20_000]]), strict=True)
        return [self._ids(out[i] if i in out else self._agenda(p)) for i, p in enumerate(parts)]

    # -- texts ------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.parts.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_parts(self.split(text)) for i in part]

    def _plain(self, ids: list[int]) -> str:
        """Text of some ids, with marks as spaces; bytes that are no character become the replacement character."""
        if all(map(self.normal.__getitem__, ids)):
            return "".join(map(self.shown.__getitem__, ids))
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):  # one replacement for each byte that starts no character
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                    except UnicodeDecodeError:
                        continue
                    at += n
                    break
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.types[i] == BYTE:
                run.append(int(self.pieces[i][1:-1], 16))
                continue
            flush()
            if self.types[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.types[i] == NORMAL:
                out.append(self.shown[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._plain(ids)
        first = next((i for i in ids if self.types[i] != CONTROL), self.unknown)
        # the space put before a text goes, where the first piece has it
        return text[1:] if self.prefix and self.types[first] == NORMAL and text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with the parts that it remembers, as ids joined by commas."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known: dict[str, str] = {}
        #: What the ids of a part decode to, where that isn't the part.
        self.other: dict[str, str] = {}

    def learn(self, parts: list[str]) -> None:
        v = self.vocabulary
        for part, ids in zip(parts, v.encode_parts(parts), strict=True):
            self.known[part] = ",".join(map(v.written.__getitem__, ids))
            if (plain := v._plain(ids)) != part.replace(MARK, " "):
                self.other[part] = plain

    def run(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        v = self.vocabulary
        split = [v.split(t) for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
            self.other.clear()
        self.learn(list({p for parts in split for p in parts} - self.known.keys()))
        for parts in split:
            plain = "".join([self.other.get(p, p) for p in parts] if self.other else parts).replace(MARK, " ")
            yield ",".join(map(self.known.__getitem__, parts)), plain[1:] if v.prefix else plain


def _library(path: str) -> Callable[[str], tuple[str, str]]:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)

    def run(text: str) -> tuple[str, str]:
        ids = library.encode(text, num_threads=1)
        return ",".join(map(str, ids)), library.decode(ids)

    return run


def _batches(path: str, columns: list[str], build: Callable[[str, str], tuple], types: list[pa.DataType], names: list[str]):
    """Encode slices of batches; the longest text of a batch and one in CHECKED, by a hash, are compared with the library.

    Where one differs, the library encodes the whole slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .vectors import slices

        encoder, library = Encoder(path), _library(path)
        for b in batches:
            longest = int(np.argmax(pc.binary_length(b["text"]).fill_null(0))) if len(b) else -1
            for at, to in slices(b["text"]):
                part = b.slice(at, to - at)
                texts = [t or "" for t in part["text"].to_pylist()]
                made = list(encoder.run(texts))
                asked = (i for i, t in enumerate(texts) if at + i == longest or zlib.crc32(t.encode()) % CHECKED == 0)
                if any(library(texts[i]) != tuple(made[i]) for i in asked):
                    made = [library(t) for t in texts]
                rows = [build(ids, decoded) for ids, decoded in made]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), *made], [*columns, *names])

    return run


def encode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (of the whole text, without begin or end), decoded (the text of the ids)."""
    build = lambda ids, decoded: ([int(i) for i in ids.split(",")] if ids else [], decoded)
    rows = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))
    run = _batches(path, ["doc_id"], build, [pa.list_(pa.int32()), pa.string()], ["ids", "decoded"])
    return rows.mapInArrow(returning_memory(run), "doc_id long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` with its results hashed in the batch that made them."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    build = lambda ids, decoded: (ids.count(",") + 1 if ids else 0, sha(ids), sha(decoded))
    rows = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))
    run = _batches(path, ["doc_id"], build, [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])
    return rows.mapInArrow(returning_memory(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
