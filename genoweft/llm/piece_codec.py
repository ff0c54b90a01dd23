"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf, read here field by field: pieces with scores and types, the
trainer's model type and byte fallback, the normaliser's name, character map, dummy prefix and
white-space handling. From it the normaliser (a precompiled character map where there is one),
the metaspace marker and the model are rebuilt: Unigram from the scores, or BPE with merges
ranked by the score of the piece they make, each with byte fallback.

No piece holds the marker after another sign, nor a sign that only byte fallback can write; so a
text parts into units there, and the units' ids joined are the text's. Distinct units are encoded
in batches, and their ids gathered for all texts. A worker holds a bounded number of units; when
there are more, the most met of those in several runs of texts stay, and the others are learned
anew if they come again. Units with a run of markers, whose merges tie in score, go through an
exact leftmost-best merge instead.
Parity with the sentencepiece library is verified for every row (codec_report).

Edge cases: null and empty texts have no ids and decode to the empty string; equal texts get
equal ids; texts of any length are encoded whole; repeated rows stay; an empty table gives an
empty result; other columns,
of whatever names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


class Codec:
    """A SentencePiece model on the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        for number, value in parts:
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
        trainer = dict(fields(next((v for n, v in parts if n == 2), b"")))
        norm = dict(fields(next((v for n, v in parts if n == 3), b"")))
        self.kind, self.fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if any(t == USER for _, _, t in self.pieces) or not norm.get(5, 1):
            raise ValueError("user-defined pieces and unescaped white space are not supported")
        chars = norm.get(2, b"")
        self.map = normalizers.Precompiled(chars) if chars else None
        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.real = {p: (s, i) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL}
        if self.kind == BPE:
            pairs = [(-s, i, p[:k], p[k:]) for p, (s, i) in self.real.items() for k in range(1, len(p)) if p[:k] in self.real and p[k:] in self.real]
            model = models.BPE(vocab, [(a, b) for _, _, a, b in sorted(pairs)], unk_token=self.pieces[self.unk][0], byte_fallback=self.fallback, fuse_unk=True)
        elif self.kind == UNIGRAM:
            # Only normal pieces may match: the others keep their ids under names with a space, which no
            # normalised text holds. Signs of no piece come back as unknown and fall back to bytes here.
            model = models.Unigram([(p if t == NORMAL else f" {i}", s) for i, (p, s, t) in enumerate(self.pieces)], self.unk, False)
        else:
            raise ValueError("only unigram and BPE models are supported")
        self.tokenizer = Tokenizer(model)
        written = set().union(*self.real) if self.real else set()
        parted = all(MARK not in p.lstrip(MARK) for p in self.real)
        alone = "".join(c for c in "\n\t\r" if c not in written) if self.fallback else ""
        self.parts = parted and self.kind == BPE
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        out = [b"" if t == CONTROL else bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t != UNKNOWN else " ⁇ ".encode() for p, _, t in self.pieces]
        self.size = np.array([len(x) for x in out], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(out), np.uint8)
        self._forget()
        # A text that begins with a sign parted from all others shows the library a unit as it stands inside a text.
        self.lead = alone[:1] if self.parts and alone and not self.squeeze else None
        self.parting = frozenset(alone)
        self.stands_alone = np.zeros(256, bool)
        self.stands_alone[list(alone.encode())] = True

    def normalise(self, text: str) -> str:
        if self.map is not None:
            text = self.map.normalize_str(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def merge(self, unit: str) -> list[int]:
        """BPE as defined: the best-scored pair first, the leftmost of equals."""
        sign = list(unit)
        left, right = list(range(-1, len(sign) - 1)), [*range(1, len(sign)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (both := sign[i] + sign[j]) in self.real:
                heapq.heappush(heap, (-self.real[both][0], i, j, both))

        for i in range(len(sign)):
            push(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not sign[i] or not sign[j] or sign[i] + sign[j] != both or right[i] != j:
                continue
            sign[i], sign[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i])
            push(i)
        out: list[int] = []
        for s in sign:
            if s in self.real:
                out.append(self.real[s][1])
            elif s and self.fallback:
                out += [self.byte_id[b] for b in s.encode()]
            elif s and (not out or out[-1] != self.unk):
                out.append(self.unk)
        return out

    def _units(self, marked: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(all units of the normalised texts, how many lie before each text and in all). A unit is a parting sign,
        or markers and what follows up to the next one; units cover the texts, so they lie on the texts' own bytes."""
        raw = [m.encode() for m in marked]
        data, edge = b"".join(raw), np.cumsum([0, *map(len, raw)])
        buf = np.frombuffer(data, np.uint8)
        mark, alone = np.zeros(len(buf), bool), self.stands_alone[buf]
        a, b, c = MARK.encode()
        mark[:-2] = (buf[:-2] == a) & (buf[1:-1] == b) & (buf[2:] == c)
        first = mark.copy()
        first[3:] &= ~mark[:-3]
        first |= alone
        first[1:] |= alone[:-1]
        first[edge[:-1][edge[:-1] < len(buf)]] = True
        at = np.flatnonzero(first)
        offs = np.append(at, len(buf)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(data)), np.searchsorted(at, edge)

    def _encode_units(self, units: list[str], chunk: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many each has). Units go to the tokenizer by the line, parted by a
        sign that no piece holds; those with a run of markers, or such a sign, through merge()."""
        odd = [k for k, u in enumerate(units) if MARK + MARK in u or self.lead is None or u in self.parting]
        own = set(odd)
        plain = [u for k, u in enumerate(units) if k not in own] if odd else units
        lines = [self.lead.join(plain[a : a + chunk]) + self.lead for a in range(0, len(plain), chunk)] if plain else []
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([*found, np.empty(0, np.int32)])
        end = ids == self.byte_id[ord(self.lead)] if self.lead else np.zeros(len(ids), bool)
        at = np.flatnonzero(end)
        size = np.diff(np.append(-1, at)) - 1
        ids = ids[~end]
        if odd:
            merged = [self.merge(units[k]) for k in odd]
            apart, sizes = np.zeros(len(units), bool), np.empty(len(units), np.int64)
            apart[odd] = True
            sizes[odd], sizes[~apart] = [len(m) for m in merged], size
            theirs = np.repeat(apart, sizes)
            out = np.empty(len(theirs), np.int32)
            out[theirs], out[~theirs] = np.concatenate([np.array(m, np.int32) for m in merged]), ids
            return out, sizes
        return ids, size

    def _with_bytes(self, text: str, found) -> list[int]:
        if not self.fallback or self.unk not in found.ids:
            return found.ids
        out: list[int] = []
        for i, (a, b) in zip(found.ids, found.offsets, strict=True):
            out += [self.byte_id[x] for x in text[a:b].encode()] if i == self.unk else [i]
        return out

    def _forget(self) -> None:
        """No unit known: number of each, in order, and per number its ids' place and count, whether the library
        agrees and in how many runs of texts it was met (halved when others are dropped)."""
        self.known: dict[str, int] = {}
        self.flat, self.begin_of, self.size_of = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.agree, self.met = np.empty(0, bool), np.empty(0, np.int64)

    def _forget_rare(self, most: int) -> None:
        """Only units met in more than one run stay known, the `most` most met ones at most."""
        stay = np.flatnonzero(self.met > 1)
        if len(stay) > most:
            stay = np.sort(stay[np.argsort(-self.met[stay], kind="stable")[:most]])
        names, size = list(self.known), self.size_of[stay]
        self.known = {names[k]: n for n, k in enumerate(stay.tolist())}
        self.flat = _gather(self.flat, self.begin_of[stay], size)
        self.begin_of, self.size_of = np.cumsum(size) - size, size
        self.agree, self.met = self.agree[stay], self.met[stay] // 2

    def _learn(self, units: list[str], theirs) -> None:
        ids, size = self._encode_units(units)
        self.known.update(zip(units, range(len(self.size_of), len(self.size_of) + len(units)), strict=True))
        agree = np.ones(len(units), bool) if theirs is None else self._compare(units, ids, size, theirs)
        self.begin_of = np.concatenate([self.begin_of, len(self.flat) + np.cumsum(size) - size])
        self.size_of, self.agree = np.concatenate([self.size_of, size]), np.concatenate([self.agree, agree])
        self.met = np.append(self.met, np.zeros(len(units), np.int64))
        self.flat = np.concatenate([self.flat, ids])

    def _compare(self, units: list[str], ids: np.ndarray, size: np.ndarray, theirs, chunk: int = 1000) -> np.ndarray:
        """Whether the library gives each unit the same ids, where it stands between parting signs."""
        sign = self.byte_id[ord(self.lead)]
        head = np.array([*self.merge(self.normalise(self.lead)[:-1]), sign], np.int32)
        edge = np.concatenate([[0], np.cumsum(size)])
        agree = np.ones(len(units), bool)
        todo = [(a, min(a + chunk, len(units))) for a in range(0, len(units), chunk)]
        while todo:
            a, b = todo.pop()
            want = theirs.encode(self.lead + self.lead.join(units[a:b]).replace(MARK, " "), num_threads=1, return_type="numpy")
            got = np.insert(ids[edge[a] : edge[b]], edge[a + 1 : b] - edge[a], sign)
            if not np.array_equal(np.concatenate([head, got]), want):
                if b - a == 1:
                    agree[a] = False
                else:
                    todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        return agree

    def encode(self, texts: list[str], most: int = 120_000, theirs=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each, whether the library `theirs` agrees on normalised text and units)."""
        marked = [self.normalise(t) for t in texts]
        same = np.array([theirs.Normalize(t) == m for t, m in zip(texts, marked, strict=True)], bool) if theirs is not None else np.ones(len(texts), bool)
        if not self.parts:
            ids = [self._with_bytes(m, e) for m, e in zip(marked, self.tokenizer.encode_batch(marked, add_special_tokens=False), strict=True)]
            return np.concatenate([np.array(i, np.int32) for i in ids] or [np.empty(0, np.int32)]), np.cumsum([0, *map(len, ids)]), same
        found, units = self._units(marked)
        found = found.dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > most:
            self._forget_rare(most // 2)
        new = [u for u in names if u not in self.known]
        if new:
            self._learn(new, theirs)
        number = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.met[number] += 1
        at = number[found.indices.to_numpy()]
        ids = _gather(self.flat, self.begin_of[at], self.size_of[at])
        bad = np.concatenate([[0], np.cumsum(~self.agree[at])])[units]
        return ids, np.concatenate([[0], np.cumsum(self.size_of[at])])[units], same & (np.diff(bad) == 0)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ids."""
        data = _gather(self.blob, self.begin[ids], self.size[ids])
        edge = np.concatenate([[0], np.cumsum(self.size[ids])])[offs]
        out = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            out.append(data[a + (1 if self.prefix and b > a and data[a] == 32 else 0) : b].tobytes())
        return out


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[begin : begin + size], joined."""
    ends = np.cumsum(size)
    return values[np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=1)
def reference_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def parity(texts: list[str], path: str = MODEL) -> list[bool]:
    """Whether ids and decoded text are those of the sentencepiece library, each text whole."""
    c = codec(path)
    ids, offs, _ = c.encode(texts)
    return _same(texts, ids, offs, c.decode(ids, offs), path)


def _same(texts: list[str], ids: np.ndarray, offs: np.ndarray, back: list[bytes], path: str) -> list[bool]:
    theirs = reference_processor(path)
    want = theirs.encode(texts, num_threads=1)
    return [ids[a:b].tolist() == w and d.decode("utf-8", "replace") == theirs.decode(w) for a, b, w, d in zip(offs[:-1], offs[1:], want, back, strict=True)]


def _slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, row after the last, texts) of runs of whole texts of about `most` bytes; only one run is
    in Python strings at a time."""
    for a, b, _, _ in text_chunks(column, most, 500):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


@tidy
def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        for a, b, texts in _slices(batch.column(1)):
            ids, offs, _ = c.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offs.astype(np.int32), ids)], ["doc_id", "ids"])
    c._forget()  # the worker goes on to other tasks


@tidy
def _digest(batches: Iterator[pa.RecordBatch], path: str, whole: bool) -> Iterator[pa.RecordBatch]:
    c, theirs = codec(path), reference_processor(path)
    c._forget()  # units of other uses of this worker were not compared
    whole = whole or not c.parts or c.lead is None
    for batch in batches:
        for a, b, part in _slices(batch.column(1)):
            ids, offs, same = c.encode(part, most=300_000, theirs=None if whole else theirs)
            back = c.decode(ids, offs)
            if whole:
                same = _same(part, ids, offs, back, path)
            else:
                same = [bool(s) and d.decode("utf-8", "replace") == theirs.decode(i) for s, d, i in zip(same, back, np.split(ids, offs[1:-1]), strict=True)]
            runs = [ids[x:y] for x, y in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array(np.diff(offs)),
                    "ids_sha256": pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in runs]),
                    "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                    "round_trip": pa.array([b == t.encode("utf-8") for b, t in zip(back, part, strict=True)], pa.bool_()),
                    "parity": pa.array(same, pa.bool_()),
                }
            )
    c._forget()


def encode_texts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, path=model), "doc_id long, ids array<int>")


def codec_report(docs: DataFrame, model: str = MODEL, whole_parity: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row; (doc_id, n_tokens, ids_sha256 of little-endian int32 ids,
    decoded_sha256, round_trip, parity).

    parity compares every row with the sentencepiece library: its normalised text, the ids of each
    of its units (each distinct unit of a task once, standing as inside a text) and the decoded
    whole; with whole_parity the library also encodes every text anew as a whole. A model whose
    texts do not part into units is always compared whole."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        partial(_digest, path=model, whole=whole_parity),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean",
    )


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return codec_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
