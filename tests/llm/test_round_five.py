"""Bounds of memory and of work of the steps that the check tool found too large, and that results stay."""

from __future__ import annotations

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from genoweft.llm import common, context_mixing, piece_codec

WORDS = ["ka", "lo", "mira", "é", "runde", "ß", "te-x", "o"]


# ---------------------------------------------------------------- encoding


def test_encoding_takes_long_texts_by_bytes(monkeypatch):
    """A worker holds a bounded run of texts as Python strings, however long they are, and all come out."""
    asked, encode = [], piece_codec.Codec.encode
    monkeypatch.setattr(piece_codec.Codec, "encode", lambda self, texts, **kw: asked.append(sum(map(len, texts))) or encode(self, texts, **kw))
    texts = [f"{w} {k} " * 20_000 for k, w in enumerate(WORDS)] * 4 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = [r for b in piece_codec._encode(iter([batch]), piece_codec.MODEL) for r in b.to_pylist()]
    assert max(asked) <= 1 << 20 and sum(asked) == sum(len(t or "") for t in texts)
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    want = [x for t in texts for b in piece_codec._encode(iter([pa.RecordBatch.from_pydict({"doc_id": [0], "text": [t or ""]})]), piece_codec.MODEL) for x in b["ids"].to_pylist()]
    assert [r["ids"] for r in got] == want


def test_encoding_holds_few_units():
    """Units of texts that share none do not pile up, and forgetting them changes no ids."""
    c = piece_codec.codec(piece_codec.MODEL)
    c._forget()
    texts = [[f"w{k}x{i}" for i in range(30_000)] for k in range(8)]
    runs = [c.encode([" ".join(t)])[0].tolist() for t in texts]
    assert len(c.known) <= 150_000
    c._forget()
    assert c.encode([" ".join(texts[-1])])[0].tolist() == runs[-1]
    c._forget()


def test_common_units_are_learned_once(monkeypatch):
    """When rare units are dropped, those that come in every run stay, with what the library says of them."""
    c, theirs = piece_codec.Codec(piece_codec.MODEL), piece_codec.reference_processor(piece_codec.MODEL)
    common = [f"c{i}" for i in range(500)]
    runs = [[" ".join(common), " ".join(f"r{k}x{i}" for i in range(800))] for k in range(12)]
    asked, good = [], c._encode_units

    def wrong(units):
        asked.extend(units)
        ids, size = good(units)
        return np.where(np.repeat(np.array([u == "▁c7" for u in units]), size), 5, ids).astype(np.int32), size

    monkeypatch.setattr(c, "_encode_units", wrong)
    for texts in runs:
        ids, offs, same = c.encode(texts, most=3000, theirs=theirs)
        assert same.tolist() == [False, True] and ids[offs[1] :].tolist() == theirs.encode(texts[1])
        assert len(c.known) <= 3000 + 1300 and list(c.known.values()) == list(range(len(c.known)))
    assert len(asked) == len(set(asked)) == 500 + 12 * 800
    assert len(c.known) == len(c.size_of) == len(c.agree) == len(c.met) and len(c.flat) == c.size_of.sum()


def test_units_by_brute_force():
    """Units read off the bytes are those of the rule, sign by sign; the ids of each are those of its merges."""
    c, rnd = piece_codec.Codec(piece_codec.MODEL), random.Random(4)
    alone = "".join(sorted(c.parting))
    rule = re.compile(f"[{alone}]|▁*[^▁{alone}]+|▁+")
    texts = ["", "▁", "▁▁", "\n", "▁\n▁", "a", "é", "▁a▁", "▁▁中\t▁▁b"] + ["".join(rnd.choice("▁▁▁\n\taé中😀.") for _ in range(rnd.randrange(12))) for _ in range(400)]
    rnd.shuffle(texts)
    units, before = c._units(texts)
    units = units.to_pylist()
    assert [units[a:b] for a, b in zip(before[:-1], before[1:], strict=True)] == [rule.findall(t) for t in texts]
    units = list(dict.fromkeys(units))
    ids, size = c._encode_units(units)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [c.merge(u) for u in units]
    assert c._units([])[0].to_pylist() == c._units([""])[0].to_pylist() == []


# ---------------------------------------------------------------- hashes


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_word_hashes_whatever_the_block(block):
    """Words hash by their bytes alone, also empty ones and ones longer than a block."""
    words = [b"ka", b"x" * 200, b"", b"ka", b"lo", b"ka\xc3\xa9", b"lo"] * 3
    buf = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    got = common.word_hashes(buf, end - size, end, block)
    assert got.tolist() == common.word_hashes(buf, end - size, end, 1 << 30).tolist()
    assert len(set(got.tolist())) == len(set(words)) == len(set(zip(words, got.tolist(), strict=True)))


def test_word_hashes_need_little_memory():
    buf = np.tile(np.frombuffer(b"words ", np.uint8), 1 << 19)
    start = np.arange(0, len(buf), 6)
    common.word_hashes(buf, start, start + 5)
    tracemalloc.start()
    common.word_hashes(buf, start, start + 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(start) + (8 << 20)  # the hashes, and not 8 bytes for each byte of text


# ---------------------------------------------------------------- context mixing


def test_places_by_brute_force():
    rng = np.random.default_rng(1)
    words = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2), np.arange(5, dtype=np.uint64), np.uint64(0xFFFF) << np.uint64(48) | np.arange(3, dtype=np.uint64)]))
    asked = np.concatenate([rng.choice(words, 500), words + np.uint64(1), words, [np.uint64((1 << 64) - 1)]])
    at = {w: i for i, w in enumerate(words.tolist())}
    assert context_mixing.places(words, asked).tolist() == [at.get(a, -1) for a in asked.tolist()]
    assert context_mixing.places(words[:0], asked).tolist() == [-1] * len(asked)


def test_styles_and_contexts_by_brute_force():
    """The style that most of the last SPAN frequent words are of, the least of equals; contexts of two to four words."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(WORDS, n)) for n in (0, 1, 2, 3, 40, 200)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashed = lambda w: common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]
    frequent = np.sort(np.array([hashed(w) for w in WORDS[:6]]))
    anchors, style = frequent[1:5], np.array([8, 1, 3, 1])
    t = context_mixing.Tokens(buf, offs, {"anchors": anchors, "style": style, "frequent": frequent})
    own, common_words = dict(zip(anchors.tolist(), style.tolist(), strict=True)), set(frequent.tolist())
    styles, contexts = [], []
    for text in texts:
        h = [int(hashed(w)) for w in text.split()] + [int(context_mixing.END)]
        for k in range(len(h)):
            n = np.bincount([own.get(x, 0) for x in h[max(0, k - context_mixing.SPAN) : k]], minlength=9)
            n[0] = 0
            styles.append(int(n.argmax()))
            if k >= 2:
                back = h[k - 1 :: -1][:4] + [int(context_mixing.START)] * 4
                some = [j < k and back[j] in common_words for j in range(3)]
                contexts.append(tuple(back[: 2 + (sum(some[:2]) >= 1) + (sum(some[:2]) >= 1 and sum(some) >= 2)]))
    assert t.style.tolist() == styles and len(set(styles)) > 3
    assert len(t.ctx) == len(contexts) and len(set(zip(contexts, t.ctx.tolist(), strict=True))) == len(set(contexts)) == len(set(t.ctx.tolist()))


def test_packed_arrays_come_back():
    rng = np.random.default_rng(4)
    for kind in (np.uint8, np.uint16, np.int32, np.uint32, np.int64, np.uint64, np.float32):
        parts = [rng.integers(0, 256, n * np.dtype(kind).itemsize).astype(np.uint8).view(kind) for n in (0, 1, 1000)]
        got, size = context_mixing.grow(pa.array([context_mixing.shrink(p) for p in parts]), kind)
        assert got.tobytes() == np.concatenate(parts).tobytes() and size.tolist() == [0, 1, 1000]


def test_bounded_tables_sort_nothing():
    """The order of steps by word so far is worked out only where words' own counts are read, and puts equal contexts together."""
    code = context_mixing.prefix_code(np.full(256, 3))
    words = [b"ka", b"kal", b"kamel", b"kamera", b"lo", b"\n"]
    args = np.array([1, 2, 1, 1, 2, 1], np.uint8), np.array([3, 1, 4, 1, 5, 9]), np.array([len(w) for w in words]), np.frombuffer(b"".join(words), np.uint8), code
    assert not context_mixing.Bits(*args, own=False).order
    bits = context_mixing.Bits(*args)
    for order, ctx in zip(bits.order, bits.context[2:], strict=True):
        assert sorted(order.tolist()) == list(range(len(bits.byte)))
        runs = 1 + int((ctx[order][1:] != ctx[order][:-1]).sum())
        assert runs == len(set(ctx.tolist()))
        same = ctx[order][1:] == ctx[order][:-1]
        assert (bits.flush[order][1:][same] >= bits.flush[order][:-1][same]).all()
    assert math.isclose(bits.of_words(np.ones(len(bits.byte))).sum(), sum(len(w) + (w != b"\n") for w in words))
