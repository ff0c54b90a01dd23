"""Language-model scoring by online logistic context mixing.

A text is the byte stream of its words (A-Z lowered), each followed by one space, and one end
byte; bytes are written in a prefix code fitted on the training text, so that a byte takes about
four bits instead of eight. Every bit is predicted by several predictors, each looking up a hash
of its own context and of the bits of the byte already known: the last two and the last three
bytes of the word within a style, and all of the word so far, within a style and in any. Their
stretched probabilities are mixed in the logistic domain by weights that a gate chooses (how
often the word so far was seen), learned online over all words of the training text.

Contexts reach across words in two ways. The style of a place is the group of frequent words
that the 32 words before it hold most of; groups are those of words that share texts. And before
a word is written bit by bit, one bit says whether it is the word that followed most often after
the words before (two, or up to four where these are frequent ones). The odds of that bit come
from an adaptive map, by how sure the counts are and how the text's bits before turned out: a
text that has followed others is trusted to go on, one that has not is not.

All that is known of the corpus grows with it: every (style, word) and every context with its
followers is counted exactly, in fragments by hash; only tables of contexts of three bytes at
most, bounded by the alphabet, are sent to all tasks (SLOT_BITS). Texts are packed in runs. A run
asks each fragment for its distinct words and contexts once and gets an answer as long as the
question, so that nothing a task holds is larger than its share. Words are gathered by their
first bytes, for the predictors of the word so far, after equal ones of all runs have become one.

Frequent words are those that make at least 1 in FREQUENT of all training words, counted exactly over
the whole table, so scores do not hang on how it is cut (up to the rounding of counts beyond 2**24).
A learning step weighs a (style, word) as often as it occurs, 2,000 times at most.

Every word and flag is priced as often as it occurs; that a word in a style costs the same
wherever it stands lets its bits be worked out once.

In learning, each occurrence is left out of its own counts. In scoring, a training text's own
occurrence of a context is left out of what is predicted to follow, or every text learned from
would merely repeat itself: it is priced by the others, as a held-out text is, and only texts that
others share follow them. Words keep their counts, as in the unigram base, which is exact. Equal
texts get equal scores if they are all learned from or all held out.

Edge cases: a null text is empty and costs its end alone; repeated rows stay; a null id is neither
held out nor left out of training (its fold is null, so it is learned from); words and texts of
any length are scored whole; an empty table gives an empty result; an empty training set leaves
flat predictors; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, give_back, joined, materialize, materialize_bucketed, mix64, per_group, release, shuffle_partitions, text_chunks, tidy, word_bounds, word_hashes

CHUNK = 2 << 20
#: log2 of the slots of the bounded tables: last two bytes, last three, first bytes of the word in any style and in one.
SLOT_BITS = (21, 22, 19, 21)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
SEGMENT = 1 << 13
#: Bytes of a word that the bounded tables hold; from there on words of one beginning are together.
HEAD = 3
LEVELS = 8
#: Frequent words that tell styles, styles, words back that are asked, and how many frequent words extend a context.
ANCHORS, STYLES, SPAN, FREQUENT = 96, 8, 32, 1000
#: Cells of the map of the predicted word: sureness, how the bits before turned out, the bit itself.
SURE, PAST = 8, 4
END, START = np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text for one fragment.
PER_FRAGMENT, LEAST_FRAGMENTS = 8 << 20, 32
_SALT = [np.uint64(x) for x in np.random.default_rng(17).integers(1, 1 << 62, 16) * 2 + 1]


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each distinct key, in order of key; number of each key). Faster than np.unique, whose places are the first."""
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def places(words: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked hash in `words`, sorted and distinct; -1 if none. Looked up by the first 16 bits."""
    out = np.full(len(asked), -1, np.int64)
    if len(words):
        bucket = (words >> np.uint64(48)).astype(np.int64)
        begin = np.searchsorted(bucket, np.arange(1 << 16)).astype(np.int32)
        at = begin[(asked >> np.uint64(48)).astype(np.int64)]
        for _ in range(int(np.bincount(bucket).max())):
            fit = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == asked)
            out[fit] = at[fit]
            at = at + 1
        out[out >= len(words)] = len(words) - 1
    return out


_ZSTD = pa.Codec("zstd")


def shrink(x: np.ndarray) -> bytes:
    """An array of integers or bytes, compressed; the bytes of each rank lie together."""
    x = np.ascontiguousarray(x)
    x = x.view(f"u{x.itemsize}")
    raw = b"".join((x >> x.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(x.itemsize))
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def grow(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all arrays of a column of shrink(), joined; length of each)."""
    width, parts = np.dtype(dtype).itemsize, []
    for data in column.to_pylist():
        size = int.from_bytes(data[:8], "little")
        raw = np.frombuffer(_ZSTD.decompress(data[8:], size, asbytes=True), np.uint8)
        one, *more = raw.reshape(width, -1)
        one = one.astype(f"u{width}")
        for k, plane in enumerate(more, 1):
            one |= plane.astype(one.dtype) << one.dtype.type(8 * k)
        parts.append(one.view(dtype))
    return np.concatenate(parts) if parts else np.empty(0, dtype), np.array([len(x) for x in parts], np.int64)


def _rows(part: np.ndarray, fixed: dict[str, np.ndarray], blob: tuple | None = None) -> dict[str, pa.Array]:
    """Packed columns, one row for each value of `part`; blob: (bytes, size of each entry's)."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
    out = {"part": pa.array(part[edge[:-1]], pa.int64())}
    for name, x in fixed.items():
        x = x[order]
        out[name] = pa.array([shrink(x[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    if blob is not None:
        data, size = blob
        begin, size = (np.cumsum(size) - size)[order], size[order]
        data, cut = _gather(data, begin, size), np.append(0, np.cumsum(size))[edge]
        out["size"] = pa.array([shrink(size[a:b].astype(np.int32)) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
        out["bytes"] = pa.array([shrink(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    return out


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- runs of texts


@tidy
def _pack(batches: Iterator[pa.RecordBatch], parts: int, held: int) -> Iterator[pa.RecordBatch]:
    """Runs of texts: ids, lowered bytes, offsets, and of the training texts a summary of the words that
    may be frequent, and the bytes."""
    for batch in batches:
        for a, b, raw, offs in text_chunks(batch.column(1), CHUNK):
            buf, ids = LOWER[raw], batch.column(0).slice(a, b - a)
            learned = np.array([fold(i, parts) != held for i in ids.to_pylist()])
            start, end = word_bounds(buf, offs)
            doc = np.repeat(np.arange(b - a), np.diff(np.searchsorted(start, offs)))
            own = learned[doc]
            words, n = lessened(*np.unique(word_hashes(buf, start, end)[own], return_counts=True))
            used = np.bincount(buf[np.repeat(learned, np.diff(offs))], minlength=256)
            used[32] += own.sum()
            used[10] += learned.sum()
            one = lambda x: pa.array([shrink(x)], pa.binary())
            yield pa.RecordBatch.from_pydict(
                {
                    "run": pa.array([random.SystemRandom().getrandbits(62)], pa.int64()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                    "text": one(buf), "offs": one(offs.astype(np.int64)), "learned": one(learned.astype(np.uint8)), "n_bytes": pa.array([len(buf)], pa.int64()), "n_words": pa.array([own.sum()], pa.int64()),
                    "top": one(words), "n": one(n.astype(np.int64)), "used": one(used.astype(np.int64)),
                }
            )


RUN = "run long, ids array<long>, text binary, offs binary, learned binary, n_bytes long, n_words long, top binary, n binary, used binary"


class Tokens:
    """Words and ends of a run of texts, in order, with style, context and place of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, frame: dict):
        start, end = word_bounds(buf, offs)
        first = np.searchsorted(start, offs)
        words = word_hashes(buf, start, end)
        self.hash = np.insert(words, first[1:], END)
        self.first = first + np.arange(len(offs))  # first token of each text
        # Bytes of each token lie in one buffer, those of an end behind all texts.
        self.buf = np.append(buf, np.uint8(10))
        self.start, self.size = np.insert(start, first[1:], len(buf)), np.insert(end - start, first[1:], 1)
        at = np.arange(len(self.hash))
        head = np.repeat(self.first[:-1], np.diff(self.first))
        known = frame["frequent"]
        k = places(known, self.hash)
        common = (k >= 0).astype(np.int8)
        self.style = np.zeros(len(at), np.uint8)
        if len(frame["anchors"]):
            # A byte for each style: no more than SPAN words are counted, so sums never pass from one to the next.
            told = np.zeros(len(known) + 1, np.uint64)  # anchors are frequent words; the last place is for no such word
            told[places(known, frame["anchors"])] = np.uint64(1) << (8 * frame["style"] - 8).astype(np.uint64)
            upto = np.append(np.uint64(0), np.cumsum(told[k], dtype=np.uint64))
            most = upto[:-1] - upto[np.maximum(head, at - SPAN)]
            met = np.flatnonzero(most)
            self.style[met] = most[met].view(np.uint8).reshape(-1, STYLES).argmax(1) + 1
        self.key = mix64(self.hash + mix64(self.style.astype(np.uint64) + np.uint64(3)))
        place = at - head
        self.asked = np.flatnonzero(place >= 2)  # both words before are words
        place = place[self.asked]
        back = [self.hash[self.asked - 1], self.hash[self.asked - 2], *(np.where(place >= k, self.hash[self.asked - k], START) for k in (3, 4))]
        often = [common[self.asked - 1], common[self.asked - 2], np.where(place >= 3, common[self.asked - 3], np.int8(0))]
        ctx = mix64(back[0] * _SALT[0] + back[1] * _SALT[1])
        more = often[0] + often[1]
        ctx = np.where(more >= 1, mix64(ctx + back[2] * _SALT[2]), ctx)
        ctx = np.where((more >= 1) & (more + often[2] >= 2), mix64(ctx + back[3] * _SALT[3]), ctx)
        # 32 bits of a context within its fragment and 16 of a follower within its context tell them apart.
        self.ctx, self.next = ctx, (self.hash[self.asked] >> np.uint64(16) & np.uint64(0xFFFF))

    def distinct_words(self):
        """(first place, number of each token's) of the distinct (style, word)."""
        return distinct(self.key)

    def distinct_contexts(self, parts: int):
        """(fragment, context, follower) of the distinct ones, and number of each asked token's."""
        part = _part(self.ctx, parts)
        pair = (self.ctx & np.uint64(0xFFFFFFFF)) << np.uint64(16) | self.next
        key = part.astype(np.uint64) << np.uint64(48) | pair
        one, which = distinct(key)
        uniq = key[one]
        return (uniq >> np.uint64(48)).astype(np.int64), uniq >> np.uint64(16) & np.uint64(0xFFFFFFFF), (uniq & np.uint64(0xFFFF)).astype(np.uint16), which


def _trained(table, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of a run's training texts."""
    learned = grow(table["learned"].slice(r, 1), np.uint8)[0].astype(bool)
    buf, offs = grow(table["text"].slice(r, 1), np.uint8)[0], grow(table["offs"].slice(r, 1), np.int64)[0]
    start, end = word_bounds(buf, offs)
    doc = np.repeat(np.arange(len(learned)), np.diff(np.searchsorted(start, offs)))
    own = learned[doc]
    return word_hashes(buf, start, end)[own], doc[own]


def _tokens(table, r: int, frame: dict):
    learned = grow(table["learned"].slice(r, 1), np.uint8)[0].astype(bool)
    t = Tokens(grow(table["text"].slice(r, 1), np.uint8)[0], grow(table["offs"].slice(r, 1), np.int64)[0], frame)
    return t, learned


# ---------------------------------------------------------------- styles


def lessened(words: np.ndarray, n: np.ndarray, most: int = 2 * FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the words, their counts less the next largest one: merged in any order, such
    summaries keep every word that is more than 1 in `most` of all."""
    if len(n) > most:
        n = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
    return words[n > 0], n[n > 0]


def _merged(table: pa.Table) -> pa.Table:
    words, at = np.unique(table["word"].to_numpy(), return_inverse=True)
    words, n = lessened(words, np.bincount(at, table["n"].to_numpy(), len(words)).astype(np.int64))
    return pa.table({"word": pa.array(words, pa.int64()), "n": pa.array(n, pa.int64())})


@tidy
def _counts(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Training occurrences of each of `words`."""
    total = np.zeros(len(words), np.int64)
    for batch in batches:
        for r in range(len(batch)):
            own, _ = _trained(batch, r)
            k = places(words, own)
            total += np.bincount(k[k >= 0], minlength=len(words))
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(words)), pa.int32()), "n": pa.array(total)})


@tidy
def _together(batches: Iterator[pa.RecordBatch], anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How much pairs of anchors share training texts: sums over texts of the product of their shares, in
    whole 1/1024, so that the order of the sum does not matter."""
    total, size = np.zeros((len(anchors), len(anchors)), np.int64), len(anchors)
    for batch in batches:
        for r in range(len(batch)):
            own, doc = _trained(batch, r)
            k = places(anchors, own)
            met = k >= 0
            texts = int(doc.max(initial=-1)) + 1
            n = np.bincount(doc[met] * size + k[met], minlength=texts * size).reshape(texts, size)
            shares = (n * 1024 // np.maximum(n.sum(1, keepdims=True), 20)).astype(float)
            total += (shares.T @ shares).astype(np.int64)  # whole numbers far below 2**53
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "v": pa.array(total.ravel()[at])})


def group_anchors(together: np.ndarray) -> np.ndarray:
    """Style (from 1) of each anchor: average-linkage merging of the cosines of how they share texts."""
    norm = together / np.sqrt(np.maximum(np.outer(together.diagonal(), together.diagonal()), 1e-300))
    groups = [[k] for k in range(len(together))]
    while len(groups) > 1:
        mean = np.array([[norm[np.ix_(a, b)].mean() if a is not b else -1.0 for b in groups] for a in groups])
        i, j = divmod(int(mean.argmax()), len(groups))
        if len(groups) <= STYLES and mean[i, j] < 0.25:
            break
        groups[min(i, j)] += groups.pop(max(i, j))
    style = np.zeros(len(together), np.int64)
    for s, g in enumerate(groups):
        style[g] = s + 1
    return style


def prefix_code(used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, length) of each byte's code: shortest for bytes used as often as told."""
    heap = [(float(n) + 1e-3, k, (k,)) for k, n in enumerate(used)]
    heapq.heapify(heap)
    value, length, name = np.zeros(256, np.uint64), np.zeros(256, np.int64), 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        value[list(y)] |= np.uint64(1) << length[list(y)].astype(np.uint64)
        length[list(x + y)] += 1
        heapq.heappush(heap, (a + b, name, x + y))
        name += 1
    return value, length


# ---------------------------------------------------------------- words


@tidy
def _ask(batches: Iterator[pa.RecordBatch], frame: dict, parts: int) -> Iterator[pa.RecordBatch]:
    """Per run and fragment its distinct (style, word), with bytes (kind 0), and its distinct (context,
    follower) (kind 1), and how often training texts have each."""
    for batch in batches:
        for r in range(len(batch)):
            t, learned = _tokens(batch, r, frame)
            learned = np.repeat(learned, np.diff(t.first))
            one, which = t.distinct_words()
            n = np.bincount(which, learned, len(one)).astype(np.uint32)
            size = t.size[one]
            out = _rows(_part(t.hash[one], parts), {"a": t.style[one], "n": n}, (_gather(t.buf, t.start[one], size), size))
            part, ctx, follower, which = t.distinct_contexts(parts)
            n = np.bincount(which, learned[t.asked], len(part)).astype(np.uint32)
            first = np.append(True, part[1:] != part[:-1])[: len(part)]
            gap = np.where(first, ctx, ctx - np.append(0, ctx[:-1]).astype(np.uint64)[: len(ctx)]).astype(np.uint32)  # sorted: only gaps are sent
            more = _rows(part, {"a": gap, "n": n, "bytes": follower})
            none = pa.array([None] * len(more["part"]), pa.binary())
            more["size"] = none
            for kind, x in ((0, out), (1, more)):
                yield pa.RecordBatch.from_pydict({"run": pa.array([batch["run"][r].as_py()] * len(x["part"]), pa.int64()), "kind": pa.array([kind] * len(x["part"]), pa.int32())} | {c: x[c] for c in ("part", "a", "n", "size", "bytes")})


ASKED = "run long, kind int, part long, a binary, n binary, size binary, bytes binary"
#: kind 0: words of a fragment for one group of first bytes; 1: followers' answers to a run; 2: a run's words, by number in the fragment.
KNOWN = "kind int, of long, part long, a binary, n binary, size binary, bytes binary, c binary, tokens long, words long"


def _known(table: pa.Table, heads: int) -> pa.Table:
    if table["kind"][0].as_py():
        return _answer_followers(table)
    style, _ = grow(table["a"], np.uint8)
    n, many = grow(table["n"], np.uint32)
    size, buf = grow(table["size"], np.int32)[0].astype(np.int64), grow(table["bytes"], np.uint8)[0]
    end = np.cumsum(size)
    begin = end - size
    word = word_hashes(buf, begin, end)
    word[(size == 1) & (buf[begin] == 10)] = END
    one, which = distinct(mix64(word + mix64(style.astype(np.uint64) + np.uint64(3))))
    total = np.bincount(which, n, len(one)).astype(np.int64)
    words, at = distinct(word[one])
    c = np.bincount(at, total, len(words)).astype(np.int64)
    few = np.minimum(size[one], HEAD)
    head = np.zeros(len(one), np.uint64)
    for k in range(HEAD):
        head = np.where(few > k, head * np.uint64(257) + buf[np.minimum(begin[one] + k, len(buf) - 1)] + np.uint64(1), head)
    out = _rows(_part(mix64(head), heads), {"a": style[one], "n": total, "c": np.arange(len(one), dtype=np.uint32)}, (_gather(buf, begin[one], size[one]), size[one]))
    own, rows = table["part"][0].as_py(), len(out["part"])
    words_of = pa.table({"kind": pa.array([0] * rows, pa.int32()), "of": pa.array([own] * rows, pa.int64()), **{k: out[k] for k in ("part", "a", "n", "size", "bytes", "c")}, "tokens": pa.array([int(c.sum())] + [0] * (rows - 1), pa.int64()), "words": pa.array([int((c > 0).sum())] + [0] * (rows - 1), pa.int64())})
    edge, count = np.append(0, np.cumsum(many)), c[at][which]
    cut = lambda x: pa.array([shrink(x[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    none, zero = pa.array([None] * len(many), pa.binary()), pa.array([0] * len(many), pa.int64())
    runs = pa.table({"kind": pa.array([2] * len(many), pa.int32()), "of": pa.array([own] * len(many), pa.int64()), "part": table["run"], "a": cut(which.astype(np.uint32)), "n": cut(count), "size": none, "bytes": none, "c": none, "tokens": zero, "words": zero})
    return pa.concat_tables([words_of, runs.cast(words_of.schema)])


def _heads(table: pa.Table) -> pa.Table:
    """All words of a group of first bytes in one row, in order of fragment."""
    table = table.sort_by("of")
    col = lambda c, t: grow(table[c], t)[0]
    c, many = grow(table["c"], np.uint32)
    one = {"of": np.repeat(table["of"].to_numpy(), many), "at": c, "a": col("a", np.uint8), "n": col("n", np.int64), "size": col("size", np.int32), "bytes": col("bytes", np.uint8)}
    return pa.table({k: pa.array([shrink(v)], pa.binary()) for k, v in one.items()})


HEADS = "of binary, at binary, a binary, n binary, size binary, bytes binary"


class Bits:
    """The bits of some (style, word): predicted by bounded tables and by the words themselves.

    All words that share their first HEAD bytes must be given together. Words of one style that begin
    alike share steps: a step is a byte after all bytes before it, and is worked out once."""

    def __init__(self, style: np.ndarray, n: np.ndarray, size: np.ndarray, buf: np.ndarray, code: tuple, own: bool = True):
        begin = np.cumsum(size) - size
        ends = (size == 1) & (buf[begin] == 10) if len(begin) else np.zeros(0, bool)
        full = size + ~ends  # a space behind each word
        self.words, self.owner = len(n), np.repeat(np.arange(len(n)), full)
        inside = np.arange(len(self.owner)) - np.repeat(np.cumsum(full) - full, full)
        last = inside >= size[self.owner]
        byte = np.where(last, np.uint8(32), buf[np.minimum(begin[self.owner] + inside, len(buf) - 1)]) if len(buf) else np.zeros(0, np.uint8)
        b = byte.astype(np.uint64) + np.uint64(1)
        s = mix64(style.astype(np.uint64) + np.uint64(11))[self.owner]
        # The word so far: a running hash, restarted at every word.
        upto = np.concatenate([[np.uint64(0)], np.cumsum(mix64(b + (inside.astype(np.uint64) << np.uint64(16))), dtype=np.uint64)])
        so_far = mix64(upto[:-1] - upto[np.arange(len(b)) - inside] + inside.astype(np.uint64))
        styled = mix64(so_far + s)
        one, self.step = distinct(mix64(styled + b))
        self.n = np.bincount(self.step, n[self.owner], len(one)).astype(np.float32)
        self.byte, self.local = byte[one], inside[one] >= HEAD
        back = [np.where(inside[one] >= k, b[np.maximum(one - k, 0)], np.uint64(0)) for k in (1, 2, 3)]
        two = back[0] + (back[1] << np.uint64(9))
        three = two + (back[2] << np.uint64(18))
        self.context = [mix64(two + s[one]), mix64(three + s[one] + np.uint64(1)), so_far[one], styled[one]]
        self.value, self.length = code
        # Steps by word so far and code, in any style and in one: bits that share a context lie together.
        flush = self.value << (np.uint64(60) - self.length.astype(np.uint64))
        self.flush = flush[self.byte]
        rank = np.empty(256, np.uint64)
        rank[np.argsort(flush, kind="stable")] = np.arange(256, dtype=np.uint64)
        # The last 8 bits of a context give way to the code's rank: one sort of whole numbers.
        self.order = [np.argsort(self.context[i] & ~np.uint64(255) | rank[self.byte]) for i in (2, 3)] if own else []

    def steps(self):
        """For each bit of the code: the steps that have it, its value, slots of the tables, and zeros and
        ones among the words given after the word so far, in any style and in one (if `own` was asked)."""
        lengths, at, order = self.length[self.byte], np.arange(len(self.byte)), self.order
        place, k = np.empty(len(at), np.int64), 0
        while len(at := at[lengths[at] > k]):
            place[at] = np.arange(len(at))
            order = [o[lengths[o] > k] for o in order]
            bit = (self.flush[at] >> np.uint64(59 - k) & np.uint64(1)).astype(np.int64)
            node = (np.uint64(1) << np.uint64(k) | self.flush[at] >> np.uint64(60 - k)) * np.uint64(0x9E3779B97F4A7C15)
            far = np.flatnonzero(~self.local[at])  # the word so far is in tables for its first bytes only
            some = (slice(None), slice(None), far, far)
            slots = [(mix64(c[at[o]] + node[o]) >> np.uint64(64 - n)).astype(np.int64) + OFFSETS[i] for i, (c, n, o) in enumerate(zip(self.context, SLOT_BITS, some, strict=True))]
            yield at, bit, slots, lambda k=k, order=order, n=len(at): [self._own(o, c, k, place, n) for o, c in zip(order, self.context[2:] if order else [], strict=True)]
            k += 1

    def _own(self, order: np.ndarray, context: np.ndarray, k: int, place: np.ndarray, size: int) -> np.ndarray:
        ctx, flush, n = context[order], self.flush[order], self.n[order]
        path = flush >> np.uint64(60 - k)
        first = np.flatnonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (path[1:] != path[:-1])))
        ones = n * (flush >> np.uint64(59 - k) & np.uint64(1)).astype(np.float32)
        total, ones = np.add.reduceat(n, first, dtype=np.float64), np.add.reduceat(ones, first, dtype=np.float64)
        out = np.empty(size, np.uint64)  # pairs of float32, moved as one
        out[place[order]] = np.repeat(np.stack([total - ones, ones], 1).astype(np.float32).view(np.uint64).ravel(), np.diff(np.append(first, len(order))))
        return out

    def of_words(self, steps: np.ndarray) -> np.ndarray:
        """Sums over the steps of each word."""
        return np.bincount(self.owner, steps[self.step], self.words)


def _of(batch, r: int, code: tuple, own: bool = True) -> Bits:
    col = lambda c, t: grow(batch[c].slice(r, 1), t)[0]
    return Bits(col("a", np.uint8), col("n", np.int64), col("size", np.int32).astype(np.int64), col("bytes", np.uint8), code, own)


@tidy
def _tables(batches: Iterator[pa.RecordBatch], code: tuple) -> Iterator[pa.RecordBatch]:
    """A task's share of the bounded tables, by segment: slots with their zeros and ones."""
    n, some = np.zeros(2 * OFFSETS[-1], np.float32), False
    for batch in batches:
        for r in range(len(batch)):
            bits, some = _of(batch, r, code, False), True
            for at, bit, slots, _ in bits.steps():
                far, weight = np.flatnonzero(~bits.local[at]), bits.n[at]
                for i, s in enumerate(slots):
                    own = slice(None) if i < 2 else far
                    np.add.at(n, 2 * s + bit[own], weight[own])
    if some:
        n = n.reshape(-1, 2)
        met = np.flatnonzero((n[:, 0] != 0) | (n[:, 1] != 0))
        out = _rows(met // SEGMENT, {"at": (met % SEGMENT).astype(np.uint16), "v": n[met].ravel().view(np.uint32).reshape(-1, 2).view(np.uint64).ravel()})
        yield pa.RecordBatch.from_pydict({k: out[k] for k in ("part", "at", "v")})


def _sum_tables(table: pa.Table) -> pa.Table:
    total = np.zeros((SEGMENT, 2))
    np.add.at(total, grow(table["at"], np.uint16)[0], grow(table["v"], np.uint64)[0].view(np.float32).reshape(-1, 2))
    met = np.flatnonzero(total.any(1)).astype(np.uint16)
    return pa.table({"part": table["part"][:1], "at": pa.array([met.tobytes()], pa.binary()), "v": pa.array([total[met].astype(np.float32).tobytes()], pa.binary())})


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1) * 0.8 + (n > 0), LEVELS - 1).astype(np.int64)


GATES, INPUTS = LEVELS * LEVELS * 2, len(SLOT_BITS) + 1


class Mixer:
    """Gated logistic mixing of the predictors of some words' bits."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray | None = None):
        self.pairs = tables.view(np.uint64).ravel()  # zeros and ones of a slot, read as one
        if weights is None:
            weights = np.full((GATES, INPUTS), 0.3, np.float32)
            weights[:, -1] = 0
        self.weights, self.power = weights, np.full(GATES, 1e-2)
        self.seen = np.zeros(GATES)

    def _inputs(self, bits: Bits, at: np.ndarray, bit: np.ndarray, slots: list[np.ndarray], own, left_out: bool):
        counts, far, own = [], np.flatnonzero(~bits.local[at]), own()
        place = np.arange(len(at)) * 2 + bit
        for i, s in enumerate(slots):
            if i < 2:
                two = self.pairs[s]
            else:
                two = own[i - 2]
                two[far] = self.pairs[s]
            two = two.view(np.float32)
            if left_out:
                two[place] -= 1
            np.maximum(two, 0, out=two)
            counts.append((two[::2].copy(), two[1::2].copy()))
        n = {i: counts[i][0] + counts[i][1] for i in (1, 3)}
        x = np.stack([np.log((b + np.float32(0.1)) / (a + np.float32(0.1))) for a, b in counts] + [np.full(len(at), 0.3, np.float32)])
        one_sided = ((np.minimum(*counts[3]) == 0) & (n[3] > 0)).astype(np.int64)
        return x, (_level(n[3]) * LEVELS + _level(n[1])) * 2 + one_sided

    def _mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.einsum("ki,ik->i", x, self.weights[gate]), -16, 16)))

    def learn(self, bits: Bits, rate: float = 0.1, block: int = 8192) -> None:
        """Online steps over the training words, each occurrence left out of its own counts."""
        for at, bit, slots, counts in bits.steps():
            x, gate = self._inputs(bits, at, bit, slots, counts, True)
            weight = np.minimum(bits.n[at], 2000)
            some = np.flatnonzero(weight > 0)
            for a in range(0, len(some), block):
                own = some[a : a + block]
                g, v = gate[own], x[:, own]
                e = (bit[own] - self._mix(v, g)) * weight[own]
                grad = np.stack([np.bincount(g, e * v[j], GATES) for j in range(INPUTS)], 1)
                self.power += np.bincount(g, e**2 * (v**2).sum(0), GATES)
                self.weights = np.clip(self.weights + rate * grad / np.sqrt(self.power)[:, None], -3, 3).astype(np.float32)
                self.seen += np.bincount(g, weight[own], GATES)

    def cost(self, bits: Bits) -> np.ndarray:
        """Bits of each word."""
        total = np.zeros(len(bits.n))
        for at, bit, slots, counts in bits.steps():
            p = np.clip(self._mix(*self._inputs(bits, at, bit, slots, counts, False)), 1e-5, 1 - 1e-5)
            total[at] -= np.log2(np.where(bit == 1, p, 1 - p))
        return bits.of_words(total)


@tidy
def _learn(batches: Iterator[pa.RecordBatch], tables, code: tuple) -> Iterator[pa.RecordBatch]:
    """Weights learned on each group of words, and how much each gate was used."""
    for batch in batches:
        for r in range(len(batch)):
            m = Mixer(tables.value)
            m.learn(_of(batch, r, code))
            yield pa.RecordBatch.from_pydict({"gate": pa.array(np.arange(GATES), pa.int32()), "seen": pa.array(m.seen), "w": pa.array(list(m.weights * m.seen[:, None]), pa.list_(pa.float64()))})


@tidy
def _price(batches: Iterator[pa.RecordBatch], tables, weights: np.ndarray, code: tuple) -> Iterator[pa.RecordBatch]:
    """Cost of each word, by number, for the fragment that asked."""
    for batch in batches:
        for r in range(len(batch)):
            cost = Mixer(tables.value, weights).cost(_of(batch, r, code)).astype(np.float32)
            of, at = grow(batch["of"].slice(r, 1), np.int64)[0], grow(batch["at"].slice(r, 1), np.uint32)[0]
            out = _rows(of, {"at": at, "cost": cost})
            yield pa.RecordBatch.from_pydict({"of": out["part"], "at": out["at"], "cost": out["cost"]})


def _answer_words(asked: pa.Table, prices: pa.Table) -> pa.Table:
    """Per run: cost of each word it asked for, and the word's count in any style."""
    at, cost = grow(prices["at"], np.uint32)[0], grow(prices["cost"], np.float32)[0]
    price = np.zeros(int(at.max(initial=0)) + 1, np.float32)
    price[at] = cost
    which = [grow(asked["a"].slice(r, 1), np.uint32)[0] for r in range(asked.num_rows)]
    return pa.table(
        {
            "run": asked["part"], "kind": pa.array([0] * asked.num_rows, pa.int32()), "part": asked["of"],
            "a": pa.array([shrink(price[w].astype(np.float32)) for w in which], pa.binary()), "b": asked["n"],
        }
    )


# ---------------------------------------------------------------- followers


def _sure(best: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How sure counts are, from 1; 0 without any."""
    alone = best == n
    level = np.select([n <= 0, alone & (n == 1), alone & (n == 2), alone & (n < 8), alone, best * 2 > n, best * 4 > n], [0, 1, 2, 3, 4, 5, 6], 7)
    return level.astype(np.uint8)


def followers(ctx: np.ndarray, nxt: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a context and a follower, counted in several parts: sureness and whether the follower
    is the predicted one (2 * sureness + hit), as it is and with one occurrence of the pair left out."""
    pair = ctx.astype(np.uint64) << np.uint64(16) | nxt.astype(np.uint64)
    one, which = distinct(pair)
    pair = pair[one]
    c = np.bincount(which, n, len(pair)).astype(np.int64)
    of, name = pair >> np.uint64(16), pair & np.uint64(0xFFFF)
    order = np.lexsort((name, -c, of))
    of_s, c_s = of[order], c[order]
    first = np.flatnonzero(np.append(True, of_s[1:] != of_s[:-1])[: len(of_s)])
    if not len(first):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    many = np.diff(np.append(first, len(of_s)))
    group = np.repeat(np.arange(len(first)), many)
    best, total = c_s[first], np.add.reduceat(c_s, first)
    second = np.where(many > 1, c_s[np.minimum(first + 1, len(c_s) - 1)], 0)
    hit = np.zeros(len(c_s), bool)
    hit[first] = best > 0
    state = _sure(best[group], total[group]) * 2 + hit
    still = hit & (c_s - 1 >= second[group]) & (c_s > 1)
    left = np.where(still, c_s - 1, np.where(hit, second[group], best[group]))
    loo = _sure(left, total[group] - 1) * 2 + still
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return state[back[which]].astype(np.uint8), loo[back[which]].astype(np.uint8)


def _answer_followers(table: pa.Table) -> pa.Table:
    gap, many = grow(table["a"], np.uint32)
    edge = np.append(0, np.cumsum(many))
    upto = np.append(0, np.cumsum(gap.astype(np.uint64)))
    ctx = upto[1:] - np.repeat(upto[edge[:-1]], many)
    state, loo = followers(ctx, grow(table["bytes"], np.uint16)[0], grow(table["n"], np.uint32)[0])
    cut = lambda x: pa.array([shrink(x[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    rows = table.num_rows
    none, zero = pa.array([None] * rows, pa.binary()), pa.array([0] * rows, pa.int64())
    return pa.table({"kind": pa.array([1] * rows, pa.int32()), "of": table["part"], "part": table["run"], "a": cut(state), "n": cut(loo), "size": none, "bytes": none, "c": none, "tokens": zero, "words": zero})


ANSWER = "run long, kind int, part long, a binary, b binary"

# ---------------------------------------------------------------- texts


def _cells(state: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Per text how often each cell of the map occurs, for predicted places in order."""
    own = state >= 2
    state, doc = state[own].astype(np.int64), doc[own]
    hit, at = state & 1, np.arange(len(state))
    head = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    # Hits in a row before each place, and whether there was a predicted place before it at all.
    stop = np.maximum.accumulate(np.where(head, at, np.where(np.append(0, 1 - hit[:-1])[: len(at)] == 1, at, 0))) if len(at) else at
    row = at - stop
    past = np.where(head, 1, np.where(row == 0, 0, np.where(row < 4, 2, 3)))
    cell = ((state >> 1) * PAST + past) * 2 + hit
    return np.bincount(doc * (SURE * PAST * 2) + cell, minlength=texts * SURE * PAST * 2).reshape(texts, -1).astype(np.int32)


def _read(run: pa.Table, answers: pa.Table, frame: dict, parts: int, held: int, words: int, follows: int) -> pa.Table:
    """Per text: tokens, known ones, base sum, bits of written words, cells of the map; one more row with the cells learned."""
    t, learned = _tokens(run, 0, frame)
    ids, texts = run["ids"][0].as_py(), len(t.first) - 1
    kind = answers["kind"].to_numpy()
    answers = [answers.filter(pa.array(kind == k)).sort_by("part") for k in (0, 1)]

    def put(k: int, order: np.ndarray, col: str, dtype) -> np.ndarray:
        out = np.empty(len(order), dtype)
        out[order] = grow(answers[k][col], dtype)[0]
        return out

    one, which = t.distinct_words()
    order = np.argsort(_part(t.hash[one], words), kind="stable")
    cost, c = put(0, order, "a", np.float32)[which].astype(float), put(0, order, "b", np.int64)[which]
    state = loo = np.zeros(0, np.uint8)
    if len(t.asked):
        part, _, _, which = t.distinct_contexts(follows)  # in order of fragment
        state, loo = put(1, np.arange(len(part)), "a", np.uint8)[which], put(1, np.arange(len(part)), "b", np.uint8)[which]
    doc = np.repeat(np.arange(texts), np.diff(t.first))
    sums = lambda v: np.bincount(doc, v, texts)
    state = np.where(learned[doc[t.asked]], loo, state)
    cost[t.asked[(state & 1) == 1]] = 0  # predicted words are not written
    cells = _cells(state, doc[t.asked], texts)
    known = cells[learned].sum(0, dtype=np.int64)
    table = {
        "doc_id": pa.array([*ids, None], pa.int64()), "held_out": pa.array([*(fold(i, parts) == held for i in ids), None], pa.bool_()),
        "n_tokens": pa.array(np.append(np.diff(t.first), 0)), "n_known": pa.array(np.append(sums(c > 0), 0).astype(np.int64)),
        "base": pa.array(np.append(sums(np.log10(c + 1.0)), 0)), "written": pa.array(np.append(sums(cost), 0)),
        "n_bytes": pa.array(np.append(sums(t.size + (t.hash != END)), 0).astype(np.int64)),
        "cells": pa.array([x.astype(np.int64).tobytes() for x in (*cells, known)], pa.binary()), "learned": pa.array([False] * texts + [True]),
    }
    return pa.table(table)


READ = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, written double, n_bytes long, cells binary, learned boolean"


@tidy
def _finish(batches: Iterator[pa.RecordBatch], chance: np.ndarray, tokens: int, words: int) -> Iterator[pa.RecordBatch]:
    price = -np.log2(np.stack([1 - chance, chance], -1)).ravel()
    for batch in batches:
        batch = batch.filter(pc.invert(batch["learned"]))
        cells = joined(pa.chunked_array([batch["cells"]]), np.int64).reshape(len(batch), -1)
        bits = batch["written"].to_numpy() + cells @ price
        n = batch["n_tokens"].to_numpy()
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": batch["n_tokens"], "n_known": batch["n_known"],
                "train_tokens": pa.array(np.full(len(batch), tokens)), "base_score": pa.array(batch["base"].to_numpy() - n * np.log10(tokens + words + 1.0)),
                "score": pa.array(-bits * np.log10(2.0)), "bits_per_byte": pa.array(bits / batch["n_bytes"].to_numpy()),
            }
        )


def _two(df: DataFrame, left: str, other: DataFrame, fn, schema: str) -> DataFrame:
    def call(a: pa.Table, b: pa.Table) -> pa.Table:
        out = fn(a, b)
        give_back()
        return out

    return df.groupBy(left).cogroup(other.groupBy(left)).applyInArrow(call, schema)


def score_texts(docs: DataFrame, parts: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model scores of all texts, learned from ids whose fold is not `held`."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = materialize_bucketed(texts.mapInArrow(partial(_pack, parts=parts, held=held), RUN), "runs", "run", max(64, shuffle_partitions(spark)))
    size, total = (x or 0 for x in runs.agg(F.sum("n_bytes"), F.sum("n_words")).first())
    frags = max(LEAST_FRAGMENTS, -(-size // PER_FRAGMENT))

    # Frequent words, at least 1 in FREQUENT of all training words, and the code: bounded lists. Summaries
    # of 2 * FREQUENT words hold every such word; these are then counted over all runs.
    used = runs.select("used").mapInArrow(_uses, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    code = prefix_code(np.bincount([r["at"] for r in used], [r["n"] for r in used], 256))
    some = runs.select("top", "n").mapInArrow(_tops, "word long, n long").groupBy(F.spark_partition_id() % 32).applyInArrow(_merged, "word long, n long")
    maybe = np.sort(_merged(some.toArrow())["word"].to_numpy().view(np.uint64))  # 32 summaries
    n = np.zeros(len(maybe), np.int64)
    if len(maybe):
        counted = runs.select("text", "offs", "learned").mapInArrow(partial(_counts, words=maybe), "at int, n long")
        for r in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():
            n[r["at"]] = r["n"]
    often = np.flatnonzero(n * FREQUENT >= max(total, 1))
    frequent = maybe[often]
    anchors = np.sort(frequent[np.lexsort((frequent, -n[often]))[:ANCHORS]])
    frame = {"anchors": anchors, "style": np.zeros(len(anchors), np.int64), "frequent": frequent}
    if len(anchors):
        pairs = runs.select("text", "offs", "learned").mapInArrow(partial(_together, anchors=anchors), "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect()
        together = np.bincount([r["at"] for r in pairs], [r["v"] for r in pairs], len(anchors) ** 2).reshape(len(anchors), -1)
        frame["style"] = group_anchors(together)

    asked = runs.select("run", "text", "offs", "learned").mapInArrow(partial(_ask, frame=frame, parts=frags), ASKED)
    heads = max(LEAST_FRAGMENTS, frags // 6)
    known = per_group(asked.withColumn("grp", F.col("part") * 2 + F.col("kind")), "grp", _known, KNOWN, heads=heads)
    known = materialize(known, "known")
    whole = known.agg(F.sum("tokens"), F.sum("words")).first()
    words = materialize(per_group(known.where("kind = 0").select("of", "part", "a", "n", "size", "bytes", "c"), "part", _heads, HEADS), "words")
    share = words.mapInArrow(partial(_tables, code=code), "part long, at binary, v binary")
    tables = np.zeros((OFFSETS[-1], 2), np.float32)
    for part, at, v in per_group(share, "part", _sum_tables, "part long, at binary, v binary").toLocalIterator():  # bounded by OFFSETS
        tables[part * SEGMENT + np.frombuffer(at, np.uint16).astype(np.int64)] = np.frombuffer(v, np.float32).reshape(-1, 2)
    sent = spark.sparkContext.broadcast(tables)  # bounded by OFFSETS
    learned = words.mapInArrow(partial(_learn, tables=sent, code=code), "gate int, seen double, w array<double>")
    learned = learned.groupBy("gate").agg(F.sum("seen").alias("seen"), *[F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(INPUTS)]).collect()  # GATES rows
    weights = Mixer(tables).weights
    for r in learned:
        if r["seen"] > 0:
            weights[r["gate"]] = [round(r[f"w{k}"] / r["seen"], 6) for k in range(INPUTS)]  # whatever order sums are taken in
    prices = words.mapInArrow(partial(_price, tables=sent, weights=weights, code=code), "of long, at binary, cost binary")
    priced = _two(known.where("kind = 2").select("of", "part", "a", "n"), "of", prices, _answer_words, ANSWER)
    follow = known.where("kind = 1").select(F.col("part").alias("run"), "kind", F.col("of").alias("part"), "a", F.col("n").alias("b"))
    read = _two(runs.select("run", "ids", "text", "offs", "learned"), "run", priced.union(follow), partial(_read, frame=frame, parts=parts, held=held, words=frags, follows=frags), READ)
    read = materialize(read, "read")
    release(runs, known, words)
    cells = np.zeros(SURE * PAST * 2)
    for r in read.where("learned").select("cells").mapInArrow(_cell_sums, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a cell
        cells[r["at"]] = r["n"]
    cells = cells.reshape(-1, 2)
    chance = np.clip((cells[:, 1] + 0.5) / (cells.sum(1) + 1.0), 1e-4, 1 - 1e-4)
    return read.mapInArrow(
        partial(_finish, chance=chance, tokens=int(whole[0] or 0), words=int(whole[1] or 0)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )


@tidy
def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary of a task's runs."""
    words, total = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        more, n = (grow(batch[c], np.int64)[0] for c in ("top", "n"))
        words, at = np.unique(np.concatenate([words, more]), return_inverse=True)
        words, total = lessened(words, np.bincount(at, np.concatenate([total, n]), len(words)).astype(np.int64))
    yield pa.RecordBatch.from_pydict({"word": pa.array(words), "n": pa.array(total)})


@tidy
def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += grow(batch["used"], np.int64)[0].reshape(-1, 256).sum(0)
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(256), pa.int32()), "n": pa.array(total)})


@tidy
def _cell_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = SURE * PAST * 2
    total = np.zeros(width, np.int64)
    for batch in batches:
        total += joined(pa.chunked_array([batch["cells"]]), np.int64).reshape(-1, width).sum(0)
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(width), pa.int32()), "n": pa.array(total)})


def op10_context_mixing(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
