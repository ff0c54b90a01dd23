"""Toxicity with noisy-channel deobfuscation.

A clean text reaches us through a channel that swaps letters for look-alikes (leetspeak), parts
a word's letters by spaces or marks, and repeats letters. Spans that the channel may have touched
(the rest has one reading only) become character lattices: each sign offers the letters it may
stand for, a repeated letter may be a repeat, a mark between letters may be noise. The Viterbi
path of least cost under a character trigram model of the corpus, plus the channel's costs, is
the restored text. A document's words, as written and as restored, are then scored by a logistic
model over the words that tell the label best.

The character model is made of all rows outside the held-out fold. The telling words and their
logistic weights are fitted on a bounded sample of the labelled rows among them: `label_rows` ids
for the words and `sample_rows` of these for the weights. Only such ids and labels are sent to
tasks; texts stay where they are read.

Edge cases: null and empty texts get the score of a text without a telling word; unlabelled rows
teach the character model only; conflicting labels of one id both count; null ids are scored,
never held out and carry no label; texts of any length are read whole; repeated rows stay; with no labelled row all scores are 0;
an empty table gives an empty result; other columns,
of whatever names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, fold_column, kept_columns, text_chunks, tidy

#: The letters that a sign may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SWAP_COST, REPEAT_COST, MARK_COST, KEEP_COST = 1.2, 0.7, 0.5, 5.0
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
#: What a token must hold, besides a letter, to have more than one reading: a sign at any place, a
#: letter twice, or three letters or signs parted by marks.
_LIKE = rf"(?:[^\W\d_]|[{re.escape(''.join(LOOKS))}])"
_TOUCHED = re.compile(rf"[{re.escape(''.join(LOOKS))}]|([^\W\d_])\1|(?:{_LIKE}[.\-_*]{{1,2}}){{2}}{_LIKE}")
_SPACED = re.compile(rf"(?<!\S){_LIKE}(?:[ .\-_*]{{1,2}}{_LIKE}(?![^\W_])){{2,}}")
#: Signs around a word that may be punctuation; a token is read with and without them.
_OUTER = "!|(+).,;:?\"'"
_MARKS = frozenset(" .-_*")
TELLING, LEAST_TEXTS = 300, 4


_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)


class Restorer:
    """Viterbi decoding under a character trigram model (27 signs: none, a to z)."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(27, 27, 27).astype(float)
        two = c.sum(0) + 0.5
        p2 = two / two.sum(1, keepdims=True)
        self.cost = -np.log((c + 20.0 * p2[None]) / (c.sum(2, keepdims=True) + 20.0))
        self.known: dict[str, str] = {}

    def __call__(self, span: str, most: int = 100_000) -> str:
        if span not in self.known:
            if len(self.known) >= most:
                self.known.clear()
            self.known[span] = self.decode(span)
        return self.known[span]

    def decode(self, span: str) -> str:
        cost = self.cost
        # A state is the last two signs; each keeps its least cost and a chain of what was written.
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for c in span:
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            reads: list[tuple[str, float]] = []
            if "a" <= c <= "z":
                reads.append((c, 0.0))
            else:
                reads += [(x, SWAP_COST) for x in LOOKS.get(c, "")]
                reads.append((c, KEEP_COST if c in LOOKS else 0.0))
            for (x, y), (total, chain) in states.items():
                for sign, price in reads:
                    z = ord(sign) - 96 if "a" <= sign <= "z" else 0
                    v = total + price + float(cost[x, y, z])
                    if v < step.get((y, z), (math.inf,))[0]:
                        step[(y, z)] = (v, (chain, sign))
                if c == before and c.isalpha():
                    v = total + REPEAT_COST
                    if v < step.get((x, y), (math.inf,))[0]:
                        step[(x, y)] = (v, chain)
                elif c in _MARKS:
                    v = total + MARK_COST
                    if v < step.get((x, y), (math.inf,))[0]:
                        step[(x, y)] = (v, chain)
            states, before = step, c
        _, chain = min(((v + float(cost[x, y, 0]), ch) for (x, y), (v, ch) in states.items()), key=lambda s: s[0])
        out = []
        while chain:
            chain, sign = chain
            out.append(sign)
        return "".join(reversed(out))


def _touched(token: str) -> bool:
    return _TOUCHED.search(token) is not None and _LETTER.search(token) is not None


class Reader:
    """Words of a text as written and as restored. What a token gives is kept (`most` tokens at most)."""

    def __init__(self, restore: Restorer, keep=None, most: int = 300_000):
        self.restore, self.keep, self.most = restore, keep, most
        self.known: dict[str, tuple] = {}

    def token(self, token: str, spaced: bool = False) -> tuple:
        got = self.known.get(token)
        if got is None:
            words = set(_WORD.findall(token))
            if spaced or _touched(token):
                words.update(_WORD.findall(self.restore(token)))
                bare = token.strip(_OUTER)
                if bare != token and (spaced or _touched(bare)):
                    words.update(_WORD.findall(self.restore(bare)))
            got = tuple(words if self.keep is None else [self.keep[w] for w in words if w in self.keep])
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[token] = got
        return got

    def __call__(self, text: str | None) -> set:
        """Distinct words, or their numbers in `keep`."""
        found: set = set()
        if text:
            low = text.lower()
            for t in set(low.split()):
                found.update(self.token(t))
            for m in _SPACED.finditer(low):
                if _LETTER.search(m.group(0)):
                    found.update(self.token(m.group(0), True))
        return found


@tidy
def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(27**3, np.int64)
    for batch in batches:
        for _, _, raw, _ in text_chunks(batch["text"]):
            x = np.concatenate([[0, 0], _CODE[LOWER[raw]], [0]])
            n += np.bincount(x[:-2] * 729 + x[1:-1] * 27 + x[2:], minlength=27**3)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["at", "n"])


class Labels:
    """How often an id is labelled clean and toxic."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.n = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)

    def find(self, ids: pa.Array) -> list[tuple[int, int, int]]:
        """(row, clean, toxic) of the labelled rows of a batch."""
        asked = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.ids, asked), len(self.ids) - 1)
        rows = np.flatnonzero(self.ids[at] == asked)
        return [(int(k), *map(int, self.n[at[k]])) for k in rows]


@tidy
def _word_counts(batches: Iterator[pa.RecordBatch], restore, labels) -> Iterator[pa.RecordBatch]:
    """Texts with each word, by label; a task's share."""
    read, n = Reader(restore.value), {}
    for batch in batches:
        texts = batch["text"]
        for k, clean, toxic in labels.value.find(batch["doc_id"]):
            for w in read(texts[k].as_py()):
                a, b = n.get(w, (0, 0))
                n[w] = (a + clean, b + toxic)
        if len(n) > 500_000:
            yield _counted(n)
            n = {}
    yield _counted(n)


def _counted(n: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(n), pa.string()), pa.array([a for a, _ in n.values()], pa.int64()), pa.array([b for _, b in n.values()], pa.int64())], ["word", "clean", "toxic"]
    )


class Scorer:
    """Logistic model over the telling words: one input each, and how many a text has."""

    def __init__(self, words: list[str]):
        self.at = {w: i for i, w in enumerate(words)}
        self.weights, self.bias = np.zeros(len(words)), -20.0

    def fit(self, rows: list[list[int]], toxic: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> None:
        x = np.zeros((len(rows), len(self.at)), np.float32)
        for i, r in enumerate(rows):
            x[i, r] = 1
        w, b = np.zeros(x.shape[1]), math.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))
        g2, gb2 = np.full(x.shape[1], 1e-8), 1e-8
        for _ in range(rounds):  # AdaGrad, whole batch
            e = (1 / (1 + np.exp(-(x @ w + b))) - toxic) / len(rows)
            g, gb = x.T @ e + decay * w, e.sum()
            g2 += g * g
            gb2 += gb * gb
            w, b = w - rate * g / np.sqrt(g2), b - rate * gb / math.sqrt(gb2)
        self.weights, self.bias = w, float(b)

    def score(self, hits: list[int]) -> float:
        t = self.bias + float(self.weights[hits].sum())
        return 1 / (1 + math.exp(-min(max(t, -50.0), 50.0)))


@tidy
def _hit_rows(batches: Iterator[pa.RecordBatch], restore, labels, scorer: Scorer) -> Iterator[pa.RecordBatch]:
    read = Reader(restore.value, scorer.at)
    for batch in batches:
        got = [(batch["doc_id"][k].as_py(), sorted(read(batch["text"][k].as_py())), t) for k, c, b in labels.value.find(batch["doc_id"]) for t in [0] * c + [1] * b]
        yield pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.int32())], ["doc_id", "hits", "toxic"]
        )


@tidy
def _score(batches: Iterator[pa.RecordBatch], restore, model, parts: int, held: int, keep: dict[str, str]) -> Iterator[pa.RecordBatch]:
    scorer: Scorer | None = model.value
    read = Reader(restore.value, scorer.at if scorer else {})
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        score = [scorer.score(sorted(read(t))) if scorer else 0.0 for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": pa.array([fold(i, parts) == held for i in ids], pa.bool_()), "score": pa.array(score, pa.float64())} | {c: batch[s] for c, s in keep.items()})


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, parts: int = 4, held: int = 2, label_rows: int = 200_000, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, kept_* of the columns in `keep`) for every row of `docs`; label_rows and sample_rows bound what is learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    learn = rows.where(fold_column(F.col("doc_id"), parts) != held)
    counts = np.zeros(27**3, np.int64)
    for at, n in learn.select("text").mapInArrow(_letters, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # 19,683 at most
        counts[at] = n
    restore = spark.sparkContext.broadcast(Restorer(counts))
    marks = marks.where(fold_column(F.col("doc_id"), parts) != held).groupBy("doc_id").agg(
        F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")
    )
    share = min(1.0, label_rows / max(1, marks.count()))
    grain, key = 1 << 20, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    known = marks.where(key < int(share * grain) + 1).select("doc_id", "clean", "toxic")
    rows_known = [tuple(map(int, r)) for r in zip(*(c.to_pylist() for c in known.toArrow().columns), strict=True)]  # label_rows
    bad, good = max(1, sum(r[2] for r in rows_known)), max(1, sum(r[1] for r in rows_known))
    model: Scorer | None = None
    if rows_known:
        found = spark.sparkContext.broadcast(Labels(rows_known))
        words = learn.mapInArrow(partial(_word_counts, restore=restore, labels=found), "word string, clean long, toxic long")
        words = words.groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(f"t >= {LEAST_TEXTS}")
        p, q = F.col("t") / bad, F.col("c") / good
        told = words.withColumn("z", (p - q) / F.sqrt((F.col("t") + 1) / (bad * bad) + (F.col("c") + 1) / (good * good)) * F.log((p + 0.5 / bad) / (q + 0.5 / good)))
        telling = [r["word"] for r in told.where("z > 0").orderBy(F.desc("z"), "word").limit(TELLING).select("word").collect()]
        model = Scorer(telling)
        few = min(1.0, share * sample_rows / len(rows_known))
        sample = learn.where(key < int(few * grain) + 1)
        got = sorted(map(tuple, sample.mapInArrow(partial(_hit_rows, restore=restore, labels=found, scorer=model), "doc_id long, hits array<int>, toxic int").collect()))
        model.fit([list(h) for _, h, _ in got], np.array([t for _, _, t in got], float))
    sent = spark.sparkContext.broadcast(model)  # TELLING words
    kept, source, kinds = kept_columns(docs, keep, text_col)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept)
    scored = read.mapInArrow(partial(_score, restore=restore, model=sent, parts=parts, held=held, keep=source), "doc_id long, held_out boolean, score double" + kinds)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
