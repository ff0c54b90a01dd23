"""Language identification by a byte convolutional network, in numpy.

A text's UTF-8 bytes (A-Z lowered) are cut into windows of WINDOW bytes that overlap by the
widest filter less one, so that every stretch of bytes is seen once. Bytes are embedded, filters
of widths 2, 3 and 4 slide over them, each filter's maximum over the window passes a rectifier,
and a softmax gives the language. A text's probabilities are the means over its windows, by
their bytes. The net is trained with Adam on windows spread evenly over the texts of a bounded
sample (`sample_per_lang` texts of each language, `sample_rows` of all, by hash of the id). All
languages are learned, however many; their names and counts, one row each, go to the driver.

Edge cases: null texts and texts without a letter are `und` with score 0; with no labelled row
to learn from all texts are `und`; null ids are scored and are not held out nor learned from;
repeated rows stay; texts of any length are read whole; an empty table gives an empty result;
other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, fold_column, kept_columns, text_chunks, tidy

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
STEP = WINDOW - max(WIDTHS) + 1
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


class ByteNet:
    """Embedding, filters and softmax; filters narrower than the widest hold zeros."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((wide, EMBED, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(wide * EMBED, n)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.2, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _spread(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows]
        return np.concatenate([x[:, k : k + STEP] for k in range(max(WIDTHS))], 2)

    def forward(self, windows: np.ndarray):
        spread = self._spread(windows)
        y = spread @ self.filters  # a product for each window: rounded alike wherever it lies
        pooled = y.max(1) + self.bias
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        e = np.exp(z - z.max(1, keepdims=True))
        return spread, y, pooled, e / e.sum(1, keepdims=True)

    def train(self, windows: np.ndarray, target: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.004, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                w, t = windows[rows], target[rows]
                spread, y, pooled, p = self.forward(w)
                dz = p.copy()
                dz[np.arange(len(rows)), t] -= 1
                dz /= len(rows)
                d = (dz @ self.out.T) * (pooled > 0)
                at = y.argmax(1)
                seen = spread[np.arange(len(rows))[:, None], at]  # rows, filters, wide * embed
                grad = {
                    "out": np.maximum(pooled, 0).T @ dz, "out_bias": dz.sum(0), "bias": d.sum(0),
                    "filters": np.einsum("bf,bfk->kf", d, seen) * self.mask, "embed": np.zeros_like(self.embed),
                }
                back = (d[:, :, None] * self.filters.T[None]).reshape(len(rows), d.shape[1], max(WIDTHS), EMBED)
                bytes_at = w[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
                np.add.at(grad["embed"], bytes_at.ravel(), back.reshape(-1, EMBED))
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(self, k, (getattr(self, k) - rate * fix * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32))

    def probabilities(self, windows: np.ndarray, block: int = 256) -> np.ndarray:
        out = [self.forward(windows[a : a + block])[3] for a in range(0, len(windows), block)]
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)


def cut_windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each text, zero-padded at its end: bytes, text number, bytes that are its own."""
    size = np.diff(offs)
    n = np.maximum(1, -(-np.maximum(size - (WINDOW - STEP), 0) // STEP)) * (size > 0)
    doc = np.repeat(np.arange(len(size)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = offs[doc] + place * STEP
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < offs[doc + 1][:, None]
    windows = np.where(inside, buf[np.minimum(at, max(0, len(buf) - 1))], 0) if len(buf) else np.zeros((0, WINDOW), np.uint8)
    return windows.astype(np.uint8), doc, np.minimum(offs[doc + 1] - begin, STEP)


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter, of any script."""
    upto = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    found = upto[offs[1:]] > upto[offs[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offs) > 0)):
        found[i] = any(c.isalpha() for c in buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


@tidy
def _sample_windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offs in text_chunks(batch["text"], 1 << 19):
            buf = LOWER[raw]
            windows, doc, _ = cut_windows(buf, offs)
            keep = []
            for i in np.flatnonzero(has_letter(buf, offs)):
                own = np.flatnonzero(doc == i) if len(offs) < 50 else np.arange(np.searchsorted(doc, i), np.searchsorted(doc, i, "right"))
                keep.append(own[np.unique(np.linspace(0, len(own) - 1, most).astype(int))])
            keep = np.concatenate(keep) if keep else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"lang": batch["lang"].slice(a, b - a).take(pa.array(doc[keep])), "bytes": pa.array([w.tobytes() for w in windows[keep]], pa.binary())})


def fit(docs: DataFrame, parts: int, held: int, sample_per_lang: int, windows_per_text: int, sample_rows: int) -> ByteNet | None:
    """The net, from at most about sample_per_lang texts of each language whose fold is not `held`."""
    learn = docs.where((fold_column(F.col("doc_id"), parts) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return None
    grain, sample_per_lang = 1 << 20, max(1, min(sample_per_lang, sample_rows // len(counts)))
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(grain, sample_per_lang * grain // n + 1)))])
    sample = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < rate[F.col("lang")]).select("lang", "text")
    got = sample.mapInArrow(partial(_sample_windows, most=windows_per_text), "lang string, bytes binary").toArrow()
    if not len(got):
        return None
    langs = sorted(set(got["lang"].to_pylist()))
    target = np.array([langs.index(x) for x in got["lang"].to_pylist()])
    windows = np.frombuffer(b"".join(got["bytes"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    order = np.lexsort((*windows.T, target))  # the order tasks end in tells nothing: what ties is the same
    net = ByteNet(langs)
    net.train(windows[order], target[order])
    return net


@tidy
def _predict(batches: Iterator[pa.RecordBatch], parts: int, held: int, model, keep: dict[str, str]) -> Iterator[pa.RecordBatch]:
    net: ByteNet | None = model.value
    for batch in batches:
        for a, b, raw, offs in text_chunks(batch["text"], 1 << 19):
            buf = LOWER[raw]
            pred, score = np.full(b - a, "und", object), np.zeros(b - a)
            if net is not None:
                windows, doc, size = cut_windows(buf, offs)
                p = net.probabilities(windows) * size[:, None]
                total = np.stack([np.bincount(doc, p[:, k], b - a) for k in range(p.shape[1])], 1)
                some = np.flatnonzero(has_letter(buf, offs))
                total = total[some] / np.maximum(np.bincount(doc, size, b - a)[some], 1)[:, None]
                if len(some):
                    pred[some] = np.array(net.langs, object)[total.argmax(1)]
                    score[some] = np.clip(total.max(1), 0, 1)
            ids = batch["doc_id"].slice(a, b - a)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids, "held_out": pa.array([fold(i, parts) == held for i in ids.to_pylist()], pa.bool_()), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)} | {c: batch[s].slice(a, b - a) for c, s in keep.items()}
            )


def identify(docs: DataFrame, parts: int = 5, held: int = 0, sample_per_lang: int = 600, windows_per_text: int = 8, sample_rows: int = 60_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, kept_* of the columns in `keep`) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, parts, held, sample_per_lang, windows_per_text, sample_rows))  # a few thousand numbers
    kept, sent, kinds = kept_columns(docs, keep, text_col)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept)
    return read.mapInArrow(
        partial(_predict, parts=parts, held=held, model=model, keep=sent), "doc_id long, held_out boolean, lang_pred string, score double" + kinds
    )


def op5_byte_cnn(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
