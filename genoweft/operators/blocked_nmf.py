"""Factorisation of samples of any size, cut into blocks of cells.

x ~ w @ h of a sample needs, beside h, only sums over its cells: every block updates its rows of w from
h and adds a rank x rank and a rank x gene matrix; their sums give the next h. So the blocks of x are
written once, bucketed; a round is one job that joins each block with its rows of w (bucketed alike:
nothing is shuffled) and one that sums what the blocks add, first within each task. What the driver
holds is h: ranks x genes of a batch of samples, at most `most_model` bytes, never rows. A round's w is
a written table, so a lost executor costs that round's tasks only.

The start is that of the one-block kernel: right singular vectors from the genes x genes products of
the blocks, summed in strips, left ones block by block. Random starts hang on the cell's id, not on
where it lies. Both therefore agree with the kernel up to rounding, whatever the number of blocks.

Bounds: a block has about `block_entries` values, dense; the products of genes meet on the driver,
genes^2 x 8 bytes (2,000 genes: 32 MB).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Workspace
from . import kernels

BLOCK = "sample_id long, block long, cells binary, ends binary, genes binary, vals binary"
STATE = "sample_id long, block long, w array<binary>, sums array<binary>"
KEY = ("sample_id", "block")


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a, float).tobytes() for a in arrays)


def _dense(row, n_genes: int) -> np.ndarray:
    ends, genes, vals = np.frombuffer(row.ends, np.int64), np.frombuffer(row.genes, np.int32), np.frombuffer(row.vals)
    x = np.zeros((len(ends), n_genes))
    x[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), genes] = vals
    return x


def cut_blocks(rows: DataFrame, sizes: DataFrame, n_genes: int, block_entries: int) -> DataFrame:
    """BLOCK rows of rows(sample_id, cell_id, genes, values): cells dealt by the hash of their id."""
    per = max(1, block_entries // n_genes)
    dealt = rows.join(sizes.select("sample_id", F.ceil(F.col("n_cells") / per).alias("n")), "sample_id").withColumn("block", F.pmod(F.xxhash64("cell_id"), F.col("n")))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        genes = [np.empty(0, np.int32) if g is None else np.asarray(g, np.int32) for g in pdf["genes"]]
        vals = [np.empty(0) if v is None else np.asarray(v, float) for v in pdf["values"]]
        ends = np.cumsum([len(g) for g in genes], dtype=np.int64)
        return pd.DataFrame([(*key, pdf["cell_id"].to_numpy(np.int64).tobytes(), ends.tobytes(), np.concatenate(genes).tobytes(), np.concatenate(vals).tobytes())], columns=["sample_id", "block", "cells", "ends", "genes", "vals"])

    return dealt.groupBy("sample_id", "block").applyInPandas(pack, BLOCK)


def _summed(df: DataFrame, column: str) -> dict[tuple[int, int], np.ndarray]:
    """Sums of the arrays of doubles in `column`, by sample and place; summed in each task, then by key."""

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for s, values in zip(pdf["sample_id"], pdf[column], strict=True):
                for i, v in enumerate(values):
                    if v:
                        a = np.frombuffer(v)
                        held[s, i] = held[s, i] + a if (s, i) in held else a
        if held:
            yield pd.DataFrame([(s, i, a.tobytes()) for (s, i), a in held.items()], columns=["sample_id", "i", "v"])

    def across(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, sum(np.frombuffer(v) for v in pdf["v"]).tobytes())], columns=["sample_id", "i", "v"])

    kind = "sample_id long, i int, v binary"
    parts = df.select("sample_id", column).mapInPandas(within, kind)
    return {(r["sample_id"], r["i"]): np.frombuffer(bytes(r["v"])) for r in parts.groupBy("sample_id", "i").applyInPandas(across, kind).collect()}


class _Model:
    """What the driver holds of one sample and rank."""

    def __init__(self, n: int, n_genes: int, rank: int, until: kernels.Convergence):
        self.n, self.n_genes, self.rank, self.until = n, n_genes, rank, until
        self.h = np.zeros((rank, n_genes))

    def split(self, flat: np.ndarray, solver: str, loss: str) -> list[np.ndarray]:
        k, m = self.rank, self.n_genes
        shapes = [(k, k), (k, m), (1,)] if solver == "cd" else [(k, k), (k, m)] if loss == "frobenius" else [(k,), (k, m)] if loss == "kullback-leibler" else [(k, m), (k, m)]
        out, at = [], 0
        for s in shapes:
            size = int(np.prod(s))
            out.append(flat[at : at + size].reshape(s))
            at += size
        return out


def fit_blocks(rows: DataFrame, sizes: DataFrame, n_genes: int, k: Sequence[int], solver: str, loss: str, init: str, alpha: float, l1_ratio: float, tol: float, max_iter: int, keep_scores: bool, seed: int, block_entries: int, most_model: int = 1 << 26) -> list[DataFrame]:
    """Records of FACTORS, one table a batch of samples, of rows(sample_id, cell_id, genes, values) of the
    samples in sizes(sample_id, n_cells)."""
    spark = rows.sparkSession
    counts = {r["sample_id"]: r["n_cells"] for r in sizes.select("sample_id", "n_cells").collect()}  # samples, not cells
    per = max(1, most_model // (8 * n_genes * max(n_genes, 4 * sum(k))))
    names = sorted(counts)
    work = Workspace(spark, "nmf")
    out = []
    for i in range(0, len(names), per):
        own = names[i : i + per]
        part = rows.where(F.col("sample_id").isin(own))
        some = sizes.where(F.col("sample_id").isin(own))
        out.append(_fit_batch(work, part, some, {s: counts[s] for s in own}, n_genes, k, solver, loss, init, alpha, l1_ratio, tol, max_iter, keep_scores, seed, block_entries))
    return out


def _fit_batch(work: Workspace, rows, sizes, counts, n_genes, k, solver, loss, init, alpha, l1_ratio, tol, max_iter, keep_scores, seed, block_entries) -> DataFrame:
    spark = rows.sparkSession
    for n in counts.values():
        for rank in k:
            kernels.check_nmf(n, n_genes, rank, solver, loss, init)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = work.write(cut_blocks(rows, sizes, n_genes, block_entries), buckets, KEY)
    models = {(s, i): _Model(n, n_genes, rank, kernels.Convergence(solver, tol, max_iter)) for s, n in counts.items() for i, rank in enumerate(k)}

    totals = _summed(x.select("sample_id", F.array("vals").alias("v")).mapInPandas(_block_totals, "sample_id long, v array<binary>"), "v")
    mean = {s: float(totals[s, 0][0]) / (n * n_genes) if (s, 0) in totals else 0.0 for s, n in counts.items()}
    for (s, _), m in models.items():
        m.until.done = m.until.done or mean[s] == 0
    live = [s for s in counts if mean[s] != 0]

    left: dict[int, tuple] = {}
    if init != "random" and live:
        strip = max(1, (1 << 20) // n_genes)
        gram = _summed(x.mapInPandas(_products(n_genes, strip, live), "sample_id long, v array<binary>"), "v")
        for s in live:
            g = np.concatenate([gram[s, i].reshape(-1, n_genes) for i in range(-(-n_genes // strip))])
            value, vector = np.linalg.eigh((g + g.T) / 2)
            top = np.argsort(-value)[: max(k)]
            left[s] = (vector[:, top].T, np.sqrt(np.maximum(value[top], 0)))
        sides = _summed(x.mapInPandas(_left_sizes(n_genes, left), "sample_id long, v array<binary>"), "v")
    starts: dict[tuple[int, int], tuple] = {}
    for (s, i), m in models.items():
        if s not in live:
            continue
        genes = np.arange(n_genes)
        if init == "random":
            scale = np.sqrt(mean[s] / m.rank)
            m.h = np.abs(scale * kernels.hashed_normals(seed + 1, genes, m.rank)).T
            starts[s, i] = (None, scale)
        else:
            v, sv = left[s][0][: m.rank], left[s][1][: m.rank]
            both = sides[s, 0].reshape(2, -1)[:, : m.rank]
            sign, factor, h = kernels.singular_parts(v, sv, both[0], both[1])
            m.h = kernels.fill_zeros(h.T, mean[s], kernels.FILLS[init], seed + 1, genes).T
            starts[s, i] = (_projector(v, sv), sign, factor)
    w = work.write(x.mapInPandas(_first_rows(n_genes, k, starts, mean, init, seed), STATE), buckets, KEY)

    while any(not m.until.done for m in models.values()):
        sent = spark.sparkContext.broadcast({key: (m.h, kernels.penalties(alpha, l1_ratio, n_genes)) for key, m in models.items() if not m.until.done})
        both = x.join(w.select(*KEY, "w"), list(KEY))
        after = work.write(both.mapInPandas(_round(n_genes, len(k), sent, solver, loss), STATE), buckets, KEY)
        for key, flat in _summed(after, "sums").items():
            m = models[key]
            m.h, moved = kernels.nmf_columns(m.h, m.split(flat, solver, loss), solver, loss, *kernels.penalties(alpha, l1_ratio, m.n))
            m.until.stepped(moved)
        sent.unpersist()
        work.drop(w)
        w = after
        asked = {key: m.h for key, m in models.items() if key in sent.value and m.until.wants_error()}
        if asked:
            sent = spark.sparkContext.broadcast(asked)
            squares = _summed(x.join(w.select(*KEY, "w"), list(KEY)).mapInPandas(_errors(n_genes, len(k), sent), "sample_id long, v array<binary>"), "v")
            for key, v in squares.items():
                models[key].until.told(float(v[0]))
            sent.unpersist()

    genes = pd.concat([
        pd.DataFrame({"record": "gene", "sample_id": s, "k": m.rank, "k_idx": i, "pos": np.repeat(np.arange(m.rank), n_genes), "item": np.tile(np.arange(n_genes), m.rank), "value": m.h.ravel()})
        for (s, i), m in models.items()
    ])
    from .core import FACTORS

    found = spark.createDataFrame(genes, FACTORS)
    if keep_scores:
        found = found.unionByName(x.select(*KEY, "cells").join(w.select(*KEY, "w"), list(KEY)).mapInPandas(_scores(list(k)), FACTORS))
    return found


def _projector(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    """x @ this = left singular vectors; directions of no size give zeros."""
    return v.T / np.where(s > 1e-12 * max(s.max(initial=0), 1e-300), s, np.inf)


def _block_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"sample_id": pdf["sample_id"], "v": [[np.array([np.frombuffer(v[0]).sum()]).tobytes()] for v in pdf["v"]]})


def _products(n_genes: int, strip: int, live: list):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                if row.sample_id in live:
                    x = _dense(row, n_genes)
                    yield pd.DataFrame([(row.sample_id, [_pack(x[:, i : i + strip].T @ x) for i in range(0, n_genes, strip)])], columns=["sample_id", "v"])

    return run


def _left_sizes(n_genes: int, left: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                if row.sample_id in left:
                    u = _dense(row, n_genes) @ _projector(*left[row.sample_id])
                    yield pd.DataFrame([(row.sample_id, [_pack((np.maximum(u, 0) ** 2).sum(0), (np.maximum(-u, 0) ** 2).sum(0))])], columns=["sample_id", "v"])

    return run


def _first_rows(n_genes: int, k: Sequence[int], starts: dict, mean: dict, init: str, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, ws = np.frombuffer(row.cells, np.int64), []
                for i, rank in enumerate(k):
                    start = starts.get((row.sample_id, i))
                    if start is None:
                        w = np.zeros((len(ids), rank))
                    elif start[0] is None:
                        w = np.abs(start[1] * kernels.hashed_normals(seed, ids, rank))
                    else:
                        w = kernels.fill_zeros(kernels.left_start(_dense(row, n_genes) @ start[0], start[1], start[2]), mean[row.sample_id], kernels.FILLS[init], seed, ids)
                    ws.append(_pack(w))
                yield pd.DataFrame([(row.sample_id, row.block, ws, [])], columns=["sample_id", "block", "w", "sums"])

    return run


def _round(n_genes: int, n_ranks: int, sent, solver: str, loss: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                x, ws, sums = None, list(row.w), [None] * n_ranks
                for i in range(n_ranks):
                    if (row.sample_id, i) in sent.value:
                        h, penalty = sent.value[row.sample_id, i]
                        x = _dense(row, n_genes) if x is None else x
                        w, more = kernels.nmf_rows(x, np.frombuffer(ws[i]).reshape(len(x), -1), h, solver, loss, *penalty)
                        ws[i], sums[i] = _pack(w), _pack(*more)
                yield pd.DataFrame([(row.sample_id, row.block, ws, sums)], columns=["sample_id", "block", "w", "sums"])

    return run


def _errors(n_genes: int, n_ranks: int, sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                asked = [i for i in range(n_ranks) if (row.sample_id, i) in sent.value]
                if asked:
                    x = _dense(row, n_genes)
                    v = [_pack(np.array([kernels.nmf_error(x, np.frombuffer(row.w[i]).reshape(len(x), -1), sent.value[row.sample_id, i])])) if i in asked else None for i in range(n_ranks)]
                    yield pd.DataFrame([(row.sample_id, v)], columns=["sample_id", "v"])

    return run


def _scores(k: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids = np.frombuffer(row.cells, np.int64)
                for i, rank in enumerate(k):
                    w = np.frombuffer(row.w[i]).reshape(len(ids), rank).T
                    yield pd.DataFrame({"record": "cell", "sample_id": row.sample_id, "k": rank, "k_idx": i, "pos": np.repeat(np.arange(rank), len(ids)), "item": np.tile(ids, rank), "value": w.ravel()})

    return run
