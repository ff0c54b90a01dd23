"""Factorisation in blocks agrees with the one-block kernel, whatever the number of blocks."""

from __future__ import annotations

import numpy as np
import pytest

from genoweft.operators import core, kernels

GENES = 12


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    rows, cells = [], []
    for sample, n in ((1, 90), (2, 8), (3, 77)):
        x = rng.random((n, 3)) @ (rng.random((3, GENES)) * (rng.random((3, GENES)) > 0.5)) + 0.01 * rng.random((n, GENES))
        x[rng.random(x.shape) < 0.2] = 0
        if sample == 3:
            x[5] = 0  # a cell without any value
        for i in range(n):
            cells.append((sample * 1000 + 7 * i, sample))
            rows += [(sample * 1000 + 7 * i, sample, g, float(x[i, g])) for g in range(GENES) if x[i, g] > 0]
    return spark.createDataFrame(rows, "cell_id long, sample_id long, gene_idx int, value double"), spark.createDataFrame(cells, "cell_id long, sample_id long")


def _fit(tables, entries, **kw):
    plain = dict(k=(2, 3), min_cells=5, normalize=False, log1p=False, clip_quantile=None, center=False, keep_scores=True, tol=1e-9)
    out = core.nmf_fit(*tables, GENES, block_entries=entries, **(plain | kw)).collect()
    return {(r["record"], r["sample_id"], r["k"], r["pos"], r["item"]): r["value"] for r in out}


@pytest.mark.parametrize(("entries", "kw"), [
    (13 * GENES, dict(max_iter=8)),
    (40 * GENES, dict(max_iter=6, init="nndsvdar", alpha=0.01, l1_ratio=0.5)),
    (13 * GENES, dict(max_iter=10, solver="mu", loss="kullback-leibler", init="random")),
    (13 * GENES, dict(max_iter=4, solver="mu", loss="itakura-saito", init="random")),
    (13 * GENES, dict(max_iter=4, solver="mu", init="nndsvd")),
])
def test_blocks_agree_with_the_kernel(tables, entries, kw):
    want, got = _fit(tables, 10**9, **kw), _fit(tables, entries, **kw)
    assert got.keys() == want.keys() and len(want) == 5 * (3 * GENES + 175)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_blocks_stop_when_the_kernel_does(tables):
    kw = dict(tol=0.05, max_iter=500, k=(2,))
    want, got = _fit(tables, 10**9, **kw), _fit(tables, 30 * GENES, **kw)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert max(abs(want[k] - v) for k, v in _fit(tables, 10**9, **(kw | dict(tol=1e-12, max_iter=40))).items()) > 1e-6


def test_a_sample_without_values(spark, tables):
    cells = tables[1].where("sample_id <> 2")
    empty = tables[0].where("sample_id = 1")
    got = _fit((empty, cells), 13 * GENES, max_iter=2)
    assert all(v == 0 for (_, s, *_), v in got.items() if s == 3) and any(v > 0 for v in got.values())
    with pytest.raises(ValueError, match="exceeds"):
        core.nmf_fit(*tables, GENES, (13,), block_entries=13 * GENES)


def test_random_numbers_hang_on_ids_alone():
    ids = np.array([5, 900, -3, 12])
    whole = kernels.hashed_normals(9, ids, 4)
    assert np.array_equal(whole[2:], kernels.hashed_normals(9, ids[2:], 4))
    many = kernels.hashed_normals(1, np.arange(200_000), 2)
    assert abs(many.mean()) < 0.01 and abs(many.std() - 1) < 0.01 and abs(np.corrcoef(many.T)[0, 1]) < 0.01
