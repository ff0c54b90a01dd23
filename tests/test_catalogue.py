"""Every query with SQL agrees with DuckDB on the smallest tables; the others with numpy on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest
from test_clusters import _whole
from test_exact import _likelihood
from test_library import _naive_clusters, _naive_progressive

from genoweft.operators import kernels
from genoweft.plans import catalogue
from genoweft.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def _plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    found = sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 for x, y in zip(a, b, strict=True)), (a, b)


# ---------------------------------------------------------------- queries that SQL does not state


@pytest.fixture(scope="module")
def samples(spark):
    """Cells and the dense values of each sample."""
    out: dict = {}
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect():
        out.setdefault(r["label"], ([], []))
        out[r["label"]][0].append(r["vec_id"])
        out[r["label"]][1].append(np.maximum(np.array(r["embedding"], float), 0))
    return {s: (np.array(ids), np.array(x)) for s, (ids, x) in out.items() if s is not None}


@pytest.fixture(scope="module")
def fits(samples):
    out = {}
    for s, (ids, x) in samples.items():
        y = np.log1p(1e4 * x / np.where(x.sum(1, keepdims=True) == 0, 1, x.sum(1, keepdims=True)))
        y = np.minimum(y, np.quantile(y, 0.999))
        if len(ids) >= 10:
            out[s] = [(k, *kernels.nmf(y, k, tol=1e-4, max_iter=300, ids=ids)) for k in (2, 3)]
    return out


def test_nmf_factors(spark, fits):
    want = {(s, k, p, g): h[p, g] for s, own in fits.items() for k, _, h in own for p in range(k) for g in range(64)}
    got = {(r["sample_id"], r["k"], r["pos"], r["gene_idx"]): r["loading"] for r in QUERIES["nmf_factors"](spark, DATA).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_nmf_cells(spark, samples, fits):
    want = {(int(samples[s][0][i]), (k - 2) * 2 + p): w[i, p] for s, own in fits.items() for k, w, _ in own for i in range(len(w)) for p in range(k)}
    got = {(r["cell_id"], r["local_idx"]): r["score"] for r in QUERIES["nmf_cell_scores"](spark, DATA).collect()}
    wide = {(r["cell_id"], n): r[f"F{n}"] for r in QUERIES["factor_scores_wide"](spark, DATA).collect() for n in range(5)}
    for found in (got, wide):
        assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-4


@pytest.fixture(scope="module")
def graph(spark):
    """Factors, their samples, loadings and the similarities of at least 0.25, as matrices."""
    long = catalogue.factors(spark, DATA).select("factor_id", "sample_id", "gene_idx", "loading").collect()
    ids = sorted({r["factor_id"] for r in long})
    assert ids == list(range(len(ids)))
    x, own = np.zeros((len(ids), 64)), np.zeros(len(ids), int)
    for r in long:
        x[r["factor_id"], r["gene_idx"]], own[r["factor_id"]] = r["loading"], r["sample_id"]
    s = np.zeros((len(ids), len(ids)))
    for r in catalogue.edges(spark, DATA).where("sim >= 0.25").collect():
        s[r["i"], r["j"]] = s[r["j"], r["i"]] = r["sim"]
    return x, own, s


def _placed(s, labels):
    return [(f // 3, p, at) for f, p, at in _whole(s, labels, True)]


def _rows(df):
    return sorted((r["factor_id"], r["program"], r["display_pos"]) for r in df.collect())


def test_cluster_centroid(spark, graph):
    _, own, s = graph
    assert _rows(QUERIES["cluster_centroid"](spark, DATA)) == _placed(s, _naive_clusters(s, own, 0.1, 2, False))


def test_cluster_progressive(spark, graph):
    x, own, s = graph
    sets = [set(np.argsort(r, kind="stable")[-catalogue.TOP :].tolist()) for r in x]
    assert _rows(QUERIES["cluster_progressive"](spark, DATA)) == _placed(s, np.array(_naive_progressive(sets, x, own, catalogue.TOP, 8, 1, 2)))


@pytest.mark.parametrize(("name", "metric"), [("threshold_sweep", "ratio"), ("sweep_curve", "delta")])
def test_sweeps(spark, graph, name, metric):
    _, own, s = graph
    got = {round(r["threshold"], 9): r["metric"] for r in QUERIES[name](spark, DATA).collect()}
    for t in [round(i / 20, 9) for i in range(21)]:
        labels = _naive_clusters(s, own, t, 2, False)
        kept = np.flatnonzero(labels >= 0)
        names = np.unique(labels[kept])
        if not 2 <= len(names) < len(kept):
            assert got[t] is None
            continue
        same, part = labels[kept][:, None] == labels[kept][None], s[np.ix_(kept, kept)]
        a, b = part[same].mean(), part[~same].mean()
        want = a - b if metric == "delta" else a / b if b > 0 else None
        assert got[t] is None if want is None else math.isclose(got[t], want, rel_tol=1e-9)


def test_gmm_threshold(spark):
    values = np.array([r["max_sim"] for r in catalogue.maxima(spark, DATA).collect()])
    assert abs(QUERIES["gmm_threshold"](spark, DATA).first()["threshold"] - kernels.crossover(values)) <= 1 / 499 + 1e-4


def test_associate_lmm(spark):
    rows = catalogue.sample_scores(spark, DATA).orderBy("sample_id").collect()
    got = {r["program"]: r for r in QUERIES["associate_lmm"](spark, DATA).collect()}
    for p in range(5):
        y = np.array([r[f"P{p}"] for r in rows])
        y, x, groups = (y - y.mean()) / y.std(ddof=1), np.array([[1.0, r["age"]] for r in rows]), [r["study"] for r in rows]
        ratio = min(np.concatenate([[0], np.logspace(-6, 6, 6001)]), key=lambda r: _likelihood(r, x, y, groups, True)[0])
        _, beta, se = _likelihood(ratio, x, y, groups, True)
        assert abs(got[f"P{p}"]["beta"] - beta[1]) < 2e-4 and abs(got[f"P{p}"]["se"] - se[1]) < 2e-4


def test_classify_cells(spark):
    """Labels follow from scores and p-values; the null is the mean expression of drawn cells."""
    rows = QUERIES["classify_cells"](spark, DATA).collect()
    scores = {(r["cell_id"], r["program"]): r["score"] for r in catalogue.cell_scores(spark, DATA).collect()}
    cells: dict = {}
    for r in rows:
        cells.setdefault(r["cell_id"], []).append(r)
    assert len(rows) == len(scores)
    for cell, own in cells.items():
        hit = [(scores[cell, r["program"]], -r["program"]) for r in own if r["padj"] < 0.05]
        assert {r["label"] for r in own} == {f"C{-max(hit)[1]}" if hit else "unresolved"}
    order = sorted(((scores[r["cell_id"], r["program"]], r["padj"]) for r in rows if r["program"] == 0), reverse=True)
    assert all(a[1] <= b[1] + 1e-6 for a, b in zip(order, order[1:], strict=False))  # higher scores, lower p-values


def test_every_query_is_checked():
    told = {"nmf_factors", "nmf_cell_scores", "factor_scores_wide", "cluster_centroid", "cluster_progressive", "threshold_sweep", "sweep_curve", "gmm_threshold", "associate_lmm", "classify_cells"}
    assert set(QUERIES) - set(ORACLES) == told
