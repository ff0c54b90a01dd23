"""Clustering by connected parts, progressive clustering by postings and leaf order per program,
against one whole matrix."""

from __future__ import annotations

import numpy as np
import pytest
from test_library import _naive_clusters, _naive_progressive

from genoweft.operators import core, graph, kernels, programs


def _parts(seed, sizes=(9, 7, 5, 2, 1, 1), high=1.0):
    """A similarity matrix of several connected parts, with ties, and the samples of its factors."""
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    s, a = np.zeros((n, n)), 0
    for size in sizes:
        s[a : a + size, a : a + size] = np.round(high * rng.random((size, size)), 1) * (rng.random((size, size)) < 0.7)
        for i in range(a, a + size - 1):
            s[i, i + 1] = max(s[i, i + 1], 0.1)
        a += size
    mix = rng.permutation(n)
    s = np.triu(s, 1)[np.ix_(mix, mix)]
    s = np.maximum(s, s.T)
    return s, rng.integers(0, 4, n)


def _tables(spark, s, samples):
    n = len(s)
    nodes = spark.createDataFrame([(3 * i, int(samples[i])) for i in range(n)], "factor_id int, sample_id long")
    return nodes, spark.createDataFrame([(3 * i, 3 * j, float(s[i, j])) for i in range(n) for j in range(i + 1, n) if s[i, j]] or [(0, 0, 0.0)], "i int, j int, sim double")


def _whole(s, labels, reorder, method="average"):
    """(factor, program, position) of one whole matrix."""
    names, size = np.unique(labels[labels >= 0], return_counts=True)
    order = []
    for c in names[np.lexsort((names, -size))] if reorder else []:
        own = np.flatnonzero(labels == c)
        if len(own) > 2:
            d = 1.0 - s[np.ix_(own, own)]
            own = own[kernels.optimal_leaf_order(kernels.linkage_tree(d, method), d)[::-1]]
        elif len(own) == 2:
            own = own[np.argsort(-np.round(s[own].sum(1), 12), kind="stable")]
        order += own.tolist()
    order = order if reorder else np.flatnonzero(labels >= 0).tolist()
    new: dict = {}
    for i in order:
        new.setdefault(labels[i], len(new))
    return sorted((3 * i, new[labels[i]], at) for at, i in enumerate(order))


def _got(df):
    return sorted((r["factor_id"], r["program"], r["display_pos"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "threshold", "few", "inter", "reorder", "method"), [(1, 0.2, 2, False, True, "average"), (2, 0.0, 1, False, True, "complete"), (3, 0.3, 2, True, True, "single"), (4, 0.1, 3, False, False, "average")])
def test_centroid_by_parts(spark, seed, threshold, few, inter, reorder, method):
    s, samples = _parts(seed)
    labels = _naive_clusters(s, samples, threshold, few, inter)
    got = programs.programs_centroid(*_tables(spark, s, samples), threshold, few, method, reorder, inter)
    assert _got(got) == _whole(s, labels, reorder, method) and len(_got(got)) > 0


@pytest.mark.parametrize(("metric", "few"), [("delta", 1), ("ratio", 2), ("silhouette", 1)])
def test_sweep_by_parts(spark, metric, few):
    s, samples = _parts(5)
    grid = [0.0, 0.15, 0.3, 0.45, 0.6, 0.75]
    got = {r["threshold"]: r for r in programs.programs_threshold(*_tables(spark, s, samples), grid, few, metric).collect()}
    values = []
    for t in grid:
        labels = _naive_clusters(s, samples, t, few, False)
        own = np.flatnonzero(labels >= 0)
        names, value = np.unique(labels[own]), None
        if 2 <= len(names) < len(own):
            part, lab = s[np.ix_(own, own)], labels[own]
            same = lab[:, None] == lab[None]
            if metric == "silhouette":
                d = 1 - part
                np.fill_diagonal(d, 0)
                if len(names) < len(own) - 1:
                    each = []
                    for i, c in enumerate(lab):
                        mine = (lab == c).sum()
                        if mine == 1:
                            each.append(0.0)
                            continue
                        a = d[i, lab == c].sum() / (mine - 1)
                        b = min(d[i, lab == o].mean() for o in names if o != c)
                        each.append((b - a) / max(a, b))
                    value = float(np.mean(each))
            else:
                inner, outer = part[same].mean(), part[~same].mean()
                value = inner - outer if metric == "delta" else inner / outer if outer > 0 else None
        values.append(value)
    assert [None if (v := got[t]["metric"]) is None else round(v, 9) for t in grid] == [None if v is None else round(float(v), 9) for v in values]
    assert any(v is not None for v in values) and sum(r["is_optimal"] for r in got.values()) == 1


def test_progressive_by_postings(spark):
    rng = np.random.default_rng(6)
    base = rng.random((4, 30)) ** 6
    x = np.concatenate([b + 0.1 * rng.random((5, 30)) for b in base])
    samples = rng.integers(0, 3, len(x))
    top = [np.argsort(r, kind="stable")[-8:] for r in x]
    labels = np.array(_naive_progressive([set(t.tolist()) for t in top], x, samples, 8, 4, 1, 2))
    long = spark.createDataFrame([(3 * i, int(samples[i]), g, float(x[i, g])) for i in range(len(x)) for g in range(30)], "factor_id int, sample_id long, gene_idx int, loading double")
    edges = core.similarity(long, top_k=8)
    s = np.array([[0.0 if i == j else len(set(a) & set(b)) / len(set(a) | set(b)) for j, b in enumerate(top)] for i, a in enumerate(top)])
    got = programs.programs_progressive(long, edges, 30, 8, 4, 1, 2)
    assert _got(got) == _whole(s, labels, True) and (labels >= 0).any()


def test_no_factor_at_all(spark):
    nodes, edges = spark.createDataFrame([], "factor_id int, sample_id long"), spark.createDataFrame([], "i int, j int, sim double")
    assert programs.programs_centroid(nodes, edges).count() == 0
    with pytest.raises(ValueError, match="no threshold"):
        programs.programs_threshold(nodes, edges)


def test_components_of_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(100) if i != 49] + [(500, 400), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "i int, j int")).collect()}
    assert got == {**{i: 0 for i in range(50)}, **{i: 50 for i in range(50, 101)}, 500: 400, 400: 400}
