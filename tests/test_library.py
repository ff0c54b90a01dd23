"""The library against brute force on small tables, and its error contract."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoweft.functions.stats import adjust_pvalues
from genoweft.operators import core, kernels, programs, scoring
from genoweft.sources import gene_sets

# ---------------------------------------------------------------- kernels


def _low_rank(n=60, m=40, k=3, seed=0):
    rng = np.random.default_rng(seed)
    w, h = rng.random((n, k)), np.zeros((k, m))
    for j in range(k):
        h[j, j * m // k : (j + 1) * m // k] = 1 + rng.random(m // k if j < k - 1 else m - (k - 1) * m // k)[: len(h[j, j * m // k : (j + 1) * m // k])]
    return w @ h, w, h


@pytest.mark.parametrize("init", kernels.INITS)
@pytest.mark.parametrize("solver", ["cd", "mu"])
def test_nmf_finds_low_rank(init, solver):
    x, _, h = _low_rank()
    w, g = kernels.nmf(x, 3, solver, init=init, tol=1e-10, max_iter=4000)
    assert (w >= 0).all() and (g >= 0).all()
    # Multiplicative steps cannot leave the zeros of a plain SVD start.
    assert np.linalg.norm(x - w @ g) < (0.02 if solver == "cd" or init != "nndsvd" else 0.3) * np.linalg.norm(x)
    if solver == "cd":
        unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
        assert ((unit(h) @ unit(g).T).max(1) > 0.98).all()


@pytest.mark.parametrize(("loss", "value"), [
    ("frobenius", lambda x, y: ((x - y) ** 2).sum()),
    ("kullback-leibler", lambda x, y: (np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / y), 0) - x + y).sum()),
    ("itakura-saito", lambda x, y: (x / y - np.log(x / y) - 1).sum()),
])
def test_nmf_loss_never_rises(loss, value):
    x = np.random.default_rng(1).random((20, 15)) + 0.1
    at = [value(x, np.matmul(*kernels.nmf(x, 4, "mu", loss, "random", tol=0, max_iter=n)) + 1e-12) for n in (1, 2, 4, 8, 16, 32, 64)]
    assert all(b <= a + 1e-9 for a, b in zip(at, at[1:]))


def test_svd_starts():
    x, _, _ = _low_rank()
    zero, mean, rand = (kernels.nmf_start(x, 3, f, 123)[0] for f in ("nndsvd", "nndsvda", "nndsvdar"))
    assert (zero == 0).any() and (mean > 0).all() and (rand > 0).all()
    assert np.allclose(mean[zero == 0], x.mean()) and (rand[zero == 0] < x.mean() / 10).all()


def test_assignment_is_best():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n, m = rng.integers(1, 6, 2)
        gain = np.round(rng.random((n, m)), 1)
        got = kernels.assign(gain)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m) == len(got)
        small = gain if n <= m else gain.T
        best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert math.isclose(sum(gain[i, j] for i, j in got), best)


def _flips(tree):
    if not isinstance(tree, tuple):
        return [[tree]]
    left, right = _flips(tree[0]), _flips(tree[1])
    return [a + b for a in left for b in right] + [b + a for a in left for b in right]


def test_leaf_order_is_best():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 8):
        d = rng.random((n, n))
        d = d + d.T
        tree = kernels.linkage_tree(d)
        cost = lambda o: sum(d[a, b] for a, b in zip(o, o[1:]))
        assert math.isclose(cost(kernels.optimal_leaf_order(tree, d)), min(map(cost, _flips(tree))), abs_tol=1e-12)


def test_leaf_order_has_no_cap():
    """Two runs of leaves on a line: whatever the number, the best order is the line."""
    at = np.random.default_rng(4).permutation(150).astype(float)
    d = np.abs(at[:, None] - at[None])
    order = kernels.optimal_leaf_order(kernels.linkage_tree(d, "single"), d)
    assert at[order].tolist() in (sorted(at), sorted(at)[::-1])


def _naive_merge(s, samples, threshold, inter_only):
    groups = [[i] for i in range(len(s))]
    while len(groups) > 1:
        best, at = -1.0, None
        for a, b in itertools.combinations(range(len(groups)), 2):
            v = [s[i, j] for i in groups[a] for j in groups[b] if not inter_only or samples[i] != samples[j]]
            mean = np.mean(v) if v else 0.0
            if mean > best + 1e-12:
                best, at = mean, (a, b)
        if best <= threshold:
            break
        groups[at[0]] += groups.pop(at[1])
    out = np.zeros(len(s), int)
    for g in groups:
        out[g] = min(g)
    return out


def _naive_clusters(s, samples, threshold, few, inter_only):
    keep = np.arange(len(s))
    while len(keep):
        lab = _naive_merge(s[np.ix_(keep, keep)], samples[keep], threshold, inter_only)
        bad = np.array([len(set(samples[keep][lab == c])) < few for c in lab])
        if not bad.any():
            out = np.full(len(s), -1)
            out[keep] = lab
            return out
        keep = keep[~bad]
    return np.full(len(s), -1)


@pytest.mark.parametrize("inter_only", [False, True])
def test_merging(inter_only):
    rng = np.random.default_rng(5)
    for _ in range(15):
        s = rng.random((14, 14)) ** 2
        s = (s + s.T) / 2
        np.fill_diagonal(s, 0)
        samples, known = rng.integers(0, 4, 14), {}
        for threshold in (0.1, 0.3, 0.4, 0.6):
            got = kernels.centroid_clusters(s, samples, threshold, 2, inter_only, known)
            assert (got == _naive_clusters(s, samples, threshold, 2, inter_only)).all()


def _naive_progressive(sets, loadings, samples, k, min_overlap, min_founder, min_cluster):
    left, barred, out, label = set(range(len(sets))), set(), [-1] * len(sets), 0
    while True:
        founder, most = None, min_founder
        for i in sorted(left - barred):
            n = sum(len(sets[i] & sets[j]) >= min_overlap for j in left if j != i)
            if n > most:
                founder, most = i, n
        if founder is None:
            return out
        own, program = [founder], set(sets[founder])
        while left - set(own):
            best = max(sorted(left - set(own)), key=lambda i: len(sets[i] & program))
            if len(sets[best] & program) < min_overlap:
                break
            own.append(best)
            count = {g: (sum(g in sets[f] for f in own), max(loadings[f][g] for f in own if g in sets[f])) for g in set().union(*(sets[f] for f in own))}
            program = set(sorted(count, key=lambda g: (-count[g][0], -count[g][1], g))[:k])
        if len({samples[f] for f in own}) < min_cluster:
            barred.add(founder)
            continue
        for f in own:
            out[f] = label
        left -= set(own)
        label += 1


def test_progressive():
    rng = np.random.default_rng(6)
    for _ in range(10):
        base = rng.random((4, 30)) ** 6
        x = np.concatenate([b + 0.1 * rng.random((5, 30)) for b in base])
        top = [np.argsort(r, kind="stable")[-8:] for r in x]
        samples = rng.integers(0, 3, len(x))
        got = kernels.progressive_clusters(top, [r[t] for r, t in zip(x, top, strict=True)], samples, 8, 4, 1, 2)
        assert got.tolist() == _naive_progressive([set(t.tolist()) for t in top], x, samples, 8, 4, 1, 2)


def test_crossover():
    rng = np.random.default_rng(7)
    x = np.clip(np.concatenate([rng.normal(0.2, 0.05, 500), rng.normal(0.7, 0.05, 500)]), 0, 1)
    w, m, d = [0.5, 0.5], [0.2, 0.7], [0.05, 0.05]
    for _ in range(200):  # a hand-written EM from the true values
        dens = [w[k] / d[k] * np.exp(-0.5 * ((x - m[k]) / d[k]) ** 2) for k in (0, 1)]
        r = dens[1] / (dens[0] + dens[1])
        w = [1 - r.mean(), r.mean()]
        m = [((1 - r) * x).sum() / (1 - r).sum(), (r * x).sum() / r.sum()]
        d = [math.sqrt(((1 - r) * (x - m[0]) ** 2).sum() / (1 - r).sum() + 1e-6), math.sqrt((r * (x - m[1]) ** 2).sum() / r.sum() + 1e-6)]
    grid = np.linspace(0, 1, 500)
    dens = [w[k] / d[k] * np.exp(-0.5 * ((grid - m[k]) / d[k]) ** 2) for k in (0, 1)]
    assert abs(kernels.crossover(x) - grid[np.argmax(dens[1] >= dens[0])]) <= 1 / 499
    assert kernels.crossover(np.array([0.1, 0.2, 0.3])) is None
    with pytest.warns(UserWarning, match="close means"):
        kernels.crossover(np.full(50, 0.5))


def test_mixed_model_without_group_effect_is_least_squares():
    rng = np.random.default_rng(8)
    x = np.stack([np.ones(40), np.linspace(0, 1, 40)], 1)
    y = x @ [0.5, 2.0] + np.tile([0.3, -0.3], 20)
    beta, se, p = kernels.random_intercept(x, y, np.repeat(np.arange(10), 4).astype(str))
    b, e, _ = kernels.ols(x, y)
    assert np.allclose(beta, b) and np.allclose(se, e, rtol=1e-6) and (p < 0.05).all()
    groups = rng.integers(0, 5, 200)
    x = np.stack([np.ones(200), rng.normal(size=200)], 1)
    y = x @ [1.0, 0.5] + rng.normal(size=5)[groups] * 3 + rng.normal(size=200)
    beta, se, _ = kernels.random_intercept(x, y, groups.astype(str))
    # Generalised least squares by the whole covariance matrix, best over a grid of variance ratios.
    best = None
    for ratio in np.logspace(-2, 3, 400):
        v = np.eye(200) + ratio * (groups[:, None] == groups[None])
        vi = np.linalg.inv(v)
        xtx = x.T @ vi @ x
        b = np.linalg.solve(xtx, x.T @ vi @ y)
        r = y - x @ b
        q = r @ vi @ r
        like = 198 * np.log(q / 198) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xtx)[1]
        if best is None or like < best[0]:
            best = (like, b, np.sqrt(np.diag(np.linalg.inv(xtx)) * q / 198))
    assert np.allclose(beta, best[1], atol=1e-3) and np.allclose(se, best[2], rtol=2e-2)


# ---------------------------------------------------------------- plans


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(9)
    rows = [(s * 100 + c, s, g, float(v)) for s in range(3) for c in range(8) for g in range(12) for v in [rng.random() * (g % 3 == c % 3) * (1 + s)] if v > 0]
    expr = spark.createDataFrame(rows, "cell_id long, sample_id long, gene_idx int, value double")
    cells = spark.createDataFrame([(s * 100 + c, s, "x") for s in range(3) for c in range(8)], "cell_id long, sample_id long, note string")
    return expr, cells


def test_fit_matches_kernel(spark, toy):
    expr, cells = toy
    out = core.nmf_fit(expr, cells, 12, (2, 3), keep_scores=True, normalize=False, log1p=False, clip_quantile=None, center=False)
    rows = out.collect()
    for s in range(3):
        x = np.zeros((8, 12))
        for r in expr.where(f"sample_id = {s}").collect():
            x[r.cell_id - s * 100, r.gene_idx] = r.value
        for i, k in enumerate((2, 3)):
            w, h = kernels.nmf(x, k)
            got = {(r.record, r.pos, r["item"]): r.value for r in rows if (r.sample_id, r.k, r.k_idx) == (s, k, i)}
            assert len(got) == k * 20
            assert all(math.isclose(got["gene", p, g], h[p, g], abs_tol=1e-9) for p in range(k) for g in range(12))
            assert all(math.isclose(got["cell", p, s * 100 + c], w[c, p], abs_tol=1e-9) for p in range(k) for c in range(8))
    wide = {r.cell_id: r for r in core.factor_scores(out, (2, 3)).collect()}
    assert len(wide) == 24 and wide[0].asDict().keys() == {"cell_id", *[f"F{n}" for n in range(5)]}
    assert all(wide[r["item"]][f"F{r.k_idx * 2 + r.pos}"] == r.value for r in rows if r.record == "cell")


def test_sweep(spark):
    rng = np.random.default_rng(10)
    s = np.kron(np.eye(3), np.full((4, 4), 0.6)) + 0.1 * rng.random((12, 12))
    s = (s + s.T) / 2
    np.fill_diagonal(s, 0)
    samples = np.tile(np.arange(4), 3)
    nodes = spark.createDataFrame([(i, int(samples[i])) for i in range(12)], "factor_id int, sample_id long")
    edges = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(12) for j in range(i + 1, 12)], "i int, j int, sim double")
    sweep = programs.programs_threshold(nodes, edges, [0.0, 0.2, 0.4, 0.65, 0.9], metric="delta")
    got = {r.threshold: r for r in sweep.collect()}
    for t, r in got.items():
        lab = _naive_clusters(s, samples, t, 2, False)
        own, valid = lab >= 0, len(set(lab[lab >= 0])) >= 2 and len(set(lab[lab >= 0])) < (lab >= 0).sum()
        if not valid:
            assert r.metric is None
            continue
        same = lab[own][:, None] == lab[own][None]
        inside = s[np.ix_(own, own)]
        assert math.isclose(r.metric, inside[same].mean() - inside[~same].mean())
    assert programs.best_threshold(sweep) == max((t for t in got if got[t].metric is not None), key=lambda t: got[t].metric)
    labels = {r.factor_id: r.program for r in programs.programs_centroid(nodes, edges, 0.3).collect()}
    assert len(labels) == 12 and len({tuple(labels[i] for i in range(k, k + 4)) for k in (0, 4, 8)}) == 3
    with pytest.raises(Exception, match="no threshold gives a valid partition"):
        programs.programs_threshold(nodes, edges, [0.99]).collect()


def test_rebuild_order(spark):
    """Labels follow display order: the largest program first."""
    members = spark.createDataFrame([(i, i % 3, 0 if i < 2 else 1 if i < 5 else 2, i) for i in range(10)], "factor_id int, sample_id long, program int, display_pos int")
    edges = spark.createDataFrame([(0, 1, 0.5), (5, 6, 0.4)], "i int, j int, sim double")
    got = {r.factor_id: (r.program, r.display_pos) for r in programs.rebuild(members, edges).collect()}
    assert {got[i][0] for i in range(5, 10)} == {0} and {got[i][0] for i in range(2, 5)} == {1} and {got[0][0], got[1][0]} == {2}
    assert sorted(p for _, p in got.values()) == list(range(10))
    assert programs.programs_merge(members, [0, 1], edges).select("program").distinct().count() == 2


def test_classify(spark, toy):
    expr, cells = toy
    genes = spark.createDataFrame([(0, 1, 0), (0, 2, 3), (1, 1, 1), (1, 2, 4)], "program int, rank int, gene_idx int")
    scores = spark.createDataFrame([(int(s * 100 + c), p, float((c + p) % 5) / 2) for s in range(3) for c in range(8) for p in range(2)], "cell_id long, program int, score double")
    got = scoring.score_classify(scores, expr, cells, genes, 4, 10, seed=5).collect()
    # The draw again: the ten cells of least hash in each shuffle.
    drawn = cells.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")).withColumn("u", F.xxhash64(F.lit(5), "s", "cell_id")).collect()
    value = {(r.cell_id, r.gene_idx): r.value for r in expr.collect()}
    null = {}
    for p, own in ((0, (0, 3)), (1, (1, 4))):
        means = []
        for s in range(4):
            unsigned = lambda r: r.u % (1 << 64)
            some = sorted((r for r in drawn if r.s == s), key=unsigned)[:10]
            means.append(np.mean([value.get((r.cell_id, g), 0.0) for r in some for g in own]))
        null[p] = (np.mean(means), np.std(means))
    p = {(r.cell_id, r.program): 0.5 * math.erfc((r.score - null[r.program][0]) / null[r.program][1] / math.sqrt(2)) for r in got}
    assert all(math.isclose(r.pval, p[r.cell_id, r.program], rel_tol=1e-5, abs_tol=1e-12) for r in got)
    order = sorted(p.values())
    padj = {k: min(1.0, min(order[n] * len(order) / (n + 1) for n in range(len(order)) if order[n] >= v)) for k, v in p.items()}
    assert all(math.isclose(r.padj, padj[r.cell_id, r.program], rel_tol=1e-4, abs_tol=1e-12) for r in got)
    for cell in {r.cell_id for r in got}:
        own = [r for r in got if r.cell_id == cell and r.padj < 0.05]
        want = "unresolved" if not own else f"C{min(own, key=lambda r: (-r.score, r.program)).program}"
        assert {r.label for r in got if r.cell_id == cell} == {want}


def test_controls_are_drawn(spark):
    binned = spark.createDataFrame([(g, float(g), g // 50) for g in range(100)], "gene_idx int, mean_expr double, bin int")
    genes = spark.createDataFrame([(0, 1, 3), (0, 2, 60)], "program int, rank int, gene_idx int")
    a, b, c = ({r.gene_idx for r in scoring.control_genes(binned, genes, 10, seed).collect()} for seed in (1, 1, 2))
    assert a == b != c and len(a) == 20 and not a & {3, 60} and sum(g < 50 for g in a) == 10


def test_pvalues_that_crowd(spark):
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.random(50) ** 20, 1 - rng.random(50) ** 20, [0.0, 1.0, 1.0, 0.5, 1e-300]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "k int, pval double")
    got = {r.k: r.padj for r in adjust_pvalues(df).collect()}
    order = np.sort(p)
    want = [min(1.0, min(order[n] * len(p) / (n + 1) for n in range(len(p)) if order[n] >= v)) for v in p]
    assert got[999] is None and all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-300) for i, w in enumerate(want))


def test_gene_set_files(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"A": ["x", "y", "x"], "B": ["y", "z"]}))
    (tmp_path / "nested.json").write_text(json.dumps({"S": {"collection": "C1", "geneSymbols": ["x"]}, "T": {"geneSymbols": ["y"]}, "U": {"collection": "C1", "geneSymbols": []}}))
    all_sets = gene_sets.Catalogue(spark, f"file://{tmp_path}")
    assert all_sets.available_sets() == ["flat", "nested"]
    one = all_sets.flat
    assert one.info() == {"A": 3, "B": 2} and one.all() == ["x", "y", "z"] and one.A == ["x", "y", "x"] and one.as_dict()["B"] == ["y", "z"]
    assert repr(one) == "flat(n_sets=2, n_genes=3)"
    for bad in (lambda: one.C, lambda: all_sets.other):
        with pytest.raises(AttributeError):
            bad()
    rows = {r.gene_set: r.collection for r in gene_sets.read_msigdb(spark, f"file://{tmp_path}/nested.json").collect()}
    assert rows == {"S": "C1", "T": ""}
    assert [r.gene_set for r in gene_sets.read_msigdb(spark, f"file://{tmp_path}/nested.json", ["C1"]).collect()] == ["S"]
    with pytest.raises(FileNotFoundError):
        gene_sets.read_gene_sets(spark, f"file://{tmp_path}/none.json")


def test_shared_folder():
    from types import SimpleNamespace as N

    from genoweft.sources.storage import shared_folder

    none = N(get=lambda k, d=None: d)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(N(conf=none, sparkContext=N(master="spark://x:7077", getConf=lambda: none)))
    some = N(get=lambda k, d=None: "hdfs://x/y/")
    assert shared_folder(N(conf=some, sparkContext=N(master="spark://x:7077", getConf=lambda: none))) == "hdfs://x/y"


# ---------------------------------------------------------------- error contract


def _tables(spark):
    loadings = spark.createDataFrame([(f, f % 2, f // 2, g, float((f * 7 + g) % 5)) for f in range(4) for g in range(6)], "factor_id int, sample_id long, k_idx int, gene_idx int, loading double")
    members = spark.createDataFrame([(f, f % 2, f // 2) for f in range(4)], "factor_id int, sample_id long, program int")
    edges = spark.createDataFrame([(0, 1, 0.5)], "i int, j int, sim double")
    genes = spark.createDataFrame([(p, r, (p + r) % 6, f"G{(p + r) % 6}") for p in range(2) for r in range(1, 4)], "program int, rank int, gene_idx int, gene string")
    return loadings, members, edges, genes


RAISES = {
    "fit scalar": (TypeError, lambda s, t, c: core.nmf_fit(*t, 12, 3)),
    "fit rank": (ValueError, lambda s, t, c: core.nmf_fit(*t, 12, (0,))),
    "fit solver": (ValueError, lambda s, t, c: core.nmf_fit(*t, 12, (2,), loss="kullback-leibler")),
    "fit loss": (ValueError, lambda s, t, c: core.nmf_fit(*t, 12, (2,), solver="mu", loss="other")),
    "fit init": (ValueError, lambda s, t, c: core.nmf_fit(*t, 12, (2,), init="nndsvdx")),
    "fit genes": (ValueError, lambda s, t, c: core.nmf_fit(*t, 0, (2,))),
    "fit samples": (ValueError, lambda s, t, c: core.nmf_fit(*t, 12, (2,), min_cells=99)),
    "fit key": (KeyError, lambda s, t, c: core.nmf_fit(t[0], t[1].drop("sample_id"), 12, (2,))),
    "select none": (ValueError, lambda s, t, c: core.select_genes(c[3], ["nope"])),
    "select column": (KeyError, lambda s, t, c: core.select_genes(c[3], "nope")),
    "scores": (KeyError, lambda s, t, c: core.factor_scores(s.createDataFrame([], core.FACTORS), (2,))),
    "prune top": (ValueError, lambda s, t, c: core.nmf_prune(c[0], 2, 0)),
    "prune genes": (ValueError, lambda s, t, c: core.nmf_prune(c[0], 2, 7, n_genes=6)),
    "prune similarity": (ValueError, lambda s, t, c: core.nmf_prune(c[0], 2, 3, 1.5)),
    "prune dedup": (ValueError, lambda s, t, c: core.nmf_prune(c[0], 2, 3, 0.1, -1)),
    "prune other": (ValueError, lambda s, t, c: core.nmf_prune(c[0], 2, 3, min_other_resolutions=2)),
    "prune matching": (ValueError, lambda s, t, c: core.nmf_prune(c[0], 2, 3, matching="x")),
    "prune field": (KeyError, lambda s, t, c: core.nmf_prune(c[0].drop("k_idx"), 2, 3)),
    "similarity metric": (ValueError, lambda s, t, c: core.similarity(c[0], "x")),
    "similarity none": (ValueError, lambda s, t, c: core.similarity(c[0], top_k=None)),
    "similarity top": (ValueError, lambda s, t, c: core.similarity(c[0], top_k=0)),
    "similarity genes": (ValueError, lambda s, t, c: core.similarity(c[0], top_k=9, n_genes=6)),
    "similarity callable": (ValueError, lambda s, t, c: core.similarity(c[0], lambda x: 0, 2)),
    "similarity value": (ValueError, lambda s, t, c: core.similarity(c[0], lambda x, y: x, 2)),
    "filter": (ValueError, lambda s, t, c: core.similarity_filter(c[0], c[2], 1.1)),
    "strategy": (ValueError, lambda s, t, c: programs.programs_cluster("x", c[0], c[2])),
    "centroid threshold": (ValueError, lambda s, t, c: programs.programs_centroid(c[0], c[2], 2)),
    "centroid cluster": (ValueError, lambda s, t, c: programs.programs_centroid(c[0], c[2], min_cluster=0)),
    "centroid method": (ValueError, lambda s, t, c: programs.programs_centroid(c[0], c[2], method="x")),
    "progressive top": (ValueError, lambda s, t, c: programs.programs_progressive(c[0], c[2], 6, 0)),
    "progressive overlap": (ValueError, lambda s, t, c: programs.programs_progressive(c[0], c[2], 6, 3, 4)),
    "progressive genes": (ValueError, lambda s, t, c: programs.programs_progressive(c[0], c[2], 6, 7, 4)),
    "sweep metric": (ValueError, lambda s, t, c: programs.programs_threshold(c[0], c[2], metric="x")),
    "sweep method": (ValueError, lambda s, t, c: programs.programs_threshold(c[0], c[2], method="x")),
    "sweep cluster": (ValueError, lambda s, t, c: programs.programs_threshold(c[0], c[2], min_cluster=0)),
    "merge empty": (ValueError, lambda s, t, c: programs.programs_merge(c[1], [])),
    "merge one": (ValueError, lambda s, t, c: programs.programs_merge(c[1], [[0]])),
    "merge unknown": (ValueError, lambda s, t, c: programs.programs_merge(c[1], [0, 9])),
    "merge twice": (ValueError, lambda s, t, c: programs.programs_merge(c[1], [[0, 1], [1, 0]])),
    "merge field": (KeyError, lambda s, t, c: programs.programs_merge(c[1].drop("program"), [0, 1])),
    "remove empty": (ValueError, lambda s, t, c: programs.programs_remove(c[1], [])),
    "remove unknown": (ValueError, lambda s, t, c: programs.programs_remove(c[1], [7])),
    "remove twice": (ValueError, lambda s, t, c: programs.programs_remove(c[1], [1, 1])),
    "remove all": (ValueError, lambda s, t, c: programs.programs_remove(c[1], [0, 1])),
    "finalise": (ValueError, lambda s, t, c: programs.finalise(c[1], c[0], c[2], 0)),
    "share": (ValueError, lambda s, t, c: programs.program_share(c[1], "x")),
    "share scores": (KeyError, lambda s, t, c: programs.program_share(c[1], "mean_score")),
    "share column": (KeyError, lambda s, t, c: programs.program_share(c[1], "mean_score", s.createDataFrame([(0, 1.0)], "sample_id long, P0 double"))),
    "stability field": (KeyError, lambda s, t, c: programs.programs_stability(c[1], c[0], c[3].drop("rank"))),
    "stability top": (ValueError, lambda s, t, c: programs.programs_stability(c[1], c[0], c[3], 0)),
    "overlaps": (ValueError, lambda s, t, c: programs.program_overlaps(c[3], c[3], "x")),
    "annotate overlap": (ValueError, lambda s, t, c: programs.programs_annotate(c[3], c[3], c[3], -1)),
    "annotate universe": (ValueError, lambda s, t, c: programs.programs_annotate(c[3], s.createDataFrame([("A", 99)], "gene_set string, gene_idx int"), s.range(6).select(F.col("id").cast("int").alias("gene_idx")))),
    "adjust": (ValueError, lambda s, t, c: adjust_pvalues(c[2], "sim", method="x")),
    "align none": (ValueError, lambda s, t, c: scoring.align_genes(c[3], s.createDataFrame([("Q",)], "gene string"), c[3], 1)),
    "align few": (ValueError, lambda s, t, c: scoring.align_genes(c[3], c[3], c[3], 50)),
    "align column": (KeyError, lambda s, t, c: scoring.align_genes(c[3].drop("gene"), c[3], c[3], 1)),
    "aggregate agg": (ValueError, lambda s, t, c: scoring.score_aggregate(t[0], t[1], [0], agg="x")),
    "aggregate cells": (ValueError, lambda s, t, c: scoring.score_aggregate(t[0], t[1], [0], min_cells=0)),
    "aggregate column": (KeyError, lambda s, t, c: scoring.score_aggregate(t[0], t[1], [0], ["age"])),
    "aggregate none": (ValueError, lambda s, t, c: scoring.score_aggregate(t[0].select("cell_id", F.lit(0).alias("program"), F.col("value").alias("score")), t[1], [0], min_cells=99)),
    "classify shuffles": (ValueError, lambda s, t, c: scoring.score_classify(t[0], t[0], t[1], c[3], 0)),
    "classify level": (ValueError, lambda s, t, c: scoring.score_classify(t[0], t[0], t[1], c[3], padj_thresh=0)),
    "classify field": (KeyError, lambda s, t, c: scoring.score_classify(t[0], t[0], t[1], c[3])),
    "formula empty": (ValueError, lambda s, t, c: scoring.score_associate(t[1], " ")),
    "formula fixed": (ValueError, lambda s, t, c: scoring.score_associate(t[1], "(1|note)")),
    "formula unknown": (KeyError, lambda s, t, c: scoring.score_associate(t[1], "age")),
    "formula programs": (ValueError, lambda s, t, c: scoring.score_associate(t[1], "note")),
}


@pytest.mark.parametrize("case", RAISES)
def test_raises(spark, toy, case):
    kind, call = RAISES[case]
    with pytest.raises(kind):
        call(spark, toy, _tables(spark))


WARNS = {
    "force missing": ("not found", lambda s, t, c: core.select_genes(c[3], ["G1"], ["nope"])),
    "force added": ("added", lambda s, t, c: core.select_genes(c[3], ["G1"], ["G2"])),
    "prune order": ("below", lambda s, t, c: core.nmf_prune(c[0], 2, 3, 0.5, 0.2)),
    "ward": ("ward", lambda s, t, c: programs.programs_centroid(c[0], c[2], method="ward")),
    "stability mode": ("unknown mode", lambda s, t, c: programs.programs_stability(c[1], c[0], c[3], 5, "x")),
    "stability few": ("fewer", lambda s, t, c: programs.programs_stability(c[1], c[0], c[3], 5, min_program_genes=10)),
    "stability cut": ("cut", lambda s, t, c: programs.programs_stability(c[1], c[0], c[3], 2)),
    "align missing": ("left out", lambda s, t, c: scoring.align_genes(c[3], c[3].where("gene <> 'G1'"), c[3], 3)),
    "align short": ("genes of 3", lambda s, t, c: scoring.align_genes(c[3], c[3].where("gene <> 'G1'"), c[3], 3)),
    "raw": ("raw counts", lambda s, t, c: scoring.warn_if_raw(s.createDataFrame([(99.0,)], "value double"))),
    "aggregate left out": ("left out", lambda s, t, c: scoring.score_aggregate(t[0].select("cell_id", F.lit(0).alias("program"), F.col("value").alias("score")), t[1].where("cell_id <> 0"), [0], min_cells=8)),
    "classify genes": ("without genes", lambda s, t, c: scoring.score_classify(s.createDataFrame([(0, 7, 1.0)], "cell_id long, program int, score double"), t[0], t[1], c[3])),
}


@pytest.mark.parametrize("case", WARNS)
def test_warns(spark, toy, case):
    text, call = WARNS[case]
    with pytest.warns(UserWarning, match=text):
        call(spark, toy, _tables(spark))
