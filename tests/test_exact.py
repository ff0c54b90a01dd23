"""Exact quantiles, thresholded similarity, deduplication and models from sums against brute force."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoweft.functions.quantiles import exact_quantiles
from genoweft.operators import core, kernels, scoring
from genoweft.operators.formula import Formula, split_groups

QS = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]


@pytest.mark.parametrize(("bins", "few"), [(4, 3), (16, 1), (1024, 4096)])
def test_quantiles_by_group(spark, bins, few):
    rng = np.random.default_rng(1)
    groups = {
        "a": rng.normal(size=300), "b": np.concatenate([np.zeros(500), rng.random(20) * 1e-9, [1e12]]), "c": np.array([3.5]), "d": np.repeat([1.0, 2.0], 40),
        None: rng.random(50) * 1e308 * np.where(rng.random(50) < 0.5, -1, 1), "e": np.round(rng.random(200), 1),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("z", None)]
    got = {r["k"]: r["q"] for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double").repartition(5), "x", QS, ["k"], bins=bins, few=few).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        s = np.sort(v)
        for q, x in zip(QS, got[k], strict=True):
            at = q * (len(s) - 1)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            assert math.isclose(x, a + (at - math.floor(at)) * (b - a), rel_tol=1e-12, abs_tol=1e-300), (k, q)


def test_quantiles_with_weights_and_without_keys(spark):
    rows = [(0.0, 10_000), (5.0, 3), (7.0, 0), (9.0, 2_500)]
    got = exact_quantiles(spark.createDataFrame(rows, "x double, w long"), "x", [0.5, 0.8, 0.9], weight="w", bins=2, few=1).collect()
    whole = np.repeat([r[0] for r in rows], [r[1] for r in rows])
    assert len(got) == 1 and np.allclose(got[0]["q"], np.quantile(whole, [0.5, 0.8, 0.9]))
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).collect()[0]["q"] is None
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame(rows, "x double, w long"), "x", [2])


def _top(spark, seed, n=60, genes=80, k=12):
    """Top sets that share hot genes."""
    rng = np.random.default_rng(seed)
    base = [rng.permutation(genes)[:k] for _ in range(5)]
    rows = []
    for f in range(n):
        own = set(base[f % 5].tolist())
        for _ in range(rng.integers(0, 5)):
            own = set(list(own)[1:]) | {int(rng.integers(genes))}
        rows += [(f, f % 4, g, 1.0) for g in own | {0, 1}]
    return spark.createDataFrame(rows, "factor_id int, sample_id long, gene_idx int, loading double")


@pytest.mark.parametrize(("t", "inter", "most"), [(0.3, False, 2000), (0.5, True, 7), (0.8, False, 3), (1.0, False, 2000)])
def test_threshold_pairs(spark, t, inter, most):
    top = _top(spark, 3)
    whole = {(r["i"], r["j"]): r["sim"] for r in core.jaccard_pairs(top, inter).collect()}
    met = {tuple(r) for r in core.threshold_candidates(top, t, inter, most).collect()}
    want = {p: s for p, s in whole.items() if s >= t - 1e-12}
    assert want.keys() <= met
    if most == 2000:
        assert {(r["i"], r["j"]): r["sim"] for r in core.threshold_pairs(top, t, inter).collect()} == want and want
    if t >= 0.8:
        assert len(met) < len(whole) / 2  # pairs met: those of one base, not all that share a hot gene


def test_deduplicate(spark):
    top = _top(spark, 5, 40)
    sets: dict = {}
    for r in top.collect():
        sets.setdefault(r["factor_id"], set()).add(r["gene_idx"])
    for t in (0.0, 0.35, 0.6, 1.0):
        want = []
        for s in range(4):
            own = [f for f in sets if f % 4 == s]
            sim = {(a, b): 0.0 if a == b else len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in own for b in own}
            label = {f: f for f in own}
            for a in own:
                for b in own:
                    if a < b and sim[a, b] >= t:
                        label = {f: label[a] if x == label[b] else x for f, x in label.items()}
            for c in set(label.values()):
                part = [f for f in own if label[f] == c]
                want.append(min(part, key=lambda f: (-round(sum(sim[f, g] for g in part) / len(part), 9), f)))
        assert sorted(r[0] for r in core.deduplicate(top, t).collect()) == sorted(want)


# ---------------------------------------------------------------- models


def _samples(spark, seed=2, n=60):
    rng = np.random.default_rng(seed)
    age, site, study = 20 + 50 * rng.random(n), rng.choice(["a", "b", "c"], n), rng.integers(0, 7, n)
    dose = rng.random(n) + 0.1
    y = 0.05 * age + (site == "b") * 0.8 + np.log(dose) + rng.normal(size=7)[study] + rng.normal(size=n)
    rows = [(i, float(y[i]), float(rng.normal()), 1.0, float(age[i]), str(site[i]), int(study[i]), float(dose[i])) for i in range(n)]
    rows[3] = (*rows[3][:4], None, *rows[3][5:])
    return spark.createDataFrame(rows, "sample_id long, P0 double, P1 double, P2 double, age double, site string, study long, `a dose` double"), rows


def _plain(rows, x_of, y_at):
    """Least squares of the standardised score on given columns."""
    y = np.array([r[y_at] for r in rows])
    y = (y - y.mean()) / y.std(ddof=1)
    keep = [i for i, r in enumerate(rows) if r[4] is not None]
    x = np.array([x_of(rows[i]) for i in keep])
    beta, rest = np.linalg.lstsq(x, y[keep], rcond=None)[:2]
    rest = y[keep] - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (rest @ rest) / (len(keep) - x.shape[1]))
    return beta, se, x, y[keep], [rows[i][6] for i in keep]


FORMULAS = {
    "age": (lambda r: [1, r[4]], 1),
    "age + np.log(Q('a dose')) + site": (lambda r: [1, r[4], np.log(r[7]), r[5] == "b", r[5] == "c"], 1),
    "age - 1": (lambda r: [r[4]], 0),
    "0 + age + C(site)": (lambda r: [r[4], r[5] == "a", r[5] == "b", r[5] == "c"], 0),
    "age * site": (lambda r: [1, r[4], r[5] == "b", r[5] == "c", r[4] * (r[5] == "b"), r[4] * (r[5] == "c")], 1),
    "age + age:Q(\"a dose\") + I(age ** 2 / 100)": (lambda r: [1, r[4], r[4] * r[7], r[4] ** 2 / 100], 1),
    "C(study) + age": (lambda r: [1, *[r[6] == k for k in range(1, 7)], r[4]], None),
    "np.sqrt(age) + age": (lambda r: [1, np.sqrt(r[4]), r[4]], 2),
}


@pytest.mark.parametrize("formula", FORMULAS)
def test_formulas(spark, formula):
    df, rows = _samples(spark)
    x_of, at = FORMULAS[formula]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = {r["program"]: r for r in scoring.score_associate(df, formula).collect()}
    assert got.keys() == {"P0", "P1"}  # P2 does not vary
    for p, k in (("P0", 1), ("P1", 2)):
        beta, se, x, y, _ = _plain(rows, lambda r: [float(v) for v in x_of(r)], k)
        assert got[p]["n_obs"] == len(rows) and got[p]["model"] == "ols"
        if at is None:
            assert got[p]["beta"] is None and got[p]["covariate"] == "study"
            continue
        assert math.isclose(got[p]["beta"], beta[at], rel_tol=1e-7) and math.isclose(got[p]["se"], se[at], rel_tol=1e-7)
        assert math.isclose(got[p]["pval"], kernels.t_two_sided(beta[at] / se[at], len(y) - x.shape[1]), rel_tol=1e-6)


def _likelihood(ratio, x, y, groups, reml):
    """Of a mixed model, by whole covariance matrices."""
    g = np.array(groups)
    v = np.eye(len(y)) + ratio * (g[:, None] == g[None])
    inverse = np.linalg.inv(v)
    a = x.T @ inverse @ x
    beta = np.linalg.solve(a, x.T @ inverse @ y)
    r = y - x @ beta
    df = len(y) - x.shape[1] if reml else len(y)
    value = df * np.log(r @ inverse @ r / df) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0)
    return value, beta, np.sqrt(np.diag(np.linalg.inv(a)) * (r @ inverse @ r) / df)


@pytest.mark.parametrize(("formula", "reml", "ratio"), [("age + (1|study)", True, None), ("(1 | study) + age", False, None), ("age + (1|study)", True, 0.0), ("age + np.log(Q('a dose')) + (1|study)", True, 1.7)])
def test_mixed_model_from_sums(spark, formula, reml, ratio):
    df, rows = _samples(spark)
    x_of = (lambda r: [1.0, r[4], np.log(r[7])]) if "np" in formula else (lambda r: [1.0, r[4]])
    beta, se, x, y, groups = _plain(rows, x_of, 1)
    got = next(r for r in scoring.score_associate(df, formula, reml, ratio=ratio).collect() if r["program"] == "P0")
    at = ratio if ratio is not None else min(np.concatenate([[0], np.logspace(-4, 4, 4001)]), key=lambda r: _likelihood(r, x, y, groups, reml)[0])
    _, b, e = _likelihood(at, x, y, groups, reml)
    assert got["model"] == "lmm" and got["groups"] == "study"
    assert math.isclose(got["beta"], b[1], rel_tol=1e-3 if ratio is None else 1e-7) and math.isclose(got["se"], e[1], rel_tol=1e-3 if ratio is None else 1e-7)
    if ratio == 0.0:
        assert math.isclose(got["beta"], beta[1], rel_tol=1e-7)


def test_formula_errors(spark):
    df, _ = _samples(spark)
    for bad in ("age + * site", "age + np.foo(age)", "age + foo(age)", "age + 3"):
        with pytest.raises(ValueError, match="cannot"):
            scoring.score_associate(df, bad)
    with pytest.raises(KeyError):
        scoring.score_associate(df, "age + np.log(weight)")
    assert split_groups("age + (1|a) + b + (1 | c)") == ("age + b", ["a", "c"])
    assert scoring.formula_variables("C(x) + np.log(age + 1) * z:w - 1 + Q('q q') + x") == ["x", "z", "w"]
    assert Formula("a*b:c").terms == [("a",), ("b", "c"), ("a", "b", "c")]
    assert Formula("a*b - a:b").terms == [("a",), ("b",)]


def test_retention_curve(spark):
    values = [0.0, 1.0, 0.5, 0.5, 1 / 99, 33 / 99, 0.3333, 0.99999]
    got = {round(r["threshold"] * 99): r["n"] for r in scoring.retention_curve(spark.createDataFrame([(v,) for v in values], "max_sim double")).collect()}
    assert got == {t: sum(v >= t / 99 for v in values) for t in range(100)}
    assert scoring.retention_curve(spark.createDataFrame([], "max_sim double")).agg(F.sum("n")).first()[0] == 0
