"""Centring by few and by many means: the same values, and no task that gets all cells of a sample and gene."""

from __future__ import annotations

import math

import numpy as np
import pytest

from genoweft.operators import core


@pytest.mark.parametrize("few", [0, 100_000])
def test_center_relu_does_not_shuffle_by_few_keys(spark, monkeypatch, few):
    rng = np.random.default_rng(5)
    rows = [(c, c % 2, g, float(rng.integers(1, 50))) for c in range(200) for g in range(3) if rng.random() < 0.7]
    expr = spark.createDataFrame(rows, "cell_id long, sample_id int, gene_idx int, value double")
    cells = spark.createDataFrame([(c, c % 2) for c in range(200)], "cell_id long, sample_id int")
    monkeypatch.setattr(core, "FEW_MEANS", few, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = core.center_relu(expr, cells)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["cell_id"], r["gene_idx"]): r["value"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    total = {}
    for _, s, g, v in rows:
        total[s, g] = total.get((s, g), 0) + v
    assert len(got) == len(rows)
    assert all(math.isclose(got[c, g], max(v - total[s, g] / 100, 0), abs_tol=1e-9) for c, s, g, v in rows)
    assert ("SortMergeJoin" in plan) == (few == 0) and ("Exchange hashpartitioning" in plan) == (few == 0)
