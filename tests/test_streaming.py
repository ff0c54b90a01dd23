"""Scores of frozen programs are the same on a stream of files as in a batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from genoweft.operators import scoring
from genoweft.streaming import scoring as stream


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    cells = [(i, [int(g) for g in rng.permutation(20)[:12]], [float(v) for v in rng.random(12)]) for i in range(60)] + [(90, None, None), (91, [3, 50], [None, 2.0])]
    df = spark.createDataFrame(cells, "cell_id long, genes array<int>, values array<double>")
    genes = spark.createDataFrame([(0, r, g) for r, g in enumerate((1, 2, 3))] + [(1, r, g) for r, g in enumerate((3, 4))], "program int, rank int, gene_idx int")
    controls = spark.createDataFrame([(0, 5), (0, 6), (1, 7), (1, 1), (9, 2)], "program int, gene_idx int")
    long = df.select("cell_id", F.explode(F.arrays_zip("genes", "values")).alias("x")).select("cell_id", F.col("x.genes").alias("gene_idx"), F.col("x.values").alias("value"))
    want = {(r["cell_id"], r["program"]): r["score"] for r in scoring.score_cells(long, df.select("cell_id"), genes, controls).where("program < 9").collect()}
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    weights = stream.frozen_weights(genes, controls)
    assert {r["program"] for r in weights.collect()} == {0, 1}
    schema = "cell_id long, genes array<int>, values array<double>"
    for part in range(3):  # files arrive between runs; the checkpoint knows which were read
        df.where(F.col("cell_id") % 3 == part).write.mode("append").parquet(source)
        query = stream.score_stream(spark, source, schema, weights, sink, str(tmp_path / "state"), 1)
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.parquet(sink).collect()
    assert len(got) == len(want) == 2 * 62
    assert all(abs(want[r["cell_id"], r["program"]] - r["score"]) < 1e-12 for r in got)
    batch = {(r["cell_id"], r["program"]): r["score"] for r in stream.score_rows(df, weights).collect()}
    assert batch == {(r["cell_id"], r["program"]): r["score"] for r in got}


def test_plan_has_no_shuffle_and_no_state(spark, tmp_path):
    spark.createDataFrame([(1, [1], [1.0])], "cell_id long, genes array<int>, values array<double>").write.parquet(str(tmp_path / "in"))
    weights = spark.createDataFrame([(0, {1: 1.0})], "program int, weights map<int,double>")
    cells = spark.readStream.schema("cell_id long, genes array<int>, values array<double>").parquet(str(tmp_path / "in"))
    plan = stream.score_rows(cells, weights)._jdf.queryExecution().logical().toString()
    assert "Aggregate [" not in plan and "StateStore" not in plan
