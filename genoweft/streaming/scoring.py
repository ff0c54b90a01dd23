"""Scores of frozen programs on cells that arrive one after another.

Programs, their controls and so the weight of each gene are fixed beforehand (frozen_weights). A cell
arrives whole, as a row with its genes and values, so its scores need no other row: the plan has no
state, no shuffle and no watermark, and gives the same on a stream as on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.core import require_columns


def frozen_weights(genes: DataFrame, controls: DataFrame) -> DataFrame:
    """(program, weights map<gene_idx, double>): 1/n for the n genes of a program, -1/m for its m controls.
    A row per program; the maps are as long as the programs' genes and controls."""
    require_columns(genes, "program", "gene_idx")
    require_columns(controls, "program", "gene_idx")

    def share(df: DataFrame, sign: float) -> DataFrame:
        n = df.groupBy("program").agg(F.count("*").alias("n"))
        return df.join(n, "program").select("program", F.col("gene_idx").cast("int").alias("gene_idx"), (F.lit(sign) / F.col("n")).alias("w"))

    own = genes.select("program", "gene_idx").distinct()
    both = share(own, 1.0).unionByName(share(controls.select("program", "gene_idx").distinct().join(own.select("program").distinct(), "program", "left_semi"), -1.0))
    return both.groupBy("program", "gene_idx").agg(F.sum("w").alias("w")).groupBy("program").agg(F.map_from_entries(F.collect_list(F.struct("gene_idx", "w"))).alias("weights"))


def score_rows(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(cell_id, program, score) of cells(cell_id, genes array<int>, values array<double>), a table or a
    stream. Genes without a weight and null values count as 0; null arrays are empty."""
    require_columns(cells, "cell_id", "genes", "values")
    pairs = F.arrays_zip(F.coalesce("genes", F.array().cast("array<int>")).alias("g"), F.coalesce("values", F.array().cast("array<double>")).alias("v"))
    rows = cells.select("cell_id", F.transform(pairs, lambda p: F.struct(p["g"].cast("int").alias("g"), p["v"].cast("double").alias("v"))).alias("x"))
    each = rows.crossJoin(F.broadcast(weights))  # a row per program
    total = F.aggregate("x", F.lit(0.0), lambda acc, p: acc + F.coalesce(p["v"] * F.try_element_at(F.col("weights"), p["g"]), F.lit(0.0)))
    return each.select("cell_id", "program", total.alias("score"))


def score_stream(spark, path: str, schema: str, weights: DataFrame, sink: str, checkpoint: str, files_per_trigger: int = 1000):
    """Started query that appends scores of the Parquet files arriving in `path` to the Parquet folder `sink`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return score_rows(stream, weights).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
