"""A corpus pipeline: language ID, toxicity, n-gram near-duplicates, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes
each stage's result as Parquet in the shared folder and reads it again for the next. Texts of any
length are taken whole by every stage; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweft.llm.common import materialize
from genoweft.llm.language_net import identify
from genoweft.llm.ngram_join import jaccard_components
from genoweft.llm.piece_codec import encode_texts
from genoweft.llm.source_mix import mix_sources
from genoweft.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of a prediction that language_id accepts.
LEAST_SCORE = 0.4


def _row(docs: DataFrame) -> DataFrame:
    """Adds `row`, a 64-bit hash of all columns, nulls told apart: equal only for rows that are equal."""
    return docs.select(*COLUMNS).withColumn("row", F.xxhash64(*[x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]))


def _kept(decided: DataFrame) -> DataFrame:
    return decided.select(*[F.col(f"kept_{c}").alias(c) for c in COLUMNS])


def _one_each(rows: DataFrame) -> DataFrame:
    """One of the rows that share `row`; repeated rows meet before the shuffle."""
    return rows.dropDuplicates(["row"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language: `und` and predictions below LEAST_SCORE go. Each row is decided by its own
    text, whatever its id; repeated rows stay."""
    return _kept(identify(docs, keep=tuple(COLUMNS)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic, each decided by its own text; repeated rows stay."""
    return _kept(score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=tuple(COLUMNS)).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of least id, null last, and of least hash among equal
    ids. A row without words is a group of its own; of rows equal in all columns one stays."""
    rows = _row(docs)
    groups = jaccard_components(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    named = groups.join(rows.select("row", "doc_id").distinct(), "row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    keep = named.groupBy("component_id").agg(least).select("least.row")
    return _one_each(rows.join(keep, "row", "left_semi")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; equal rows as often as it takes them together."""
    rows = _row(docs)
    taken = mix_sources(rows, id_col="row").groupBy(F.col("doc_id").alias("row")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    mixed = _one_each(rows).join(taken, "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    return encode_texts(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]
#: Trained models decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
