"""Gene-set sources: one JSON object per file.

Flat files map a set's name to its genes; collection files map it to an object with `collection`
and `geneSymbols`. Files are read whole: a gene-set file is one object, far below a block.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_folder

FLAT = "map<string,array<string>>"
NESTED = "map<string,struct<collection:string,geneSymbols:array<string>>>"


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("gene_set", "v"))


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(gene_set, genes) of a flat file; genes keep their order and repeats."""
    return _parsed(spark, path, FLAT).select("gene_set", F.col("v").alias("genes"))


def read_msigdb(spark: SparkSession, path: str, collections: list[str] | None = None) -> DataFrame:
    """(gene_set, collection, genes) of a collection file; sets without genes go."""
    out = _parsed(spark, path, NESTED).select("gene_set", F.coalesce("v.collection", F.lit("")).alias("collection"), F.col("v.geneSymbols").alias("genes"))
    out = out.where(F.size("genes") > 0)
    return out if collections is None else out.where(F.col("collection").isin(list(collections)))


class GeneSets:
    """A named collection read from a flat file; each set is an attribute."""

    def __init__(self, spark: SparkSession, path: str, name: str = "GeneSets"):
        self._name = name
        self._sets = {r["gene_set"]: list(r["genes"]) for r in read_gene_sets(spark, path).collect()}  # a metadata file

    def __getattr__(self, key: str) -> list[str]:
        if key.startswith("_") or key not in self._sets:
            raise AttributeError(key)
        return list(self._sets[key])

    def info(self) -> dict[str, int]:
        return {k: len(v) for k, v in self._sets.items()}

    def all(self) -> list[str]:
        """Distinct genes in order of first mention."""
        return list(dict.fromkeys(g for genes in self._sets.values() for g in genes))

    def as_dict(self) -> dict[str, list[str]]:
        return {k: list(v) for k, v in self._sets.items()}

    def __repr__(self) -> str:
        return f"{self._name}(n_sets={len(self._sets)}, n_genes={len(self.all())})"


class Catalogue:
    """The collections of a folder: each `name.json` in it is one, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def available_sets(self) -> list[str]:
        jvm = self._spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._folder)
        files = at.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        names = [f.getPath().getName() for f in files]
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith(("_", ".")))

    def __getattr__(self, name: str) -> GeneSets:
        if name.startswith("_") or name not in self.available_sets():
            raise AttributeError(name)
        return GeneSets(self._spark, f"{self._folder}/{name}.json", name)


def _json_text(key: str, value: str):
    """One-line JSON of a group: its name and the list or object in `value`."""
    return F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), F.to_json(value))


def _write_object(entries: DataFrame, name: str, per_file: int = 5000) -> str:
    """JSON objects of all (n, entry) rows, per_file entries to a file, each in order of n: no task joins more."""
    path = f"{shared_folder(entries.sparkSession)}/{name}-{uuid.uuid4().hex}"
    parts = max(1, -(-entries.count() // per_file))
    dealt = entries.withColumn("file", F.pmod(F.xxhash64("n"), F.lit(parts))).groupBy("file")
    whole = dealt.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda e: e["entry"]), ",").alias("v"))
    whole.select("file", F.concat(F.lit("{"), "v", F.lit("}")).alias("value")).write.partitionBy("file").text(path)
    return path


def write_json(df: DataFrame, set_col: str, gene_col: str, order_col: str) -> str:
    """A flat file made of a table, in the shared folder; returns its path."""
    rows = df.groupBy(F.col(set_col).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order_col, gene_col))), lambda s: s[gene_col]).alias("genes"))
    return _write_object(rows.select("n", _json_text("n", "genes").alias("entry")), "gene-sets")


def write_collections(df: DataFrame, set_col: str, gene_col: str, order_col: str, collection_col: str) -> str:
    """A collection file made of a table, in the shared folder; a set's collection is the least of its rows'."""
    rows = df.groupBy(F.col(set_col).alias("n")).agg(
        F.min(collection_col).alias("collection"), F.transform(F.array_sort(F.collect_list(F.struct(order_col, gene_col))), lambda s: s[gene_col]).alias("geneSymbols")
    )
    rows = rows.select("n", F.struct("collection", F.filter("geneSymbols", lambda g: g.isNotNull()).alias("geneSymbols")).alias("v"))
    return _write_object(rows.select("n", _json_text("n", "v").alias("entry")), "collections")
