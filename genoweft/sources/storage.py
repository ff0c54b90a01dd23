"""Where intermediate tables and files lie."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, which
    has no other machine, may do without and gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="genoweft-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Tables written to the shared folder: computed once, lineage cut, safe when executors are lost.
    Those not removed before go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.held = spark, name, {}
        atexit.register(self.clear)

    def write(self, df: DataFrame, buckets: int | None = None, key: tuple[str, ...] = ()) -> DataFrame:
        """`df` as written; with `buckets`, as a table bucketed by `key`: joins on it do not shuffle it again."""
        table = f"genoweft_{self.name}_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{table}"
        if buckets:
            df.write.bucketBy(buckets, *key).format("parquet").option("path", path).saveAsTable(table)
            out = self.spark.table(table)
        else:
            df.write.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        self.held[path] = table if buckets else None
        out._at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = t._at
            table = self.held.pop(path, None)
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete_path(self.spark, path)

    def clear(self) -> None:
        for path in list(self.held):
            try:
                table = self.held.pop(path)
                if table:
                    self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                delete_path(self.spark, path)
            except Exception:  # the session has ended; the folder's owner clears it
                pass
