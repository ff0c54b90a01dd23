"""Helpers shared by the training-data operators: shared storage, word splitting on Arrow
buffers, 64-bit hashing in numpy, and distributed connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.storage import shared_folder

# ---------------------------------------------------------------- shared storage

_written: list[tuple[SparkSession, str]] = []


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            pass


atexit.register(_clean)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, lineage cut,
    safe when executors are lost. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/genoweft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._genoweft_path = path
    return out


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like materialize(), as a table bucketed by `key`: what is grouped by it later is read where it
    belongs and not shuffled."""
    spark, table = df.sparkSession, f"genoweft_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    _written.append((spark, path))
    out = spark.table(table)
    out._genoweft_path, out._genoweft_table = path, table
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables written by materialize() that no later step reads."""
    for t in tables:
        path = getattr(t, "_genoweft_path", None)
        if path:
            if getattr(t, "_genoweft_table", None):
                t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._genoweft_table}")
            drop_path(t.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


def fold_column(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fold(doc_id: int | None, parts: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def kept_columns(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> tuple[list[Column], dict[str, str], str]:
    """Columns that an operator hands on beside its result: those to send besides `text`, the column
    sent for each kept_*, their part of a schema. A string `text_col`, the widest, is sent once: as `text`."""
    sent = {f"kept_{c}": "text" if c == text_col and docs.schema[c].dataType == StringType() else f"kept_{c}" for c in keep}
    kinds = "".join(f", kept_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return [F.col(c).alias(f"kept_{c}") for c in keep if sent[f"kept_{c}"] != "text"], sent, kinds


# ---------------------------------------------------------------- words in numpy

#: The six ASCII white-space bytes that part words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_bounds(buf: np.ndarray, offs: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of each word; a word never crosses a document's end. `parts`: which bytes part words."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    black = ~parts[buf]
    before = np.empty_like(black)
    before[0], before[1:] = False, black[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    after = np.empty_like(black)
    after[-1], after[:-1] = False, black[1:]
    ends = offs[1:] - 1
    after[ends[ends >= 0]] = False
    return np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; starts and ends ascend. Words are taken by blocks of about
    `block` bytes, so that what is worked out on the way stays in the processor's caches."""
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        low = int(start[a])
        b = max(a + 1, int(np.searchsorted(end, low + block, "right")))
        some = buf[low : int(end[b - 1])]
        up, down = _power_tables(len(some) + 1)
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum((some.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        first, last = start[a:b] - low, end[a:b] - low
        h = (total[last] - total[first]) * down[first]
        out[a:b] = mix64(h + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        a = b
    return out


def text_chunks(column: pa.Array, most: int = 1 << 21, most_texts: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes and `most_texts` at most: first row, row after the last, bytes, offsets.
    A null is an empty text. One text is never split, however long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, n, a + most_texts)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """One array out of a column of binaries, whose buffers already lie end to end."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            offs = np.frombuffer(chunk.buffers()[1], np.int32)
            first, last = offs[chunk.offset], offs[chunk.offset + len(chunk)]
            if last > first:
                parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[first:last].view(dtype))
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def give_back() -> None:
    """Free memory that allocators keep, so that reused Python workers do not grow from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(fn):
    """A function of batches that gives memory back when its task ends."""

    @functools.wraps(fn)
    def call(batches, *args, **kw):
        yield from fn(batches, *args, **kw)
        give_back()

    return call


def per_group(df: DataFrame, key: str, fn, schema: str, **kw) -> DataFrame:
    """groupBy(key).applyInArrow of `fn(table, **kw)`."""

    def call(table: pa.Table) -> pa.Table:
        out = fn(table, **kw)
        give_back()
        return out

    return df.groupBy(key).applyInArrow(call, schema)


def lookup(left: DataFrame, right: DataFrame, key: str, total: int, parts: int = 1000) -> DataFrame:
    """`left` with the columns of `right`, null where none fits. `right` has one row of each key, and in
    `held` the number of rows of `left` that have it; `left` has `total` rows. Keys that hold more than
    1/parts of these are fewer than `parts`: only they are broadcast, so the shuffle meets no hot key."""
    hot = F.broadcast(right.where(F.col("held") * parts > total).drop("held"))
    cold = right.where(F.col("held") * parts <= total).drop("held")
    rest = left.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti").join(cold, key, "left")
    none = left.where(F.col(key).isNull())
    return left.join(hot, key).unionByName(rest).unionByName(none, allowMissingColumns=True)


# ---------------------------------------------------------------- components

#: Up to so many distinct links (16 MB) one task finds the components; beyond, star rounds do.
ONE_TASK_EDGES = 1_000_000


@tidy
def _union_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:  # nodes are sorted, so the least label is the least node
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])



def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of `edges(u long, v long)`; component is the least
    node reachable. Alternating large-star and small-star rounds, each a min per node and a
    join, so a hub's neighbours are never gathered in one row. Self-links and repeats are fine.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )

    def stamp(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = stamp(now)
    if seen[0] <= ONE_TASK_EDGES:
        return now.coalesce(1).mapInArrow(_union_all, "node long, component long")
    for _ in range(most_rounds):
        # Large star: greater neighbours go to the least of the closed neighbourhood.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("w"), F.col("u").alias("x")).join(
            low.select(F.col("u").alias("w"), "m"), "w"
        )
        large = large.select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: lesser neighbours and the node itself go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "cc")
        release(now)
        now, stamped = after, stamp(after)
        if stamped == seen:
            break
        seen = stamped
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
