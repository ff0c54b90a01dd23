"""Embedding near-dedup by a forest of random-projection trees.

Equal vectors of one label form a class. Every tree splits the classes of a label again and
again at the middle of a random projection; rows within `spill` of the middle (in rank) go to
both sides, until a leaf holds `leaf` rows at most. A split that would part a dense mass is
not made: where at least 1 in DENSE of sampled pairs from either side of a cut link, the group stays
one leaf, compared whole; so groups of many near copies lose no links to cuts. Rows that a projection
does not tell apart (ends of the spill within TIE of each other) go to one side together. Groups beyond `group_rows` are split first
across tasks, in as many rounds as their size needs: each round fits cut points of up to
`round_levels` levels on a sample of every such group (64 rows for each node it makes), in the
group's own task, and deals all rows by them; so every task recurses on a bounded group whatever
the size of a label. In a leaf all pairs are compared in double precision. A pair that shares
several leaves counts in the least of them, which both rows' leaf lists tell, so no pair is ever
sent on: leaves return link counts per row and a spanning set of links.

Edge cases: null or unequal labels, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; repeated rows of one id are one vector of each
distinct content under that id; rows without an id are one vector of each content: they are
counted as links, never name a component, and are kept if their component has no id at all;
vectors of any length are compared whole; an empty table gives an empty result; other columns,
of whatever names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, mix64, per_group, release, tidy


#: Sampled pairs across a cut, of which 1 in DENSE that links tells a dense mass; difference of projections that counts as none.
PAIRS, DENSE, TIE = 512, 50, 1e-9


def _direction(seed: int, tree: int, node: int, level: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, node & (2**64 - 1), level]).standard_normal(dim)


def _cuts(x: np.ndarray, spill: float) -> tuple[float, float]:
    lo, hi = np.quantile(x, [0.5 - spill, 0.5 + spill])
    return float(lo), float(hi)


def _sides(x: np.ndarray, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """Rows on the left and on the right of a cut with its spill."""
    tied = np.asarray(hi - lo <= TIE)
    return x <= hi + TIE * tied, np.where(tied, x > hi + TIE, x >= lo)


def _parts_mass(unit: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, rng) -> bool:
    """Whether a cut goes through a dense mass, by pairs of a row on the left only and one on the right only."""
    a, b = np.flatnonzero(left & ~right), np.flatnonzero(right & ~left)
    if not len(a) or not len(b):
        return False
    i, j = a[rng.integers(0, len(a), PAIRS)], b[rng.integers(0, len(b), PAIRS)]
    return int((np.einsum("nd,nd->n", unit[i], unit[j]) >= least).sum()) * DENSE >= PAIRS


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a column of lists of `dim` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    values = values / np.abs(values).max(1, keepdims=True, initial=1e-300)  # no square runs over
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _fit(table: pa.Table, spill: float, seed: int) -> pa.Table:
    """Cut points of one group, level by level, from its sample."""
    tree, node, dim, depth = (table[c][0].as_py() for c in ("tree", "node", "dim", "depth"))
    unit = _units(table["vec"], dim)
    at, out = np.zeros(len(unit), np.int64), []
    for level in range(depth):
        x = unit @ _direction(seed, tree, node, level, dim)
        cuts, mid = np.zeros((1 << level, 2)), np.zeros(1 << level)
        for k in np.unique(at):
            cuts[k], mid[k] = _cuts(x[at == k], spill), np.median(x[at == k])
        out.append(cuts.ravel())
        at = at * 2 + (x > mid[at])
    return pa.table({"label": table["label"][:1], "dim": table["dim"][:1], "tree": table["tree"][:1], "node": table["node"][:1], "cuts": pa.array([np.concatenate(out).tobytes()], pa.binary())})


@tidy
def _route(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of groups with cut points to the nodes below these."""
    for batch in batches:
        names = ("dim", "tree", "node")
        keys = np.stack([batch[c].to_numpy() for c in names], 1).astype(np.int64)
        for dim, tree, node in np.unique(keys, axis=0).tolist():
            rows = np.flatnonzero((keys == (dim, tree, node)).all(1))
            by_cuts: dict[bytes | None, list[int]] = {}
            for r, c in zip(rows.tolist(), batch["cuts"].take(pa.array(rows)).to_pylist(), strict=True):
                by_cuts.setdefault(c, []).append(r)  # labels have cut points of their own
            for packed, some in by_cuts.items():
                rows = np.array(some)
                own, at = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                if packed is not None:
                    unit, cuts, level = _units(batch["vec"].take(pa.array(rows)), dim), np.frombuffer(packed).reshape(-1, 2), 0
                    while len(cuts):
                        here, cuts = cuts[: 1 << level], cuts[1 << level :]
                        x = unit[own] @ _direction(seed, tree, node, level, dim)
                        left, right = _sides(x, here[at, 0], here[at, 1])
                        own, at = np.concatenate([own[left], own[right]]), np.concatenate([at[left] * 2, at[right] * 2 + 1])
                        level += 1
                    at = mix64(np.uint64(node & (2**64 - 1)) + mix64(at.astype(np.uint64) + np.uint64(1))).view(np.int64)
                else:
                    at = np.full(len(rows), node)
                take = pa.array(rows[own])
                yield pa.RecordBatch.from_arrays([*(batch[c].take(take) for c in ("label", "dim", "tree")), pa.array(at), batch["cid"].take(take), batch["vec"].take(take)], ["label", "dim", "tree", "node", "cid", "vec"])


def _leaves(table: pa.Table, leaf: int, spill: float, seed: int, least: float = 0.93) -> pa.Table:
    """(cid, leaf) of a group: recursion until leaves are small or dense."""
    label, dim, tree, top = (table[c][0].as_py() for c in ("label", "dim", "tree", "node"))
    cid, unit = table["cid"].to_numpy(), _units(table["vec"], dim)
    root = np.zeros(1, np.uint64)
    for part in (label, dim, tree, top):  # in order: no two groups share a name
        root = mix64(root * np.uint64(0xD6E8FEB86659FD93) + np.uint64(part & (2**64 - 1)) + np.uint64(1))
    root = int(root[0])
    out_c, out_l, todo = [], [], [(np.arange(len(cid)), 1)]
    while todo:
        rows, path = todo.pop()
        parts: list[np.ndarray] = []
        if len(rows) > leaf:
            x = unit[rows] @ _direction(seed, tree, top, path, dim)
            left, right = _sides(x, *_cuts(x, spill))
            if not _parts_mass(unit[rows], left, right, least, np.random.default_rng([seed, tree, top & (2**64 - 1), path])):
                parts = [rows[left], rows[right]]
        if not parts or max(map(len, parts)) == len(rows):  # nothing splits them: they stay together
            out_c.append(cid[rows])
            name = int(mix64(np.array([(root + path * 0x9E3779B97F4A7C15) & (2**64 - 1)], np.uint64)).view(np.int64)[0])
            out_l.append(np.full(len(rows), name))
        else:
            todo += [(p, path * 2 + k) for k, p in enumerate(parts)]
    return pa.table({"cid": np.concatenate(out_c), "leaf": np.concatenate(out_l)})


def _compare(table: pa.Table, least: float) -> pa.Table:
    """Link counts and a spanning set of links from the leaves of one bucket."""
    leaf, cid, size = (table[c].to_numpy() for c in ("leaf", "cid", "size"))
    lists, vectors = table["leaves"].combine_chunks(), table["vec"].combine_chunks()
    edge = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    member = lists.flatten().to_numpy()
    out: dict[str, list] = {"u": [], "v": [], "links": []}
    order = np.argsort(leaf, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        if len(rows) < 2:
            continue
        # Lesser leaves of each row: pairs that share one count there.
        n = edge[rows + 1] - edge[rows]
        flat = member[np.repeat(edge[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        who, less = np.repeat(np.arange(len(rows)), n), flat < leaf[rows[0]]
        names, at, many = np.unique(flat[less], return_inverse=True, return_counts=True)
        if many.max(initial=0) == len(rows):  # a lesser leaf holds them all
            continue
        unit = _units(vectors.take(pa.array(rows)), len(vectors[int(rows[0])]))
        shared = np.zeros((len(rows), len(names)), np.float32)
        shared[who[less], at] = 1
        shared = shared[:, many > 1]
        step = max(1, (1 << 24) // max(1, shared.shape[1]))
        links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for a in range(0, len(rows), 1024):
            near = unit[a : a + 1024] @ unit.T >= least
            k = np.arange(len(near))
            near[k, a + k] = False
            i, j = np.nonzero(near)
            if len(i) * 8 > near.size:  # dense: leaves that pairs share, all at once
                new = near & (shared[a : a + 1024] @ shared.T == 0)
                links[a : a + 1024] += (new @ size[rows].astype(float)).astype(np.int64)  # whole numbers below 2**53
                i += a
            else:
                i += a
                new = [(shared[i[k : k + step]] * shared[j[k : k + step]]).sum(1) == 0 for k in range(0, len(i), step)]
                new = np.concatenate(new) if new else np.empty(0, bool)
                links += np.bincount(i[new], size[rows[j[new]]], len(rows)).astype(np.int64)
            while True:  # the least row reachable, by the links of the blocks so far
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                u, v = label[i], label[j]
                np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
                while (label[label] != label).any():
                    label = label[label]
        some = (links > 0) | (label != np.arange(len(rows)))
        out["u"].append(cid[rows[some]])
        out["v"].append(cid[rows[label[some]]])
        out["links"].append(links[some])
    return pa.table({k: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for k, v in out.items()})


def deal(classes: DataFrame, trees: int, spill: float, group_rows: int, round_levels: int, seed: int) -> DataFrame:
    """(label, dim, tree, node, cid, vec): each class in its groups of every tree, of about group_rows rows."""
    node = ["label", "dim", "tree", "node"]
    schema = "label long, dim int, tree int, node long, cid long, vec array<double>"
    dealt = classes.select("label", F.size("vec").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), "cid", "vec")
    sizes = classes.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("rows")).select("label", "dim", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), "rows")
    stuck, halves = None, 1 - math.log2(1 + 2 * spill)  # what a level leaves of a group, spill and all
    while True:
        large = sizes.where(F.col("rows") > group_rows)
        if stuck is not None:  # a group that no cut makes smaller holds vectors that no projection tells apart
            large = large.where(F.col("rows") < stuck)
        large = materialize(large.withColumn("depth", F.least(F.ceil(F.log2(F.col("rows") / group_rows) / halves), F.lit(round_levels)).cast("int")), "large")
        most = large.agg(F.max("rows")).first()[0]
        if most is None:
            return dealt
        stuck = most
        share = F.lit(64.0) * F.pow(F.lit(2.0), "depth") / F.col("rows")
        key = F.pmod(F.xxhash64("cid", "tree", "node"), F.lit(1 << 30)) / float(1 << 30)
        sample = dealt.join(large, node).where(key < share).select(*node, "depth", "vec")
        cuts = materialize(per_group(sample.withColumn("grp", F.xxhash64(*node)), "grp", _fit, "label long, dim int, tree int, node long, cuts binary", spill=spill, seed=seed), "cuts")
        after = dealt.join(cuts, node, "left").mapInArrow(partial(_route, seed=seed), schema)
        dealt = materialize(after, "dealt")
        sizes = dealt.groupBy(*node).agg(F.count("*").alias("rows"))


def near_vectors(table: DataFrame, least: float = 0.93, trees: int = 12, leaf: int = 256, spill: float = 0.05, group_rows: int = 8192, round_levels: int = 10, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    size = F.countDistinct("vec_id") + F.max(F.col("vec_id").isNull().cast("int"))
    classes = rows.where(good).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), size.cast("long").alias("size"))
    classes = materialize(classes.withColumn("cid", F.xxhash64("label", "vec")), "vectors")
    dealt = deal(classes, trees, spill, group_rows, round_levels, seed)
    leaves = per_group(dealt.withColumn("grp", F.xxhash64("label", "dim", "tree", "node")), "grp", _leaves, "cid long, leaf long", leaf=leaf, spill=spill, seed=seed, least=least)
    lists = leaves.groupBy("cid").agg(F.collect_set("leaf").alias("leaves"))
    whole = classes.join(lists, "cid")
    buckets = max(16, -(-classes.count() * trees // 2048))
    spread = whole.select("cid", "size", "vec", "leaves", F.explode("leaves").alias("leaf"))
    spread = spread.withColumn("bucket", F.pmod(F.col("leaf"), F.lit(buckets)))
    found = materialize(per_group(spread, "bucket", _compare, "u long, v long, links long", least=least), "found")
    release(dealt)
    comp = connected_components(found.select("u", "v"))
    links = found.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    named = (
        classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
        .select("label", "vec", "least", F.col("size").alias("same"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    )
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(first, "component")
    keyed = rows.withColumn("good", good)
    linked = keyed.where("good").join(named, ["label", "vec"]).select("vec_id", (F.col("links") + F.col("same") - 1).alias("n_links"), F.col("first").alias("component_id"))
    alone = keyed.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_projection_forest(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
