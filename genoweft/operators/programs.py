"""Programs: clustering of factors, their genes, curation, stability, comparison and annotation.

members(factor_id, sample_id, program) is the table of a clustering.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjust_pvalues, hypergeom_sf
from ..sources.storage import Workspace
from . import kernels
from .core import combined_score, require_columns, top_genes
from .graph import components

METHODS = ("single", "complete", "average", "ward")
METRICS = ("ratio", "delta", "silhouette")

# ---------------------------------------------------------------- clustering


def _graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors (factor_id, sample_id), and the similarities other than 0 among them."""
    n = nodes.select(F.col("factor_id").cast("int").alias("factor_id"), F.col("sample_id").cast("long").alias("sample_id")).distinct()
    e = edges.where("sim <> 0").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("sim").cast("double").alias("sim"))
    return n, e.join(n.select(F.col("factor_id").alias("i")), "i", "left_semi").join(n.select(F.col("factor_id").alias("j")), "j", "left_semi")


def _by_part(nodes: DataFrame, edges: DataFrame, part: DataFrame) -> DataFrame:
    """Factors (i < 0) and similarities of each part, to be grouped by it. part: (factor_id, part)."""
    n = nodes.join(part, "factor_id").select("part", "factor_id", "sample_id", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0.0).alias("sim"))
    other = part.select(F.col("factor_id").alias("j"), F.col("part").alias("pj"))
    e = edges.join(part.withColumnRenamed("factor_id", "i"), "i").join(other, "j").where("part = pj")
    return n.unionByName(e.select("part", F.lit(-1).alias("factor_id"), F.lit(-1).cast("long").alias("sample_id"), "i", "j", "sim"))


def _split(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = pdf[pdf["factor_id"] >= 0].sort_values("factor_id")
    ids = nodes["factor_id"].to_numpy()
    s = np.zeros((len(ids), len(ids)))
    edges = pdf[pdf["i"] >= 0]
    a, b = np.searchsorted(ids, edges["i"]), np.searchsorted(ids, edges["j"])
    s[a, b] = s[b, a] = edges["sim"]
    return ids, nodes["sample_id"].to_numpy(), s


def _parts(nodes: DataFrame, edges: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Rows of each connected part, and the factors without a similarity.

    Merging above a threshold of at least 0 joins no two parts: between them all similarities are 0."""
    part = work.write(components(edges).select(F.col("node").alias("factor_id"), F.col("component").alias("part")))
    lone = nodes.join(part, "factor_id", "left_anti")
    return _by_part(nodes, edges, part), lone


def ordered(labels: DataFrame, edges: DataFrame, reorder: bool = True, method: str = "average") -> DataFrame:
    """(factor_id, sample_id, program, display_pos) of labels(factor_id, sample_id, cluster) and the
    similarities among all factors: clusters by size, each in leaf order, pairs by mean similarity, one
    group per program; then every program's first position is added. Without reorder, by factor."""
    own = labels.groupBy("cluster").agg(F.count("*").alias("n"), F.min("factor_id").alias("least"))
    if not reorder:
        own = own.withColumn("program", (F.row_number().over(Window.orderBy("least")) - 1).cast("int"))
        placed = labels.join(own.select("cluster", "program"), "cluster")
        return placed.select("factor_id", "sample_id", "program", (F.row_number().over(Window.orderBy("factor_id")) - 1).cast("int").alias("display_pos"))
    rank = Window.orderBy(F.desc("n"), "cluster")
    own = own.select("cluster", "n", (F.row_number().over(rank) - 1).cast("int").alias("program"), (F.sum("n").over(rank.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).cast("int").alias("offset"))
    placed = labels.join(own, "cluster")

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, _, s = _split(pdf)
        d = 1.0 - s
        order = kernels.optimal_leaf_order(kernels.linkage_tree(d, method), d)[::-1]
        return pd.DataFrame({"factor_id": ids[order], "at": range(len(ids))})

    many = placed.where("n > 2").select("factor_id", F.col("program").alias("part"))
    in_leaf_order = _by_part(labels.select("factor_id", "sample_id"), edges, many).groupBy("part").applyInPandas(leaves, "factor_id int, at int")
    ends = edges.select(F.col("i").alias("factor_id"), "sim").union(edges.select("j", "sim"))
    total = ends.join(placed.where("n <= 2").select("factor_id"), "factor_id", "left_semi").groupBy("factor_id").agg(F.round(F.sum("sim"), 12).alias("total"))
    few = placed.where("n <= 2").select("factor_id", "program").join(total, "factor_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    by_mean = Window.partitionBy("program").orderBy(F.desc("total"), "factor_id")
    at = in_leaf_order.union(few.select("factor_id", (F.row_number().over(by_mean) - 1).cast("int")))
    return placed.join(at, "factor_id").select("factor_id", "sample_id", "program", (F.col("offset") + F.col("at")).alias("display_pos"))


def programs_centroid(nodes: DataFrame, edges: DataFrame, threshold: float = 0.1, min_cluster: int = 2, method: str = "average", reorder: bool = True, inter_only: bool = False) -> DataFrame:
    """Members by average-linkage merging above `threshold`, one group per connected part of the
    similarities: a part of n factors takes n^2 values."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    if min_cluster < 1:
        raise ValueError("min_cluster must be at least 1")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "ward":
        warnings.warn("ward on similarities is an approximation", UserWarning, stacklevel=2)
    work = Workspace(nodes.sparkSession, "centroid")
    n, e = _graph(nodes, edges)
    e = work.write(e)
    rows, lone = _parts(n, e, work)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, samples, s = _split(pdf)
        labels = kernels.centroid_clusters(s, samples, threshold, min_cluster, inter_only)
        own = labels >= 0
        first = {c: ids[labels == c].min() for c in np.unique(labels[own])}
        return pd.DataFrame({"factor_id": ids[own], "sample_id": samples[own], "cluster": [first[c] for c in labels[own]]})

    labels = rows.groupBy("part").applyInPandas(run, "factor_id int, sample_id long, cluster int")
    if min_cluster == 1:
        labels = labels.union(lone.select("factor_id", "sample_id", "factor_id"))
    return work.write(ordered(work.write(labels), e, reorder, method))


def programs_progressive(loadings: DataFrame, edges: DataFrame, n_genes: int, top_k: int = 50, min_overlap: int = 10, min_founder_overlaps: int = 6, min_cluster: int = 2, reorder: bool = True) -> DataFrame:
    """Members by founders that grow with the overlap of their evolving gene set.

    Founders follow each other, so one task finds them; it holds the factors' top genes as postings
    (top_k per factor), never a factors x genes or factors x factors matrix. How many partners each
    factor begins with is an equi-join on genes before that."""
    if top_k < 1 or min_overlap < 1 or min_founder_overlaps < 0 or min_cluster < 1:
        raise ValueError("top_k, min_overlap and min_cluster must be at least 1, min_founder_overlaps at least 0")
    if min_overlap > top_k:
        raise ValueError("min_overlap must not exceed top_k")
    if top_k > n_genes:
        raise ValueError("top_k exceeds the number of genes")
    work = Workspace(loadings.sparkSession, "progressive")
    n, e = _graph(loadings, edges)
    e = work.write(e)
    top = work.write(top_genes(loadings, top_k).select(F.col("factor_id").cast("int").alias("factor_id"), F.col("sample_id").cast("long").alias("sample_id"), F.col("gene_idx").cast("int").alias("gene_idx"), "loading"))
    a, b = top.select(F.col("factor_id").alias("a"), "gene_idx"), top.select(F.col("factor_id").alias("b"), "gene_idx")
    shared = a.join(b, "gene_idx").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_overlap)
    partners = shared.select(F.explode(F.array("a", "b")).alias("factor_id")).groupBy("factor_id").agg(F.count("*").alias("partners"))
    rows = top.groupBy("factor_id", "sample_id").agg(F.collect_list("gene_idx").alias("genes"), F.collect_list("loading").alias("values")).join(partners, "factor_id", "left").withColumn("g", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("factor_id")
        labels = kernels.progressive_clusters(
            [np.asarray(g) for g in pdf["genes"]], [np.asarray(v) for v in pdf["values"]], pdf["sample_id"].to_numpy(), top_k, min_overlap, min_founder_overlaps, min_cluster, pdf["partners"].fillna(0).to_numpy(np.int64)
        )
        own = labels >= 0
        return pd.DataFrame({"factor_id": pdf["factor_id"].to_numpy()[own], "sample_id": pdf["sample_id"].to_numpy()[own], "cluster": labels[own]})

    labels = work.write(rows.groupBy("g").applyInPandas(run, "factor_id int, sample_id long, cluster int"))
    return work.write(ordered(labels, e, reorder, "average"))


def programs_cluster(strategy: str, *args, **kw) -> DataFrame:
    if strategy == "centroid":
        return programs_centroid(*args, **kw)
    if strategy == "progressive":
        return programs_progressive(*args, **kw)
    raise ValueError("strategy must be 'centroid' or 'progressive'")


def programs_threshold(nodes: DataFrame, edges: DataFrame, thresholds: Sequence[float] | None = None, min_cluster: int = 2, metric: str = "ratio", method: str = "average") -> DataFrame:
    """(threshold, metric, is_local_max, is_optimal) of a sweep; invalid partitions have a null metric."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if min_cluster < 1:
        raise ValueError("min_cluster must be at least 1")
    grid = np.linspace(0, 1, 50) if thresholds is None else np.asarray(thresholds, float)
    work = Workspace(nodes.sparkSession, "sweep")
    n, e = _graph(nodes, edges)
    rows, lone = _parts(n, work.write(e), work)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, samples, s = _split(pdf)
        known: dict = {}
        made = []
        for i, t in enumerate(grid):
            labels = kernels.centroid_clusters(s, samples, float(t), min_cluster, known=known)
            own = labels >= 0
            if own.any():
                made.append((i, *kernels.part_scores(s[np.ix_(own, own)], labels[own])))
        return pd.DataFrame(made, columns=["at", "factors", "clusters", "squares", "inner", "outer", "alone", "among"])

    kind = "at int, factors long, clusters long, squares long, inner double, outer double, alone double, among double"
    parts = rows.groupBy("part").applyInPandas(run, kind)
    if min_cluster == 1:  # factors without a similarity are clusters of their own at any threshold
        one = F.col("n")
        single = lone.agg(F.count("*").alias("n")).where("n > 0").select(F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("at"), one.alias("factors"), one.alias("clusters"), one.alias("squares"), *[F.lit(0.0).alias(c) for c in ("inner", "outer", "alone", "among")])
        parts = parts.unionByName(single)
    parts = work.write(parts)
    every = parts.groupBy("at").agg(F.sum("clusters").alias("total"))
    # A cluster of another part is at distance 1 of a factor.
    silhouette = F.sum(F.when(F.col("total") > F.col("clusters"), F.col("among")).otherwise(F.col("alone")))
    sums = parts.join(every, "at").groupBy("at").agg(F.sum("factors").alias("f"), F.first("total").alias("c"), F.sum("squares").alias("q"), F.sum("inner").alias("si"), F.sum("outer").alias("so"), silhouette.alias("sil"))
    inner, outer = F.col("si") / F.col("q"), F.col("so") / (F.col("f") * F.col("f") - F.col("q"))
    if metric == "silhouette":
        value = F.when(F.col("c") < F.col("f") - 1, F.col("sil") / F.col("f"))
    else:
        value = inner - outer if metric == "delta" else F.when(outer > 0, inner / outer)
    found = {r["at"]: r["v"] for r in sums.where("c >= 2 and c < f").select("at", value.alias("v")).collect()}  # a row per threshold
    y = np.array([-np.inf if found.get(i) is None else found[i] for i in range(len(grid))])
    if not np.isfinite(y).any():
        raise ValueError("no threshold gives a valid partition")
    with np.errstate(invalid="ignore"):
        sign = np.sign(np.nan_to_num(np.diff(y), nan=0.0, posinf=1, neginf=-1))
    peak = np.zeros(len(grid), bool)
    peak[1:-1] = np.diff(sign) < 0
    peak &= np.isfinite(y)
    best = int(np.argmax(np.where(peak, y, -np.inf) if peak.any() else y))
    rows = [(float(t), found.get(i), bool(peak[i]), i == best) for i, t in enumerate(grid)]
    return nodes.sparkSession.createDataFrame(rows, "threshold double, metric double, is_local_max boolean, is_optimal boolean")


def best_threshold(sweep: DataFrame) -> float:
    """The threshold that a sweep marks as optimal."""
    row = require_columns(sweep, "threshold", "is_optimal").where("is_optimal").first()
    if row is None:
        raise ValueError("no threshold gives a valid partition")
    return float(row["threshold"])


def sweep_peaks(sweep: DataFrame) -> DataFrame:
    """(threshold, metric) of local maxima other than the optimum."""
    return sweep.where("is_local_max and not is_optimal").select("threshold", "metric")


# ---------------------------------------------------------------- what a program is


def centroids(members: DataFrame, loadings: DataFrame) -> DataFrame:
    """(program, gene_idx, loading): mean loading of the members."""
    m = members.select("factor_id", "program")
    return loadings.join(m, "factor_id").groupBy("program", "gene_idx").agg(F.avg("loading").alias("loading"))


def program_genes(cents: DataFrame, n_top: int = 50) -> DataFrame:
    """(program, rank, gene_idx): genes of highest combined score across programs."""
    return top_genes(combined_score(cents), n_top, "score", "program").select("program", "rank", "gene_idx")


def meta_genes(members: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """(program, gene_idx, freq, max_loading): the k genes most members have in their top set."""
    held = top.join(members.select("factor_id", "program"), "factor_id")
    freq = held.groupBy("program", "gene_idx").agg(F.count("*").alias("freq"), F.max("loading").alias("max_loading"))
    order = Window.partitionBy("program").orderBy(F.desc("freq"), F.desc("max_loading"), "gene_idx")
    return freq.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def gene_lists(genes: DataFrame) -> DataFrame:
    """(name, genes): `C{program}` and its genes in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "gene_idx")))
    return require_columns(genes, "program", "rank", "gene_idx").groupBy("program").agg(F.transform(ordered, lambda s: s["gene_idx"]).alias("genes")).select(F.concat(F.lit("C"), F.col("program").cast("string")).alias("name"), "genes")


def program_samples(members: DataFrame) -> DataFrame:
    return members.groupBy("program").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))


def donor_counts(members: DataFrame) -> DataFrame:
    """(donor, program, n_factors, fraction) of the full donor by program grid."""
    grid = members.select(F.col("sample_id").alias("donor")).distinct().crossJoin(members.select("program").distinct())
    n = members.groupBy(F.col("sample_id").alias("donor"), "program").agg(F.count("*").alias("n"))
    out = grid.join(n, ["donor", "program"], "left").select("donor", "program", F.coalesce("n", F.lit(0)).alias("n_factors"))
    return out.withColumn("fraction", F.col("n_factors") / F.sum("n_factors").over(Window.partitionBy("program")))


def program_share(members: DataFrame, metric: str = "n_factors", scores: DataFrame | None = None) -> DataFrame:
    """(program, donor, value) of the full grid: factors, their share of the program, or the donor's
    aggregate score P{program} of `scores` (sample_id, P0, ...), 0 for donors that it lacks."""
    if metric not in ("n_factors", "fraction", "mean_score"):
        raise ValueError("metric must be 'n_factors', 'fraction' or 'mean_score'")
    grid = donor_counts(members)
    if metric != "mean_score":
        return grid.select("program", "donor", F.col(metric).cast("double").alias("value"))
    if scores is None:
        raise KeyError("mean_score needs aggregate scores")
    programs = sorted(_known(members))
    require_columns(scores, "sample_id", *[f"P{p}" for p in programs])
    long = scores.select(F.col("sample_id").alias("donor"), F.explode(F.create_map(*[x for p in programs for x in (F.lit(p), F.col(f"P{p}").cast("double"))])).alias("program", "value"))
    return grid.select("program", "donor").join(long, ["program", "donor"], "left").select("program", "donor", F.coalesce("value", F.lit(0.0)).alias("value"))


def partition_quality(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(inner, outer, ratio, delta): mean similarity of same-program cells (zero diagonal included) and of the others."""
    m = members.select("factor_id", "program")
    e = edges.join(m.select(F.col("factor_id").alias("i"), F.col("program").alias("pi")), "i").join(m.select(F.col("factor_id").alias("j"), F.col("program").alias("pj")), "j")
    sums = e.agg(F.sum(F.when(F.col("pi") == F.col("pj"), 2 * F.col("sim")).otherwise(0.0)).alias("si"), F.sum(F.when(F.col("pi") != F.col("pj"), 2 * F.col("sim")).otherwise(0.0)).alias("so"))
    size = m.groupBy("program").count().agg(F.sum(F.col("count") * F.col("count")).alias("ci"), F.pow(F.sum("count"), F.lit(2)).alias("all"))
    inner, outer = F.col("si") / F.col("ci"), F.col("so") / (F.col("all") - F.col("ci"))
    return sums.crossJoin(size).select(inner.alias("inner"), outer.alias("outer"), (inner / outer).alias("ratio"), (inner - outer).alias("delta"))


def silhouette(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(silhouette) of distance 1 - sim; null unless 1 < programs < factors - 1."""
    m = members.select("factor_id", "program")
    size = m.groupBy("program").agg(F.count("*").alias("n"))
    both = edges.select("i", "j", "sim").union(edges.select("j", "i", "sim"))
    sums = both.join(m.withColumnRenamed("factor_id", "j"), "j").groupBy(F.col("i").alias("factor_id"), F.col("program").alias("other")).agg(F.sum("sim").alias("s"))
    grid = m.crossJoin(size.select(F.col("program").alias("other"), "n")).join(sums, ["factor_id", "other"], "left")
    s, own = F.coalesce("s", F.lit(0.0)), F.col("other") == F.col("program")
    grid = grid.select("factor_id", own.alias("own"), "n", F.when(own, (F.col("n") - 1 - s) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise((F.col("n") - s) / F.col("n")).alias("d"))
    per = grid.groupBy("factor_id").agg(F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"), F.max(F.when(F.col("own"), F.col("n"))).alias("n"))
    score = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    counts = m.agg(F.count_distinct("program").alias("c"), F.count("*").alias("f"))
    return per.agg(F.avg(score).alias("v")).crossJoin(counts).select(F.when((F.col("c") > 1) & (F.col("c") < F.col("f") - 1), F.col("v")).alias("silhouette"))


# ---------------------------------------------------------------- curation


def _known(members: DataFrame) -> set[int]:
    return {r["program"] for r in members.select("program").distinct().collect()}  # programs, not rows


def programs_merge(members: DataFrame, clusters: Sequence, edges: DataFrame | None = None, method: str = "average") -> DataFrame:
    """Members with every group of labels merged into its least; with `edges`, ordered anew and
    labelled in display order (rebuild()), else made contiguous."""
    require_columns(members, "factor_id", "sample_id", "program")
    groups = [list(g) for g in clusters] if clusters and isinstance(clusters[0], Iterable) else [list(clusters)] if clusters else []
    if not groups:
        raise ValueError("clusters must not be empty")
    known, seen = _known(members), set()
    for g in groups:
        if len(set(g)) < 2:
            raise ValueError("each group needs at least 2 programs")
        missing = sorted(set(g) - known)
        if missing:
            raise ValueError(f"programs not found: {missing}")
        if seen & set(g):
            raise ValueError(f"programs in more than one group: {sorted(seen & set(g))}")
        seen |= set(g)
    label = F.col("program")
    for g in groups:
        label = F.when(F.col("program").isin([int(x) for x in g]), int(min(g))).otherwise(label)
    merged = members.withColumn("program", label)
    return _contiguous(merged) if edges is None else rebuild(merged, edges, method)


def programs_remove(members: DataFrame, clusters: Sequence[int], edges: DataFrame | None = None, method: str = "average") -> DataFrame:
    """Members without the labels; the rest ordered and labelled as in programs_merge()."""
    require_columns(members, "factor_id", "sample_id", "program")
    if not clusters:
        raise ValueError("clusters must not be empty")
    known = _known(members)
    missing = sorted(set(clusters) - known)
    if missing:
        raise ValueError(f"programs not found: {missing}")
    if len(set(clusters)) != len(clusters):
        raise ValueError("duplicate programs")
    if set(clusters) == known:
        raise ValueError("cannot remove all programs")
    left = members.where(~F.col("program").isin([int(c) for c in clusters]))
    return _contiguous(left) if edges is None else rebuild(left, edges, method)


def _contiguous(members: DataFrame) -> DataFrame:
    new = members.select("program").distinct().withColumn("p", (F.row_number().over(Window.orderBy("program")) - 1).cast("int"))
    return members.join(new, "program").drop("program").withColumnRenamed("p", "program")


def rebuild(members: DataFrame, edges: DataFrame, method: str = "average") -> DataFrame:
    """(factor_id, sample_id, program, display_pos) of members whose labels changed: display order
    found anew, labels contiguous in it."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    work = Workspace(members.sparkSession, "rebuild")
    _, e = _graph(members, edges)
    label = members.select(F.col("factor_id").cast("int").alias("factor_id"), F.col("sample_id").cast("long").alias("sample_id"), F.col("program").cast("int").alias("cluster")).distinct()
    return work.write(ordered(work.write(label), work.write(e), True, method))


def finalise(members: DataFrame, loadings: DataFrame, edges: DataFrame, n_top: int = 50, member_top: DataFrame | None = None) -> dict[str, DataFrame]:
    """What belongs to a clustering: members, centroids, genes (program, rank, gene_idx), samples and
    stats (inner, outer, silhouette). With member_top (progressive mode) the genes are those most
    members have, else those of highest combined score. After programs_merge() or
    programs_remove() the same call gives the rebuilt state."""
    require_columns(members, "factor_id", "sample_id", "program")
    if n_top < 1:
        raise ValueError("n_top must be at least 1")
    cents = centroids(members, loadings)
    if member_top is None:
        genes = program_genes(cents, n_top)
    else:
        order = Window.partitionBy("program").orderBy("gene_idx")
        genes = meta_genes(members, member_top, n_top).select("program", F.row_number().over(order).alias("rank"), "gene_idx")
    stats = partition_quality(members, edges).select("inner", "outer").crossJoin(silhouette(members, edges))
    return {"members": members, "centroids": cents, "genes": genes, "samples": program_samples(members), "stats": stats}


# ---------------------------------------------------------------- comparison


def program_overlaps(a: DataFrame, b: DataFrame, metric: str = "jaccard") -> DataFrame:
    """(program_a, program_b, value) of all programs of two tables (program, gene_idx): set overlaps."""
    if metric not in ("jaccard", "overlap_coefficient"):
        raise ValueError("metric must be 'jaccard' or 'overlap_coefficient'")
    sa = a.groupBy(F.col("program").alias("program_a")).agg(F.collect_set("gene_idx").alias("ga"))
    sb = b.groupBy(F.col("program").alias("program_b")).agg(F.collect_set("gene_idx").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb")).cast("double")
    under = F.size(F.array_union("ga", "gb")) if metric == "jaccard" else F.least(F.size("ga"), F.size("gb"))
    return sa.crossJoin(sb).select("program_a", "program_b", F.coalesce(both / F.nullif(under, F.lit(0)), F.lit(0.0)).alias("value"))


def programs_stability(members: DataFrame, loadings: DataFrame, genes: DataFrame, top_k: int = 50, mode: str = "centroid", member_top: DataFrame | None = None, min_program_genes: int = 1) -> DataFrame:
    """(program, donor, jaccard, contributed): gene set without one donor's factors against the
    program's own first top_k genes (program, rank, gene_idx); null when no member is left.

    Sums over a program less those of one donor give what is left, so no factor is copied per
    donor; donors without a member of a program share one result of the whole program."""
    require_columns(members, "factor_id", "sample_id", "program")
    require_columns(genes, "program", "rank", "gene_idx")
    if top_k < 1 or min_program_genes < 1:
        raise ValueError("top_k and min_program_genes must be at least 1")
    if mode not in ("centroid", "progressive"):
        warnings.warn("unknown mode; using 'centroid'", UserWarning, stacklevel=2)
        mode = "centroid"
    held = {r["program"]: r["n"] for r in genes.groupBy("program").agg(F.count("*").alias("n")).collect()}  # programs, not rows
    few, cut = sorted(p for p, n in held.items() if n < min_program_genes), sorted(p for p, n in held.items() if n > top_k)
    if few:
        warnings.warn(f"programs of fewer than {min_program_genes} genes: {few}", UserWarning, stacklevel=2)
    if cut:
        warnings.warn(f"programs of more than {top_k} genes are cut to these: {cut}", UserWarning, stacklevel=2)
    m = members.select("factor_id", "program", F.col("sample_id").alias("donor"))
    canonical = genes.where(F.col("rank") <= top_k).select("program", "gene_idx")
    size = m.groupBy("program", "donor").agg(F.count("*").alias("n_donor"))
    size = size.withColumn("n_left", F.sum("n_donor").over(Window.partitionBy("program")) - F.col("n_donor"))
    whole_size = m.groupBy("program").agg(F.count("*").alias("n_left"))
    rows = loadings if mode == "centroid" else (member_top if member_top is not None else top_genes(loadings, top_k))
    part = m.join(rows.select("factor_id", "gene_idx", "loading"), "factor_id").groupBy("program", "donor", "gene_idx").agg(
        F.sum("loading").alias("s"), F.count("*").alias("c"), F.max("loading").alias("best")
    )
    whole = part.groupBy("program", "gene_idx").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"), F.slice(F.sort_array(F.collect_list("best"), False), 1, 2).alias("tops"))
    # A donor that holds the greatest loading leaves the second; a tie leaves an equal one.
    left = size.where("n_left > 0").join(whole, "program").join(part, ["program", "donor", "gene_idx"], "left")
    without = F.when(F.col("best") == F.col("tops")[0], F.col("tops")[1]).otherwise(F.col("tops")[0])
    left = left.select("program", "donor", "n_left", "gene_idx", (F.col("ts") - F.coalesce("s", F.lit(0.0))).alias("s"), (F.col("tc") - F.coalesce("c", F.lit(0))).alias("c"), without.alias("best"))
    nobody = whole.join(whole_size, "program").select("program", F.lit(None).cast("long").alias("donor"), "n_left", "gene_idx", F.col("ts").alias("s"), F.col("tc").alias("c"), F.col("tops")[0].alias("best"))
    both = left.unionByName(nobody).where("c > 0")
    if mode == "centroid":
        g = F.greatest(F.col("s") / F.col("n_left"), F.lit(0.0))
        score = F.greatest(F.coalesce(g * F.log(g / (g + 1e-8) + 1e-8), F.lit(0.0)), F.lit(0.0))
        order = Window.partitionBy("program", "donor").orderBy(F.desc(score), F.desc("gene_idx"))
    else:
        order = Window.partitionBy("program", "donor").orderBy(F.desc("c"), F.desc("best"), "gene_idx")
    kept = both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_k).select("program", "donor", "gene_idx")
    na = canonical.groupBy("program").agg(F.count("*").alias("na"))
    hit = kept.join(canonical.withColumn("own", F.lit(1)), ["program", "gene_idx"], "left").groupBy("program", "donor").agg(F.count("*").alias("nb"), F.sum("own").alias("hit"))
    c = F.coalesce("hit", F.lit(0)).cast("double")
    value = hit.join(na, "program").select("program", "donor", (c / (F.col("na") + F.col("nb") - c)).alias("jaccard"))
    grid = m.select("program").distinct().crossJoin(m.select("donor").distinct())
    out = grid.join(size, ["program", "donor"], "left").join(value.where("donor is not null"), ["program", "donor"], "left")
    out = out.join(value.where("donor is null").select("program", F.col("jaccard").alias("all")), "program", "left").join(na, "program", "left")
    found = F.when(F.col("na").isNull(), 0.0).when(F.col("n_donor").isNull(), F.col("all")).otherwise(F.col("jaccard"))
    return out.select("program", "donor", found.alias("jaccard"), F.col("n_donor").isNotNull().alias("contributed"))


def stability_table(stability: DataFrame, donors: Sequence) -> DataFrame:
    """(program, one column per donor, mean): the matrix of jaccards and its mean over donors with a value."""
    mean = stability.groupBy("program").agg(F.avg("jaccard").alias("mean"))
    return stability.groupBy("program").pivot("donor", list(donors)).agg(F.max("jaccard")).join(mean, "program")


# ---------------------------------------------------------------- enrichment


def programs_annotate(genes: DataFrame, gene_sets: DataFrame, universe: DataFrame, min_overlap: int = 1, padj_method: str = "fdr_bh") -> DataFrame:
    """(program, gene_set, jaccard, n_overlap, n_program, n_geneset, n_background, pval, padj) of
    genes(program, gene_idx), gene_sets(gene_set, gene_idx) and universe(gene_idx)."""
    if min_overlap < 0:
        raise ValueError("min_overlap must be at least 0")
    require_columns(genes, "program", "gene_idx")
    require_columns(gene_sets, "gene_set", "gene_idx")
    p = genes.select("program", "gene_idx").distinct()
    s = gene_sets.select("gene_set", "gene_idx").distinct().join(universe.select("gene_idx"), "gene_idx", "left_semi")
    if s.isEmpty():
        raise ValueError("no gene of a set is in the universe")
    np_, ns = p.groupBy("program").agg(F.count("*").alias("n_program")), s.groupBy("gene_set").agg(F.count("*").alias("n_geneset"))
    both = p.join(s, "gene_idx").groupBy("program", "gene_set").agg(F.count("*").alias("c"))
    size = universe.select("gene_idx").distinct().agg(F.count("*").alias("n_background"))
    if min_overlap >= 1:  # only pairs that share a gene can reach it
        grid = both.where(F.col("c") >= min_overlap).withColumnRenamed("c", "n_overlap").join(np_, "program").join(ns, "gene_set")
    else:
        grid = np_.crossJoin(ns).join(both, ["program", "gene_set"], "left").withColumn("n_overlap", F.coalesce("c", F.lit(0)))
    grid = grid.crossJoin(size)
    d = lambda c: F.col(c).cast("double")
    out = grid.select(
        "program", "gene_set", F.round(d("n_overlap") / (F.col("n_program") + F.col("n_geneset") - F.col("n_overlap")), 6).alias("jaccard"),
        "n_overlap", "n_program", "n_geneset", "n_background",
        F.when(F.col("n_overlap") == 0, 1.0).otherwise(hypergeom_sf(F.col("n_overlap"), d("n_background"), d("n_geneset"), d("n_program"))).alias("pval"),
    )
    return adjust_pvalues(out, "pval", "padj", padj_method).orderBy("padj", "program", "gene_set")


def set_order(hits: DataFrame) -> DataFrame:
    """(gene_set, pos, jaccard): sets by their best Jaccard, highest first."""
    best = hits.groupBy("gene_set").agg(F.max("jaccard").alias("jaccard"))
    return best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("jaccard"), "gene_set")) - 1)


def annotation_cells(hits: DataFrame, level: float = 0.05) -> DataFrame:
    """(gene_set, pos, program, jaccard, padj, significant) of the full grid of sets, in order, and
    programs: 0 and 1 where a program lacks a set."""
    grid = set_order(hits).select("gene_set", "pos").crossJoin(hits.select("program").distinct())
    out = grid.join(hits.select("program", "gene_set", "jaccard", "padj"), ["program", "gene_set"], "left")
    padj = F.coalesce("padj", F.lit(1.0))
    return out.select("gene_set", "pos", "program", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), padj.alias("padj"), (padj < level).alias("significant"))


def top_hits(annotation: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("program").orderBy("padj", F.desc("jaccard"), "gene_set")
    return annotation.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
