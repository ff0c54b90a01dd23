"""Expression preprocessing, factors, their top genes, similarity and keep masks.

Tables: expr(cell_id, sample_id, gene_idx, value), zeros left out; cells(cell_id, sample_id);
factors in long form loadings(factor_id, sample_id, k, pos, gene_idx, loading).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..sources.storage import Workspace
from . import kernels
from .blocked_nmf import fit_blocks
from .graph import components


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def _within(value: float, low: float, high: float, name: str) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in [{low}, {high}]")


# ---------------------------------------------------------------- selection and normalisation

#: Up to so many means (some 10 MB) go to all tasks.
FEW_MEANS = 100_000


def select_genes(genes: DataFrame, selector: str | Sequence[str] | None = None, force: Sequence[str] | None = None, name_col: str = "gene") -> DataFrame:
    """`genes` with `selected`: a boolean column, a list of names, or all; forced names are added.

    Warns of names that are not there and of names that forcing adds; raises if nothing is selected."""
    require_columns(genes, name_col)
    if isinstance(selector, str):
        chosen = require_columns(genes, selector)[selector].cast("boolean")
    elif selector is None:
        chosen = F.lit(True)
    else:
        chosen = F.col(name_col).isin(list(selector))
    chosen = F.coalesce(chosen, F.lit(False))
    asked = sorted({*(force or ()), *(selector if isinstance(selector, (list, tuple, set)) else ())})
    found = {r["n"]: r["c"] for r in genes.where(F.col(name_col).isin(asked)).select(F.col(name_col).alias("n"), chosen.alias("c")).collect()} if asked else {}
    missing, added = [n for n in asked if n not in found], [n for n in force or () if found.get(n) is False]
    if missing:
        warnings.warn(f"genes not found: {missing}", UserWarning, stacklevel=2)
    if added:
        warnings.warn(f"genes added by force: {added}", UserWarning, stacklevel=2)
    if force:
        chosen = chosen | F.col(name_col).isin(list(force))
    out = genes.withColumn("selected", chosen)
    if out.where("selected").isEmpty():
        raise ValueError("no genes selected")
    return out


def sample_sizes(cells: DataFrame, min_cells: int = 5, key: str = "sample_id") -> DataFrame:
    """(sample_id, n_cells) of samples with enough cells; null keys are no sample."""
    require_columns(cells, key)
    return cells.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("sample_id")).agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)


def clip_negative(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.greatest("value", F.lit(0.0)))


def normalise(expr: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """Each cell's values scaled to target_sum; a cell of sum 0 is left as it is."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.lit(float(target_sum)) * F.col("value") / F.when(total == 0, 1.0).otherwise(total))


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def sample_quantiles(expr: DataFrame, cells: DataFrame, n_genes: int, q: float = 0.999) -> DataFrame:
    """(sample_id, q): exact linear quantile over all entries of a sample; one row stands for its implicit zeros."""
    sizes = cells.groupBy("sample_id").agg(F.count("*").alias("n_cells"))
    some = expr.where("value <> 0").select("sample_id", "value", F.lit(1).cast("long").alias("f"))
    held = some.groupBy("sample_id").agg(F.count("*").alias("nnz"))
    zeros = sizes.join(held, "sample_id", "left").select("sample_id", F.lit(0.0).alias("value"), (F.col("n_cells") * n_genes - F.coalesce("nnz", F.lit(0))).alias("f"))
    both = some.unionByName(zeros).where("f > 0").groupBy("sample_id", "value").agg(F.sum("f").alias("f"))
    return exact_quantiles(both, "value", [q], ["sample_id"], "f").select("sample_id", F.col("q")[0].alias("q"))


def clip_quantile(expr: DataFrame, cells: DataFrame, n_genes: int, q: float = 0.999) -> DataFrame:
    cut = sample_quantiles(expr, cells, n_genes, q)
    return expr.join(cut, "sample_id").withColumn("value", F.least("value", "q")).drop("q")


def center_relu(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Values less their gene's mean within the sample, floored at 0; zeros stay zeros.

    The means, one for each sample and gene, are written first. Few are sent to all tasks: a shuffle by so
    few keys would give a task all cells of a sample and gene. With more, each key is a small share."""
    sizes = cells.groupBy("sample_id").agg(F.count("*").alias("n_cells"))
    sums = expr.groupBy("sample_id", "gene_idx").agg(F.sum("value").alias("s"))
    means = sums.join(sizes, "sample_id").select("sample_id", "gene_idx", (F.col("s") / F.col("n_cells")).alias("mean"))
    means = Workspace(expr.sparkSession, "means").write(means)
    means = F.broadcast(means) if means.count() <= FEW_MEANS else means
    return expr.join(means, ["sample_id", "gene_idx"]).withColumn("value", F.greatest(F.col("value") - F.col("mean"), F.lit(0.0))).drop("mean")


def preprocess(expr: DataFrame, cells: DataFrame, n_genes: int, target_sum: float = 1e4, scale: bool = True, log: bool = True, q: float | None = 0.999, center: bool = True) -> DataFrame:
    out = clip_negative(expr)
    out = normalise(out, target_sum) if scale else out
    out = log1p(out) if log else out
    out = clip_quantile(out, cells, n_genes, q) if q is not None else out
    return center_relu(out, cells) if center else out


# ---------------------------------------------------------------- factorisation

FACTORS = "record string, sample_id long, k int, k_idx int, pos int, item long, value double"


def nmf_fit(expr: DataFrame, cells: DataFrame, n_genes: int, k: Sequence[int] = (7, 8, 9, 10), min_cells: int = 5, target_sum: float = 1e4, normalize: bool = True, log1p: bool = True, clip_quantile: float | None = 0.999, center: bool = True, solver: str = "cd", loss: str = "frobenius", init: str = "nndsvda", alpha: float = 0.0, l1_ratio: float = 0.0, tol: float = 1e-5, max_iter: int = 10000, keep_scores: bool = False, seed: int = 123, block_entries: int = 8_000_000) -> DataFrame:
    """One factorisation per (sample, rank). Rows of record `gene` hold loadings by gene_idx, of
    record `cell` (with keep_scores) scores by cell_id.

    A sample of up to block_entries values (cells x genes) is one dense block in one group; a larger one
    is cut into blocks of that size, with the same result (blocked_nmf)."""
    if isinstance(k, int):
        raise TypeError("k must be a sequence of ranks")
    if any(r < 1 for r in k):
        raise ValueError("ranks must be at least 1")
    if solver == "cd" and loss != "frobenius":
        raise ValueError("solver 'cd' needs loss 'frobenius'")
    if init not in kernels.INITS or loss not in kernels.LOSSES or solver not in ("cd", "mu"):
        raise ValueError(f"init must be one of {kernels.INITS}, loss one of {kernels.LOSSES}, solver 'cd' or 'mu'")
    if n_genes < 1:
        raise ValueError("no genes selected")
    require_columns(expr, "cell_id", "sample_id", "gene_idx", "value")
    sizes = sample_sizes(cells, min_cells)
    if sizes.isEmpty():
        raise ValueError(f"no sample has {min_cells} cells")
    kept = cells.join(sizes.select("sample_id"), "sample_id", "left_semi")
    data = preprocess(expr.join(sizes.select("sample_id"), "sample_id", "left_semi"), kept, n_genes, target_sum, normalize, log1p, clip_quantile, center)
    # A row per cell keeps cells without a value in the block.
    rows = kept.select("sample_id", "cell_id").join(
        data.groupBy("cell_id").agg(F.collect_list("gene_idx").alias("genes"), F.collect_list("value").alias("values")), "cell_id", "left"
    )

    large = sizes.where(F.col("n_cells") * n_genes > block_entries)
    parts = []
    if not large.isEmpty():
        own = rows.join(large.select("sample_id"), "sample_id", "left_semi")
        parts = fit_blocks(own, large, n_genes, k, solver, loss, init, alpha, l1_ratio, tol, max_iter, keep_scores, seed, block_entries)
        rows = rows.join(large.select("sample_id"), "sample_id", "left_anti")

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        x = np.zeros((len(pdf), n_genes))
        for i, (g, v) in enumerate(zip(pdf["genes"], pdf["values"], strict=True)):
            if g is not None:
                x[i, np.asarray(g, int)] = v
        cell_ids, made = pdf["cell_id"].to_numpy(), []
        for index, rank in enumerate(k):
            w, h = kernels.nmf(x, int(rank), solver, loss, init, alpha, l1_ratio, tol, max_iter, seed, cell_ids)
            blocks = [("gene", np.arange(n_genes), h)] + ([("cell", cell_ids, w.T)] if keep_scores else [])
            for record, items, m in blocks:
                made.append(pd.DataFrame({"record": record, "sample_id": key[0], "k": rank, "k_idx": index, "pos": np.repeat(np.arange(rank), len(items)), "item": np.tile(items, rank), "value": m.ravel()}))
        return pd.concat(made)

    out = rows.groupBy("sample_id").applyInPandas(fit, FACTORS)
    for p in parts:
        out = out.unionByName(p)
    return out


def factor_loadings(loadings: DataFrame, keep: DataFrame | None = None, kept_only: bool = True, samples: Sequence | None = None, per_sample: int | None = None) -> DataFrame:
    """Wide gene x factor table: gene_idx and one column `{sample}_F{n}` per factor, n counted
    within the kept factors of a sample. keep: (factor_id, keep). The labels are read first unless
    samples and the number of factors per sample name them."""
    if kept_only and keep is not None:
        loadings = loadings.join(require_columns(keep, "factor_id", "keep").where("keep"), "factor_id", "left_semi")
    names = loadings.select("sample_id", "factor_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("sample_id").orderBy("factor_id")) - 1)
    names = names.select("factor_id", F.concat(F.col("sample_id").cast("string"), F.lit("_F"), "n").alias("label"))
    if samples is not None and per_sample is not None:
        labels = [f"{x}_F{n}" for x in samples for n in range(per_sample)]
    else:
        labels = [r["label"] for r in names.join(loadings.select("factor_id", "sample_id").distinct(), "factor_id").orderBy("factor_id").collect()]
    return loadings.join(names, "factor_id").groupBy("gene_idx").pivot("label", labels).agg(F.max("loading"))


def factor_scores(records: DataFrame, k: Sequence[int]) -> DataFrame:
    """Wide cell x local factor table (cell_id, F0, F1, ...) of nmf_fit(keep_scores=True)."""
    cell = require_columns(records, "record", "k_idx", "pos", "item", "value").where("record = 'cell'")
    if cell.isEmpty():
        raise KeyError("no cell scores: fit with keep_scores=True")
    at = F.element_at(F.array(*[F.lit(sum(k[:i])) for i in range(len(k))]), (F.col("k_idx") + 1).cast("int")) + F.col("pos")
    return cell.groupBy(F.col("item").alias("cell_id")).agg(*[F.max(F.when(at == n, F.col("value"))).alias(f"F{n}") for n in range(sum(k))])


def number_factors(df: DataFrame, k: Sequence[int]) -> DataFrame:
    """`factor_id` = rank of sample * sum(k) + offset of k_idx + pos; samples are one small table."""
    samples = df.select("sample_id").distinct().withColumn("r", F.row_number().over(Window.orderBy("sample_id")) - 1)
    offset = F.element_at(F.array(*[F.lit(sum(k[:i])) for i in range(len(k))]), (F.col("k_idx") + 1).cast("int"))
    out = df.join(samples, "sample_id")
    return out.withColumn("factor_id", (F.col("r") * sum(k) + offset + F.col("pos")).cast("int")).drop("r")


def combined_score(loadings: DataFrame, scope: Sequence[str] = (), eps: float = 1e-8) -> DataFrame:
    """`score` = max(g ln(g / (mean + eps) + eps), 0), mean over the factors of a scope."""
    mean = F.avg("loading").over(Window.partitionBy(*scope, "gene_idx"))
    g = F.col("loading")
    return loadings.withColumn("score", F.greatest(g * F.log(g / (mean + eps) + eps), F.lit(0.0)))


def top_genes(loadings: DataFrame, k: int, by: str = "loading", key: str = "factor_id") -> DataFrame:
    """The k highest genes of each factor, rank from 1; ties go to the later gene."""
    order = Window.partitionBy(key).orderBy(F.desc(by), F.desc("gene_idx"))
    return loadings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- similarity


def jaccard_pairs(top: DataFrame, inter_only: bool = False) -> DataFrame:
    """(i, j, sim) of factor pairs i < j that share a gene: an equi-join on gene, never all pairs."""
    size = top.groupBy("factor_id").agg(F.count("*").alias("n"))
    t = top.join(size, "factor_id").select("factor_id", "sample_id", "gene_idx", "n")
    a, b = t.alias("a"), t.alias("b")
    on = (F.col("a.gene_idx") == F.col("b.gene_idx")) & (F.col("a.factor_id") < F.col("b.factor_id"))
    if inter_only:
        on = on & (F.col("a.sample_id") != F.col("b.sample_id"))
    both = a.join(b, on).groupBy(F.col("a.factor_id").alias("i"), F.col("b.factor_id").alias("j"))
    c = F.col("c").cast("double")
    return both.agg(F.count("*").alias("c"), F.first("a.n").alias("na"), F.first("b.n").alias("nb")).select("i", "j", (c / (F.col("na") + F.col("nb") - c)).alias("sim"))


def threshold_candidates(top: DataFrame, min_similarity: float, inter_only: bool = False, most: int = 2000) -> DataFrame:
    """(i, j) of factor pairs i < j that may reach a Jaccard of min_similarity: they share a gene among the
    first n - ceil(t n) + 1 of each set of n, rarest genes first; sizes and what follows the gene allow it.

    A gene that more than `most` factors hold among these is met in blocks of holders: pairs of blocks
    are apart, so no task meets all its holders with each other."""
    held = top.groupBy("gene_idx").agg(F.count("*").alias("df"))
    order = Window.partitionBy("factor_id").orderBy("df", "gene_idx")
    size = Window.partitionBy("factor_id")
    placed = top.join(held, "gene_idx").select("factor_id", "sample_id", "gene_idx", F.row_number().over(order).alias("at"), F.count("*").over(size).alias("n"))
    first = placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * min_similarity - 1e-9) + 1)
    blocks = first.groupBy("gene_idx").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("blocks > 1")
    first = first.join(blocks, "gene_idx", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("factor_id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = first.withColumn("other", F.explode(every)).select("gene_idx", F.col("own").alias("ba"), F.col("other").alias("bb"), F.col("factor_id").alias("i"), F.col("sample_id").alias("si"), F.col("at").alias("ai"), F.col("n").alias("ni"))
    b = first.withColumn("other", F.explode(every)).select("gene_idx", F.col("other").alias("ba"), F.col("own").alias("bb"), F.col("factor_id").alias("j"), F.col("sample_id").alias("sj"), F.col("at").alias("aj"), F.col("n").alias("nj"))
    both = a.join(b, ["gene_idx", "ba", "bb"]).where("i < j")
    if inter_only:
        both = both.where("si <> sj")
    need = F.ceil(min_similarity / (1 + min_similarity) * (F.col("ni") + F.col("nj")) - 1e-9)
    follow = 1 + F.least(F.col("ni") - F.col("ai"), F.col("nj") - F.col("aj"))
    # The first gene that both share has only others after it; a later one is met as well but adds no pair.
    return both.where(follow + F.least(F.col("ai"), F.col("aj")) - 1 >= need).select("i", "j").distinct()


def threshold_pairs(top: DataFrame, min_similarity: float, inter_only: bool = False) -> DataFrame:
    """(i, j, sim) of the pairs of jaccard_pairs() with a similarity of at least min_similarity (over 0)."""
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be in (0, 1]")
    sets = top.groupBy("factor_id").agg(F.collect_set("gene_idx").alias("genes"))
    pairs = threshold_candidates(top, min_similarity, inter_only)
    both = pairs.join(sets.select(F.col("factor_id").alias("i"), F.col("genes").alias("gi")), "i").join(sets.select(F.col("factor_id").alias("j"), F.col("genes").alias("gj")), "j")
    c = F.size(F.array_intersect("gi", "gj")).cast("double")
    return both.select("i", "j", (c / (F.size("gi") + F.size("gj") - c)).alias("sim")).where(F.col("sim") >= min_similarity - 1e-12)


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    n = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / n if n > 0 else 0.0


def check_metric(metric: Callable) -> None:
    rng = np.random.default_rng(0)
    try:
        value = metric(rng.random(4), rng.random(4))
    except Exception as e:
        raise ValueError("metric must take two vectors") from e
    if not np.isscalar(value):
        raise ValueError("metric must return a number")


def metric_pairs(loadings: DataFrame, metric: Callable, top_k: int | None, inter_only: bool = False) -> DataFrame:
    """(i, j, sim) of all factor pairs by a Python metric on the union of both top sets, in gene order.

    All pairs is the contract of a free metric; factors are few (ranks times samples)."""
    check_metric(metric)
    f = loadings.groupBy("factor_id", "sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene_idx", "loading"))), lambda s: s["loading"]).alias("v"))
    a, b = f.alias("a"), f.alias("b")
    on = F.col("a.factor_id") < F.col("b.factor_id")
    if inter_only:
        on = on & (F.col("a.sample_id") != F.col("b.sample_id"))
    pairs = a.join(b, on).select(F.col("a.factor_id").alias("i"), F.col("b.factor_id").alias("j"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))

    def run(batches):
        for pdf in batches:
            out = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = np.asarray(x), np.asarray(y)
                if not x.any() or not y.any():
                    out.append(0.0)
                    continue
                if top_k is not None:
                    at = np.union1d(np.argsort(x, kind="stable")[-top_k:], np.argsort(y, kind="stable")[-top_k:])
                    x, y = x[at], y[at]
                v = float(metric(x, y))
                out.append(0.0 if np.isnan(v) else v)
            yield pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "sim": out})

    return pairs.mapInPandas(run, "i int, j int, sim double")


def similarity(loadings: DataFrame, metric: str | Callable = "jaccard", top_k: int | None = 50, intra_sample: bool = True, use_combined: bool = False, n_genes: int | None = None, min_similarity: float | None = None) -> DataFrame:
    """Pairs with a non-zero similarity, or of at least min_similarity: a Jaccard threshold bounds which
    pairs meet at all. n_genes, if told, bounds top_k."""
    require_columns(loadings, "factor_id", "sample_id", "gene_idx", "loading")
    if not callable(metric) and metric != "jaccard":
        raise ValueError("metric must be 'jaccard' or callable")
    if metric == "jaccard" and top_k is None:
        raise ValueError("top_k is required for 'jaccard'")
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be at least 1")
    if top_k is not None and n_genes is not None and top_k > n_genes:
        raise ValueError("top_k exceeds the number of genes")
    if callable(metric):
        out = metric_pairs(loadings, metric, top_k, not intra_sample).where("sim <> 0")
        return out if min_similarity is None else out.where(F.col("sim") >= min_similarity)
    live = loadings.join(loadings.groupBy("factor_id").agg(F.sum("loading").alias("s")).where("s <> 0"), "factor_id", "left_semi")
    scored = combined_score(live) if use_combined else live
    top = top_genes(scored, top_k, "score" if use_combined else "loading")
    return jaccard_pairs(top, not intra_sample) if min_similarity is None else threshold_pairs(top, min_similarity, not intra_sample)


def similarity_compute(loadings: DataFrame, distance: str | Callable = "jaccard", **kw) -> DataFrame:
    """Older name of similarity(); `distance` is still a similarity."""
    return similarity(loadings, metric=distance, **kw)


def max_similarity(factors: DataFrame, edges: DataFrame) -> DataFrame:
    """(factor_id, max_sim), 0 for factors without an edge."""
    ends = edges.select(F.col("i").alias("factor_id"), "sim").union(edges.select("j", "sim"))
    best = ends.groupBy("factor_id").agg(F.max("sim").alias("m"))
    return factors.select("factor_id").distinct().join(best, "factor_id", "left").select("factor_id", F.coalesce("m", F.lit(0.0)).alias("max_sim"))


def drop_zeros(factors: DataFrame, edges: DataFrame, atol: float = 1e-8) -> DataFrame:
    """`factors` without those whose similarities are all (near) zero."""
    live = edges.where(F.abs("sim") > atol)
    ends = live.select(F.col("i").alias("factor_id")).union(live.select("j"))
    return factors.join(ends, "factor_id", "left_semi")


def similarity_filter(factors: DataFrame, edges: DataFrame, min_similarity: float) -> DataFrame:
    """(factor_id, max_sim, keep): best similarity at least min_similarity, and not all near 0."""
    _within(min_similarity, 0, 1, "min_similarity")
    return max_similarity(factors, edges).withColumn("keep", (F.col("max_sim") >= min_similarity) & (F.abs("max_sim") > 1e-8))


def keep_all(*masks: Column) -> Column:
    """Conjunction of keep masks; a missing mask keeps."""
    out = F.lit(True)
    for m in masks:
        out = out & F.coalesce(m, F.lit(True))
    return out


# ---------------------------------------------------------------- pruning


def cross_rank_pairs(top: DataFrame) -> DataFrame:
    """(sample_id, ka, kb, a, b, sim): Jaccard of factors of different ranks of one sample that share a gene."""
    size = top.groupBy("factor_id").agg(F.count("*").alias("n"))
    t = top.join(size, "factor_id").select("factor_id", "sample_id", "k_idx", "gene_idx", "n")
    a, b = t.alias("a"), t.alias("b")
    on = (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.gene_idx") == F.col("b.gene_idx")) & (F.col("a.k_idx") != F.col("b.k_idx"))
    c = F.count("*").cast("double")
    return a.join(b, on).groupBy(
        F.col("a.sample_id").alias("sample_id"), F.col("a.k_idx").alias("ka"), F.col("b.k_idx").alias("kb"), F.col("a.factor_id").alias("a"), F.col("b.factor_id").alias("b")
    ).agg((c / (F.first("a.n") + F.first("b.n") - c)).alias("sim"))


def match_greedy(pairs: DataFrame, min_similarity: float) -> DataFrame:
    """(factor_id, k_other) matched by the best similarity."""
    return pairs.groupBy(F.col("a").alias("factor_id"), F.col("kb").alias("k_other")).agg(F.max("sim").alias("m")).where(F.col("m") >= min_similarity).drop("m")


def rank_grid(factors: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` with those of no common gene at 0: all factors of two ranks of a sample (at most the
    square of a rank each)."""
    f = factors.select("factor_id", "sample_id", "k_idx").distinct()
    a = f.select("sample_id", F.col("k_idx").alias("ka"), F.col("factor_id").alias("a"))
    b = f.select("sample_id", F.col("k_idx").alias("kb"), F.col("factor_id").alias("b"))
    every = a.join(b, "sample_id").where("ka <> kb")
    return every.join(pairs.select("a", "b", "sim"), ["a", "b"], "left").select("sample_id", "ka", "kb", "a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def match_hungarian(pairs: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """(sample_id, ka, kb, a, b, sim): one-to-one matches of greatest total similarity, per rank
    pair. pairs: those of rank_grid(), or only such as share a gene; a match of 0 counts at
    min_similarity 0 if its pair is given. Of equal totals both directions take the one of least sum of
    (place in the lower rank) x sqrt(place in the higher rank), places from 1 by factor."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(pdf["a"]), np.unique(pdf["b"])
        gain = np.full((len(a), len(b)), np.nan)
        gain[np.searchsorted(a, pdf["a"]), np.searchsorted(b, pdf["b"])] = pdf["sim"]
        first, second = np.arange(1.0, len(a) + 1)[:, None], np.arange(1.0, len(b) + 1)[None]
        tie = first * np.sqrt(second) if key[1] < key[2] else np.sqrt(first) * second
        rows = [(*key, a[i], b[j], gain[i, j]) for i, j in kernels.assign(np.nan_to_num(gain) - 1e-9 * tie / tie.max()) if gain[i, j] >= min_similarity]
        return pd.DataFrame(rows, columns=["sample_id", "ka", "kb", "a", "b", "sim"])

    return pairs.groupBy("sample_id", "ka", "kb").applyInPandas(run, "sample_id long, ka int, kb int, a int, b int, sim double")


def recurrence(factors: DataFrame, matches: DataFrame) -> DataFrame:
    """(factor_id, prune_matches): other ranks matched."""
    n = matches.groupBy("factor_id").agg(F.count_distinct("k_other").alias("m"))
    return factors.select("factor_id").distinct().join(n, "factor_id", "left").select("factor_id", F.coalesce("m", F.lit(0)).alias("prune_matches"))


def deduplicate(top: DataFrame, threshold: float) -> DataFrame:
    """(factor_id) kept: of every component of {Jaccard >= threshold} within a sample, the member of
    highest mean similarity in its group, the lowest id of equals.

    Similarities come from the gene join within samples, components from label passing, the member from
    an aggregate; at threshold 0 a sample's factors are one component."""
    ids = top.select("factor_id", "sample_id").distinct()
    one = top.select("factor_id", F.col("sample_id").alias("s"), "gene_idx")
    sim = jaccard_pairs(one.select("factor_id", "s", F.struct("s", "gene_idx").alias("gene_idx"), F.col("s").alias("sample_id")))
    work = Workspace(top.sparkSession, "dedup")
    sim = work.write(sim)
    if threshold <= 0:
        part = ids.withColumn("component", F.min("factor_id").over(Window.partitionBy("sample_id")))
    else:
        linked = components(sim.where(F.col("sim") >= threshold)).withColumnRenamed("node", "factor_id")
        part = ids.join(linked, "factor_id", "left").withColumn("component", F.coalesce("component", "factor_id"))
    part = work.write(part.select("factor_id", "component"))
    ends = sim.select("i", "j", "sim").union(sim.select("j", "i", "sim"))
    own = ends.join(part.select(F.col("factor_id").alias("i"), "component"), "i").join(part.select(F.col("factor_id").alias("j"), F.col("component").alias("cj")), "j").where("component = cj")
    total = own.groupBy(F.col("i").alias("factor_id")).agg(F.sum("sim").alias("total"))
    size = part.groupBy("component").agg(F.count("*").alias("n"))
    mean = part.join(size, "component").join(total, "factor_id", "left").withColumn("mean", F.round(F.coalesce("total", F.lit(0.0)) / F.col("n"), 9))
    best = mean.groupBy("component").agg(F.min(F.struct((-F.col("mean")).alias("m"), "factor_id")).alias("b"))
    return best.select("b.factor_id")


def nmf_prune(loadings: DataFrame, n_ranks: int, top_k: int = 50, min_similarity: float = 0.1, dedup_similarity: float = 0.7, min_other_resolutions: int = 1, matching: str = "hungarian", deduplicate_factors: bool = True, use_combined: bool = False, n_genes: int | None = None) -> DataFrame:
    """(factor_id, prune_matches, keep). n_genes, if told, bounds top_k."""
    require_columns(loadings, "factor_id", "sample_id", "k_idx", "gene_idx", "loading")
    if n_genes is not None and top_k > n_genes:
        raise ValueError("top_k exceeds the number of genes")
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    _within(min_similarity, 0, 1, "min_similarity")
    _within(dedup_similarity, 0, 1, "dedup_similarity")
    if min_other_resolutions < 0 or min_other_resolutions > n_ranks - 1:
        raise ValueError("min_other_resolutions must be between 0 and the number of other ranks")
    if matching not in ("greedy", "hungarian"):
        raise ValueError("matching must be 'greedy' or 'hungarian'")
    if deduplicate_factors and dedup_similarity < min_similarity:
        warnings.warn("dedup_similarity is below min_similarity", UserWarning, stacklevel=2)
    scored = combined_score(loadings, ("sample_id", "k_idx")) if use_combined else loadings
    top = top_genes(scored, top_k, "score" if use_combined else "loading")
    pairs = cross_rank_pairs(top)
    if matching == "greedy":
        matches = match_greedy(rank_grid(top, pairs) if min_similarity == 0 else pairs, min_similarity)
    else:
        matches = match_hungarian(rank_grid(top, pairs), min_similarity).select(F.col("a").alias("factor_id"), F.col("kb").alias("k_other"))
    counted = recurrence(loadings, matches).withColumn("keep", F.col("prune_matches") >= min_other_resolutions)
    if not deduplicate_factors:
        return counted
    kept = deduplicate(top.join(counted.where("keep"), "factor_id", "left_semi"), dedup_similarity).withColumn("one", F.lit(True))
    return counted.join(kept, "factor_id", "left").select("factor_id", "prune_matches", (F.col("keep") & F.coalesce("one", F.lit(False))).alias("keep"))
