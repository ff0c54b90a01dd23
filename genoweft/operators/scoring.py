"""Cell and sample scores of programs, classification, association, and the tables behind plots."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.stats import adjust_pvalues, normal_sf
from ..sources.storage import Workspace
from . import kernels
from .core import require_columns
from .formula import Formula, split_groups

# ---------------------------------------------------------------- scores


def gene_means(expr: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """(gene_idx, mean_expr) of all genes, zeros counted."""
    every = expr.sparkSession.range(n_genes).select(F.col("id").cast("int").alias("gene_idx"))
    sums = expr.groupBy("gene_idx").agg(F.sum("value").alias("s"))
    return every.join(sums, "gene_idx", "left").select("gene_idx", (F.coalesce("s", F.lit(0.0)) / n_cells).alias("mean_expr"))


def align_genes(program_genes: DataFrame, cell_genes: DataFrame, fitted_genes: DataFrame, n_top: int, name_col: str = "gene") -> DataFrame:
    """Rows of program_genes whose gene is among those of the cells and of the fit, by name.

    Raises if these share no gene or fewer than n_top; warns of fitted genes that the cells lack
    and of programs left short or empty. Names are gene-level metadata, never rows."""
    for df in (program_genes, cell_genes, fitted_genes):
        require_columns(df, name_col)
    if n_top < 1:
        raise ValueError("n_top must be at least 1")
    fitted = fitted_genes.select(name_col).distinct()
    shared = fitted.join(cell_genes.select(name_col).distinct(), name_col, "left_semi")
    n_shared, n_fitted = shared.count(), fitted.count()
    if n_shared == 0:
        raise ValueError("the cells have none of the fitted genes")
    if n_shared < n_top:
        raise ValueError(f"only {n_shared} genes are shared, n_top is {n_top}")
    if n_shared < n_fitted:
        warnings.warn(f"{n_fitted - n_shared} fitted genes are not among the cells' and are left out", UserWarning, stacklevel=2)
    out = program_genes.join(shared, name_col, "left_semi")
    left = {r["program"]: r["n"] for r in out.groupBy("program").agg(F.count("*").alias("n")).collect()}
    names = [r["program"] for r in program_genes.select("program").distinct().collect()]
    for p in sorted(names):
        if left.get(p, 0) == 0:
            warnings.warn(f"program C{p} has no gene left", UserWarning, stacklevel=2)
        elif left[p] < n_top:
            warnings.warn(f"program C{p} has {left[p]} genes of {n_top}", UserWarning, stacklevel=2)
    return out


def warn_if_raw(expr: DataFrame, most: float = 40.0) -> DataFrame:
    """`expr`; warns if a value above `most` says that it holds counts rather than logarithms."""
    top = require_columns(expr, "value").agg(F.max("value")).first()[0]
    if top is not None and top > most:
        warnings.warn(f"values up to {top:g}: these look like raw counts", UserWarning, stacklevel=2)
    return expr


def gene_bins(means: DataFrame, bins: int = 25) -> DataFrame:
    """`means` with `bin`: number of percentile edges at or below the mean, less one; the last edge is nudged.
    One row per gene, so one buffer holds them."""
    edges = means.agg(F.percentile("mean_expr", [i / bins for i in range(bins + 1)]).alias("e"))
    nudged = F.transform("e", lambda x, i: F.when(i == bins, x + 1e-6).otherwise(x))
    return means.crossJoin(edges).select("gene_idx", "mean_expr", (F.size(F.filter(nudged, lambda x: x <= F.col("mean_expr"))) - 1).alias("bin"))


def control_genes(binned: DataFrame, genes: DataFrame, n_control: int = 50, seed: int = 123, pool: set[int] | None = None) -> DataFrame:
    """(program, gene_idx): controls of each program gene from its bin, or the nearest with any.
    Gene-level metadata is drawn on the driver, one random stream in program and gene order."""
    bin_of = {r["gene_idx"]: r["bin"] for r in binned.select("gene_idx", "bin").collect()}
    program: dict[int, list[int]] = {}
    for r in genes.select("program", "rank", "gene_idx").orderBy("program", "rank").collect():
        program.setdefault(r["program"], []).append(r["gene_idx"])
    rng = np.random.default_rng(seed)
    by_bin: dict[int, list[int]] = {}
    for g in sorted(bin_of):
        if pool is None or g in pool:
            by_bin.setdefault(bin_of[g], []).append(g)
    rows = []
    for p, own in program.items():
        chosen: set[int] = set()
        for g in own:
            for step in (0, 1, -1, 2, -2, 3, -3):
                free = [x for x in by_bin.get(bin_of[g] + step, []) if x not in set(own)]
                if free:
                    take = free if len(free) <= n_control else rng.choice(free, n_control, replace=False).tolist()
                    chosen.update(take)
                    break
        rows += [(int(p), int(x)) for x in sorted(chosen)]
    return binned.sparkSession.createDataFrame(rows, "program int, gene_idx int")


def score_cells(expr: DataFrame, cells: DataFrame, genes: DataFrame, controls: DataFrame) -> DataFrame:
    """(cell_id, program, score): mean of program genes less mean of controls, zeros counted.

    One join with a weight per (program, gene) and one sum; the weights are gene-level metadata."""
    def weight(df: DataFrame, sign: float) -> DataFrame:
        n = df.groupBy("program").agg(F.count("*").alias("n"))
        return df.join(n, "program").select("program", "gene_idx", (F.lit(sign) / F.col("n")).alias("w"))

    w = weight(genes.select("program", "gene_idx"), 1.0).union(weight(controls, -1.0)).groupBy("program", "gene_idx").agg(F.sum("w").alias("w"))
    s = expr.join(w, "gene_idx").groupBy("cell_id", "program").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    grid = cells.select("cell_id").crossJoin(genes.select("program").distinct())
    return grid.join(s, ["cell_id", "program"], "left").select("cell_id", "program", F.coalesce("s", F.lit(0.0)).alias("score"))


def score_aggregate(scores: DataFrame, cells: DataFrame, programs: Sequence[int], obs_cols: Sequence[str] = (), agg: str = "mean", min_cells: int = 10) -> DataFrame:
    """One row per sample: P0.. as mean or median over cells, first non-null covariates by cell."""
    if agg not in ("mean", "median"):
        raise ValueError("agg must be 'mean' or 'median'")
    if min_cells < 1:
        raise ValueError("min_cells must be at least 1")
    missing = [c for c in obs_cols if c not in cells.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    rows = scores.join(cells.select("cell_id", "sample_id"), "cell_id")
    if agg == "mean":
        per = rows.groupBy("sample_id", "program").agg(F.avg("score").alias("v"))
    else:
        per = exact_quantiles(rows, "score", [0.5], ["sample_id", "program"]).select("sample_id", "program", F.col("q")[0].alias("v"))
    per = per.groupBy("sample_id").pivot("program", list(programs)).agg(F.max("v"))
    per = per.select("sample_id", *[F.col(str(p)).alias(f"P{p}") for p in programs])
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("cell_id"))).alias(c) for c in obs_cols]
    counts = cells.groupBy("sample_id").agg(F.count("*").alias("n_cells"), *first)
    enough = {bool(r["e"]): r["n"] for r in counts.groupBy((F.col("n_cells") >= min_cells).alias("e")).agg(F.count("*").alias("n")).collect()}
    if not enough.get(True):
        raise ValueError(f"no sample has {min_cells} cells")
    if enough.get(False):
        warnings.warn(f"{enough[False]} samples of fewer than {min_cells} cells are left out", UserWarning, stacklevel=2)
    kept = counts.where(F.col("n_cells") >= min_cells).drop("n_cells")
    return per.join(kept, "sample_id")


def score_classify(scores: DataFrame, expr: DataFrame, cells: DataFrame, genes: DataFrame, n_shuffles: int = 20, n_cells_per_shuffle: int = 5000, padj_thresh: float = 0.05, seed: int = 123) -> DataFrame:
    """(cell_id, program, score, pval, padj, label). The null of a program is the mean expression of
    its genes over drawn cells: shuffling a gene's values cannot change its mean, so none is shuffled.
    Cells are drawn by the rank of a seeded hash within each shuffle, exactly n_cells_per_shuffle of
    them: counts per range of the hash tell the range in which the last is, and only that is ranked."""
    if n_shuffles < 1 or n_cells_per_shuffle < 1:
        raise ValueError("n_shuffles and n_cells_per_shuffle must be at least 1")
    if not 0 < padj_thresh <= 1:
        raise ValueError("padj_thresh must be in (0, 1]")
    require_columns(scores, "cell_id", "program", "score")
    require_columns(genes, "program", "gene_idx")
    empty = scores.select("program").distinct().join(genes, "program", "left_anti").collect()
    if empty:
        warnings.warn(f"programs without genes: {sorted(r['program'] for r in empty)}", UserWarning, stacklevel=2)
    work = Workspace(scores.sparkSession, "classify")
    genes = work.write(genes.select("program", "gene_idx").distinct())
    scores = work.write(scores)
    n_cells = cells.count()
    take = min(n_cells, n_cells_per_shuffle)
    size = genes.groupBy("program").agg(F.count("*").alias("n"))
    wanted = expr
    if take == n_cells:
        sums = wanted.join(genes, "gene_idx").groupBy("cell_id", "program").agg(F.sum("value").alias("v"))
        nulls = sums.groupBy("program").agg(F.sum("v").alias("t")).join(size, "program").select("program", (F.col("t") / (F.col("n") * take)).alias("mean"), F.lit(1e-8).alias("std"))
    else:
        drawn = cells.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))).alias("s"))
        drawn = drawn.withColumn("u", F.xxhash64(F.lit(seed), "s", "cell_id")).withColumn("b", F.shiftrightunsigned("u", 48))
        upto = drawn.groupBy("s", "b").agg(F.count("*").alias("m"))
        upto = upto.withColumn("upto", F.sum("m").over(Window.partitionBy("s").orderBy("b")))
        last = upto.where((F.col("upto") >= take) & (F.col("upto") - F.col("m") < take)).select("s", F.col("b").alias("last"), (take - F.col("upto") + F.col("m")).alias("more"))
        drawn = drawn.join(F.broadcast(last), "s")  # one row per shuffle
        edge = drawn.where("b = last").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("u", "cell_id"))).where("r <= more")
        drawn = work.write(drawn.where("b < last").select("cell_id", "s").union(edge.select("cell_id", "s")))
        # Only drawn cells are summed.
        wanted = expr.join(drawn.select("cell_id").distinct(), "cell_id", "left_semi")
        sums = wanted.join(genes, "gene_idx").groupBy("cell_id", "program").agg(F.sum("value").alias("v"))
        per = drawn.join(sums, "cell_id").groupBy("s", "program").agg(F.sum("v").alias("t")).join(size, "program")
        every = genes.select("program").distinct().crossJoin(cells.sparkSession.range(n_shuffles).select(F.col("id").cast("int").alias("s")))
        per = every.join(per, ["program", "s"], "left").select("program", F.coalesce(F.col("t") / (F.col("n") * take), F.lit(0.0)).alias("x"))
        std = F.stddev_pop("x")
        nulls = per.groupBy("program").agg(F.avg("x").alias("mean"), F.when(std == 0, 1e-8).otherwise(std).alias("std"))
    tested = scores.join(nulls, "program").withColumn("pval", normal_sf((F.col("score") - F.col("mean")) / F.col("std"))).drop("mean", "std")
    adjusted = adjust_pvalues(tested, "pval", "padj")
    best = F.max(F.when(F.col("padj") < padj_thresh, F.struct("score", (-F.col("program")).alias("p")))).over(Window.partitionBy("cell_id"))
    return adjusted.withColumn("label", F.coalesce(F.concat(F.lit("C"), (-best["p"]).cast("string")), F.lit("unresolved")))


# ---------------------------------------------------------------- association


def parse_formula(formula: str) -> tuple[str, list[str]]:
    """Fixed part and random-intercept groups of a formula such as 'age + (1|study)'."""
    return split_groups(formula)


def formula_variables(formula: str) -> list[str]:
    """Bare names in a formula, in order, once each; transformed terms such as np.log(x) or Q('x') are left out."""
    text = re.sub(r"\bC\(\s*([\w.]+)[^)]*\)", r"\1", formula)
    text = re.sub(r"\b(?:np\.\w+|Q|I)\((?:[^()]|\([^()]*\))*\)", " ", text)
    names = [t for t in re.split(r"[-+*:|~()\s]+", text) if t and not re.fullmatch(r"[\d.]+", t)]
    return list(dict.fromkeys(names))


ASSOCIATION = "program string, covariate string, beta double, se double, pval double, n_obs int, model string, groups string"


def _sums(long: DataFrame, p: int) -> tuple[dict, dict]:
    """What the models need of rows(program, y, x0.., g): n, x'x, x'y and y'y per program, and the same of
    the sums of groups, put together by the groups' size. Cross products of a design, never rows."""
    xs = [f"x{i}" for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    whole = long.groupBy("program").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *[F.sum(F.col(x) * F.col("y")).alias(f"{x}y") for x in xs], *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"q{i}_{j}") for i, j in pairs]
    )
    group = long.groupBy("program", "g").agg(F.count("*").alias("size"), F.sum("y").alias("y"), *[F.sum(x).alias(x) for x in xs])
    by_size = group.groupBy("program", "size").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *[F.sum(F.col(x) * F.col("y")).alias(f"{x}y") for x in xs], *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"q{i}_{j}") for i, j in pairs]
    )

    def told(r) -> tuple:
        q = np.zeros((p, p))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        return r["n"], q, np.array([r[f"{x}y"] for x in xs]), r["yy"]

    groups: dict[str, list] = {}
    for r in by_size.collect():
        groups.setdefault(r["program"], []).append((r["size"], *told(r)))
    return {r["program"]: told(r) for r in whole.collect()}, groups


def score_associate(samples: DataFrame, formula: str, reml: bool = True, padj_method: str = "fdr_bh", ratio: float | None = None) -> DataFrame:
    """Association of each program's standardised score with the first fixed covariate.

    The formula is compiled to columns (formula.Formula); models are fitted from cross products summed by
    Spark. ratio: variance of the groups over that of the rest, if it is not to be estimated."""
    fixed, groups = parse_formula(formula)
    if not fixed:
        raise ValueError("formula has no fixed effects")
    names = formula_variables(fixed)
    model = Formula(fixed)
    missing = [v for v in [*names, *model.columns(), *groups] if v not in samples.columns]
    if missing:
        raise KeyError(f"variables not found: {missing}")
    if not names:
        raise ValueError("formula has no variables")
    programs = [c for c in samples.columns if re.fullmatch(r"P\d+", c)]
    if not programs:
        raise ValueError("no program columns")
    terms, columns = model.design(samples)
    p, label = len(terms), "_".join(groups) or None
    g = F.concat_ws("_", *[F.coalesce(F.col(x).cast("string"), F.lit("None")) for x in groups]) if groups else F.lit("")
    wide = samples.select(*programs, *[c.alias(f"x{i}") for i, c in enumerate(columns)], g.alias("g"))
    whole = F.lit(True)
    for i in range(p):
        whole = whole & F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}")
    about = wide.agg(
        F.count("*").alias("rows"), F.count_distinct(F.when(whole, F.col("g"))).alias("groups"), *[F.avg(c).alias(f"m_{c}") for c in programs], *[F.stddev_samp(c).alias(f"s_{c}") for c in programs],
        *[F.avg(F.when(whole, F.col(f"x{i}"))).alias(f"mx{i}") for i in range(p)], *[F.stddev_pop(F.when(whole, F.col(f"x{i}"))).alias(f"sx{i}") for i in range(p)],
    ).first()
    live = [c for c in programs if about[f"s_{c}"] is not None and about[f"s_{c}"] > 0]
    for c in programs:
        if c not in live:
            warnings.warn(f"{c}: zero variance", UserWarning, stacklevel=2)
    # Columns about their mean (with an intercept) and in units of their spread: the sums stay accurate.
    shift = [about[f"mx{i}"] or 0.0 if model.intercept and i else 0.0 for i in range(p)]
    unit = [about[f"sx{i}"] or 1.0 if i or not model.intercept else 1.0 for i in range(p)]
    scaled = wide.where(whole).select("*", *[((F.col(f"x{i}") - shift[i]) / unit[i]).alias(f"z{i}") for i in range(p)])
    rows = []
    if live:
        each = F.explode(F.create_map(*[x for c in live for x in (F.lit(c), (F.col(c).cast("double") - float(about[f"m_{c}"])) / float(about[f"s_{c}"]))])).alias("program", "y")
        long = scaled.select(each, *[F.col(f"z{i}").alias(f"x{i}") for i in range(p)], "g").where("y is not null")
        sums, by_size = _sums(long, p)
        mixed = bool(groups) and about["groups"] >= 2
        if groups and not mixed:
            warnings.warn("fewer than 2 groups: using OLS", UserWarning, stacklevel=2)
        at = terms.index(names[0]) if names[0] in terms else None
        for c in live:
            if c not in sums or sums[c][0] < 2:
                continue
            kind, n = "ols", sums[c][0]
            if mixed:
                try:
                    beta, se, pval = kernels.intercept_from_sums(*sums[c], by_size[c], reml, ratio)
                    kind = "lmm"
                except np.linalg.LinAlgError:
                    warnings.warn(f"{c}: singular model, using OLS", UserWarning, stacklevel=2)
            if kind == "ols":
                beta, se, pval = kernels.ols_from_sums(*sums[c])
            value = lambda x: None if at is None or not np.isfinite(x[at]) else float(x[at])
            b, e = value(beta), value(se)
            rows.append((c, names[0], None if b is None else b / unit[at], None if e is None else e / unit[at], value(pval), int(about["rows"]), kind, label))
    out = samples.sparkSession.createDataFrame(rows, ASSOCIATION)
    return adjust_pvalues(out, "pval", "padj", padj_method).orderBy(F.asc_nulls_last("padj"), "program")


def associate_native(samples: DataFrame, programs: Sequence[str], covariate: str) -> DataFrame:
    """(program, beta, se) of OLS on one numeric covariate, by regression aggregates alone."""
    long = samples.select(F.col(covariate).cast("double").alias("x"), F.explode(F.create_map(*[v for p in programs for v in (F.lit(p), F.col(p).cast("double"))])).alias("program", "y"))
    long = long.where("x is not null and y is not null")
    w = Window.partitionBy("program")
    z = long.withColumn("z", (F.col("y") - F.avg("y").over(w)) / F.nullif(F.stddev_samp("y").over(w), F.lit(0.0)))
    n = F.count("z")
    sxx, syy, sxy = F.regr_sxx("z", "x"), F.regr_syy("z", "x"), F.regr_sxy("z", "x")
    return z.where("z is not null").groupBy("program").agg((sxy / sxx).alias("beta"), F.sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx).alias("se"))


# ---------------------------------------------------------------- tables behind plots


def retention_curve(max_sim: DataFrame, points: int = 100) -> DataFrame:
    """(threshold, n): factors whose best similarity reaches each of `points` thresholds on [0, 1]."""
    t = max_sim.sparkSession.range(points).select(F.col("id").alias("at"), (F.col("id") / float(points - 1)).alias("threshold"))
    # The last threshold that a value reaches, exact at the edges; then counts from the right.
    guess = F.floor(F.col("max_sim") * (points - 1))
    reached = F.greatest(*[F.when((guess + k) / float(points - 1) <= F.col("max_sim"), guess + k) for k in (-1, 0, 1)], F.lit(-1))
    held = max_sim.where(F.col("max_sim") >= 0).groupBy(F.least(reached, F.lit(points - 1)).alias("at")).agg(F.count("*").alias("c"))
    right = Window.orderBy(F.desc("at"))
    return t.join(held, "at", "left").select("threshold", F.sum(F.coalesce("c", F.lit(0))).over(right).alias("n"))


def histogram(max_sim: DataFrame, bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n) of non-empty bins, the last closed on the right."""
    at = F.least(F.floor((F.col("max_sim") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return max_sim.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def similarity_cutoff(max_sim: DataFrame, bins: int = 4096) -> DataFrame:
    """(threshold): crossover of a two-normal mixture; null when there are too few values.

    The mixture is fitted to counts, means and variances of `bins` bins on [0, 1], one aggregate, so what
    it reads does not grow with the factors."""
    v = F.col("max_sim").cast("double")
    at = F.least(F.floor(F.greatest(v, F.lit(0.0)) * bins), F.lit(bins - 1))
    held = max_sim.where(v.isNotNull() & ~F.isnan(v)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s")).orderBy("b").collect()
    told = kernels.crossover(np.array([r["m"] for r in held]), np.array([r["n"] for r in held]), np.array([r["s"] for r in held])) if held else None
    return max_sim.sparkSession.createDataFrame([(told,)], "threshold double")


def heatmap_limits(edges: DataFrame) -> DataFrame:
    """(vmin, vmax): 1st and 99th percentile of positive similarities."""
    q = exact_quantiles(edges.where("sim > 0"), "sim", [0.01, 0.99])
    return q.select(F.coalesce(F.col("q")[0], F.lit(0.0)).alias("vmin"), F.coalesce(F.col("q")[1], F.lit(1.0)).alias("vmax"))


def heatmap_cells(members: DataFrame, edges: DataFrame, transform: bool = False) -> DataFrame:
    """(row, col, value) by display position: similarities of members, the diagonal 1, absent pairs 0
    and left out; transform: J / (1 - J), 1 where J is 1."""
    pos = require_columns(members, "factor_id", "display_pos").select("factor_id", "display_pos")
    both = edges.select("i", "j", "sim").union(edges.select("j", "i", "sim"))
    off = both.join(pos.select(F.col("factor_id").alias("i"), F.col("display_pos").alias("row")), "i").join(pos.select(F.col("factor_id").alias("j"), F.col("display_pos").alias("col")), "j")
    cells = off.select("row", "col", "sim").union(pos.select("display_pos", "display_pos", F.lit(1.0)))
    return cells.select("row", "col", (F.when(F.col("sim") < 1, F.col("sim") / (1 - F.col("sim"))).otherwise(1.0) if transform else F.col("sim")).alias("value"))


def heatmap_scale(cells: DataFrame) -> DataFrame:
    """(vmin, vmax) of heatmap cells off the diagonal: 1st and 99th percentile of positive values;
    0 and the greatest if these are within 1e-6; 0 and 1 without any."""
    q = exact_quantiles(cells.where("row <> col and value > 0"), "value", [0.01, 0.99, 1.0]).withColumn("top", F.col("q")[2])
    flat = F.col("q")[1] - F.col("q")[0] < 1e-6
    return q.select(
        F.coalesce(F.when(flat, 0.0).otherwise(F.col("q")[0]), F.lit(0.0)).alias("vmin"), F.coalesce(F.when(flat, F.col("top")).otherwise(F.col("q")[1]), F.lit(1.0)).alias("vmax")
    )


def block_bounds(members: DataFrame) -> DataFrame:
    """(program, first, last) display positions of each program's block."""
    return members.groupBy("program").agg(F.min("display_pos").alias("first"), F.max("display_pos").alias("last"))


def loading_bars(cents: DataFrame, genes: DataFrame) -> DataFrame:
    """(program, gene_idx, norm_loading): canonical genes' loading over the program's greatest."""
    most = cents.withColumn("m", F.max("loading").over(Window.partitionBy("program")))
    return most.join(genes.select("program", "gene_idx"), ["program", "gene_idx"]).select("program", "gene_idx", F.when(F.col("m") > 0, F.col("loading") / F.col("m")).otherwise(0.0).alias("norm_loading"))


def colour_limits(scores: DataFrame, centre: float = 0.0) -> DataFrame:
    """(vmin, vmax, two_slope): 1st and 99th percentile of finite scores, and whether the centre lies
    between; equal limits are parted by 1e-6."""
    q = exact_quantiles(scores, "score", [0.01, 0.99])
    low, high = F.col("q")[0], F.col("q")[1]
    high = F.when(low == high, low + 1e-6).otherwise(high)
    return q.select(low.alias("vmin"), high.alias("vmax"), ((low < centre) & (high > centre)).alias("two_slope"))


def association_forest(association: DataFrame, level: float = 0.05) -> DataFrame:
    """(program, lo, beta, hi, significant): beta and one standard error about it, by beta."""
    out = association.select("program", (F.col("beta") - F.col("se")).alias("lo"), "beta", (F.col("beta") + F.col("se")).alias("hi"), (F.coalesce("padj", F.lit(1.0)) < level).alias("significant"))
    return out.orderBy("beta", "program")
