"""Statistics as Column expressions and DataFrame plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation of ln gamma (g = 7, n = 9).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Chebyshev coefficients of erfc, lowest power of t first (relative error 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def ln_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 0.5."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + k)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_gamma(n + 1.0) - ln_gamma(k + 1.0) - ln_gamma(n - k + 1.0)


def hypergeom_sf(overlap: Column, universe: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= overlap) for `drawn` of `universe` of which `marked` are marked."""
    low = F.greatest(overlap, drawn + marked - universe, F.lit(0)).cast("int")
    high = F.least(marked, drawn).cast("int")
    steps = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    term = lambda i: F.exp(ln_choose(marked, i) + ln_choose(universe - marked, drawn - i) - ln_choose(universe, drawn))
    return F.least(F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + term(i.cast("double"))), F.lit(1.0))


def erfc(x: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + c
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal."""
    return 0.5 * erfc(z / math.sqrt(2.0))


#: Adjustments by name; each takes (p, rank from the least, rows) to a value before it is made monotone.
PADJ_METHODS = ("fdr_bh", "fdr_by", "bonferroni", "sidak", "holm", "simes-hochberg")


def adjust_pvalues(df: DataFrame, p: str = "pval", out: str = "padj", method: str = "fdr_bh", grain: int = 1024) -> DataFrame:
    """`df` with adjusted p-values; null p are left out and stay null.

    Equal p-values are one row with a count. Ranks are prefix sums over ranges of p, `grain` to
    every halving of p below 0.5 and of 1 - p above, so that values that crowd near 0 or 1 part
    as well as others; only one small row per range meets in one task, never all p-values."""
    if method not in PADJ_METHODS:
        raise ValueError(f"unknown method {method!r}")
    tested = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    edge = F.lit(1 << 30)
    low, high = F.floor(F.log2("_p") * grain), -F.floor(F.log2(1 - F.col("_p")) * grain)
    tested = tested.withColumn("_b", F.when(F.col("_p") <= 0, -edge).when(F.col("_p") >= 1, edge).when(F.col("_p") < 0.5, low).otherwise(high).cast("int"))
    parts = tested.groupBy("_b").agg(F.sum("_n").alias("_s"))
    up = Window.orderBy("_b")
    parts = parts.select("_b", (F.sum("_s").over(up) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_m"))
    inside = Window.partitionBy("_b").orderBy("_p")
    ranked = tested.join(parts, "_b").withColumn("_last", F.col("_before") + F.sum("_n").over(inside))
    first, m, x = F.col("_last") - F.col("_n") + 1, F.col("_m").cast("double"), F.col("_p")
    if method in ("fdr_bh", "fdr_by"):
        value = x * m / F.col("_last")
        if method == "fdr_by":
            value = value * (F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))
        rising = False
    elif method == "bonferroni":
        value, rising = x * m, None
    elif method == "sidak":
        value, rising = 1 - F.pow(1 - x, m), None
    elif method == "holm":
        value, rising = x * (m - first + 1), True
    else:
        value, rising = x * (m - F.col("_last") + 1), False
    ranked = ranked.withColumn("_v", value)
    if rising is not None:
        most = F.max if rising else F.min
        edge = ranked.groupBy("_b").agg(most("_v").alias("_e"))
        order = Window.orderBy(F.col("_b") if rising else F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.select("_b", most("_e").over(order).alias("_other"))
        inner = Window.partitionBy("_b").orderBy(F.col("_p") if rising else F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
        pick = F.greatest if rising else F.least
        ranked = ranked.join(edge, "_b").withColumn("_v", pick(most("_v").over(inner), F.coalesce("_other", most("_v").over(inner))))
    table = ranked.select("_p", F.least("_v", F.lit(1.0)).alias(out))
    # A p-value that is on many rows is hot on the left alone, which an adaptive skew join splits.
    return df.join(table, df[p] == table["_p"], "left").drop("_p")
