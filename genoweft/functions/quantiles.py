"""Exact quantiles without holding a group's values: ranges narrowed until few values are left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import Workspace


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = (), weight: str | None = None, bins: int = 1024, few: int = 4096) -> DataFrame:
    """(*keys, q): the linearly interpolated quantiles `qs` of each group, as an array in that order.

    A quantile lies between two ranks. The range that holds a rank is cut into `bins` equal parts, the
    rows of each are counted (in every task first, then by part), and the part with the rank, from its
    least to its greatest value, is the next range, until it is one value or holds `few` rows at most;
    those are put in order. No task holds more than bins or few rows of a range, whatever the group.

    weight: how many times a row counts (long). Nulls, NaN and infinities are left out; a group without
    values gives no row (without keys: one row, null)."""
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles must be in [0, 1]")
    work = Workspace(df.sparkSession, "quantiles")
    v = F.col(value).cast("double")
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))  # in a struct a null equals a null
    data = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(key.alias("k"), v.alias("v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("w"))
    data = work.write(data.where("w > 0"))
    met = (lambda d: d) if keys else F.broadcast  # without keys: as many ranges as ranks at most
    stats = data.groupBy("k").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    most = stats.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("n")))).first()[0] or 0
    place = F.col("p") * (F.col("n") - 1)
    if most > few:
        stats = work.write(stats)
    wanted = stats.withColumn("p", F.explode(F.array(*[F.lit(float(q)) for q in dict.fromkeys(qs)])))
    wanted = wanted.select("k", "n", "lo", "hi", "p", (place - F.floor(place)).alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("rank")))).alias("s"))
    wanted = wanted.select("k", "n", "lo", "hi", "p", "part", "s.side", "s.rank")
    ranks = wanted.select("k", "rank", "lo", "hi", F.lit(0).cast("long").alias("less"), "n").distinct()
    while most > few:
        wide = ranks.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        inside = data.join(met(wide.select("k", "lo", "hi").distinct()), "k").where("v between lo and hi")
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = inside.groupBy("k", "lo", part.alias("b")).agg(F.sum("w").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "lo").orderBy("b")))
        after = wide.select("k", "lo", "rank", "less").join(upto, ["k", "lo"]).where("less + upto > rank and less + upto - c <= rank")
        after = after.select("k", "rank", F.col("a").alias("lo"), F.col("z").alias("hi"), (F.col("less") + F.col("upto") - F.col("c")).alias("less"), F.col("c").alias("n"))
        done = ranks.where((F.col("lo") == F.col("hi")) | (F.col("n") <= few))
        ranks = work.write(done.unionByName(after))
        most = ranks.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("n")))).first()[0] or 0
    left = ranks.where("lo < hi")
    inside = data.join(met(left.select("k", "lo", "hi", "less").distinct()), "k").where("v between lo and hi").groupBy("k", "lo", "less", "v").agg(F.sum("w").alias("c"))
    upto = inside.select("k", "lo", "v", "c", (F.col("less") + F.sum("c").over(Window.partitionBy("k", "lo").orderBy("v"))).alias("upto"))
    found = left.select("k", "lo", "rank").join(upto, ["k", "lo"]).where("upto > rank and upto - c <= rank").select("k", "rank", F.col("v").alias("x"))
    found = found.unionByName(ranks.where("lo = hi").select("k", "rank", F.col("lo").alias("x")))
    both = wanted.select("k", "p", "part", "side", "rank").join(found, ["k", "rank"])
    end = lambda q, side, c: F.max(F.when((F.col("p") == float(q)) & (F.col("side") == side), F.col(c)))
    q = F.array(*[end(q, 0, "x") + end(q, 0, "part") * (end(q, 1, "x") - end(q, 0, "x")) for q in qs]).alias("q")
    if not keys:
        return both.agg(q).select(F.when(F.col("q")[0].isNotNull(), F.col("q")).alias("q"))
    return both.groupBy("k").agg(q).select("k.*", "q")
