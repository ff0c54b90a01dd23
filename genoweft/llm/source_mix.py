"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Sources, by code point with null last, weigh 3, 1, 2, repeating, and share `ratio` of all words;
a target stops at `most` times its source's words and the excess is shared anew by weight. With
sources in order of cap over weight the stop level is found in one pass of prefix sums.

A source with target t times its words takes floor(t) whole copies of every document for
certain. The rest of its target is a sample of unequal probability: inclusion probabilities pi
are proportional to size ** size_power and scaled so that the expected words equal the rest;
documents whose pi would reach 1 are certain, and the others are scaled anew to what these
leave. The others are ranked by random odds u/(1-u) over inclusion odds pi/(1-pi) (u a hash of
id, or of text where that is null, and seed, so reruns agree) and taken in that order while the rest of the target holds them.
`top_ups` further documents that fit the gap best are then taken per source.

Prefix sums run over (source, bucket), a bucket being a range of the logarithm of the rank. That
logarithm is a logistic variable shifted by each document's own odds, so whatever the odds no
unit of it holds more than a quarter of a source: ranges of 1/g hold n / 4g, about PER_BUCKET at
most. What is known of a source comes from its (size, count) table.

Edge cases: null text has size 0 and takes 0 words; a null source is a source of its own; empty
sources get target 0; rows without an id draw by their texts; equal ids, and equal texts without
one, tie in the draw and go by size; texts of any length are counted whole; repeated rows are documents of their own; an empty table gives
an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed value: a word.
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
#: The weights that sources repeat.
WEIGHTS = (3, 1, 2)
PER_BUCKET = 5000


def source_targets(hist: DataFrame, ratio: float, most: float) -> DataFrame:
    """(skey, source_size, n, target) of a table (skey, size, m): m documents of a size."""
    s = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    # One row per source: the windows below sort names and three numbers, never documents.
    place = F.row_number().over(Window.orderBy("skey")) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) * float(ratio) - before) / behind)
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("skey"), F.col("level").alias("l")))).over(every)["l"]
    return s.select("skey", "source_size", "n", F.coalesce(F.least(level * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def _measure(size, power: float):
    return F.pow(size.cast("double"), F.lit(float(power)))


def inclusion(hist: DataFrame, source: DataFrame, power: float) -> DataFrame:
    """`source` (skey, rest, ...) with `cut`, the greatest size that is not certain, `factor`, by which
    measures of the others become probabilities, and `sure`, the words of the certain documents."""
    words, pull = F.col("size") * F.col("m"), _measure(F.col("size"), power) * F.col("size") * F.col("m")
    down = Window.partitionBy("skey").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum("w").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("p").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    steps = hist.where("size > 0").select("skey", "size", words.alias("w"), pull.alias("p")).select("skey", "size", larger.alias("sure"), others.alias("others"))
    steps = steps.join(source.select("skey", "rest"), "skey").withColumn("factor", F.greatest((F.col("rest") - F.col("sure")) / F.col("others"), F.lit(0.0)))
    open_ = steps.where(F.col("factor") * _measure(F.col("size"), power) < 1)
    cut = open_.groupBy("skey").agg(F.max(F.struct("size", "factor", "sure")).alias("c"))
    cut = cut.select("skey", F.col("c.size").alias("cut"), F.col("c.factor").alias("factor"), F.col("c.sure").cast("long").alias("sure"))
    return source.join(cut, "skey", "left").fillna({"cut": 0, "factor": 0.0, "sure": 0})


def ranked(sizes: DataFrame, source: DataFrame, power: float, seed: int, draw: str = "doc_id") -> DataFrame:
    """Documents that are not certain, with bucket, place and words up to it in their bucket."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(draw)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = sizes.join(source, "skey").where("size <= cut or size = 0")
    pi = F.greatest(F.least(F.col("factor") * _measure(F.col("size"), power), F.lit(1 - 1e-12)), F.lit(1e-12))
    rows = rows.withColumn("lq", F.log(u / (1 - u)) - F.log(pi / (1 - pi)))
    grain = F.greatest(F.ceil(F.col("n") / (4.0 * PER_BUCKET)), F.lit(1))
    rows = rows.withColumn("bucket", F.floor(F.col("lq") * grain).cast("long"))
    order = Window.partitionBy("skey", "bucket").orderBy("lq", "doc_id", "size")
    return rows.select("*", F.row_number().over(order).alias("rn"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


def mix_sources(docs: DataFrame, ratio: float = 1.5, most: float = 2.0, size_power: float = 0.5, seed: int = 1, top_ups: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of `docs`."""
    name = F.col(source_col).cast("string")
    sizes = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name)).alias("skey"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))).alias("draw"),
        ),
        "sizes",
    )
    hist = materialize(sizes.groupBy("skey", "size").agg(F.count("*").alias("m")), "hist")
    source = source_targets(hist, ratio, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    source = source.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    source = materialize(inclusion(hist, source, size_power), "sources")

    rows = ranked(sizes, source, size_power, seed, "draw")
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    prior = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("words").over(prior), F.lit(0)).alias("prior"))
    extra = (F.col("sure") + F.col("prior") + F.col("upto") <= F.col("rest")) & (F.col("size") > 0)
    kept = ["doc_id", "skey", "bucket", "rn", "size"]
    sample = materialize(rows.join(sums, ["skey", "bucket"]).select(*kept, extra.cast("int").alias("extra")), "mix")
    picks = _top_ups(sample, source, top_ups)
    sample = sample.join(picks, ["skey", "bucket", "rn"], "left").select("doc_id", "skey", "size", (F.col("extra") + F.coalesce("add", F.lit(0))).alias("extra"))
    sure = sizes.join(source.select("skey", "cut"), "skey").where("size > cut and size > 0").select("doc_id", "skey", "size", F.lit(1).alias("extra"))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    out = sample.union(sure).join(source.select("skey", "source_size", "target", "whole"), "skey")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def _top_ups(sample: DataFrame, source: DataFrame, rounds: int) -> DataFrame:
    """(skey, bucket, rn, add): per source the documents that fill what the sample leaves best, one a round."""
    held = sample.groupBy("skey").agg(F.sum(F.col("extra") * F.col("size")).alias("held"))
    gap = materialize(source.join(held, "skey").select("skey", (F.col("rest") - F.col("sure") - F.col("held")).alias("gap")), "gap")
    picks = gap.select("skey", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("int").alias("rn"), F.lit(None).cast("long").alias("size")).limit(0)
    for _ in range(rounds):
        taken = picks.groupBy("skey").agg(F.sum("size").alias("used"))
        now = gap.join(taken, "skey", "left").select("skey", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
        free = sample.where("extra = 0 and size > 0").join(now, "skey").where("size <= gap").join(picks.select("skey", "bucket", "rn"), ["skey", "bucket", "rn"], "left_anti")
        best = free.groupBy("skey").agg(F.max(F.struct("size", "bucket", "rn")).alias("b")).select("skey", "b.bucket", "b.rn", "b.size")
        picks = materialize(picks.union(best), "picks")
    return picks.select("skey", "bucket", "rn", F.lit(1).alias("add"))


def op3_pareto_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
