"""Document fingerprints: SimHash with permuted block tables. DataFrame functions only.

A term is a word with the word after it (the last word stands alone); its weight is the number
of characters of both, 16 at most, counted at every occurrence. Every term's 64-bit hash votes
with its weight for or against each bit; a bit is set when the votes for it are the majority.
Two votes share one long (bits i and i + 32), so one pass keeps 32 sums a text.

Near fingerprints: 64 bits in `blocks` blocks. Fingerprints at most `radius` bits apart agree
on blocks - radius blocks at least, so one table for every choice of that many blocks, keyed by
those bits, holds every near pair; pairs found are verified by their distance. Equal
fingerprints are one row with a count, so copies never multiply.

Edge cases: null or blank texts have no terms and fingerprint 0; equal texts have equal
fingerprints; repeated ids are ordered by text; null ids come first; an empty table gives an
empty result; texts of any length are read whole; columns beside id and text, of whatever names,
are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Fixed value: what parts words (the six ASCII white-space characters).
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
_PAIR = 0x100000001
LEAST = -(1 << 63)


def add_fingerprints(rows: DataFrame, keys: list[str], text: str, out: str = "fp") -> DataFrame:
    """`rows` grouped by `keys`, with the SimHash (long) of the text of each."""
    words = F.split(F.trim(F.regexp_replace(text, SPACE_RUN, " ")), " ")
    terms = rows.select(*keys, words.alias("w")).select(
        *keys,
        F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("t"),
    )
    size = F.length("t.a") + F.coalesce(F.length("t.b"), F.lit(0))
    terms = terms.select(*keys, F.xxhash64("t.a", "t.b").alias("h"), F.least(size, F.lit(16)).cast("long").alias("v"))
    votes = terms.groupBy(*keys).agg(
        F.sum("v").alias("all"),
        *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_PAIR)) * F.col("v")).alias(f"s{i}") for i in range(32)],
    )
    fp: Column | None = None
    for i in range(32):
        for shift, ones in ((i, F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"s{i}", 32))):
            bit = F.shiftleft((ones * 2 > F.col("all")).cast("long"), shift)
            fp = bit if fp is None else fp.bitwiseOR(bit)
    return votes.select(*keys, fp.alias(out))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of the 64 bits that agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def count_near(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, n_near): for each distinct fp of `queries`, the rows of `fps` at most `radius` bits away."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in keep) for keep in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key")
    held = fps.groupBy("fp").agg(F.count("*").alias("n")).select("fp", "n", keys)
    asked = queries.select("fp").distinct().select(F.col("fp"), keys).withColumnRenamed("fp", "q")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("q"))) <= radius
    pairs = held.join(asked, ["table", "key"]).where(close).select("q", "fp", "n").distinct()
    return pairs.groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("n_near"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside the next by id (after the last: the first), without one sort of all.

    Ids are cut at approximate quantiles (a bounded list); the first row of each range is also
    dealt to the range before it, behind that range's own rows, as the `ghost` of its end."""
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(LEAST)))
    cuts = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("k"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((b, k) for b, k in rows.groupBy("bucket").agg(F.min("k")).collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    if before:
        ghost = F.create_map(*[x for k, b in before.items() for x in (F.lit(k).cast("long"), F.lit(b))])[F.col("k")]
        dealt = F.array(F.struct(F.lit(False).alias("ghost"), F.col("bucket")), F.struct(F.lit(True).alias("ghost"), ghost.alias("bucket")))
        rows = rows.select("doc_id", "text", "k", F.explode(F.filter(dealt, lambda x: x["bucket"].isNotNull())).alias("to"))
        rows = rows.select("doc_id", "text", "k", "to.ghost", "to.bucket")
    else:
        rows = rows.withColumn("ghost", F.lit(False))
    order = Window.partitionBy("bucket").orderBy("ghost", "k", "text")
    return rows.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.when(F.col("ghost"), "").otherwise(
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    )
    rows = rows.select("bucket", "rn", "ghost", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.when(~F.col("ghost"), F.sha2(F.col("edited").cast("binary"), 256)))
    keys = ["bucket", "rn", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"))
    both = both.select(*keys, "v.kind", "v.text").where("not ghost or kind = 0")
    prints = add_fingerprints(both, [*keys, "kind"], "text")
    prints = prints.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    prints = prints.withColumn("nfp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn")))
    out = prints.where("not ghost").select(
        "doc_id", "n_chars", "edited_sha256",
        "fp",
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
    out = materialize(out, "simhash")
    asked = F.col("doc_id") % 50 == 0
    near = count_near(out.select("fp"), out.where(asked).select("fp"))
    return (
        out.join(near, "fp", "left")
        .select(*[c for c in out.columns if c != "fp"], F.when(asked, F.col("n_near") - 1).alias("n_near"))
    )
