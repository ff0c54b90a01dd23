"""The registered queries over the documented bindings, and the SQL that states the same.

Binding: a cell is a row of `embeddings`, its sample the label, its genes the 64 positions, its
values the positive parts. Pseudo-factors (ranks 2 and 3 of every sample; mean positive part of
the cells whose id leaves the same remainder) make later operators checkable without a
factorisation; pseudo-programs are the factors of one rank and remainder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjust_pvalues
from ..operators import core, programs, scoring
from ..sources import gene_sets
from ..sources.storage import Workspace
from ..streaming import scoring as stream

GENES, TOP, N_TOP = 64, 20, 15


# ---------------------------------------------------------------- bindings


def _emb(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def cells(spark, d: str) -> DataFrame:
    label = F.col("label").cast("long")
    return _emb(spark, d).select(F.col("vec_id").alias("cell_id"), label.alias("sample_id"), (30 + 5 * label).cast("double").alias("age"), (label % 3).alias("study"))


def raw(spark, d: str) -> DataFrame:
    return _emb(spark, d).select(F.col("vec_id").alias("cell_id"), F.col("label").cast("long").alias("sample_id"), F.posexplode("embedding").alias("gene_idx", "v")).select("cell_id", "sample_id", "gene_idx", F.col("v").cast("double").alias("value"))


def expr(spark, d: str) -> DataFrame:
    return core.clip_negative(raw(spark, d)).where("value > 0")


def factors(spark, d: str) -> DataFrame:
    """Pseudo-factors, long: factor_id, sample_id, k, k_idx, pos, gene_idx, loading."""
    both = core.clip_negative(raw(spark, d)).withColumn("k", F.explode(F.array(F.lit(2), F.lit(3))))
    mean = both.groupBy("sample_id", "k", (F.col("cell_id") % F.col("k")).cast("int").alias("pos"), "gene_idx").agg(F.avg("value").alias("loading"))
    return core.number_factors(mean.withColumn("k_idx", F.col("k") - 2), (2, 3))


def members(spark, d: str) -> DataFrame:
    one = factors(spark, d).select("factor_id", "sample_id", "k_idx", "pos").distinct()
    return one.select("factor_id", "sample_id", (F.col("k_idx") * 2 + F.col("pos")).cast("int").alias("program"))


def edges(spark, d: str) -> DataFrame:
    return core.similarity(factors(spark, d), top_k=TOP)


def program_table(spark, d: str) -> DataFrame:
    return programs.program_genes(programs.centroids(members(spark, d), factors(spark, d)), N_TOP)


def controls(spark, d: str) -> DataFrame:
    c = cells(spark, d)
    binned = scoring.gene_bins(scoring.gene_means(expr(spark, d), c.count(), GENES))
    return scoring.control_genes(binned, program_table(spark, d), n_control=GENES)


def cell_scores(spark, d: str) -> DataFrame:
    return scoring.score_cells(expr(spark, d), cells(spark, d), program_table(spark, d), controls(spark, d))


def sample_scores(spark, d: str, agg: str = "mean") -> DataFrame:
    return scoring.score_aggregate(cell_scores(spark, d), cells(spark, d), range(5), ("age", "study"), agg, 10)


def fixed_sets(spark) -> DataFrame:
    """Three overlapping runs of genes."""
    runs = (("GS_A", 0, 20), ("GS_B", 10, 35), ("GS_C", 30, 50))
    rows = [F.struct(F.lit(n).alias("gene_set"), F.explode(F.sequence(F.lit(a), F.lit(b - 1))).alias("gene_idx")) for n, a, b in runs]
    del rows
    return spark.createDataFrame([(n, g) for n, a, b in runs for g in range(a, b)], "gene_set string, gene_idx int")


def annotation(spark, d: str) -> DataFrame:
    universe = spark.range(GENES).select(F.col("id").cast("int").alias("gene_idx"))
    return programs.programs_annotate(program_table(spark, d), fixed_sets(spark), universe)


def maxima(spark, d: str) -> DataFrame:
    f = factors(spark, d)
    return core.max_similarity(f, core.similarity(f, top_k=TOP))


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- SQL of the bindings

_RAW = "raw AS (SELECT vec_id AS cell_id, CAST(label AS BIGINT) AS sample_id, unnest(range(0, 64)) AS gene_idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_EXPR = _RAW + ", ex AS (SELECT cell_id, sample_id, CAST(gene_idx AS INT) AS gene_idx, greatest(v, 0) AS value FROM raw)"
_PF = _EXPR + """, smp AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS r FROM (SELECT DISTINCT sample_id FROM ex)),
pf AS (SELECT CAST(r * 5 + (k - 2) * 2 + cell_id % k AS INT) AS factor_id, e.sample_id, CAST(k - 2 AS INT) AS k_idx, CAST(cell_id % k AS INT) AS pos, gene_idx, avg(value) AS loading
 FROM ex e JOIN smp USING (sample_id), (VALUES (2), (3)) t(k) GROUP BY ALL)"""
_TOP = _PF + ", tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY loading DESC, gene_idx DESC) AS rank FROM pf) WHERE rank <= 20)"
_SIM = _TOP + """, sim AS (SELECT a.factor_id AS i, b.factor_id AS j, count(*) / (40.0 - count(*)) AS sim, any_value(a.sample_id) AS si, any_value(b.sample_id) AS sj
 FROM tg a JOIN tg b ON a.gene_idx = b.gene_idx AND a.factor_id < b.factor_id GROUP BY 1, 2)"""
_MEM = _SIM + ", mem AS (SELECT DISTINCT factor_id, sample_id, k_idx * 2 + pos AS program FROM pf)"
_CEN = _MEM + ", cen AS (SELECT program, gene_idx, avg(loading) AS loading FROM pf JOIN mem USING (factor_id) GROUP BY 1, 2)"
_GEN = _CEN + """, cs AS (SELECT *, greatest(loading * ln(loading / (avg(loading) OVER (PARTITION BY gene_idx) + 1e-8) + 1e-8), 0) AS score FROM cen),
gen AS (SELECT program, rank, gene_idx FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY score DESC, gene_idx DESC) AS rank FROM cs) WHERE rank <= 15)"""
_MAX = _SIM + ", mx AS (SELECT f.factor_id, coalesce(max(e.sim), 0) AS max_sim FROM (SELECT DISTINCT factor_id FROM pf) f LEFT JOIN (SELECT i AS f, sim FROM sim UNION ALL SELECT j, sim FROM sim) e ON e.f = f.factor_id GROUP BY 1)"
_BIN = _GEN + """, gm AS (SELECT gene_idx, avg(value) AS mean_expr FROM ex GROUP BY 1),
ed AS (SELECT quantile_cont(mean_expr, [i / 25.0 FOR i IN range(0, 26)]) AS e FROM gm),
bn AS (SELECT gene_idx, mean_expr, CAST(len(list_filter(e, lambda x: x <= mean_expr)) - CASE WHEN mean_expr >= e[26] AND mean_expr < e[26] + 1e-6 THEN 1 ELSE 0 END - 1 AS INT) AS bin FROM gm, ed)"""
_CTL = _BIN + """, st AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, -1), (3, 2), (4, -2), (5, 3), (6, -3)) t(o, step)),
cand AS (SELECT g.program, g.gene_idx AS g, o, c.gene_idx FROM gen g JOIN bn b USING (gene_idx), st, bn c WHERE c.bin = b.bin + step AND NOT EXISTS (SELECT 1 FROM gen x WHERE x.program = g.program AND x.gene_idx = c.gene_idx)),
ctl AS (SELECT DISTINCT program, gene_idx FROM cand WHERE o = (SELECT min(o) FROM cand z WHERE z.program = cand.program AND z.g = cand.g))"""
_SCO = _CTL + """, w AS (SELECT program, gene_idx, sum(w) AS w FROM (SELECT program, gene_idx, 1.0 / count(*) OVER (PARTITION BY program) AS w FROM gen UNION ALL SELECT program, gene_idx, -1.0 / count(*) OVER (PARTITION BY program) FROM ctl) GROUP BY 1, 2),
sc AS (SELECT cell_id, any_value(sample_id) AS sample_id, program, sum(value * w) AS score FROM ex JOIN w USING (gene_idx) GROUP BY cell_id, program)"""
_SAM = "SELECT sample_id, {p}, max(30.0 + 5 * sample_id) AS age, max(sample_id % 3) AS study FROM sc GROUP BY 1 HAVING count(DISTINCT cell_id) >= 10"
_ANN = _GEN + """, gs AS (SELECT 'GS_A' AS gene_set, unnest(range(0, 20)) AS gene_idx UNION ALL SELECT 'GS_B', unnest(range(10, 35)) UNION ALL SELECT 'GS_C', unnest(range(30, 50))),
ov AS (SELECT program, gene_set, count(*) AS n_overlap FROM gen JOIN gs USING (gene_idx) GROUP BY 1, 2),
an AS (SELECT program, gene_set, n_overlap, CAST(15 AS BIGINT) AS n_program, (SELECT count(*) FROM gs g WHERE g.gene_set = ov.gene_set) AS n_geneset FROM ov),
lc AS (SELECT an.*, (SELECT sum(exp(lgamma(n_geneset + 1.0) - lgamma(i + 1.0) - lgamma(n_geneset - i + 1.0) + lgamma(65.0 - n_geneset) - lgamma(n_program - i + 1.0) - lgamma(65.0 - n_geneset - n_program + i) - lgamma(65.0) + lgamma(n_program + 1.0) + lgamma(65.0 - n_program)))
 FROM range(0, 16) r(i) WHERE i BETWEEN greatest(n_overlap, n_program + n_geneset - 64) AND least(n_geneset, n_program)) AS pval FROM an),
bh AS (SELECT *, least(1, min(pval * m / rk) OVER (ORDER BY pval DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj0 FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY pval) AS rk FROM lc)),
ann AS (SELECT program, gene_set, n_overlap, n_program, n_geneset, CAST(64 AS BIGINT) AS n_background, round(n_overlap / CAST(n_program + n_geneset - n_overlap AS DOUBLE), 6) AS jaccard, pval, min(padj0) OVER (PARTITION BY pval) AS padj FROM bh)"""
_NORM = _EXPR + ", nm AS (SELECT cell_id, sample_id, gene_idx, 1e4 * value / CASE WHEN sum(value) OVER (PARTITION BY cell_id) = 0 THEN 1 ELSE sum(value) OVER (PARTITION BY cell_id) END AS value FROM ex)"
_PROG = "SELECT DISTINCT factor_id, sample_id, program FROM mem"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---------------------------------------------------------------- scans and preprocessing

query("expr_scan", f"WITH {_EXPR} SELECT cell_id, sample_id, gene_idx, round(value, 6) AS value FROM ex WHERE value > 0")(lambda s, d: _r(expr(s, d), "value"))


@query("gene_sets_flat", "SELECT p_type AS gene_set, count(*) AS n_genes, count(DISTINCT p_brand) AS n_distinct FROM part GROUP BY 1")
def _gene_sets(s, d):
    path = gene_sets.write_json(s.read.parquet(f"{d}/part.parquet"), "p_type", "p_brand", "p_partkey")
    g = gene_sets.read_gene_sets(s, path)
    return g.select("gene_set", F.size("genes").cast("long").alias("n_genes"), F.size(F.array_distinct("genes")).cast("long").alias("n_distinct"))


@query("collections_nested", "SELECT p_name AS gene_set, min(p_type) AS collection, count(*) AS n_genes FROM part GROUP BY 1 HAVING min(p_type) IN ('ECONOMY', 'PROMO')")
def _collections(s, d):
    path = gene_sets.write_collections(s.read.parquet(f"{d}/part.parquet"), "p_name", "p_brand", "p_partkey", "p_type")
    g = gene_sets.read_msigdb(s, path, ["ECONOMY", "PROMO"])
    return g.select("gene_set", "collection", F.size("genes").cast("long").alias("n_genes"))


@query("gene_select", "SELECT p_partkey AS gene_idx, p_size <= 20 OR p_partkey IN (40, 41) AS selected FROM part")
def _gene_select(s, d):
    genes = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("gene_idx"), F.concat(F.lit("G"), "p_partkey").alias("gene"), (F.col("p_size") <= 20).alias("highly_variable"))
    return core.select_genes(genes, "highly_variable", ["G40", "G41"]).select("gene_idx", "selected")


query("sample_filter", "SELECT CAST(label AS BIGINT) AS sample_id, count(*) AS n_cells FROM embeddings WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) >= 50")(lambda s, d: core.sample_sizes(cells(s, d), 50))
query("clip_negative", f"WITH {_EXPR} SELECT cell_id, gene_idx, round(value, 6) AS value FROM ex")(lambda s, d: _r(core.clip_negative(raw(s, d)).select("cell_id", "gene_idx", "value"), "value"))
query("libsize_norm", f"WITH {_NORM} SELECT cell_id, gene_idx, round(value, 6) AS value FROM nm WHERE value > 0")(lambda s, d: _r(core.normalise(expr(s, d)).select("cell_id", "gene_idx", "value"), "value"))
query("log1p_expr", f"WITH {_NORM} SELECT cell_id, gene_idx, round(ln(1 + value), 6) AS value FROM nm WHERE value > 0")(lambda s, d: _r(core.log1p(core.normalise(expr(s, d))).select("cell_id", "gene_idx", "value"), "value"))


@query("quantile_clip", f"WITH {_EXPR}, q AS (SELECT sample_id, quantile_cont(value, 0.99) AS q FROM ex GROUP BY 1) SELECT sample_id, round(any_value(q), 6) AS q, count(*) FILTER (WHERE value > q) AS n_clipped FROM ex JOIN q USING (sample_id) GROUP BY 1")
def _quantile(s, d):
    e = expr(s, d)
    q = core.sample_quantiles(e, cells(s, d), GENES, 0.99)
    return e.join(q, "sample_id").groupBy("sample_id").agg(F.round(F.first("q"), 6).alias("q"), F.count_if(F.col("value") > F.col("q")).alias("n_clipped"))


query("center_relu", f"WITH {_EXPR}, c AS (SELECT cell_id, gene_idx, greatest(value - avg(value) OVER (PARTITION BY sample_id, gene_idx), 0) AS value FROM ex) SELECT cell_id, gene_idx, round(value, 6) AS value FROM c WHERE value > 0")(
    lambda s, d: _r(core.center_relu(expr(s, d), cells(s, d)).where("value > 0").select("cell_id", "gene_idx", "value"), "value")
)


@query("preprocess_sparse", """WITH x AS (SELECT c_mktsegment AS sample_id, l_orderkey AS cell_id, p_brand AS gene, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
n AS (SELECT *, ln(1 + 1e4 * v / sum(v) OVER (PARTITION BY cell_id)) AS y FROM x), k AS (SELECT sample_id, count(DISTINCT cell_id) AS c FROM x GROUP BY 1),
m AS (SELECT sample_id, gene, sum(y) AS t, any_value(c) AS c FROM n JOIN k USING (sample_id) GROUP BY 1, 2)
SELECT sample_id, gene, round(sum(greatest(y - t / c, 0)), 4) AS sum_value, count(*) FILTER (WHERE y - t / c > 0) AS nnz FROM n JOIN m USING (sample_id, gene) GROUP BY 1, 2""")
def _sparse(s, d):
    t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    # Dealt by cell once: the sums, the cells of each sample and the values of each cell are all worked out where a cell lies.
    parts = max(64, int(s.conf.get("spark.sql.shuffle.partitions")), t("lineitem").count() // 250_000)
    x = x.select(F.col("c_mktsegment").alias("sample_id"), F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene_idx"), "l_quantity").repartition(parts, "cell_id")
    x = x.groupBy("sample_id", "cell_id", "gene_idx").agg(F.sum("l_quantity").alias("value"))
    x = Workspace(s, "counts").write(x, parts, ("cell_id",))  # the join is made once: for the values, and for the cells of each sample
    out = core.preprocess(x, x.select("cell_id", "sample_id").distinct(), 25, q=None)
    return out.groupBy("sample_id", F.col("gene_idx").alias("gene")).agg(F.round(F.sum("value"), 4).alias("sum_value"), F.count_if(F.col("value") > 0).alias("nnz"))


# ---------------------------------------------------------------- factors


@query("nmf_factors")
def _nmf(s, d):
    out = core.nmf_fit(expr(s, d), cells(s, d), GENES, (2, 3), min_cells=10, center=False, tol=1e-4, max_iter=300)
    return out.select("sample_id", "k", "pos", F.col("item").cast("int").alias("gene_idx"), F.round("value", 6).alias("loading"))


@query("nmf_cell_scores")
def _nmf_cells(s, d):
    out = core.nmf_fit(expr(s, d), cells(s, d), GENES, (2, 3), min_cells=10, center=False, tol=1e-4, max_iter=300, keep_scores=True)
    return out.where("record = 'cell'").select(F.col("item").alias("cell_id"), (F.col("k_idx") * 2 + F.col("pos")).alias("local_idx"), F.round("value", 6).alias("score"))


query("combined_score", f"WITH {_PF} SELECT factor_id, gene_idx, round(greatest(loading * ln(loading / (avg(loading) OVER (PARTITION BY gene_idx) + 1e-8) + 1e-8), 0), 6) AS score FROM pf")(lambda s, d: _r(core.combined_score(factors(s, d)).select("factor_id", "gene_idx", "score"), "score"))
query("factor_top_genes", f"WITH {_TOP} SELECT factor_id, CAST(rank AS INT) AS rank, gene_idx FROM tg")(lambda s, d: core.top_genes(factors(s, d), TOP).select("factor_id", F.col("rank").cast("int"), "gene_idx"))
_LABELS = [f"{x}_F{n}" for x in range(10) for n in range(5)]
query("factor_loadings_wide", f"WITH {_PF} SELECT gene_idx, " + ", ".join(f'round(max(loading) FILTER (WHERE sample_id = {c.split("_F")[0]} AND factor_id % 5 = {c.split("_F")[1]}), 6) AS "{c}"' for c in _LABELS) + " FROM pf GROUP BY 1")(
    lambda s, d: _r(core.factor_loadings(factors(s, d), samples=range(10), per_sample=5), *_LABELS)
)
_KEPT = [f"{x}_F{n}" for x in range(10) for n in range(3)]


@query("factor_loadings_kept", f"WITH {_PF} SELECT gene_idx, " + ", ".join(f'round(max(loading) FILTER (WHERE sample_id = {c.split("_F")[0]} AND factor_id % 5 = {2 * int(c.split("_F")[1])}), 6) AS "{c}"' for c in _KEPT) + " FROM pf GROUP BY 1")
def _kept(s, d):
    f = factors(s, d)
    keep = f.select("factor_id", (F.col("factor_id") % 5 % 2 == 0).alias("keep")).distinct()
    return _r(core.factor_loadings(f, keep, True, range(10), 3), *_KEPT)


@query("factor_scores_wide")
def _scores_wide(s, d):
    out = core.nmf_fit(expr(s, d), cells(s, d), GENES, (2, 3), min_cells=10, center=False, tol=1e-4, max_iter=300, keep_scores=True)
    return _r(core.factor_scores(out, (2, 3)), *[f"F{n}" for n in range(5)])


query("factor_similarity", f"WITH {_SIM} SELECT i, j, round(sim, 6) AS sim FROM sim")(lambda s, d: _r(edges(s, d), "sim"))
query("factor_similarity_threshold", f"WITH {_SIM} SELECT i, j, round(sim, 6) AS sim FROM sim WHERE sim >= 0.35")(lambda s, d: _r(core.similarity(factors(s, d), top_k=TOP, min_similarity=0.35), "sim"))
query("factor_similarity_inter", f"WITH {_SIM} SELECT i, j, round(sim, 6) AS sim FROM sim WHERE si <> sj")(lambda s, d: _r(core.similarity(factors(s, d), top_k=TOP, intra_sample=False), "sim"))
query("factor_similarity_combined", f"""WITH {_PF}, c AS (SELECT *, greatest(loading * ln(loading / (avg(loading) OVER (PARTITION BY gene_idx) + 1e-8) + 1e-8), 0) AS score FROM pf),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY score DESC, gene_idx DESC) AS r FROM c) WHERE r <= 20)
SELECT a.factor_id AS i, b.factor_id AS j, round(count(*) / (40.0 - count(*)), 6) AS sim FROM t a JOIN t b ON a.gene_idx = b.gene_idx AND a.factor_id < b.factor_id GROUP BY 1, 2""")(lambda s, d: _r(core.similarity_compute(factors(s, d), "jaccard", top_k=TOP, use_combined=True), "sim"))
query("factor_similarity_cosine", f"""WITH {_TOP}, p AS (SELECT DISTINCT a.factor_id AS i, b.factor_id AS j FROM pf a, pf b WHERE a.factor_id < b.factor_id AND a.gene_idx = 0 AND b.gene_idx = 0),
u AS (SELECT i, j, x.gene_idx, x.loading AS a, y.loading AS b FROM p JOIN pf x ON x.factor_id = i JOIN pf y ON y.factor_id = j AND y.gene_idx = x.gene_idx WHERE EXISTS (SELECT 1 FROM tg WHERE tg.gene_idx = x.gene_idx AND tg.factor_id IN (i, j)))
SELECT i, j, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS sim FROM u GROUP BY 1, 2""")(lambda s, d: _r(core.similarity(factors(s, d), core.cosine, TOP), "sim"))

# ---------------------------------------------------------------- pruning and masks

_XR = _TOP + """, xr AS (SELECT a.factor_id AS a, b.k_idx AS kb, b.factor_id AS b, count(*) / (40.0 - count(*)) AS sim FROM tg a JOIN tg b ON a.gene_idx = b.gene_idx AND a.sample_id = b.sample_id AND a.k_idx <> b.k_idx GROUP BY 1, 2, 3),
mt AS (SELECT f.factor_id, count(x.kb) AS prune_matches FROM (SELECT DISTINCT factor_id FROM pf) f LEFT JOIN (SELECT a, kb FROM xr GROUP BY 1, 2 HAVING max(sim) >= 0.3) x ON x.a = f.factor_id GROUP BY 1)"""


def _greedy(s, d):
    f = factors(s, d)
    return core.recurrence(f, core.match_greedy(core.cross_rank_pairs(core.top_genes(f, TOP)), 0.3))


query("match_greedy", f"WITH {_XR} SELECT factor_id, prune_matches FROM mt")(_greedy)
_HUN = _TOP + """, g AS (SELECT DISTINCT factor_id, sample_id, k_idx FROM pf), xs AS (SELECT a.sample_id, a.factor_id AS a, b.factor_id AS b, (SELECT count(*) / (40.0 - count(*)) FROM tg x JOIN tg y ON x.gene_idx = y.gene_idx WHERE x.factor_id = a.factor_id AND y.factor_id = b.factor_id) AS sim
 FROM g a JOIN g b USING (sample_id) WHERE a.k_idx = 0 AND b.k_idx = 1), best AS (SELECT p.sample_id, max(p.sim + q.sim) AS total FROM xs p JOIN xs q ON p.sample_id = q.sample_id AND p.a < q.a AND p.b <> q.b GROUP BY 1)"""


@query("match_hungarian", f"WITH {_HUN} SELECT sample_id, ka, CAST(1 - ka AS INT) AS kb, CAST(2 AS BIGINT) AS n, round(total, 6) AS total FROM best, (VALUES (0), (1)) t(ka)")
def _hungarian(s, d):
    top = core.top_genes(factors(s, d), TOP)
    found = core.match_hungarian(core.rank_grid(top, core.cross_rank_pairs(top)))
    return _r(found.groupBy("sample_id", "ka", "kb").agg(F.count("*").alias("n"), F.sum("sim").alias("total")), "total")


_ONE_TO_ONE = _HUN + """, am AS (SELECT p.sample_id, arg_max([{'f': p.a, 's': p.sim}, {'f': p.b, 's': p.sim}, {'f': q.a, 's': q.sim}, {'f': q.b, 's': q.sim}], p.sim + q.sim - 1e-9 * ((p.a % 5 + 1) * sqrt(p.b % 5 - 1) + (q.a % 5 + 1) * sqrt(q.b % 5 - 1)) / (2 * sqrt(3))) AS m FROM xs p JOIN xs q ON p.sample_id = q.sample_id AND p.a < q.a AND p.b <> q.b GROUP BY 1),
mm AS (SELECT e.f FROM (SELECT unnest(m) AS e FROM am) WHERE e.s >= 0.2), mt AS (SELECT DISTINCT factor_id, CAST(factor_id IN (SELECT f FROM mm) AS BIGINT) AS prune_matches FROM pf)"""
_DEDUP = """, kp AS (SELECT factor_id, prune_matches, prune_matches >= 1 AS ok FROM mt), sg AS (SELECT a.factor_id AS a, b.factor_id AS b, any_value(a.sample_id) AS sample_id, count(*) / (40.0 - count(*)) AS sim
 FROM tg a JOIN tg b ON a.gene_idx = b.gene_idx AND a.sample_id = b.sample_id AND a.factor_id <> b.factor_id JOIN kp x ON x.factor_id = a.factor_id AND x.ok JOIN kp y ON y.factor_id = b.factor_id AND y.ok GROUP BY 1, 2),
rc(f, g) AS (SELECT factor_id, factor_id FROM kp WHERE ok UNION SELECT rc.f, sg.b FROM rc JOIN sg ON sg.a = rc.g AND sim >= LEAST),
cp AS (SELECT f, min(g) AS c FROM rc GROUP BY 1), ms AS (SELECT x.f, x.c, round(coalesce(sum(sg.sim) / (SELECT count(*) FROM cp z WHERE z.c = x.c), 0), 9) AS m FROM cp x LEFT JOIN (SELECT sg.*, cp.c FROM sg JOIN cp ON cp.f = sg.b) sg ON sg.a = x.f AND sg.c = x.c GROUP BY 1, 2),
kt AS (SELECT f FROM (SELECT f, row_number() OVER (PARTITION BY c ORDER BY m DESC, f) AS r FROM ms) WHERE r = 1)
SELECT factor_id, prune_matches, ok AND factor_id IN (SELECT f FROM kt) AS keep FROM kp"""
query("prune_dedup", f"WITH RECURSIVE {_ONE_TO_ONE}{_DEDUP.replace('LEAST', '0.5')}")(lambda s, d: core.nmf_prune(factors(s, d), 2, TOP, 0.2, 0.5))
query("prune_greedy", f"WITH RECURSIVE {_XR}{_DEDUP.replace('LEAST', '0.3')}")(lambda s, d: core.nmf_prune(factors(s, d), 2, TOP, 0.3, 0.3, matching="greedy"))
query("drop_zeros", f"WITH {_SIM}, st AS (SELECT * FROM sim WHERE sim >= 0.35) SELECT DISTINCT factor_id FROM pf WHERE factor_id IN (SELECT i FROM st UNION ALL SELECT j FROM st)")(lambda s, d: core.drop_zeros(factors(s, d).select("factor_id").distinct(), edges(s, d).where("sim >= 0.35")))
query("similarity_filter", f"WITH {_MAX} SELECT factor_id, round(max_sim, 6) AS max_sim, max_sim >= 0.35 AS keep FROM mx")(lambda s, d: _r(core.similarity_filter(factors(s, d), edges(s, d), 0.35), "max_sim"))


@query("keep_masks", f"WITH {_XR}, sim AS (SELECT a.factor_id AS i, b.factor_id AS j, count(*) / (40.0 - count(*)) AS sim FROM tg a JOIN tg b ON a.gene_idx = b.gene_idx AND a.factor_id <> b.factor_id GROUP BY 1, 2) SELECT factor_id, prune_matches >= 1 AND max(sim) >= 0.35 AS keep FROM mt JOIN sim ON i = factor_id GROUP BY 1, prune_matches")
def _masks(s, d):
    f = factors(s, d)
    a = _greedy(s, d).select("factor_id", (F.col("prune_matches") >= 1).alias("p"))
    b = core.similarity_filter(f, edges(s, d), 0.35).select("factor_id", F.col("keep").alias("m"))
    return a.join(b, "factor_id").select("factor_id", core.keep_all(F.col("p"), F.col("m"), F.lit(None).cast("boolean")).alias("keep"))


# ---------------------------------------------------------------- programs

query("program_centroids", f"WITH {_CEN} SELECT program, gene_idx, round(loading, 6) AS loading FROM cen")(lambda s, d: _r(programs.centroids(members(s, d), factors(s, d)), "loading"))
query("program_genes", f"WITH {_GEN} SELECT program, CAST(rank AS INT) AS rank, gene_idx FROM gen")(lambda s, d: program_table(s, d).withColumn("rank", F.col("rank").cast("int")))
query("mp_genes", f"""WITH {_MEM}, fq AS (SELECT program, gene_idx, count(*) AS freq, max(loading) AS m FROM tg JOIN mem USING (factor_id) GROUP BY 1, 2)
SELECT program, gene_idx, freq, round(m, 6) AS max_loading FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY freq DESC, m DESC, gene_idx) AS r FROM fq) WHERE r <= 20""")(lambda s, d: _r(programs.meta_genes(members(s, d), core.top_genes(factors(s, d), TOP), TOP), "max_loading"))
query("program_samples", f"WITH {_MEM} SELECT program, string_agg(DISTINCT CAST(sample_id AS VARCHAR), ',' ORDER BY CAST(sample_id AS VARCHAR)) AS samples FROM mem GROUP BY 1")(
    lambda s, d: programs.program_samples(members(s, d)).select("program", F.array_join(F.array_sort(F.transform("samples", lambda x: x.cast("string"))), ",").alias("samples"))
)
query("donor_counts", f"WITH {_MEM} SELECT sample_id AS donor, program, count(*) AS n_factors, round(count(*) / sum(count(*)) OVER (PARTITION BY program), 6) AS fraction FROM mem GROUP BY 1, 2")(lambda s, d: _r(programs.donor_counts(members(s, d)), "fraction"))
_PQ = _MEM + """, n AS (SELECT sum(c * c) AS ci, sum(c) * sum(c) AS al FROM (SELECT count(*) AS c FROM mem GROUP BY program)),
e AS (SELECT sum(CASE WHEN a.program = b.program THEN 2 * sim ELSE 0 END) AS si, sum(CASE WHEN a.program <> b.program THEN 2 * sim ELSE 0 END) AS so FROM sim JOIN mem a ON a.factor_id = i JOIN mem b ON b.factor_id = j), q AS (SELECT si / ci AS inn, so / (al - ci) AS outr FROM e, n)"""
query("program_share_scores", f"WITH {_SCO}, ss AS (SELECT sample_id, program, avg(score) AS v FROM sc GROUP BY 1, 2 HAVING count(DISTINCT cell_id) >= 10) SELECT m.program, m.donor, round(coalesce(v, 0), 6) AS value FROM (SELECT DISTINCT a.program, b.sample_id AS donor FROM mem a, mem b) m LEFT JOIN ss ON ss.program = m.program AND ss.sample_id = m.donor")(
    lambda s, d: _r(programs.program_share(members(s, d), "mean_score", sample_scores(s, d)), "value")
)
query("partition_quality", f'WITH {_PQ} SELECT round(inn, 6) AS "inner", round(outr, 6) AS "outer", round(inn / outr, 6) AS ratio, round(inn - outr, 6) AS delta FROM q')(lambda s, d: _r(programs.partition_quality(members(s, d), edges(s, d)), "inner", "outer", "ratio", "delta"))
_SIL = _MEM + """, es AS (SELECT i, j, sim FROM sim UNION ALL SELECT j, i, sim FROM sim), dd AS (SELECT a.factor_id, a.program AS p, b.program AS o, sum(CASE WHEN a.factor_id = b.factor_id THEN 0 ELSE 1 - coalesce(sim, 0) END) AS t, count(*) AS n FROM mem a CROSS JOIN mem b LEFT JOIN es ON es.i = a.factor_id AND es.j = b.factor_id GROUP BY 1, 2, 3),
ab AS (SELECT factor_id, max(CASE WHEN p = o THEN t / (n - 1) END) AS a, min(CASE WHEN p <> o THEN t / n END) AS b FROM dd GROUP BY 1)"""
query("silhouette", f"WITH {_SIL} SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab")(lambda s, d: _r(programs.silhouette(members(s, d), edges(s, d)), "silhouette"))


def _strong(s, d):
    return edges(s, d).where("sim >= 0.25")


query("cluster_centroid")(lambda s, d: programs.programs_cluster("centroid", factors(s, d), _strong(s, d), threshold=0.1, min_cluster=2).select("factor_id", "program", "display_pos"))
query("cluster_progressive")(lambda s, d: programs.programs_cluster("progressive", factors(s, d), _strong(s, d), GENES, top_k=TOP, min_overlap=8, min_founder_overlaps=1).select("factor_id", "program", "display_pos"))
query("threshold_sweep")(lambda s, d: programs.programs_threshold(factors(s, d), _strong(s, d), [i / 20 for i in range(21)]))
query("sweep_curve")(lambda s, d: programs.programs_threshold(factors(s, d), _strong(s, d), [i / 20 for i in range(21)], metric="delta").select("threshold", "metric"))
query("programs_merge", f"WITH {_MEM} SELECT factor_id, sample_id, CAST(CASE program WHEN 0 THEN 0 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS INT) AS program FROM mem")(lambda s, d: programs.programs_merge(members(s, d), [[0, 2]], edges(s, d)).select("factor_id", "sample_id", "program"))
query("programs_remove", f"WITH {_MEM} SELECT factor_id, sample_id, CAST(CASE WHEN program < 1 THEN 0 ELSE program - 1 END AS INT) AS program FROM mem WHERE program <> 1")(lambda s, d: programs.programs_remove(members(s, d), [1], edges(s, d)).select("factor_id", "sample_id", "program"))
# The rebuilt state: labels by size (the merged one first, the removed one gone), then everything that hangs on them.
_RB = _SIM + ", mem AS (SELECT factor_id, sample_id, CASE p WHEN 1 THEN 0 WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS program FROM (SELECT DISTINCT factor_id, sample_id, k_idx * 2 + pos AS p FROM pf) WHERE p <> 4)"
_RBG = _RB + _GEN[len(_MEM):]


def _rebuilt(s, d):
    e = edges(s, d)
    left = programs.programs_remove(programs.programs_merge(members(s, d), [1, 3], e), [3], e)
    return programs.finalise(left, factors(s, d), e, N_TOP)


query("rebuild_genes", f"WITH {_RBG} SELECT program, CAST(rank AS INT) AS rank, gene_idx FROM gen")(lambda s, d: _rebuilt(s, d)["genes"].withColumn("rank", F.col("rank").cast("int")))
query("rebuild_centroids", f"WITH {_RBG} SELECT program, gene_idx, round(loading, 6) AS loading FROM cen")(lambda s, d: _r(_rebuilt(s, d)["centroids"], "loading"))
query("rebuild_stats", f"WITH {_RB}{_PQ[len(_MEM):]}{_SIL[len(_MEM):]} SELECT round(inn, 6) AS \"inner\", round(outr, 6) AS \"outer\", (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM ab) AS silhouette FROM q")(lambda s, d: _r(_rebuilt(s, d)["stats"], "inner", "outer", "silhouette"))
query("program_gene_lists", f"WITH {_GEN} SELECT 'C' || program AS name, string_agg(CAST(gene_idx AS VARCHAR), ',' ORDER BY rank) AS genes FROM gen GROUP BY program")(lambda s, d: programs.gene_lists(program_table(s, d)).select("name", F.array_join(F.transform("genes", lambda x: x.cast("string")), ",").alias("genes")))
query("program_compare", f"WITH {_GEN} SELECT a.program AS program_a, b.program AS program_b, round(count(c.gene_idx) / (30.0 - count(c.gene_idx)), 6) AS value FROM gen a CROSS JOIN (SELECT DISTINCT program FROM gen) b LEFT JOIN gen c ON c.program = b.program AND c.gene_idx = a.gene_idx GROUP BY 1, 2")(lambda s, d: _r(programs.program_overlaps(program_table(s, d), program_table(s, d)), "value"))
query("program_overlap_coef", f"WITH {_GEN} SELECT a.program AS program_a, b.program AS program_b, round(count(c.gene_idx) / 15.0, 6) AS value FROM gen a CROSS JOIN (SELECT DISTINCT program FROM gen) b LEFT JOIN gen c ON c.program = b.program AND c.gene_idx = a.gene_idx GROUP BY 1, 2")(lambda s, d: _r(programs.program_overlaps(program_table(s, d), program_table(s, d), "overlap_coefficient"), "value"))
_LEFT = _GEN + ", lo AS (SELECT m.program, m.factor_id, x.sample_id AS donor FROM mem m, (SELECT DISTINCT sample_id FROM mem) x WHERE m.sample_id <> x.sample_id)"
_JAC = "SELECT k.program, k.donor, round(count(g.gene_idx) / ({n} + count(*) - count(g.gene_idx)), 6) AS jaccard FROM kp k LEFT JOIN gen g ON g.program = k.program AND g.gene_idx = k.gene_idx GROUP BY 1, 2"
query("stability_centroid", f"""WITH {_LEFT}, c AS (SELECT program, donor, gene_idx, avg(loading) AS l FROM lo JOIN pf USING (factor_id) GROUP BY 1, 2, 3),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY program, donor ORDER BY greatest(l * ln(l / (l + 1e-8) + 1e-8), 0) DESC, gene_idx DESC) AS r FROM c) WHERE r <= 15) {_JAC.format(n="15.0")}""")(lambda s, d: _r(programs.programs_stability(members(s, d), factors(s, d), program_table(s, d), N_TOP).select("program", "donor", "jaccard"), "jaccard"))
query("stability_progressive", f"""WITH {_LEFT}, c AS (SELECT program, donor, gene_idx, count(*) AS f, max(loading) AS l FROM lo JOIN tg USING (factor_id) GROUP BY 1, 2, 3),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY program, donor ORDER BY f DESC, l DESC, gene_idx) AS r FROM c) WHERE r <= 15) {_JAC.format(n="15.0")}""")(
    lambda s, d: _r(programs.programs_stability(members(s, d), factors(s, d), program_table(s, d), N_TOP, "progressive", core.top_genes(factors(s, d), TOP)).select("program", "donor", "jaccard"), "jaccard")
)

_DONORS = list(range(10))
query("stability_table", f"WITH {_LEFT}, c AS (SELECT program, donor, gene_idx, count(*) AS f, max(loading) AS l FROM lo JOIN tg USING (factor_id) GROUP BY 1, 2, 3), kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY program, donor ORDER BY f DESC, l DESC, gene_idx) AS r FROM c) WHERE r <= 15), js AS (SELECT k.program, k.donor, count(g.gene_idx) / (15.0 + count(*) - count(g.gene_idx)) AS j FROM kp k LEFT JOIN gen g ON g.program = k.program AND g.gene_idx = k.gene_idx GROUP BY 1, 2) SELECT program, " + ", ".join(f'round(max(j) FILTER (WHERE donor = {x}), 6) AS "{x}"' for x in _DONORS) + ", round(avg(j), 6) AS mean FROM js GROUP BY 1")(
    lambda s, d: _r(programs.stability_table(programs.programs_stability(members(s, d), factors(s, d), program_table(s, d), N_TOP, "progressive", core.top_genes(factors(s, d), TOP)), _DONORS), *map(str, _DONORS), "mean")
)

# ---------------------------------------------------------------- scores

query("gene_bins", f"WITH {_BIN} SELECT gene_idx, round(mean_expr, 6) AS mean_expr, bin FROM bn")(lambda s, d: _r(scoring.gene_bins(scoring.gene_means(expr(s, d), cells(s, d).count(), GENES)), "mean_expr"))
query("control_genes", f"WITH {_CTL} SELECT CAST(program AS INT) AS program, gene_idx FROM ctl")(controls)
query("cell_scores", f"WITH {_SCO} SELECT cell_id, program, round(score, 6) AS score FROM sc")(lambda s, d: _r(cell_scores(s, d), "score"))


@query("cell_scores_packed", f"WITH {_SCO} SELECT cell_id, program, round(score, 6) AS score FROM sc")
def _packed(s, d):
    """The form that scores a stream, on the whole table: a cell is one row."""
    packed = _emb(s, d).select(F.col("vec_id").alias("cell_id"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("genes"), F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0))).alias("values"))
    return _r(stream.score_rows(packed, stream.frozen_weights(program_table(s, d), controls(s, d))), "score")


query("sample_scores_mean", f"WITH {_SCO} " + _SAM.format(p=", ".join(f"round(avg(score) FILTER (WHERE program = {p}), 6) AS P{p}" for p in range(5))))(lambda s, d: _r(sample_scores(s, d), *[f"P{p}" for p in range(5)]))
query("sample_scores_median", f"WITH {_SCO} " + _SAM.format(p=", ".join(f"round(quantile_cont(score, 0.5) FILTER (WHERE program = {p}), 6) AS P{p}" for p in range(5))))(lambda s, d: _r(sample_scores(s, d, "median"), *[f"P{p}" for p in range(5)]))


@query("classify_cells")
def _classify(s, d):
    e, c, g = expr(s, d), cells(s, d), program_table(s, d)
    out = scoring.score_classify(cell_scores(s, d), e, c, g, 5, 200)
    return out.select("cell_id", "program", F.round("padj", 6).alias("padj"), "label")


@query("bh_adjust", "WITH p AS (SELECT o_orderkey AS key, (o_orderkey * 7919 % 10007 + 1) / 10008.0 AS p FROM orders), r AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS rk FROM p), q AS (SELECT *, min(p * m / rk) OVER (ORDER BY p DESC) AS a FROM r) SELECT key, round(p, 6) AS p, round(least(1, a), 6) AS padj FROM q")
def _bh(s, d):
    p = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), ((F.col("o_orderkey") * 7919 % 10007 + 1) / 10008.0).alias("p"))
    return _r(adjust_pvalues(p, "p"), "p", "padj")


_ADJ = "WITH p AS (SELECT o_orderkey AS key, (o_orderkey * 7919 % 10007 + 1) / 1000800.0 AS p FROM orders), c AS (SELECT p, count(*) AS n FROM p GROUP BY 1), r AS (SELECT p, sum(n) OVER (ORDER BY p) AS last, sum(n) OVER () AS m, n FROM c)"
for _method, _value in {
    "fdr_by": "least(1, min(p * m / last * (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) + 1 FROM p)) t(i))) OVER (ORDER BY p DESC))",
    "bonferroni": "least(1, p * m)",
    "sidak": "1 - pow(1 - p, m)",
    "holm": "least(1, max(p * (m - last + n)) OVER (ORDER BY p))",
    "simes-hochberg": "least(1, min(p * (m - last + 1)) OVER (ORDER BY p DESC))",
}.items():
    query(f"adjust_{_method.replace('-', '_')}", f"{_ADJ}, q AS (SELECT p, {_value} AS a FROM r) SELECT key, round(a, 6) AS padj FROM p JOIN q USING (p)")(
        lambda s, d, method=_method: _r(adjust_pvalues(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), ((F.col("o_orderkey") * 7919 % 10007 + 1) / 1000800.0).alias("p")), "p", method=method).select("key", "padj"), "padj")
    )

_OLS = _SCO + ", ss AS (SELECT sample_id, program, avg(score) AS y, 30.0 + 5 * sample_id AS x FROM sc GROUP BY 1, 2 HAVING count(*) >= 10), z AS (SELECT program, x, (y - avg(y) OVER (PARTITION BY program)) / stddev_samp(y) OVER (PARTITION BY program) AS y FROM ss), b AS (SELECT program, regr_slope(y, x) AS beta, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM z GROUP BY 1)"
query("associate_ols", f"WITH {_OLS} SELECT 'P' || program AS program, round(beta, 6) AS beta, round(se, 6) AS se FROM b")(lambda s, d: _r(scoring.score_associate(sample_scores(s, d), "age").select("program", "beta", "se"), "beta", "se"))
query("associate_native", f"WITH {_OLS} SELECT 'P' || program AS program, round(beta, 6) AS beta, round(se, 6) AS se FROM b")(lambda s, d: _r(scoring.associate_native(sample_scores(s, d), [f"P{p}" for p in range(5)], "age"), "beta", "se"))
_ROWS = _SCO + ", ss AS (SELECT sample_id, program, avg(score) AS y, 30.0 + 5 * sample_id AS x, sample_id % 3 AS g FROM sc GROUP BY 1, 2 HAVING count(*) >= 10), z AS (SELECT program, x, ln(x) AS lx, g, (y - avg(y) OVER (PARTITION BY program)) / stddev_samp(y) OVER (PARTITION BY program) AS y FROM ss)"
query("associate_transformed", f"""WITH {_ROWS}, f AS (SELECT program, regr_slope(x, lx) AS bx, regr_intercept(x, lx) AS ax, regr_slope(y, lx) AS by_, regr_intercept(y, lx) AS ay FROM z GROUP BY 1),
e AS (SELECT z.program, x - ax - bx * lx AS x, y - ay - by_ * lx AS y FROM z JOIN f USING (program)), b AS (SELECT program, sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n FROM e GROUP BY 1)
SELECT 'P' || program AS program, round(beta, 5) AS beta, round(sqrt((yy - beta * beta * xx) / (n - 3) / xx), 5) AS se FROM b""")(lambda s, d: _r(scoring.score_associate(sample_scores(s, d), "age + np.log(age)").select("program", "beta", "se"), "beta", "se", digits=5))
query("associate_no_intercept", f"""WITH {_ROWS}, b AS (SELECT program, sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n FROM z GROUP BY 1)
SELECT 'P' || program AS program, round(beta, 6) AS beta, round(sqrt((yy - beta * beta * xx) / (n - 1) / xx), 6) AS se FROM b""")(lambda s, d: _r(scoring.score_associate(sample_scores(s, d), "age - 1").select("program", "beta", "se"), "beta", "se"))
query("associate_lmm_ratio", f"""WITH {_ROWS}, gs AS (SELECT program, g, count(*) AS n, sum(x) AS x, sum(y) AS y, 0.5 / (1 + 0.5 * count(*)) AS s FROM z GROUP BY 1, 2),
ww AS (SELECT program, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM z GROUP BY 1), k AS (SELECT program, sum(s * n * n) AS nn, sum(s * n * x) AS nx, sum(s * n * y) AS ny, sum(s * x * x) AS xx, sum(s * x * y) AS xy, sum(s * y * y) AS yy FROM gs GROUP BY 1),
a AS (SELECT program, ww.n, ww.n - nn AS a, ww.x - nx AS b, ww.xx - k.xx AS d, ww.y - ny AS u, ww.xy - k.xy AS v, ww.yy - k.yy AS c FROM ww JOIN k USING (program)), t AS (SELECT *, (a * v - b * u) / (a * d - b * b) AS b1, (d * u - b * v) / (a * d - b * b) AS b0 FROM a)
SELECT 'P' || program AS program, round(b1, 5) AS beta, round(sqrt((c - b0 * u - b1 * v) / (n - 2) * a / (a * d - b * b)), 5) AS se FROM t""")(lambda s, d: _r(scoring.score_associate(sample_scores(s, d), "age + (1|study)", ratio=0.5).select("program", "beta", "se"), "beta", "se", digits=5))
query("associate_lmm")(lambda s, d: _r(scoring.score_associate(sample_scores(s, d), "age + (1|study)").select("program", "beta", "se", "pval", "padj"), "beta", "se", "pval", "padj", digits=4))
_FOREST = _OLS + """, tt AS (SELECT program, beta, se, abs(beta / se) AS t FROM b), th AS (SELECT *, atan(t / sqrt(8.0)) AS h FROM tt),
pv AS (SELECT *, 1 - sin(h) * (1 + pow(cos(h), 2) / 2 + 3 * pow(cos(h), 4) / 8 + 5 * pow(cos(h), 6) / 16) AS p FROM th),
pa AS (SELECT *, min(least(1, p * m / rk)) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS padj FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS rk FROM pv))"""
query("associate_padj", f"WITH {_FOREST} SELECT 'P' || program AS program, round(p, 5) AS pval, round(padj, 5) AS padj FROM pa")(lambda s, d: _r(scoring.score_associate(sample_scores(s, d), "age").select("program", "pval", "padj"), "pval", "padj", digits=5))
query("association_forest", f"WITH {_FOREST} SELECT 'P' || program AS program, round(beta - se, 6) AS lo, round(beta, 6) AS beta, round(beta + se, 6) AS hi, padj < 0.05 AS significant FROM pa")(lambda s, d: _r(scoring.association_forest(scoring.score_associate(sample_scores(s, d), "age")), "lo", "beta", "hi"))

# ---------------------------------------------------------------- enrichment and plot tables

query("annotate_programs", f"WITH {_ANN} SELECT program, gene_set, jaccard, n_overlap, n_program, n_geneset, n_background, round(pval, 6) AS pval, round(padj, 6) AS padj FROM ann")(lambda s, d: _r(annotation(s, d), "pval", "padj"))
query("annotate_top_n", f"WITH {_ANN} SELECT program, gene_set, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY padj, jaccard DESC, gene_set) AS r FROM ann) WHERE r <= 2")(lambda s, d: programs.top_hits(annotation(s, d), 2).select("program", "gene_set", F.col("rank").cast("int")))
_SETS = ("GS_A", "GS_B", "GS_C")
query("annotate_pivot", f"WITH {_ANN} SELECT program, " + ", ".join(f"coalesce(max(jaccard) FILTER (WHERE gene_set = '{g}'), 0) AS {g}" for g in _SETS) + " FROM ann GROUP BY 1")(lambda s, d: annotation(s, d).groupBy("program").pivot("gene_set", list(_SETS)).agg(F.max("jaccard")).na.fill(0.0))
_HIT = _ANN + ", hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY padj, jaccard DESC, gene_set) AS r FROM ann) WHERE r <= 2), so AS (SELECT gene_set, row_number() OVER (ORDER BY max(jaccard) DESC, gene_set) - 1 AS pos FROM hit GROUP BY 1)"
query("annotate_cells", f"WITH {_HIT} SELECT so.gene_set, CAST(pos AS INT) AS pos, p.program, coalesce(jaccard, 0) AS jaccard, round(coalesce(padj, 1), 6) AS padj, coalesce(padj, 1) < 0.05 AS significant FROM so CROSS JOIN (SELECT DISTINCT program FROM hit) p LEFT JOIN hit ON hit.gene_set = so.gene_set AND hit.program = p.program")(
    lambda s, d: _r(programs.annotation_cells(programs.top_hits(annotation(s, d), 2)).withColumn("pos", F.col("pos").cast("int")), "padj")
)
query("retention_curve", f"WITH {_MAX} SELECT round(t / 99.0, 6) AS threshold, count(*) FILTER (WHERE max_sim >= t / 99.0) AS n FROM mx, range(0, 100) r(t) GROUP BY t")(lambda s, d: _r(scoring.retention_curve(maxima(s, d)), "threshold"))
query("max_sim_histogram", f"WITH {_MAX} SELECT CAST(least(floor(max_sim * 50), 49) AS INT) AS bin, count(*) AS n FROM mx GROUP BY 1")(lambda s, d: scoring.histogram(maxima(s, d)))
query("gmm_threshold")(lambda s, d: _r(scoring.similarity_cutoff(maxima(s, d)), "threshold", digits=4))
query("heatmap_limits", f"WITH {_SIM} SELECT round(quantile_cont(sim, 0.01), 6) AS vmin, round(quantile_cont(sim, 0.99), 6) AS vmax FROM sim")(lambda s, d: _r(scoring.heatmap_limits(edges(s, d)), "vmin", "vmax"))
_HM = _PQ.split(", n AS")[0] + ", dp AS (SELECT factor_id, CAST(row_number() OVER (ORDER BY program, factor_id) - 1 AS INT) AS pos FROM mem), hc AS (SELECT a.pos AS row, b.pos AS col, sim FROM (SELECT i, j, sim FROM sim UNION ALL SELECT j, i, sim FROM sim) e JOIN dp a ON a.factor_id = i JOIN dp b ON b.factor_id = j UNION ALL SELECT pos, pos, 1.0 FROM dp)"


def _placed(s, d):
    """Members at display positions by program and id."""
    return members(s, d).withColumn("display_pos", (F.row_number().over(Window.orderBy("program", "factor_id")) - 1).cast("int"))


query("heatmap_cells", f"WITH {_HM} SELECT row, col, round(CASE WHEN sim < 1 THEN sim / (1 - sim) ELSE 1 END, 6) AS value FROM hc")(lambda s, d: _r(scoring.heatmap_cells(_placed(s, d), edges(s, d), True), "value"))
query("heatmap_scale", f"WITH {_HM} SELECT round(quantile_cont(sim, 0.01), 6) AS vmin, round(quantile_cont(sim, 0.99), 6) AS vmax FROM hc WHERE row <> col AND sim > 0")(lambda s, d: _r(scoring.heatmap_scale(scoring.heatmap_cells(_placed(s, d), edges(s, d))), "vmin", "vmax"))
query("block_bounds", f"WITH {_HM} SELECT program, min(pos) AS first, max(pos) AS last FROM dp JOIN mem USING (factor_id) GROUP BY 1")(lambda s, d: scoring.block_bounds(_placed(s, d)))
query("colour_limits", f"WITH {_SCO} SELECT round(quantile_cont(score, 0.01), 6) AS vmin, round(quantile_cont(score, 0.99), 6) AS vmax, quantile_cont(score, 0.01) < 0 AND quantile_cont(score, 0.99) > 0 AS two_slope FROM sc")(lambda s, d: _r(scoring.colour_limits(cell_scores(s, d)), "vmin", "vmax"))
query("loading_bars", f"WITH {_GEN}, mm AS (SELECT program, max(loading) AS m FROM cen GROUP BY 1) SELECT c.program, c.gene_idx, round(c.loading / m, 6) AS norm_loading FROM cen c JOIN gen g ON g.program = c.program AND g.gene_idx = c.gene_idx JOIN mm ON mm.program = c.program")(lambda s, d: _r(scoring.loading_bars(programs.centroids(members(s, d), factors(s, d)), program_table(s, d)), "norm_loading"))
query("embedding_scores", f"WITH {_SCO} SELECT cell_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, program, round(score, 6) AS score FROM sc JOIN embeddings ON vec_id = cell_id")(
    lambda s, d: _r(_emb(s, d).select(F.col("vec_id").alias("cell_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")).join(cell_scores(s, d), "cell_id"), "x", "y", "score")
)
