"""Queries of contrasts, variance, corrections and ranking measures on a table of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import designs, joins
from ..operators import statistics as st
from ..operators.scratch import new_path
from ..streaming import runs
from .registry import Tables, query

CUBE_SQL = "cube AS (SELECT o_orderstatus AS budget, substr(o_orderpriority, 1, 1) AS arm, (o_custkey % 5)::INT AS seed, avg(o_totalprice) / 1e6 AS value FROM orders GROUP BY ALL)"
COEFFICIENTS = [("arms", "F", "1", 1.0), ("arms", "F", "2", -1.0), ("budgets", "F", "1", 1.0), ("budgets", "O", "1", -1.0), ("interaction", "F", "1", 1.0), ("interaction", "F", "2", -1.0), ("interaction", "O", "1", -1.0), ("interaction", "O", "2", 1.0)]
VALUES_SQL = f"{CUBE_SQL}, k(contrast, budget, arm, weight) AS (VALUES {', '.join(map(str, COEFFICIENTS))}), v AS (SELECT contrast, seed, sum(weight * value * 100) AS difference FROM cube JOIN k USING (budget, arm) GROUP BY ALL)"
SUMMARY_SQL = f"""{VALUES_SQL}, w AS (SELECT *, count(*) OVER c AS nn, sum(difference) OVER c AS ss FROM v WINDOW c AS (PARTITION BY contrast)),
s AS (SELECT contrast, count(*) AS n, avg(difference) AS mean, stddev_samp(difference) AS sd, sum(CASE WHEN sign(difference) = sign(ss) THEN 1 ELSE 0 END)::BIGINT AS n_same_sign, min((ss - difference) / (nn - 1)) AS loo_min, max((ss - difference) / (nn - 1)) AS loo_max FROM w GROUP BY contrast)"""


def cube(db: Tables) -> DataFrame:
    return db.orders.groupBy(F.col("o_orderstatus").alias("budget"), F.substring("o_orderpriority", 1, 1).alias("arm"), (F.col("o_custkey") % 5).cast("int").alias("seed")).agg((F.avg("o_totalprice") / 1e6).alias("value"))


def values(db: Tables) -> DataFrame:
    return st.contrast_values(cube(db), db.spark.createDataFrame(COEFFICIENTS, "contrast string, budget string, arm string, weight double"), ["budget", "arm"])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query(f"WITH {VALUES_SQL} SELECT contrast, seed, round(difference, 6) AS difference FROM v")
def contrast_values(db: Tables) -> DataFrame:
    return rounded(values(db), "difference")


@query(f"WITH {SUMMARY_SQL} SELECT contrast, n, round(mean, 6) AS mean, round(sd, 6) AS sd, n_same_sign, round(loo_min, 6) AS loo_min, round(loo_max, 6) AS loo_max, round(mean / (sd / sqrt(n)), 6) AS t, round(mean / sd, 6) AS effect, CASE WHEN abs(mean) > 2 AND n_same_sign = n THEN 'real' WHEN n_same_sign >= ceil(n * 2 / 3) THEN 'direction' ELSE 'noise' END AS verdict FROM s")
def contrast_signs(db: Tables) -> DataFrame:
    return rounded(st.verdict_by_signs(st.contrast_summary(values(db))), "mean", "sd", "loo_min", "loo_max", "t", "effect")


@query(f"WITH {SUMMARY_SQL}, i AS (SELECT *, mean - 2.7764451051977987 * sd / sqrt(n) AS lo95, mean + 2.7764451051977987 * sd / sqrt(n) AS hi95, mean - 2.13184678632665 * sd / sqrt(n) AS lo90, mean + 2.13184678632665 * sd / sqrt(n) AS hi90 FROM s) SELECT contrast, round(lo95, 5) AS lo95, round(hi95, 5) AS hi95, round(lo90, 5) AS lo90, round(hi90, 5) AS hi90, sd > 0.8 AS underpowered, CASE WHEN hi95 < 0 THEN 'worse' WHEN lo95 > 0 THEN 'better' WHEN lo90 > -1 AND hi90 < 1 THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM i")
def contrast_intervals(db: Tables) -> DataFrame:
    s = st.verdict_by_intervals(st.intervals(st.contrast_summary(values(db))))
    return s.select("contrast", *[F.round(c, 5).alias(c) for c in ("lo95", "hi95", "lo90", "hi90")], "underpowered", "verdict")


@query(None)
def contrast_p_values(db: Tables) -> DataFrame:
    s = st.intervals(st.contrast_summary(values(db))).withColumn("family", F.lit("all"))
    return st.holm(s, "family", "contrast").select("contrast", "t", "p", "p_equivalent", "p_holm")


@query("WITH p AS (SELECT r_name AS family, n_name AS name, ((n_nationkey * 7) % 25 + 1) / 100.0::DOUBLE AS p FROM nation JOIN region ON r_regionkey = n_regionkey), s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p) AS step FROM p) SELECT family, name, p, round(max(step) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s")
def holm_correction(db: Tables) -> DataFrame:
    p = db.nation.join(F.broadcast(db.region), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("family"), F.col("n_name").alias("name"), (((F.col("n_nationkey") * 7) % 25 + 1) / 100.0).alias("p"))
    return rounded(st.holm(p, "family", "name"), "p_holm")


@query(f"""WITH {CUBE_SQL}, x AS (SELECT budget, arm, seed, value * 100 AS v FROM cube), m AS (SELECT avg(v) AS mu, sum((v - (SELECT avg(v) FROM x))^2) AS tot FROM x),
a AS (SELECT sum(n * (g - mu)^2) AS ss, count(*) - 1 AS df FROM (SELECT avg(v) AS g, count(*) AS n FROM x GROUP BY budget), m), b AS (SELECT sum(n * (g - mu)^2) AS ss, count(*) - 1 AS df FROM (SELECT avg(v) AS g, count(*) AS n FROM x GROUP BY arm), m),
ab AS (SELECT sum(n * (g - mu)^2) AS ss, count(*) - 1 AS df FROM (SELECT avg(v) AS g, count(*) AS n FROM x GROUP BY budget, arm), m), s AS (SELECT sum(n * (g - mu)^2) AS ss, count(*) - 1 AS df FROM (SELECT avg(v) AS g, count(*) AS n FROM x GROUP BY seed), m),
e AS (SELECT tot - ab.ss - s.ss AS ss, ab.df * s.df AS df FROM m, ab, s),
u AS (SELECT 'budget' AS term, ss, df FROM a UNION ALL SELECT 'arm', ss, df FROM b UNION ALL SELECT 'budget:arm', ab.ss - a.ss - b.ss, a.df * b.df FROM a, b, ab UNION ALL SELECT 'seed', ss, df FROM s UNION ALL SELECT 'error', ss, df FROM e)
SELECT term, round(u.ss, 5) AS ss, u.df::BIGINT AS df, CASE WHEN term != 'error' THEN round((u.ss / u.df) / (e.ss / e.df), 5) END AS f FROM u, e""")
def anova_two_factors(db: Tables) -> DataFrame:
    return st.anova(cube(db), "budget", "arm", "seed", "value").select("term", F.round("ss", 5).alias("ss"), "df", F.round("f", 5).alias("f"))


RANK_SQL = "r AS (SELECT n_chars AS s, sum(quality)::BIGINT AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM r WINDOW w AS (ORDER BY s DESC))"


@query(f"WITH {RANK_SQL} SELECT round(sum(pos * cp / cn::DOUBLE) / sum(pos), 6) AS ap, round(sum((n - pos) * (cp - pos + pos / 2.0::DOUBLE)) / (sum(pos) * sum(n - pos))::DOUBLE, 6) AS auc, sum(pos)::BIGINT AS n_pos, sum(n - pos)::BIGINT AS n_neg FROM c")
def ranking_measures(db: Tables) -> DataFrame:
    rows = db.documents.select("doc_id", "n_chars").join(db.labels.select("doc_id", "quality"), "doc_id")
    return rounded(st.ranking_measures(rows, "n_chars", "quality"), "ap", "auc")


@query("WITH x AS (SELECT * FROM (SELECT 'quantity' AS feature, l_quantity AS x, l_extendedprice / 1e4 - l_tax AS phi FROM lineitem UNION ALL SELECT 'discount', l_discount, l_tax - l_discount FROM lineitem UNION ALL SELECT 'constant', 1.0, l_tax * 2 FROM lineitem)), r AS (SELECT feature, round(avg(abs(phi)), 6) AS importance, round(CASE WHEN min(x) = max(x) THEN 0 ELSE corr(x, phi) END, 6) AS direction FROM x GROUP BY feature) SELECT *, row_number() OVER (ORDER BY importance DESC, feature)::INT AS position FROM r")
def importance_ranking(db: Tables) -> DataFrame:
    t = db.lineitem
    rows = [("quantity", F.col("l_quantity"), F.col("l_extendedprice") / 1e4 - F.col("l_tax")), ("discount", F.col("l_discount"), F.col("l_tax") - F.col("l_discount")), ("constant", F.lit(1.0), F.col("l_tax") * 2)]
    long = t.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), x.alias("x"), phi.alias("phi")) for f, x, phi in rows])).alias("r")).select("r.*")
    return rounded(st.importance_ranking(long), "importance", "direction")


@query("WITH f AS (SELECT p_type AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1), r AS (SELECT substr(feature, 1, 3) AS cluster, sum(importance) AS i FROM f GROUP BY 1) SELECT cluster, round(i, 6) AS importance, row_number() OVER (ORDER BY i DESC, cluster)::INT AS position FROM r")
def cluster_importance(db: Tables) -> DataFrame:
    f = db.part.groupBy(F.col("p_type").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    return rounded(agg.by_cluster(f, f.select("feature", F.substring("feature", 1, 3).alias("cluster"))), "importance").select("cluster", "importance", "position")


@query(f"WITH {CUBE_SQL} SELECT a.budget, a.seed, round(a.value - b.value, 6) AS difference FROM cube a JOIN cube b ON a.budget = b.budget AND a.seed = b.seed WHERE a.arm = '1' AND b.arm = '5'")
def paired_differences(db: Tables) -> DataFrame:
    return rounded(joins.paired_differences(cube(db), ["budget", "seed"], "arm", "value", "1", "5"), "difference")


# A table of results with the arms and measures of the families: budgets, arms and seeds from keys, measures from amounts.
FAMILY_CUBE_SQL = "y AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'S1' ELSE 'S2' END AS budget, CASE o_custkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'M25' ELSE 'M50' END AS arm, ((o_orderkey // 2) % 5)::INT AS seed, avg(o_totalprice) / 1e6 AS recall, avg(o_totalprice * (o_custkey % 7)) / 1e7 AS small, max(o_totalprice) / 1e6 AS map50, avg(o_custkey) / 1e5 AS auc FROM orders GROUP BY ALL)"
COEFFICIENT_SQL = "k(family, contrast, measure, budget, arm, weight) AS (VALUES " + ", ".join(str((f, n, m, b, a, w)) for f, family in designs.FAMILIES.items() for n, (m, weights) in family.items() for (b, a), w in weights.items()) + ")"


def family_cube(db: Tables) -> DataFrame:
    """Long: measure, budget, arm, seed, value."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wide = db.orders.groupBy(F.when(k % 2 == 0, "S1").otherwise("S2").alias("budget"), F.when(c % 3 == 0, "C").when(c % 3 == 1, "M25").otherwise("M50").alias("arm"), (F.floor(k / 2) % 5).cast("int").alias("seed")).agg(
        (F.avg("o_totalprice") / 1e6).alias("recall"), (F.avg(F.col("o_totalprice") * (c % 7)) / 1e7).alias("small"), (F.max("o_totalprice") / 1e6).alias("map50"), (F.avg("o_custkey") / 1e5).alias("auc"),
    )
    return wide.unpivot(["budget", "arm", "seed"], ["recall", "small", "map50", "auc"], "measure", "value")


@query(f"""WITH {FAMILY_CUBE_SQL}, l AS (UNPIVOT y ON recall, small, map50, auc INTO NAME measure VALUE value), {COEFFICIENT_SQL}, v AS (SELECT family, contrast, seed, sum(weight * value * 100) AS d FROM l JOIN k USING (measure, budget, arm) GROUP BY ALL),
s AS (SELECT family, contrast, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM v GROUP BY ALL), i AS (SELECT *, mean - 2.7764451051977987 * sd / sqrt(n) AS lo95, mean + 2.7764451051977987 * sd / sqrt(n) AS hi95, mean - 2.13184678632665 * sd / sqrt(n) AS lo90, mean + 2.13184678632665 * sd / sqrt(n) AS hi90 FROM s)
SELECT family, contrast, n, round(mean, 6) AS mean, round(lo95, 5) AS lo95, round(hi95, 5) AS hi95, CASE WHEN hi95 < 0 THEN 'worse' WHEN lo95 > 0 THEN 'better' WHEN lo90 > -1 AND hi90 < 1 THEN 'equivalent' ELSE 'inconclusive' END AS verdict, family IN ('F1', 'F2') AS corrected FROM i""")
def contrast_families(db: Tables) -> DataFrame:
    """Every contrast of the confirming, secondary and describing families."""
    f = st.families(family_cube(db), designs.family_coefficients(db.spark), ["measure", "budget", "arm"], designs.ADJUSTED)
    return f.select("family", "contrast", "n", F.round("mean", 6).alias("mean"), F.round("lo95", 5).alias("lo95"), F.round("hi95", 5).alias("hi95"), "verdict", F.col("p_holm").isNotNull().alias("corrected"))


CELL_SQL = "z AS (SELECT CASE o_custkey % 5 WHEN 0 THEN 'matched__high' WHEN 1 THEN 'matched__low' WHEN 2 THEN 'shrunk__high' WHEN 3 THEN 'shrunk__low' ELSE 'control' END AS arm, (o_orderkey % 3)::INT AS seed, avg(o_totalprice) / 1e6 AS value FROM orders GROUP BY ALL)"
CELL_COEFFICIENT_SQL = "k(family, contrast, arm, weight) AS (VALUES " + ", ".join(str((f, n, a, w)) for f, family in designs.CELL_FAMILIES.items() for n, weights in family.items() for a, w in weights.items()) + ")"


def cells(db: Tables) -> DataFrame:
    """arm, seed, value of the cells and the control."""
    c, names = F.col("o_custkey") % 5, [*designs.CELLS, "control"]
    return db.orders.groupBy(F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int")).alias("arm"), (F.col("o_orderkey") % 3).cast("int").alias("seed")).agg((F.avg("o_totalprice") / 1e6).alias("value"))


@query(f"""WITH {CELL_SQL}, {CELL_COEFFICIENT_SQL}, v AS (SELECT family, contrast, seed, sum(weight * value * 100) AS d FROM z JOIN k USING (arm) GROUP BY ALL), w AS (SELECT *, sum(d) OVER (PARTITION BY contrast) AS t FROM v),
s AS (SELECT family, contrast, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, count(*) FILTER (sign(d) = sign(t)) AS same FROM w GROUP BY ALL)
SELECT family, contrast, n, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN abs(mean) > 2 AND same = n THEN 'real' WHEN same >= ceil(n * 2 / 3) THEN 'direction' ELSE 'noise' END AS verdict, family = 'F1' AS corrected FROM s""")
def cell_contrasts(db: Tables) -> DataFrame:
    """Scale, contrast, their interaction, and every cell and their mean against the control."""
    f = st.sign_families(cells(db), designs.cell_coefficients(db.spark), ["arm"], ("F1",))
    return f.select("family", "contrast", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "verdict", F.col("p_holm").isNotNull().alias("corrected"))


@query(f"WITH {FAMILY_CUBE_SQL} SELECT round(avg(recall) FILTER (budget = 'S2' AND arm = 'C'), 6) AS mean, round((SELECT avg(c_acctbal) / 1e5 FROM customer), 6) AS other_mean, round((avg(recall) FILTER (budget = 'S2' AND arm = 'C') - (SELECT avg(c_acctbal) / 1e5 FROM customer)) * 100, 6) AS difference FROM y")
def control_plausibility(db: Tables) -> DataFrame:
    """The control's mean beside that of an earlier experiment."""
    rows = family_cube(db).where("measure = 'recall'")
    other = db.customer.select((F.col("c_acctbal") / 1e5).alias("value"))
    return rounded(st.unpaired_difference(rows, (F.col("budget") == "S2") & (F.col("arm") == "C"), other, "value"), "mean", "other_mean", "difference")


@query(f"WITH {FAMILY_CUBE_SQL} SELECT budget, arm, round(avg(recall), 6) AS recall, round(avg(auc), 6) AS auc FROM y GROUP BY ALL")
def means_by_arm(db: Tables) -> DataFrame:
    wide = family_cube(db).groupBy("budget", "arm", "seed").pivot("measure", ["recall", "auc"]).agg(F.first("value"))
    return rounded(st.group_means(wide, ["budget", "arm"], ["recall", "auc"]), "recall", "auc")


@query("""WITH r AS (SELECT o_orderpriority || '/' || o_orderstatus AS run, count(*) AS steps FROM orders GROUP BY 1), p AS (SELECT DISTINCT o_orderpriority || '/' || s AS run FROM orders, (SELECT unnest(['F', 'O', 'none']) AS s)), n AS (SELECT count(*) // 40 AS planned FROM customer)
SELECT coalesce(r.run, p.run) AS run, coalesce(steps, 0) AS steps, CASE WHEN p.run IS NULL THEN 'violation' WHEN coalesce(steps, 0) >= planned THEN 'done' ELSE 'pending' END AS state FROM r FULL JOIN p ON p.run = r.run CROSS JOIN n""")
def run_step_states(db: Tables) -> DataFrame:
    """Orders as the steps of runs, which arrive in two parts to a stream that is started for each."""
    at = new_path(db.spark, "steps")
    name = lambda status: F.concat_ws("/", "o_orderpriority", status)
    planned = db.customer.agg(F.expr("count(*) div 40").alias("planned"))  # one row
    plan = db.orders.select(F.explode(F.array(*[name(F.lit(s)) for s in ("F", "O", "none")])).alias("run")).distinct().crossJoin(F.broadcast(planned)).select("run", "planned", F.lit(0).cast("bigint").alias("steps"))
    taken = db.orders.groupBy(name(F.col("o_orderstatus")).alias("run"), (F.col("o_orderkey") % 2).alias("part")).agg(F.count("*").alias("steps")).select("run", F.lit(None).cast("bigint").alias("planned"), "steps", "part")
    session = runs.stateful_session(db.spark)
    for part, rows in ((0, plan), (1, None)):
        new = taken.where(F.col("part") == part).drop("part")
        (new if rows is None else new.unionByName(rows)).write.mode("append").parquet(f"{at}/rows")
        runs.count_steps(session, f"{at}/rows", f"{at}/reports", f"{at}/state")
    return runs.latest(db.spark.read.schema(runs.OUT).parquet(f"{at}/reports"))
