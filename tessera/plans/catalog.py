"""Queries of lookups, manifests, picks and training designs on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import aggregates as agg
from ..operators import catalogs as cat
from ..operators import designs, gates, joins, reports
from ..operators import statistics as st
from ..sources import training
from .core import BOX, BOX_SQL, DRAW_SQL, IOU_SQL, boxes, detections
from .registry import Tables, query
from .results import CELL_COEFFICIENT_SQL, CELL_SQL, SUMMARY_SQL, cells, rounded, values


@query("SELECT p_partkey, round((a + c) / 2 / 640.0::DOUBLE, 8) AS cx, round((b + d) / 2 / 480.0::DOUBLE, 8) AS cy, round((c - a) / 640.0::DOUBLE, 8) AS w, round((d - b) / 480.0::DOUBLE, 8) AS h FROM (SELECT p_partkey, (p_partkey % 97)::DOUBLE AS a, (p_partkey % 89)::DOUBLE AS b, (p_partkey % 97 + p_size)::DOUBLE AS c, (p_partkey % 89 + p_size * 2)::DOUBLE AS d FROM part)")
def normalised_boxes(db: Tables) -> DataFrame:
    x0, y0 = (F.col("p_partkey") % 97).cast("double"), (F.col("p_partkey") % 89).cast("double")
    box = g.normalised(x0, y0, x0 + F.col("p_size"), y0 + F.col("p_size") * 2, F.lit(640.0), F.lit(480.0))
    return db.part.select("p_partkey", *[F.round(c, 8).alias(n) for c, n in zip(box, ("cx", "cy", "w", "h"))])


@query("WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS n_images, sum(n)::BIGINT AS n_objects, round(avg(n), 6) AS mean, max(n) AS most FROM n")
def objects_per_image(db: Tables) -> DataFrame:
    return rounded(agg.objects_per_image(db.lineitem, "l_orderkey"), "mean")


@query("""WITH s AS (SELECT p_brand, CASE WHEN p_partkey % 6 != 0 AND p_brand != 'Brand#1' THEN least(p_size, p_retailprice / 40.0) END AS side FROM part)
SELECT p_brand, count(side) AS n_crops, round(min(side), 6) AS min, round(max(side), 6) AS max, round(quantile_cont(side, 0.05), 6) AS p5, round(quantile_cont(side, 0.1), 6) AS p10, round(quantile_cont(side, 0.25), 6) AS p25, round(median(side), 6) AS median FROM s GROUP BY 1""")
def source_profile(db: Tables) -> DataFrame:
    rows = db.part.select("p_brand", F.col("p_size").alias("w"), (F.col("p_retailprice") / 40.0).alias("h"), ((F.col("p_partkey") % 6 != 0) & (F.col("p_brand") != "Brand#1")).alias("extracted"))
    return rounded(agg.source_profile(rows, "p_brand", F.col("extracted"), "w", "h"), "min", "max", "p5", "p10", "p25", "median")


@query("""WITH b AS (SELECT o_totalprice > 100000 AS feasible, o_totalprice AS area, CASE WHEN o_totalprice > 100000 OR o_orderkey != 3 THEN o_totalprice * pow(640.0::DOUBLE / greatest(1920, 1080, 1), 2) END AS boxed FROM orders)
SELECT feasible, count(*) AS n, round(median(area), 6) AS area, round(CASE WHEN count(boxed) = count(*) THEN median(boxed) END, 6) AS boxed_area, round(CASE WHEN count(boxed) = count(*) THEN sqrt(median(boxed)) END, 6) AS boxed_side, round(CASE WHEN count(boxed) = count(*) THEN avg((boxed < 1024)::INT) END, 6) AS small_share FROM b GROUP BY 1""")
def geometry_comparison(db: Tables) -> DataFrame:
    boxed = g.letterbox_area(F.col("o_totalprice"), F.lit(1920), F.lit(1080))
    rows = db.orders.select((F.col("o_totalprice") > 100000).alias("feasible"), F.col("o_totalprice").alias("area"), F.when((F.col("o_totalprice") > 100000) | (F.col("o_orderkey") != 3), boxed).alias("boxed"))
    return rounded(agg.compare_geometry(rows, "feasible", "area", "boxed"), "area", "boxed_area", "boxed_side", "small_share")


PASTE_SQL = "p AS (SELECT l_shipmode AS cell, l_orderkey, l_partkey, l_returnflag AS source, l_quantity / (l_linenumber * 4) AS factor, l_discount FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'high' ELSE 'low' END AS l_shipmode FROM lineitem))"


def pastes(db: Tables) -> DataFrame:
    """Line items as pastes in two cells, by supplier."""
    return db.lineitem.select(F.when(F.col("l_suppkey") % 2 == 0, "high").otherwise("low").alias("cell"), "l_orderkey", "l_partkey", F.col("l_returnflag").alias("source"), (F.col("l_quantity") / (F.col("l_linenumber") * 4)).alias("factor"), "l_discount")


@query(f"WITH {PASTE_SQL} SELECT cell, count(*) AS n, count(DISTINCT (l_orderkey, l_partkey)) AS n_boxes, count(*) FILTER (NOT factor BETWEEN 0.5 AND 2) AS wrong_scale, count(*) FILTER ((l_discount > 0.05) != (cell = 'high')) AS wrong_contrast, round(min(factor), 6) AS min, round(max(factor), 6) AS max, round(quantile_cont(factor, 0.05), 6) AS p5, round(median(factor), 6) AS median, round(quantile_cont(factor, 0.95), 6) AS p95 FROM p GROUP BY cell")
def paste_audit(db: Tables) -> DataFrame:
    wrong = {"wrong_scale": g.scale_class(F.col("factor")) != "matched", "wrong_contrast": (F.col("l_discount") > 0.05) != (F.col("cell") == "high")}
    return rounded(agg.audit_pastes(pastes(db), "cell", ["l_orderkey", "l_partkey"], wrong, "factor"), "min", "max", "p5", "median", "p95")


@query(f"WITH {PASTE_SQL}, s AS (SELECT unnest(['A', 'N', 'R', 'X']) AS source), c AS (SELECT cell, count(*) AS n FROM p GROUP BY 1) SELECT c.cell, s.source, round((SELECT count(*) FROM p WHERE p.cell = c.cell AND p.source = s.source) / c.n::DOUBLE, 6) AS share FROM c, s")
def paste_sources(db: Tables) -> DataFrame:
    return rounded(agg.group_shares(pastes(db), "cell", "source", ["A", "N", "R", "X"]), "share")


@query("""SELECT coalesce(c_mktsegment, 'all') AS c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def split_totals(db: Tables) -> DataFrame:
    t = agg.totals(db.customer, "c_mktsegment", {"n": F.count("*"), "balance": F.sum("c_acctbal")})
    return t.withColumn("balance", F.round("balance", 2))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT a.label AS la, b.label AS lb, round(1 - round(list_cosine_similarity(a.e, b.e), 9), 9) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS k FROM v a JOIN v b ON a.vec_id != b.vec_id)
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.05), 6) AS p5, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(avg((la = lb)::INT), 6) AS same_share FROM p WHERE k = 1""")
def distance_summary(db: Tables) -> DataFrame:
    near = joins.nearest(db.embeddings, "vec_id", "embedding").withColumn("distance", 1 - F.col("cosine"))
    kind = db.embeddings.select("vec_id", "label")
    rows = near.join(kind, "vec_id").join(kind.select(F.col("vec_id").alias("near_id"), F.col("label").alias("near_label")), "near_id")
    return rounded(agg.distance_summary(rows, "distance", F.col("label") == F.col("near_label")), "mean", "p5", "median", "p95", "same_share")


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'l_quantity' AS "column", round((1 - c * c) / det, 6) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) FROM d""")
def variance_inflation(db: Tables) -> DataFrame:
    return rounded(agg.variance_inflation(db.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), "vif")


@query("SELECT CASE WHEN strpos(text, 'http') > 0 OR strpos(text, '@') > 0 THEN doc_id END AS doc_id FROM documents WHERE strpos(text, 'http') > 0 OR strpos(text, '@') > 0")
def forbidden_markers(db: Tables) -> DataFrame:
    return gates.forbidden(db.documents, "text", ["http", "@"]).select("doc_id")


@query("WITH x AS (SELECT unnest(['user', 'assistant', 'system', 'tool']) AS category), n AS (SELECT role, count(*) AS n FROM conversations GROUP BY 1) SELECT category, coalesce(n, 0) AS n FROM x LEFT JOIN n ON role = category")
def role_counts(db: Tables) -> DataFrame:
    return cat.class_counts(db.conversations.select(F.concat_ws(" ", "role", "conv_id", "turn").alias("line")), "line", ["user", "assistant", "system", "tool"])


@query("SELECT s_suppkey, '0 ' || s_suppkey || ' ' || s_nationkey AS line FROM supplier")
def collapsed_classes(db: Tables) -> DataFrame:
    lines = db.supplier.select("s_suppkey", F.concat_ws(" ", F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")), "s_suppkey", "s_nationkey").alias("line"))
    return cat.collapsed(lines, "line", ["c0", "c1", "c2"])


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def latest_by_key(db: Tables) -> DataFrame:
    return cat.last_wins(db.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("SELECT text_key AS text_key, n FROM (SELECT md5(text) AS text_key, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def ambiguous_keys(db: Tables) -> DataFrame:
    return cat.ambiguous(db.documents.select(F.md5(F.col("text").cast("binary")).alias("text_key")), "text_key")


@query("SELECT count(*) AS n, count(DISTINCT l_partkey) AS n_crops, count(*) - count(p_partkey) AS n_blank, round(avg(ln(p_retailprice)), 6) AS brightness FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5")
def crop_lookup(db: Tables) -> DataFrame:
    pool = db.part.where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = cat.computed_once(db.lineitem.select("l_partkey"), "l_partkey", lambda keys: keys.join(pool, "l_partkey").select("l_partkey", F.ln("p_retailprice").alias("brightness")))
    return rounded(rows.agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("n_crops"), F.count(F.when(F.col("brightness").isNull(), 1)).alias("n_blank"), F.avg("brightness").alias("brightness")), "brightness")


@query("""WITH m AS (SELECT doc_id, md5(text) AS h FROM documents), f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 7 != 0)
SELECT m.doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN f.h IS NOT DISTINCT FROM m.h THEN 'ok' ELSE 'mismatch' END AS state FROM m LEFT JOIN f ON f.doc_id = m.doc_id""")
def manifest_resolution(db: Tables) -> DataFrame:
    h = lambda c: F.md5(c.cast("binary"))
    i, d = F.col("doc_id"), db.documents
    files = d.where(i % 7 != 0).select("doc_id", F.when(i % 11 == 0, h(F.concat("text", F.lit("!")))).otherwise(h(F.col("text"))).alias("h"))  # a store that misses and has changed some
    return cat.resolved(d.select("doc_id", h(F.col("text")).alias("h")), files, "doc_id", "h").select("doc_id", "state")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 90 - 10 AS a, l_suppkey % 50 - 5 AS b, l_partkey % 90 - 10 + l_quantity::INT AS c, l_suppkey % 50 - 5 + l_linenumber AS d FROM lineitem), j AS (SELECT b.*, o_orderkey FROM b LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus != 'P')
SELECT status, count(*) AS n, min(x1) AS least_x1 FROM (SELECT CASE WHEN least(60, c) - greatest(0, a) <= 0 OR least(40, d) - greatest(0, b) <= 0 THEN 'degenerate' ELSE 'ok' END AS status, least(60, c)::BIGINT AS x1 FROM j WHERE o_orderkey IS NOT NULL UNION ALL SELECT 'image missing', NULL FROM (SELECT DISTINCT l_orderkey FROM j WHERE o_orderkey IS NULL)) GROUP BY status""")
def extraction_manifest(db: Tables) -> DataFrame:
    a, b = F.col("l_partkey") % 90 - 10, F.col("l_suppkey") % 50 - 5
    rows = db.lineitem.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box_index"), a.alias("x0"), b.alias("y0"), (a + F.col("l_quantity").cast("int")).alias("x1"), (b + F.col("l_linenumber")).alias("y1"))
    images = db.orders.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("image"), F.lit(60).alias("width"), F.lit(40).alias("height"))
    return cat.extraction_manifest(rows, images).groupBy("status").agg(F.count("*").alias("n"), F.min("x1").cast("bigint").alias("least_x1"))


@query("""WITH c AS (SELECT l_partkey, arg_max(l_discount * 10, l_orderkey * 10 + l_linenumber) AS m FROM (SELECT l_partkey, l_discount, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = (SELECT min(l_suppkey) FROM lineitem x WHERE x.l_partkey = lineitem.l_partkey AND x.l_orderkey = lineitem.l_orderkey AND x.l_linenumber = lineitem.l_linenumber AND x.l_returnflag = 'R')) GROUP BY 1),
v AS (SELECT p_brand, CASE WHEN p_size < 10 THEN false WHEN m IS NULL THEN true WHEN m < 0.2 THEN false ELSE true END AS keep FROM part LEFT JOIN c ON l_partkey = p_partkey)
SELECT p_brand, count(*) AS n_seen, count(*) FILTER (keep) AS n_kept, round(count(*) FILTER (keep) / count(*)::DOUBLE, 6) AS kept_share FROM v GROUP BY 1""")
def quality_yield(db: Tables) -> DataFrame:
    # repeats of a file name come in the order of order, line and, of the same line, supplier (the smallest last)
    rows = db.lineitem.select(F.col("l_partkey").alias("p_partkey"), (F.col("l_discount") * 10).alias("m"), "l_returnflag", F.struct("l_orderkey", "l_linenumber", -F.col("l_suppkey")).alias("at"))
    found = cat.coverage_lookup(rows, "p_partkey", "m", F.col("l_returnflag") == "R", "at")
    m = cat.quality_manifest(db.part.select("p_partkey", "p_brand", "p_size"), found, "p_partkey", F.col("p_size"), 10, 0.2, False)
    return rounded(cat.kept_yield(m, ["p_brand"]), "kept_share")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def outputs_without_parts(db: Tables) -> DataFrame:
    return cat.without_parts(db.customer.select("c_custkey"), db.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(r"SELECT doc_id, sha256(text) AS sha256, text IS NULL AS orphan, len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda s: trim(s) <> ''))::INT AS n_boxes FROM documents")
def label_digests(db: Tables) -> DataFrame:
    return cat.label_digests(db.documents, "doc_id", "text")


@query("""SELECT small, count(*) AS n, round(avg(area), 6) AS area FROM (SELECT area, area < 1024 AS small FROM (SELECT greatest(1, l_quantity * (l_quantity / 2 + l_linenumber))::DOUBLE * pow(640.0::DOUBLE / greatest(640, 480, 1), 2) AS area FROM lineitem)) GROUP BY small""")
def truth_boxes(db: Tables) -> DataFrame:
    rows = db.lineitem.select(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("l_quantity").alias("x1"), (F.col("l_quantity") / 2 + F.col("l_linenumber")).alias("y1"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return rounded(cat.truth_boxes(rows).groupBy("small").agg(F.count("*").alias("n"), F.avg("area").alias("area")), "area")


@query("""WITH l AS (SELECT p_partkey, (p_partkey % 97) / 97.0::DOUBLE AS cx, (p_partkey % 89) / 89.0::DOUBLE AS cy, p_size / 500.0::DOUBLE AS w, (p_size % 13) / 200.0::DOUBLE AS h FROM part), b AS (SELECT p_partkey || '__0' AS crop_id, greatest(0, trunc((cx - w / 2) * 640)::INT) AS x0, greatest(0, trunc((cy - h / 2) * 480)::INT) AS y0, least(640, trunc((cx + w / 2) * 640)::INT) AS x1, least(480, trunc((cy + h / 2) * 480)::INT) AS y1 FROM l) SELECT * FROM b WHERE x1 - x0 >= 2 AND y1 - y0 >= 2""")
def object_crops(db: Tables) -> DataFrame:
    i, s = F.col("p_partkey"), F.col("p_size")
    return cat.object_crops(db.part.select(i.alias("image"), F.lit(0).alias("box_index"), (i % 97 / 97.0).alias("cx"), (i % 89 / 89.0).alias("cy"), (s / 500.0).alias("w"), (s % 13 / 200.0).alias("h"), F.lit(640).alias("width"), F.lit(480).alias("height")))


@query(f"""WITH {BOX_SQL}, c AS (SELECT *, (x0 * 1000 + y0 * 10)::BIGINT AS id FROM d), p AS (SELECT b.*, s.seed, d.id, {IOU_SQL} AS o FROM b CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed) s LEFT JOIN c AS d ON d.scene = b.scene AND d.seed = s.seed),
m AS (SELECT *, max(o) OVER (PARTITION BY scene, seed, partkey, suppkey, line, w, price, shipped, source) AS most FROM p)
SELECT scene, seed, partkey, suppkey, line, w, price, source, min(id) FILTER (o >= 0.5 AND o = most) AS match, round(max(o) FILTER (o >= 0.5), 6) AS overlap FROM m GROUP BY scene, seed, partkey, suppkey, line, w, price, shipped, source""")
def best_match(db: Tables) -> DataFrame:
    """Of every detector the detection that overlaps a box most."""
    d = detections(db).select("*", (F.col("x0") * 1000 + F.col("y0") * 10).cast("bigint").alias("id"))
    b = boxes(db).select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seed"))
    return rounded(joins.best_match(b, d, ["seed", *BOX], "id", ["scene", "seed"]).drop("shipped"), "overlap")


def pick_pool(db: Tables) -> DataFrame:
    key = F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"))
    return db.lineitem.select(F.col("l_returnflag").alias("source"), F.col("l_extendedprice").alias("area"), key.alias("k"))


@query("WITH p AS (SELECT l_returnflag AS source, l_extendedprice AS area, l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber || '/' || l_quantity::INT AS k FROM lineitem), q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY area, " + DRAW_SQL.format("'3:' || k") + " % 64, k) - 1 AS position FROM p), n AS (SELECT o_orderkey, s.source, (SELECT count(*) FROM p WHERE p.source = s.source AND p.area < b.area / 2) AS first, (SELECT count(*) FROM p WHERE p.source = s.source AND p.area BETWEEN b.area / 2 AND b.area * 2) AS n FROM (SELECT o_orderkey, o_totalprice / 5 AS area FROM orders) b, (SELECT DISTINCT source FROM p) s), o AS (SELECT *, min(n) OVER (PARTITION BY o_orderkey) AS fewest, row_number() OVER (PARTITION BY o_orderkey ORDER BY source) - 1 AS i, count(*) OVER (PARTITION BY o_orderkey) AS m FROM n), t AS (SELECT o_orderkey, source, first + " + DRAW_SQL.format("'3:member:' || o_orderkey") + " % n AS position FROM o WHERE i = " + DRAW_SQL.format("'3:source:' || o_orderkey") + " % m AND fewest >= 2) SELECT orders.o_orderkey, t.source, q.k AS picked FROM orders LEFT JOIN t ON t.o_orderkey = orders.o_orderkey LEFT JOIN q ON q.source = t.source AND q.position = t.position")
def balanced_pick(db: Tables) -> DataFrame:
    """A pick for every order; null where a source has fewer than two eligible members."""
    return joins.balanced_pick(db.orders.select("o_orderkey", (F.col("o_totalprice") / 5).alias("area")), pick_pool(db), ["o_orderkey"], "source", "k", "matched", 3, refuse=False)


@query(f"WITH {SUMMARY_SQL}, u AS (SELECT contrast, mean, CASE WHEN abs(mean) > 2 AND n_same_sign = n THEN 'real' WHEN n_same_sign >= ceil(n * 2 / 3) THEN 'direction' ELSE 'noise' END AS verdict FROM s) SELECT contrast, round(mean, 6) AS mean_1, verdict AS verdict_1, round(-mean, 6) AS mean_2, CASE WHEN contrast = 'arms' THEN 'noise' ELSE verdict END AS verdict_2, contrast != 'arms' OR verdict = 'noise' AS replicates FROM u WHERE contrast != 'interaction'")
def replication(db: Tables) -> DataFrame:
    v = st.verdict_by_signs(st.contrast_summary(values(db)))
    first = v.withColumn("contrast", F.concat("contrast", F.lit(": first")))
    second = v.where("contrast != 'interaction'").select(F.concat("contrast", F.lit(": second")).alias("contrast"), (-F.col("mean")).alias("mean"), F.when(F.col("contrast") == "arms", "noise").otherwise(F.col("verdict")).alias("verdict"))
    return rounded(joins.replication(first, second), "mean_1", "mean_2")


@query("SELECT o_orderpriority, count(*) AS n_images, ceil(count(*) / 16.0::DOUBLE)::BIGINT AS steps, round(900 / (count(*) / 16.0::DOUBLE), 6) AS epochs, round(900.0::DOUBLE, 6) AS steps_again FROM orders GROUP BY 1")
def warmup(db: Tables) -> DataFrame:
    n = db.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n_images"))
    n = n.withColumn("steps", designs.steps_per_epoch(F.col("n_images"), 16)).withColumn("epochs", designs.warmup_epochs(900, F.col("n_images"), 16))
    return rounded(n.withColumn("steps_again", designs.warmup_steps(F.col("epochs"), F.col("n_images"), 16)), "epochs", "steps_again")


@query("SELECT o_orderpriority AS arm, (5392 * f)::BIGINT AS n_synthetic, (4 - 4 * f)::BIGINT AS repeat_real FROM (SELECT o_orderpriority, round_even(4 * avg((o_totalprice > 150000)::INT), 0) / 4 AS f FROM orders GROUP BY 1)")
def arm_compositions(db: Tables) -> DataFrame:
    """A priority is an arm; its share of dear orders, to a quarter, is what of its list is synthetic."""
    fraction = F.rint(4 * F.avg((F.col("o_totalprice") > 150000).cast("int"))) / 4
    return designs.arms(db.orders.groupBy(F.col("o_orderpriority").alias("arm")).agg(fraction.alias("fraction")), 5392, 1348)


@query("""WITH b AS (SELECT r_regionkey AS ordinal, r_name AS budget, 15 * count(n_nationkey) AS epochs FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL), s(i, seed) AS (VALUES (0, 42), (1, 123), (2, 2024), (3, 7), (4, 31415)), a(j, arm) AS (VALUES (0, 'C'), (1, 'M25'), (2, 'M50')), n AS (SELECT ceil(count(*) / 16.0::DOUBLE) AS steps FROM customer)
SELECT ((ordinal * 5 + i) * 3 + j)::INT AS place, budget || '_' || arm || '_seed' || seed AS run, (epochs // 15)::INT AS close_mosaic, (epochs * steps)::BIGINT AS steps FROM b, s, a, n""")
def run_plan(db: Tables) -> DataFrame:
    """Regions are budgets with fifteen epochs a nation, customers the images of an epoch."""
    budgets = db.nation.join(db.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("budget")).agg((15 * F.count("*")).cast("int").alias("epochs"))
    return designs.run_plan(budgets, ["C", "M25", "M50"], [42, 123, 2024, 7, 31415], db.customer.count(), 16)


@query("WITH r AS (SELECT 3 * count(*) AS n FROM supplier), s AS (SELECT count(*) AS n FROM customer) SELECT r.n AS n_real, s.n AS n_synthetic, r.n + s.n AS n_total, round(r.n / (r.n + s.n)::DOUBLE, 6) AS real_share FROM r, s")
def trainlist_counts(db: Tables) -> DataFrame:
    rows = designs.trainlist(db.supplier.select(F.col("s_name").alias("path")), db.customer.select(F.col("c_name").alias("path")), "path", 3)
    return rounded(designs.trainlist_counts(rows), "real_share")


@query("WITH m AS (SELECT event_type AS run, day(ts) AS step FROM events GROUP BY ALL), n AS (SELECT run, count(*) AS n, max(step) AS last FROM m GROUP BY 1) SELECT run, n, n = 30 AND last = 30 AND run != 'view' AS complete FROM n")
def complete_runs(db: Tables) -> DataFrame:
    m = db.events.select(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("step")).distinct()
    return designs.complete_runs(m, "run", "step", 30, m.where("run != 'view'").select("run"))


@query("""WITH r AS (SELECT n_nationkey AS run, n_nationkey % 3 + 29 AS epochs, CASE WHEN n_nationkey % 5 != 0 THEN 10110 END AS steps FROM nation) SELECT run, 'epochs' AS name, epochs::BIGINT AS found, 30::BIGINT AS expected FROM r WHERE epochs != 30 UNION ALL SELECT run, 'steps', steps::BIGINT, 10110 FROM r WHERE steps IS DISTINCT FROM 10110""")
def unexpected_values(db: Tables) -> DataFrame:
    doc = F.to_json(F.struct((F.col("n_nationkey") % 3 + 29).alias("epochs"), F.when(F.col("n_nationkey") % 5 != 0, 10110).alias("steps")))
    return gates.unexpected(db.nation.select(F.col("n_nationkey").alias("run"), doc.alias("doc")), "run", "doc", {"epochs": 30, "steps": 10110})


@query("SELECT count(*) FILTER (o_orderkey % 4 = 0)::BIGINT AS n_differ, 0::BIGINT AS n_wrong, CASE WHEN count(*) FILTER (o_orderkey % 4 = 0) = 0 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM orders")
def determinism(db: Tables) -> DataFrame:
    a = db.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    b = a.withColumn("price", F.when(F.col("o_orderkey") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    doc = db.region.select(F.col("r_regionkey").alias("run"), F.lit('{"steps": 5}').alias("doc"))
    return gates.same_runs(joins.same_rows(a, b, "o_orderkey", ["price"]), gates.unexpected(doc, "run", "doc", {"steps": 5}))


@query("WITH v AS (SELECT c_custkey AS image, c_nationkey AS box, c_custkey % 3 != 0 AS listed FROM customer) SELECT image, box, listed AS registered FROM v")
def registered_boxes(db: Tables) -> DataFrame:
    """Boxes of a registered list, and those that stay as they are."""
    rows = db.customer.select(F.col("c_custkey").alias("image"), F.col("c_nationkey").alias("box"))
    inside, outside = cat.registered_only(rows, rows.where("image % 3 != 0"), ["image", "box"])
    return inside.withColumn("registered", F.lit(True)).unionByName(outside.withColumn("registered", F.lit(False)))


@query("""WITH i AS (SELECT o_custkey AS image, 640 AS width, 480 AS height FROM orders WHERE o_custkey % 4 != 0 GROUP BY 1), b AS (SELECT o_custkey AS image, o_orderkey AS box_index, (o_orderkey % 700 - 20)::INT AS x0, (o_orderkey % 500 - 10)::INT AS y0, CASE o_orderkey % 3 WHEN 0 THEN 640 WHEN 1 THEN 800 END AS w, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 480 END AS h FROM orders),
f AS (SELECT b.*, i.width, greatest(0, x0) AS a, greatest(0, y0) AS c, least(640, x0 + 40) AS e, least(480, y0 + 30) AS g FROM b LEFT JOIN i USING (image))
SELECT image, box_index, a AS x0, c AS y0, e AS x1, g AS y1, CASE WHEN e <= a OR g <= c THEN 'degenerate' ELSE 'ok' END AS status, w = 640 AND h = 480 AS size_agrees FROM f WHERE width IS NOT NULL
UNION ALL SELECT DISTINCT image, -1, NULL::INT, NULL::INT, NULL::INT, NULL::INT, 'not in the index', NULL::BOOLEAN FROM f WHERE width IS NULL""")
def stated_sizes(db: Tables) -> DataFrame:
    """Extraction whose annotations state a size: the image's, another one, or none."""
    o, k = db.orders, F.col("o_orderkey")
    x0, y0 = (k % 700 - 20).cast("int"), (k % 500 - 10).cast("int")
    b = o.select(F.col("o_custkey").alias("image"), k.alias("box_index"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 30).alias("y1"), F.when(k % 3 == 0, 640).when(k % 3 == 1, 800).alias("stated_width"), F.when(k % 3 != 2, 480).alias("stated_height"))
    i = o.where("o_custkey % 4 != 0").select(F.col("o_custkey").alias("image"), F.lit(640).alias("width"), F.lit(480).alias("height")).distinct()
    return cat.extraction_manifest(b, i, lost="not in the index", stated=("stated_width", "stated_height"))


@query("SELECT DISTINCT o_custkey AS base FROM orders")
def base_images(db: Tables) -> DataFrame:
    return db.orders.select(F.col("o_custkey").alias("base")).distinct()


@query("WITH d AS (SELECT c_custkey AS name FROM customer WHERE c_acctbal IS DISTINCT FROM greatest(c_acctbal, 0)) SELECT (SELECT count(*) FROM d) = 0 AS identical, (SELECT count(*) FROM customer) AS n_tensors, (SELECT count(*) FROM d) AS n_different, (SELECT string_agg(name::VARCHAR, ',' ORDER BY name) FROM (SELECT name FROM d ORDER BY name LIMIT 5)) AS examples")
def weights_compared(db: Tables) -> DataFrame:
    a, b = (db.customer.select("c_custkey", F.array(v.cast("double")).alias("v")) for v in (F.col("c_acctbal"), F.greatest("c_acctbal", F.lit(0))))
    w = training.weights_compared(a, b, "c_custkey", "v")
    return w.select("identical", "n_tensors", "n_different", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query("WITH w AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey != 3)), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY " + DRAW_SQL.format("'21:' || o_orderpriority || ':' || o_custkey") + ", o_custkey) AS ordinal FROM w), d AS (SELECT * FROM r WHERE ordinal <= 8) SELECT o_orderpriority, o_custkey, ordinal::INT AS ordinal, ordinal <= 3 AS \"inner\", (SELECT sha256(string_agg(o_orderpriority || chr(9) || ordinal || chr(9) || o_custkey || chr(10), '' ORDER BY o_orderpriority, ordinal)) FROM d) AS digest FROM d")
def sampled_set(db: Tables) -> DataFrame:
    """A sampled list with the digest that seals it."""
    outputs = db.orders.select("o_orderpriority", "o_custkey").distinct()
    parts = outputs.join(db.customer.where("c_nationkey != 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    drawn, digest = reports.sampled_set(outputs, parts, "o_orderpriority", "o_custkey", 8, 21, 3)
    return drawn.select("o_orderpriority", "o_custkey", "ordinal", "inner", F.lit(digest).alias("digest"))


@query("""WITH c AS (SELECT p_partkey, arg_max(p_retailprice, p_size) AS price FROM part WHERE p_size > 5 GROUP BY 1), t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, bool_or(l_discount > 0.05) OVER (PARTITION BY l_orderkey, l_linenumber) AS y FROM lineitem),
x AS (SELECT t.*, c.p_partkey IS NOT NULL AS found, ln(c.price) AS f, ln(greatest(l_quantity, 1e-12)) AS s, l_linenumber::DOUBLE AS m FROM t LEFT JOIN c ON c.p_partkey = t.l_partkey), f AS (SELECT coalesce(regr_intercept(m, s), avg(m)) AS a, coalesce(regr_slope(m, s), 0) AS b FROM x)
SELECT found, y, count(*) AS n, count(DISTINCT l_partkey) AS n_crops, round(avg(f), 6) AS feature, round(avg(abs(m - (a + b * s))), 6) AS residual FROM x, f GROUP BY ALL""")
def feature_table(db: Tables) -> DataFrame:
    """Line items as pastes, parts as crops, a discount as target."""
    rows = db.lineitem.select("l_partkey", "l_linenumber", "l_quantity", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("paste"), (F.col("l_discount") > 0.05).alias("y"))
    labelled = rows.select("paste", "y").groupBy("paste").agg(F.max("y").alias("y"))
    compute = lambda crops: crops.select("l_partkey", F.ln("price").alias("f"))
    crops = db.part.where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"), "p_size")
    t = reports.feature_table(rows.drop("y"), crops, "l_partkey", "p_size", labelled, ["paste"], compute, F.ln(F.greatest("l_quantity", F.lit(1e-12))), F.col("l_linenumber").cast("double"))
    return rounded(t.groupBy("found", "y").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("n_crops"), F.avg("f").alias("feature"), F.avg(F.abs("residual")).alias("residual")), "feature", "residual")


@query(f"""WITH {CELL_SQL}, {CELL_COEFFICIENT_SQL}, v AS (SELECT family, contrast, seed, sum(weight * value * 100) AS d FROM z JOIN k USING (arm) GROUP BY ALL) SELECT family, contrast, count(*) AS n, round(avg(d), 6) AS mean FROM v GROUP BY ALL""")
def closed_evaluation(db: Tables) -> DataFrame:
    """Contrasts over a closed list of models: every arm and seed once."""
    rows = cells(db).withColumn("model", F.concat_ws("_seed", "arm", "seed"))
    models = [f"{a}_seed{s}" for a in (*designs.CELLS, "control") for s in range(3)]
    f = reports.closed_evaluation(rows, "model", models, designs.cell_coefficients(db.spark), ["arm"], ("F1",))
    return f.select("family", "contrast", "n", F.round("mean", 6).alias("mean"))
