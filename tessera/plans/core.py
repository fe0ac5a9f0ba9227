"""Queries of boxes, features, joins, profiles, samples and gates on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..functions.vectors import dot, unit
from ..operators import aggregates as agg
from ..operators import catalogs as cat
from ..operators import gates, joins, sampling, windows
from ..operators.bounds import dealt
from .registry import Tables, query

BOX = ["scene", "source", "partkey", "suppkey", "line", "w", "price", "shipped"]


def boxes(db: Tables) -> DataFrame:
    """Line items as boxes: an order is a scene, a return flag a source. They are dealt by scene."""
    return dealt(db.lineitem, db.lineitem.count(), "l_orderkey").select(
        F.col("l_orderkey").alias("scene"), F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("shipped"),
        (F.col("l_partkey") % 100).cast("double").alias("x0"), (F.col("l_suppkey") % 50).cast("double").alias("y0"),
        (F.col("l_partkey") % 100 + F.col("l_quantity")).alias("x1"), (F.col("l_suppkey") % 50 + F.col("l_quantity") / 2).alias("y1"),
    )


def detections(db: Tables) -> DataFrame:
    """The same boxes as three detectors see them, moved a little. They are dealt by scene before they are three."""
    d = dealt(db.lineitem, db.lineitem.count(), "l_orderkey").select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seed"))
    shift = (F.col("l_suppkey") + F.col("seed")) % 5
    x0 = (F.col("l_partkey") % 100 + shift).cast("double")
    return d.select(F.col("l_orderkey").alias("scene"), "seed", x0.alias("x0"), (F.col("l_suppkey") % 50).cast("double").alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (F.col("l_suppkey") % 50 + F.col("l_quantity") / 2).alias("y1"), (F.col("l_discount") * 10).alias("conf"))


BOX_SQL = """b AS (SELECT l_orderkey AS scene, l_returnflag AS source, l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS line, l_quantity AS w, l_extendedprice AS price, l_shipdate AS shipped,
 (l_partkey % 100)::DOUBLE AS x0, (l_suppkey % 50)::DOUBLE AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey % 50 + l_quantity / 2 AS y1 FROM lineitem),
d AS (SELECT l_orderkey AS scene, seed, (l_partkey % 100 + (l_suppkey + seed) % 5)::DOUBLE AS x0, (l_suppkey % 50)::DOUBLE AS y0, l_partkey % 100 + (l_suppkey + seed) % 5 + l_quantity AS x1, l_suppkey % 50 + l_quantity / 2 AS y1, l_discount * 10 AS conf
 FROM lineitem, (SELECT unnest([0, 1, 2]) AS seed))"""
IOU_SQL = "(CASE WHEN (b.x1-b.x0)*(b.y1-b.y0) + (d.x1-d.x0)*(d.y1-d.y0) - {i} > 0 THEN {i} / ((b.x1-b.x0)*(b.y1-b.y0) + (d.x1-d.x0)*(d.y1-d.y0) - {i}) ELSE 0 END)".format(i="(greatest(0, least(b.x1, d.x1) - greatest(b.x0, d.x0)) * greatest(0, least(b.y1, d.y1) - greatest(b.y0, d.y0)))")
HITS_SQL = f"""{BOX_SQL}, s AS (SELECT unnest([0, 1, 2]) AS seed),
m AS (SELECT b.scene, b.source, b.partkey, b.suppkey, b.line, b.w, b.price, b.shipped, s.seed, coalesce(max(d.conf), 0) AS conf_max
 FROM b CROSS JOIN s LEFT JOIN d ON d.scene = b.scene AND d.seed = s.seed AND {IOU_SQL} >= 0.5 GROUP BY ALL),
h AS (SELECT scene, source, partkey, suppkey, line, w, price, shipped, count(*) AS n_seeds, count(*) FILTER (conf_max >= 0.25) AS n_hits, avg(conf_max) AS conf_mean FROM m GROUP BY ALL)"""


def _hits(db: Tables) -> DataFrame:
    return agg.hits(joins.best_overlap(boxes(db), detections(db), BOX), BOX)


@query(f"WITH {HITS_SQL} SELECT source, count(*) AS n_boxes, round(avg(CASE WHEN n_hits >= n_seeds // 2 + 1 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(conf_mean), 6) AS conf_mean FROM h GROUP BY source")
def hit_rate_by_source(db: Tables) -> DataFrame:
    return _hits(db).groupBy("source").agg(F.count("*").alias("n_boxes"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("conf_mean"), 6).alias("conf_mean"))


@query(f"WITH {HITS_SQL} SELECT seed, count(*) AS n, round(avg(CASE WHEN conf_max >= 0.25 THEN 1 ELSE 0 END), 6) AS rate FROM m GROUP BY seed")
def hit_rate_by_seed(db: Tables) -> DataFrame:
    m = joins.best_overlap(boxes(db), detections(db), BOX)
    return m.groupBy("seed").agg(F.count("*").alias("n"), F.round(F.avg((F.col("conf_max") >= 0.25).cast("int")), 6).alias("rate"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS bw, l_linenumber + 1 AS bh, p_size AS cw, p_size + l_tax * 100 AS ch, l_extendedprice,
 (greatest(1, l_quantity) * greatest(1, l_linenumber + 1)) / (greatest(1, p_size) * greatest(1, p_size + l_tax * 100))::DOUBLE AS factor FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT CASE WHEN factor < 0.5 THEN 'shrunk' WHEN factor > 2 THEN 'enlarged' ELSE 'matched' END AS scale, count(*) AS n, round(avg(ln(greatest(factor, 1e-9))), 6) AS log_factor, round(avg(ln((greatest(1, bw) / greatest(1, bh)) / (greatest(1, cw) / greatest(1, ch)))), 6) AS distortion,
 round(avg((bw * bh) / (greatest(1, 640) * greatest(1, 480))), 6) AS area_norm, sum(CASE WHEN factor > 1 THEN 1 ELSE 0 END)::BIGINT AS n_upsample, round(avg(least(greatest(1, cw), greatest(1, ch))), 6) AS crop_min_side FROM f GROUP BY 1""")
def box_geometry(db: Tables) -> DataFrame:
    j = db.lineitem.join(db.part, F.col("p_partkey") == F.col("l_partkey"))
    bw, bh, cw, ch = F.col("l_quantity"), F.col("l_linenumber") + 1, F.col("p_size"), F.col("p_size") + F.col("l_tax") * 100
    rows = j.select(bw.alias("bw"), bh.alias("bh"), cw.alias("cw"), ch.alias("ch"), g.rescale_factor(bw, bh, cw, ch).alias("factor"))
    f = g.box_features(F.lit(0), F.lit(0), F.col("bw"), F.col("bh"), F.lit(640), F.lit(480), F.col("cw"), F.col("ch"), F.col("factor"))
    rows = rows.select(g.scale_class(F.col("factor")).alias("scale"), *[c.alias(k) for k, c in f.items()])
    return rows.groupBy("scale").agg(F.count("*").alias("n"), F.round(F.avg("log_factor"), 6).alias("log_factor"), F.round(F.avg("aspect_distortion"), 6).alias("distortion"), F.round(F.avg("area_norm"), 6).alias("area_norm"), F.sum("upsample").alias("n_upsample"), F.round(F.avg("crop_min_side"), 6).alias("crop_min_side"))


@query("""SELECT p_partkey, x0, y0, (round_even(x0 + w * 640, 0))::INT AS x1, (round_even(y0 + h * 480, 0))::INT AS y1, CASE WHEN w * h * 640 * 480 * power(640.0 / 640, 2) < 1024 THEN 'small' WHEN w * h * 640 * 480 < 9216 THEN 'medium' ELSE 'large' END AS size_class
FROM (SELECT p_partkey, w, h, (round_even(cx * 640 - w * 640 / 2, 0))::INT AS x0, (round_even(cy * 480 - h * 480 / 2, 0))::INT AS y0 FROM (SELECT p_partkey, (p_partkey % 97) / 97.0::DOUBLE AS cx, (p_partkey % 89) / 89.0::DOUBLE AS cy, p_size / 100.0::DOUBLE AS w, (p_size % 13) / 50.0::DOUBLE AS h FROM part))""")
def yolo_boxes(db: Tables) -> DataFrame:
    p = db.part.select("p_partkey", (F.col("p_partkey") % 97 / 97.0).alias("cx"), (F.col("p_partkey") % 89 / 89.0).alias("cy"), (F.col("p_size") / 100.0).alias("w"), (F.col("p_size") % 13 / 50.0).alias("h"))
    box = g.yolo_to_pixels(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), 640, 480)
    size = g.size_class(g.letterbox_area(F.col("w") * F.col("h") * 640 * 480, F.lit(640), F.lit(480)))
    return p.select("p_partkey", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))], size.alias("size_class"))


@query("""SELECT status, count(*) AS n, sum(greatest(0, x1 - x0))::BIGINT AS width FROM (SELECT greatest(0, a) AS x0, greatest(0, b) AS y0, least(60, c) AS x1, least(40, d) AS y1, CASE WHEN least(60, c) - greatest(0, a) <= 0 OR least(40, d) - greatest(0, b) <= 0 THEN 'degenerate' ELSE 'ok' END AS status
FROM (SELECT (l_partkey % 90 - 10) AS a, (l_suppkey % 50 - 5) AS b, l_partkey % 90 - 10 + l_quantity::INT AS c, l_suppkey % 50 - 5 + l_linenumber AS d FROM lineitem)) GROUP BY status""")
def clipped_boxes(db: Tables) -> DataFrame:
    a, b = F.col("l_partkey") % 90 - 10, F.col("l_suppkey") % 50 - 5
    *box, status = g.clipped(a, b, a + F.col("l_quantity").cast("int"), b + F.col("l_linenumber"), F.lit(60), F.lit(40))
    rows = db.lineitem.select(*[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))], status.alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.col("x1") - F.col("x0"))).alias("width"))


@query("""SELECT reason_kind, keep, count(*) AS n FROM (SELECT CASE WHEN p_size < 10 THEN false WHEN m IS NULL THEN false WHEN m < 0.2 THEN false ELSE true END AS keep,
 CASE WHEN p_size < 10 THEN 'min_side' WHEN m IS NULL THEN 'mask missing' WHEN m < 0.2 THEN printf('mask %.3f < 0.200', m) ELSE 'ok' END AS reason_kind FROM (SELECT p_size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 100) / 100.0::DOUBLE END AS m FROM part)) GROUP BY ALL""")
def quality_filter(db: Tables) -> DataFrame:
    m = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 100 / 100.0)
    v = db.part.select(t.quality_reason(F.col("p_size"), m, 10, 0.2, True).alias("v"))
    kind = F.when(F.col("v.reason").startswith("min_side"), "min_side").otherwise(F.col("v.reason"))
    return v.groupBy(kind.alias("reason_kind"), F.col("v.keep").alias("keep")).agg(F.count("*").alias("n"))


NAMES_SQL = "n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'plain' || doc_id || '.png' ELSE 'MVI_' || (doc_id % 40) || CASE WHEN doc_id % 2 = 0 THEN '_VIS' ELSE '' END || '_frame' || (doc_id % 7) || '_jpg.rf.' || substr(md5(doc_id::VARCHAR), 1, 8) || '.JPG' END AS name FROM documents)"


def names(db: Tables) -> DataFrame:
    i = F.col("doc_id")
    export = F.concat(F.lit("MVI_"), (i % 40).cast("string"), F.when(i % 2 == 0, "_VIS").otherwise(""), F.lit("_frame"), (i % 7).cast("string"), F.lit("_jpg.rf."), F.substring(F.md5(i.cast("string")), 1, 8), F.lit(".JPG"))
    return db.documents.select("doc_id", F.when(i % 5 == 0, F.concat(F.lit("plain"), i.cast("string"), F.lit(".png"))).otherwise(export).alias("name"))


@query(f"WITH {NAMES_SQL}, r AS (SELECT *, CASE WHEN regexp_matches(name, '^(.*)_jpg\\.rf\\.[a-f0-9]+\\.(jpg|jpeg|png)$', 'i') THEN regexp_extract(name, '^(.*)_jpg\\.rf\\.', 1) END AS base FROM n), f AS (SELECT *, min(name) OVER (PARTITION BY base) AS first FROM r) SELECT doc_id, CASE WHEN base IS NULL THEN 'unrecognised' WHEN name = first THEN 'kept' ELSE 'discarded' END AS status, regexp_extract(name, '^(MVI_\\d+(?:_VIS|_NIR)?(?:_Haze)?)_frame', 1) AS video FROM f")
def export_dedup(db: Tables) -> DataFrame:
    return agg.keep_first(names(db), t.base_name("name"), "name").select("doc_id", "status", t.video_id("name").alias("video"))


@query("SELECT url, page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def page_names(db: Tables) -> DataFrame:
    return db.pages.select("url", "page_id", t.file_name("url").alias("name"))


@query("SELECT o_orderkey, 'img' || o_custkey AS image, (o_orderkey % 20)::INT AS variation FROM orders")
def variation_names(db: Tables) -> DataFrame:
    n = db.orders.select("o_orderkey", F.concat(F.lit("img"), F.col("o_custkey").cast("string"), F.lit("_v"), (F.col("o_orderkey") % 20).cast("string")).alias("name"))
    image, k = t.split_variation("name")
    return n.select("o_orderkey", image.alias("image"), k.alias("variation"))


POOL_SQL = "pool AS (SELECT l_returnflag AS source, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS contrast, l_extendedprice AS area FROM lineitem)"
RANGE_SQL = f"""WITH {POOL_SQL}, c AS (SELECT source, contrast, area, count(*) AS n FROM pool GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY source, contrast ORDER BY area) AS upto FROM c), g AS (SELECT source, contrast, sum(n) AS total FROM c GROUP BY ALL),
x AS (SELECT o_orderkey, o_totalprice * 2 AS hi, o_totalprice / 2 AS lo, g.* FROM orders, g), y AS (SELECT x.*, coalesce(u.upto, 0) AS within FROM x ASOF LEFT JOIN u ON u.source = x.source AND u.contrast = x.contrast AND x.hi >= u.area),
r AS (SELECT o_orderkey, y.source, y.contrast, (within - coalesce(u.upto, 0))::BIGINT AS n_matched, (total - within)::BIGINT AS n_shrunk, coalesce(u.upto, 0)::BIGINT AS n_enlarged FROM y ASOF LEFT JOIN u ON u.source = y.source AND u.contrast = y.contrast AND y.lo > u.area)"""


def _range(db: Tables) -> DataFrame:
    pool = db.lineitem.select(F.col("l_returnflag").alias("source"), F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("contrast"), F.col("l_extendedprice").alias("area"))
    return joins.range_counts(db.orders.select("o_orderkey", F.col("o_totalprice").alias("area")), pool, ["o_orderkey"], ["source", "contrast"])


@query(f"{RANGE_SQL} SELECT * FROM r")
def range_counts(db: Tables) -> DataFrame:
    return _range(db)


# Feasibility by its meaning: every order meets every source (one of them, X, isn't in the pool at all in the second
# query), contrast and scale; a cell without members counts as 0.
CELLS_SQL = """, k AS (SELECT o_orderkey, s.source, c.contrast, z.scale FROM (SELECT DISTINCT o_orderkey FROM orders), (SELECT unnest({sources}) AS source) s, (SELECT unnest(['high', 'low']) AS contrast) c, (SELECT unnest(['matched', 'shrunk', 'enlarged']) AS scale) z),
cells AS (SELECT k.*, coalesce(CASE k.scale WHEN 'matched' THEN n_matched WHEN 'shrunk' THEN n_shrunk ELSE n_enlarged END, 0)::BIGINT AS n FROM k LEFT JOIN r ON r.o_orderkey = k.o_orderkey AND r.source = k.source AND r.contrast = k.contrast),
f AS (SELECT o_orderkey, min(n) AS bottleneck FROM cells GROUP BY 1)"""
LEVELS = {"source": ["A", "N", "R"], "contrast": ["high", "low"]}
SOURCES_SQL = "['A', 'N', 'R']"


def _cells(db: Tables, **levels: list) -> DataFrame:
    return agg.cell_counts(db.orders, _range(db), ["o_orderkey"], ["source", "contrast"], LEVELS | levels)


@query(f"{RANGE_SQL}{CELLS_SQL.format(sources=SOURCES_SQL)} SELECT o_orderkey, bottleneck, bottleneck >= 1 AS feasible FROM f")
def feasible_boxes(db: Tables) -> DataFrame:
    return agg.feasible(_cells(db), ["o_orderkey"], 1)


@query(f"""{RANGE_SQL}{CELLS_SQL.format(sources="['A', 'N', 'X']")} SELECT o_orderkey, bottleneck, bottleneck >= 1 AS feasible FROM f""")
def feasible_without_source(db: Tables) -> DataFrame:
    """A source of the design that the pool lacks makes every order infeasible."""
    return agg.feasible(_cells(db, source=["A", "N", "X"]), ["o_orderkey"], 1)


@query(f"{RANGE_SQL}{CELLS_SQL.format(sources=SOURCES_SQL)} SELECT scale, contrast, count(*) FILTER (n >= 2) AS n_feasible FROM (SELECT o_orderkey, scale, contrast, min(n) AS n FROM cells GROUP BY ALL) GROUP BY ALL")
def feasible_by_cell(db: Tables) -> DataFrame:
    return agg.feasible_by_cell(_cells(db), ["o_orderkey"], "source", ["scale", "contrast"], 2)


@query(f"{RANGE_SQL}{CELLS_SQL.format(sources=SOURCES_SQL)} SELECT scale, contrast, source, coalesce(min(n) FILTER (o_orderkey IN (SELECT o_orderkey FROM f WHERE bottleneck >= 2)), 0) AS bottleneck FROM cells GROUP BY ALL")
def bottleneck_by_cell(db: Tables) -> DataFrame:
    return agg.bottlenecks(_cells(db), ["o_orderkey"], "source", ["scale", "contrast"], 2)


@query(f"WITH {POOL_SQL}, s AS (SELECT DISTINCT source FROM pool), c AS (SELECT DISTINCT contrast FROM pool), n AS (SELECT source, contrast, count(*) AS n FROM pool GROUP BY ALL) SELECT s.source, c.contrast, coalesce(n.n, 0) AS n FROM s CROSS JOIN c LEFT JOIN n ON n.source = s.source AND n.contrast = c.contrast")
def pool_grid(db: Tables) -> DataFrame:
    return agg.grid_counts(db.lineitem.select(F.col("l_returnflag").alias("source"), F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("contrast")), ["source", "contrast"])


@query("SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal > (SELECT median(s_acctbal) FROM supplier) THEN 'high' ELSE 'low' END AS level FROM supplier")
def median_split(db: Tables) -> DataFrame:
    return agg.median_split(db.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal")


DRAW_SQL = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"


@query("WITH p AS (SELECT s_suppkey, s_acctbal + 1000.01 AS a FROM supplier), q AS (SELECT p_partkey, p_retailprice AS a, row_number() OVER (ORDER BY p_retailprice, " + DRAW_SQL.format("'9:' || p_partkey") + " % 64, p_partkey) - 1 AS position FROM part), n AS (SELECT s_suppkey, count(*) FILTER (q.a < p.a / 2) AS under, count(*) FILTER (q.a BETWEEN p.a / 2 AND p.a * 2) AS n FROM p, q GROUP BY 1) SELECT s_suppkey, p_partkey AS picked FROM n LEFT JOIN q ON n > 0 AND position = under + " + DRAW_SQL.format("'9:member:' || s_suppkey") + " % greatest(n, 1)")
def range_pick(db: Tables) -> DataFrame:
    return joins.range_pick(db.supplier.select("s_suppkey", (F.col("s_acctbal") + 1000.01).alias("area")), db.part.select("p_partkey", F.col("p_retailprice").alias("area")), ["s_suppkey"], "p_partkey", 9)


@query("SELECT k, side FROM (SELECT DISTINCT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer))")
def unpaired(db: Tables) -> DataFrame:
    return joins.unpaired(db.customer.select(F.col("c_custkey").alias("k")), db.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k")


@query("WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 != 1), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN md5(text || '.') ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 != 3) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'new' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def drift(db: Tables) -> DataFrame:
    i, d = F.col("doc_id"), db.documents
    now = d.where(i % 10 != 3).select("doc_id", F.when(i % 10 == 2, F.md5(F.concat("text", F.lit(".")).cast("binary"))).otherwise(F.md5(F.col("text").cast("binary"))).alias("h"))
    return joins.drift(d.where(i % 10 != 1).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")), now, "doc_id", "h")


@query("WITH s AS (SELECT DISTINCT source, md5(text) AS h FROM documents WHERE source != 'src0'), a AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE source = 'src0') SELECT source, count(*) AS n_shared, min(s.h) AS first_shared FROM s JOIN a ON a.h = s.h GROUP BY source")
def content_overlap(db: Tables) -> DataFrame:
    d = db.documents.select("source", F.md5(F.col("text").cast("binary")).alias("h"))
    return joins.overlaps(d.where("source != 'src0'"), d.where("source = 'src0'"), "source", "h")


@query("SELECT h, n FROM (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def content_repeats(db: Tables) -> DataFrame:
    return db.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT 'l_tax' AS \"column\", count(*) AS n, 0::BIGINT AS n_differ FROM orders UNION ALL SELECT 'price', count(*), count(*) FILTER (o_orderkey % 4 = 0) FROM orders")
def run_comparison(db: Tables) -> DataFrame:
    a = db.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(float("nan")).alias("l_tax"))
    b = a.withColumn("price", F.when(F.col("o_orderkey") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return joins.same_rows(a, b, "o_orderkey", ["l_tax", "price"])


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS near_id, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.vec_id != b.vec_id)
SELECT vec_id, near_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, near_id) AS k FROM p) WHERE k = 1""")
def nearest_vectors(db: Tables) -> DataFrame:
    return joins.nearest(db.embeddings, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(e) AS x, unnest(range(len(e))) AS i FROM u WHERE label = 0) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS c FROM m)
SELECT vec_id, round(1 - list_cosine_similarity(e, c), 6) AS distance FROM u, c""")
def centroid_distance(db: Tables) -> DataFrame:
    c = joins.centroid(db.embeddings.where("label = 0"), "embedding")
    return db.embeddings.crossJoin(F.broadcast(c)).select("vec_id", F.round(1 - dot(unit("embedding"), F.col("centroid")), 6).alias("distance"))


@query("SELECT n_name, k::INT AS variation, c.kind FROM nation, (SELECT unnest(range(5)) AS k), (SELECT unnest(['a', 'b']) AS kind) c")
def composition(db: Tables) -> DataFrame:
    return db.nation.select("n_name", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("variation")).select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("kind"))


@query("""WITH x AS (SELECT * FROM (SELECT measure, unnest([]::DOUBLE[]) AS value FROM (SELECT 'a' AS measure)) UNION ALL SELECT 'size', p_size::DOUBLE FROM part UNION ALL SELECT 'price', p_retailprice FROM part)
SELECT measure, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median, """ + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in agg.PERCENTS) + " FROM x GROUP BY measure")
def part_profile(db: Tables) -> DataFrame:
    p = agg.profile(db.part, {"size": F.col("p_size"), "price": F.col("p_retailprice")})
    return p.select("measure", "n", *[F.round(c, 6).alias(c) for c in p.columns[2:]])


@query("WITH a AS (SELECT count(*) AS n FROM part) SELECT category, c AS n, c * 100.0 / n AS pct FROM (SELECT 'small' AS category, count(*) FILTER (p_size * 40 < 1024) AS c FROM part UNION ALL SELECT 'medium', count(*) FILTER (p_size * 40 >= 1024 AND p_size * 40 < 9216) FROM part UNION ALL SELECT 'large', count(*) FILTER (p_size * 40 >= 9216) FROM part), a".replace("c * 100.0 / n", "round(c * 100.0::DOUBLE / n, 6)"))
def size_shares(db: Tables) -> DataFrame:
    s = agg.shares(db.part, g.size_class(F.col("p_size") * 40), ["small", "medium", "large"])
    return s.withColumn("pct", F.round("pct", 6))


@query("SELECT p_brand, threshold::INT AS threshold, count(*) FILTER (p_size >= threshold) AS n_kept, round(count(*) FILTER (p_size >= threshold) * 100.0::DOUBLE / count(*), 1) AS pct FROM part, (SELECT unnest([8, 16, 24, 32, 48]) AS threshold) GROUP BY ALL")
def side_thresholds(db: Tables) -> DataFrame:
    return agg.thresholds(db.part, "p_brand", "p_size", [8, 16, 24, 32, 48])


@query("SELECT round(coalesce(regr_intercept(y, x), avg(y)), 6) AS a, round(coalesce(regr_slope(y, x), 0), 6) AS b FROM (SELECT l_discount AS x, ln(greatest(l_extendedprice, 1e-12)) AS y FROM lineitem)")
def scale_line(db: Tables) -> DataFrame:
    f = agg.line_fit(db.lineitem, F.col("l_discount"), F.ln(F.greatest("l_extendedprice", F.lit(1e-12))))
    return f.select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("WITH x AS (SELECT o_orderkey, o_custkey::DOUBLE AS x, ln(greatest(o_totalprice, 1e-12)) AS y FROM orders), f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM x) SELECT o_orderkey, round(y - (a + b * x), 6) AS residual FROM x, f")
def scale_residuals(db: Tables) -> DataFrame:
    return agg.residuals(db.orders, F.col("o_custkey").cast("double"), F.ln(F.greatest("o_totalprice", F.lit(1e-12))), ["o_orderkey"]).withColumn("residual", F.round("residual", 6))


SERIES_SQL = "e AS (SELECT event_type, (day(ts))::INT AS step, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


@query(f"WITH {SERIES_SQL}, p AS (SELECT *, step - lag(step) OVER w AS dx, (v + lag(v) OVER w) / 2 AS y FROM e WINDOW w AS (PARTITION BY event_type ORDER BY step)) SELECT event_type, (arg_max(step, v - step * 1e-12))::INT AS peak_step, max(v) AS peak, arg_max(v, step) AS last, round(coalesce(sum(dx * y) / nullif(max(step) - min(step), 0), arg_max(v, step)), 6) AS auc, list_sort(list(step)) = range(1, count(*) + 1) AS complete FROM p GROUP BY event_type")
def run_series(db: Tables) -> DataFrame:
    e = db.events.groupBy("event_type", F.dayofmonth("ts").alias("step")).agg(F.round(F.avg("value"), 6).alias("v"))
    return agg.series(e, ["event_type"], "step", "v").withColumn("auc", F.round("auc", 6))


@query("WITH y AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END AS y FROM events), g AS (SELECT user_id, sum(y) AS s, count(*) AS n FROM y GROUP BY 1) SELECT event_id, round(CASE WHEN n > 1 THEN (s - y) / (n - 1) ELSE (SELECT avg(y) FROM y) END, 6) AS loo_mean FROM y JOIN g USING (user_id)")
def leave_one_out(db: Tables) -> DataFrame:
    e = db.events.select("event_id", "user_id", (F.col("event_type") == "purchase").cast("double").alias("y"))
    return windows.leave_one_out(e, "user_id", "y").select("event_id", F.round("loo_mean", 6).alias("loo_mean"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT - 1 AS place FROM events")
def place_in_group(db: Tables) -> DataFrame:
    return windows.place_in_group(db.events, "user_id", ["ts", "event_id"]).select("event_id", "place")


@query("WITH y AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0 END) AS m, count(*) AS n FROM events GROUP BY 1), t AS (SELECT avg(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0 END) AS mu, count(*) AS n FROM events) SELECT round(sum(y.n * (m - mu) * (m - mu)) / any_value(t.n * mu * (1 - mu)), 6) AS \"between\", count(*) AS n_groups, count(*) FILTER (m = 1) AS n_always, count(*) FILTER (m = 0) AS n_never FROM y, t")
def variance_between(db: Tables) -> DataFrame:
    b = agg.between_share(db.events, "user_id", (F.col("event_type") == "view").cast("int"))
    return b.withColumn("between", F.round("between", 6))


@query("SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem)")
def correlations(db: Tables) -> DataFrame:
    return agg.correlations(db.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@query("SELECT floor(ln(o_totalprice) / 0.25)::BIGINT AS bin, count(*) AS n, round(avg(o_custkey), 6) AS mean FROM orders GROUP BY 1")
def binned_effect(db: Tables) -> DataFrame:
    return agg.binned_mean(db.orders, F.ln("o_totalprice"), F.col("o_custkey"), 0.25).withColumn("mean", F.round("mean", 6))


@query("SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::INT AS s_auto FROM customer")
def one_hot_segment(db: Tables) -> DataFrame:
    c = agg.one_hot(db.customer.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "AUTOMOBILE", "auto").otherwise(F.lower("c_mktsegment"))), "c_mktsegment", "s")
    return c.select("c_custkey", F.col("s_auto") if "s_auto" in c.columns else F.lit(0).alias("s_auto"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY " + DRAW_SQL.format("'7:' || o_orderpriority || ':' || o_orderkey") + ", o_orderkey) AS k FROM orders) SELECT o_orderpriority, o_orderkey, k::INT AS ordinal, k <= 10 AS \"inner\" FROM r WHERE k <= 40")
def stratified_sample(db: Tables) -> DataFrame:
    return sampling.stratified(db.orders, "o_orderpriority", "o_orderkey", 40, 7, 10).select("o_orderpriority", "o_orderkey", "ordinal", "inner")


@query("WITH n AS (SELECT count(*) AS n FROM part), d AS (SELECT i, " + DRAW_SQL.format("'5:s:' || i") + " % n AS s, " + DRAW_SQL.format("'5:t:' || i") + " % n AS t FROM range(5000) r(i), n), p AS (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS row, p_retailprice AS a, p_size * 40.0::DOUBLE AS b FROM part), f AS (SELECT y.b / x.a AS f FROM d JOIN p x ON x.row = d.s JOIN p y ON y.row = d.t WHERE x.a > 0 AND y.b > 0) SELECT scale, n, n * 100.0::DOUBLE / 5000 AS pct FROM (SELECT 'matched' AS scale, count(*) FILTER (f BETWEEN 0.5 AND 2) AS n FROM f UNION ALL SELECT 'shrunk', count(*) FILTER (f < 0.5) FROM f UNION ALL SELECT 'enlarged', count(*) FILTER (f > 2) FROM f)")
def pairing_simulation(db: Tables) -> DataFrame:
    low = db.part.agg(F.min("p_partkey").alias("lo"))
    p = db.part.crossJoin(F.broadcast(low)).select((F.col("p_partkey") - F.col("lo")).alias("row"), F.col("p_retailprice").alias("a"), (F.col("p_size") * 40.0).alias("b"))
    return sampling.pairing(p.select("row", F.col("a").alias("area")), p.select("row", F.col("b").alias("area")), 5000, 5)


@query("SELECT event_id, (" + DRAW_SQL.format("'42:' || user_id") + " % 5)::INT AS fold FROM events")
def group_folds(db: Tables) -> DataFrame:
    return sampling.group_folds(db.events, "user_id", 5).select("event_id", "fold")


@query("WITH g AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, row_number() OVER (ORDER BY " + DRAW_SQL.format("'3:' || user_id") + " % 256, user_id) - 1 AS row FROM g), t AS (SELECT count(*) AS total FROM g), r AS (SELECT (id % 30)::INT AS replicate, " + DRAW_SQL.format("'3:' || id") + " % total AS row FROM (SELECT unnest(range(30 * total)) AS id, total FROM t)) SELECT replicate, user_id, count(*) AS times FROM r JOIN n ON n.row = r.row GROUP BY ALL")
def bootstrap_groups(db: Tables) -> DataFrame:
    return sampling.bootstrap_groups(db.events, "user_id", 30, 3)


@query("WITH x AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT c_custkey, 10::BIGINT AS n_expected FROM customer) SELECT coalesce(o_custkey, c_custkey) AS k, coalesce(n, 0) AS n, coalesce(n_expected, 0) AS n_expected FROM x FULL JOIN e ON o_custkey = c_custkey WHERE coalesce(n, 0) != coalesce(n_expected, 0)")
def bag_check(db: Tables) -> DataFrame:
    return agg.bag_violations(db.orders.select(F.col("o_custkey").alias("k")), db.customer.select(F.col("c_custkey").alias("k"), F.lit(10).alias("n_expected")), "k")


@query("SELECT p_brand AS k, count(DISTINCT p_size % 4) AS n_cells FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 4) != (SELECT count(DISTINCT p_size % 4) FROM part)")
def cell_key_sets(db: Tables) -> DataFrame:
    return agg.same_keys(db.part.select(F.col("p_brand").alias("k"), (F.col("p_size") % 4).alias("cell")), "cell", "k")


@query("SELECT 'no customer' AS \"check\", count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'price', count(*) FROM orders WHERE o_totalprice <= 0 UNION ALL SELECT 'repeated text', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)")
def isolation_checks(db: Tables) -> DataFrame:
    return gates.violations({"no customer": db.orders.join(db.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "price": db.orders.where("o_totalprice <= 0"), "repeated text": db.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n")).where("n > 1")})


@query("WITH p AS (SELECT n_name AS b, s AS seed FROM nation, (SELECT unnest([1, 2, 3]) AS s)), o AS (SELECT n_name AS b, s AS seed, n_nationkey % 2 = 0 AS done FROM nation, (SELECT unnest([2, 3, 4]) AS s)) SELECT coalesce(p.b, o.b) AS b, coalesce(p.seed, o.seed) AS seed, CASE WHEN p.b IS NULL THEN 'violation' WHEN coalesce(done, false) THEN 'done' ELSE 'pending' END AS state FROM p FULL JOIN o ON p.b = o.b AND p.seed = o.seed")
def run_states(db: Tables) -> DataFrame:
    n = db.nation
    plan = n.select(F.col("n_name").alias("b"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seed"))
    seen = n.select(F.col("n_name").alias("b"), F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("seed"), (F.col("n_nationkey") % 2 == 0).alias("done"))
    return gates.states(plan, seen, ["b", "seed"])


# One-to-one matches by their meaning: an object takes, of the predictions that overlap it and that no object before it took, the
# first by falling confidence (then by its corners).
GREEDY_SQL = f"""{BOX_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY line, partkey, suppkey, w, price) - 1 AS idx FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY scene, seed ORDER BY conf DESC, x0, y0, x1, y1) AS i FROM d),
e AS (SELECT b.scene, s.seed, b.idx, list(d.i ORDER BY d.i) FILTER (d.i IS NOT NULL) AS fits FROM o AS b CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed) s LEFT JOIN p AS d ON d.scene = b.scene AND d.seed = s.seed AND {IOU_SQL} >= 0.5 GROUP BY b.scene, s.seed, b.idx),
m AS (SELECT scene, seed, idx, fits[1] AS pick, list_filter([fits[1]], lambda x: x IS NOT NULL) AS used FROM e WHERE idx = 0
 UNION ALL SELECT e.scene, e.seed, e.idx, list_filter(e.fits, lambda x: NOT list_contains(m.used, x))[1] AS pick, list_concat(m.used, list_filter([list_filter(e.fits, lambda x: NOT list_contains(m.used, x))[1]], lambda x: x IS NOT NULL)) AS used FROM m JOIN e ON e.scene = m.scene AND e.seed = m.seed AND e.idx = m.idx + 1)"""


def detected(db: Tables, truth: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """scene, seed, idx, ``keep`` and whether each detector finds the object, one to one within a scene."""
    views = truth.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seed"))
    return joins.greedy_match(detections(db), views, ["scene", "seed"], keep=keep)


def numbered_boxes(rows: DataFrame) -> DataFrame:
    return windows.place_in_group(rows, "scene", ["line", "partkey", "suppkey", "w", "price"]).withColumn("idx", F.col("place").cast("bigint")).drop("place")


@query(f"WITH RECURSIVE {GREEDY_SQL} SELECT seed, idx = 0 AS first, count(*) AS n, round(avg((pick IS NOT NULL)::INT), 6) AS recall FROM m GROUP BY ALL")
def greedy_recall(db: Tables) -> DataFrame:
    m = detected(db, numbered_boxes(boxes(db)))
    return m.groupBy("seed", (F.col("idx") == 0).alias("first")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("detected").cast("int")), 6).alias("recall"))


# Recall by size: the letterboxed area of a 640 by 480 image is the box's own, of 1 at least.
@query(f"WITH RECURSIVE {GREEDY_SQL} SELECT seed, greatest(1, (x1 - x0) * (y1 - y0)) < 256 AS small, count(*) AS n, round(avg((pick IS NOT NULL)::INT), 6) AS recall FROM m JOIN o ON o.scene = m.scene AND o.idx = m.idx GROUP BY ALL")
def recall_by_size(db: Tables) -> DataFrame:
    """Greedy one-to-one recall of each detector on small and other boxes."""
    truth = numbered_boxes(cat.truth_boxes(boxes(db).withColumn("width", F.lit(640)).withColumn("height", F.lit(480)), 256.0))
    return detected(db, truth, ["small"]).groupBy("seed", "small").agg(F.count("*").alias("n"), F.round(F.avg(F.col("detected").cast("int")), 6).alias("recall"))


@query("WITH p AS (SELECT s_suppkey, p_partkey, " + DRAW_SQL.format("'13:' || s_suppkey || ':' || k") + " % (SELECT count(*) FROM part) AS row, k FROM supplier, (SELECT unnest(range(4)) AS k), (SELECT 0 AS p_partkey)), n AS (SELECT p_partkey, row_number() OVER (ORDER BY " + DRAW_SQL.format("'13:' || p_partkey") + " % 256, p_partkey) - 1 AS row FROM part) SELECT p.s_suppkey, p.k::INT AS variation, n.p_partkey FROM p JOIN n ON n.row = p.row")
def uniform_draws(db: Tables) -> DataFrame:
    asks = db.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("variation"))
    return sampling.uniform_draws(asks, db.part.select("p_partkey"), ["s_suppkey", "variation"], "p_partkey", 13)


@query("WITH s AS (SELECT p_brand AS source, row_number() OVER (PARTITION BY p_brand ORDER BY " + DRAW_SQL.format("'2:' || p_partkey") + " % 256, p_partkey) - 1 AS row, p_retailprice AS area FROM part), t AS (SELECT row_number() OVER (ORDER BY " + DRAW_SQL.format("'2:' || s_suppkey") + " % 256, s_suppkey) - 1 AS row, greatest(s_acctbal, 0) AS area FROM supplier), g AS (SELECT source, count(*) AS ns, (SELECT count(*) FROM t) AS nt FROM s GROUP BY 1), r AS (SELECT source, " + DRAW_SQL.format("'8:s:' || source || ':' || i") + " % ns AS a, " + DRAW_SQL.format("'8:t:' || source || ':' || i") + " % nt AS b FROM g, range(500) x(i)), f AS (SELECT r.source, t.area / s.area AS f, s.area > 0 AND t.area > 0 AS ok FROM r JOIN s ON s.source = r.source AND s.row = r.a JOIN t ON t.row = r.b), c AS (SELECT source, count(*) FILTER (ok AND f BETWEEN 0.5 AND 2) AS m, count(*) FILTER (ok AND f < 0.5) AS s, count(*) FILTER (ok AND f > 2) AS e FROM f GROUP BY 1) SELECT source, scale, n, n * 100.0::DOUBLE / 500 AS pct FROM (SELECT source, 'matched' AS scale, m AS n FROM c UNION ALL SELECT source, 'shrunk', s FROM c UNION ALL SELECT source, 'enlarged', e FROM c)")
def pairing_by_source(db: Tables) -> DataFrame:
    s = sampling.dense_numbers(db.part.select(F.col("p_brand").alias("source"), "p_partkey", F.col("p_retailprice").alias("area")), "p_partkey", 2, ["source"], "row")
    t = sampling.dense_numbers(db.supplier.select("s_suppkey", F.greatest("s_acctbal", F.lit(0.0)).alias("area")), "s_suppkey", 2, name="row")
    return sampling.pairing_by(s.select("source", "row", "area"), t.select("row", "area"), "source", 500, 8)


@query("WITH s AS (SELECT DISTINCT source, md5(text) AS h FROM documents), a AS (SELECT source AS other, h FROM s) SELECT s.source, a.other, count(*) AS n_shared, list(s.h ORDER BY s.h)[:5] AS shared FROM s JOIN a ON a.h = s.h AND a.other != s.source GROUP BY ALL".replace("list(s.h ORDER BY s.h)[:5] AS shared", "array_to_string(list(s.h ORDER BY s.h)[:5], ',') AS shared"))
def overlap_of_sets(db: Tables) -> DataFrame:
    d = db.documents.select("source", F.md5(F.col("text").cast("binary")).alias("h"))
    return joins.overlaps_of_all(d, "source", "h", 5).withColumn("shared", F.array_join("shared", ","))
