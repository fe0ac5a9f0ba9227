"""Queries that write given tables in each format of files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogs as cat
from ..operators.scratch import new_path, write_files, written
from ..sources import annotations, labels, manifests, pools
from .registry import Tables, query

# Forty parts are an image; a seventh of the lines is broken; nations are labels without a line; two thirds of the images are there.
SETS_SQL = """b AS (SELECT 'set' || p_partkey // 40 AS image, p_partkey % 40 AS line, p_brand, p_size, p_partkey, (p_partkey % 64) / 64.0::DOUBLE AS cx, (p_partkey % 32) / 32.0::DOUBLE AS cy, (p_partkey % 16) / 64.0::DOUBLE AS w, (p_partkey % 8) / 32.0::DOUBLE AS h FROM part),
f AS (SELECT DISTINCT 'set' || p_partkey // 40 AS image, (p_partkey // 40) % 3 > 0 AS there FROM part UNION ALL SELECT 'nation' || n_nationkey, n_nationkey % 2 = 0 FROM nation),
y AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY p_partkey) - 1 AS i FROM b WHERE p_partkey % 7 > 0)"""


def files_of(rows: DataFrame, line, head: str = "", tail: str = "") -> DataFrame:
    """name and content of a file for each ``image``, lines in the order of ``at``; a file has as many as an image has boxes."""
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]))
    return rows.groupBy("image").agg(F.concat(F.lit(head), text, F.lit(tail)).alias("content")).withColumnRenamed("image", "name")


def parts(db: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return db.part.select(
        F.concat(F.lit("set"), F.floor(k / 40).cast("string")).alias("image"), k.alias("at"), (F.floor(k / 40) % 3 > 0).alias("there"), "p_brand", "p_size",
        (k % 64 / 64).alias("cx"), (k % 32 / 32).alias("cy"), (k % 16 / 64).alias("w"), (k % 8 / 32).alias("h"),
    )


def yolo_folder(db: Tables) -> str:
    at = new_path(db.spark, "labels")
    box = F.concat_ws(" ", F.regexp_replace("p_brand", "[^0-9]", ""), *[F.format_string("%.6f", c) for c in ("cx", "cy", "w", "h")])
    full = files_of(parts(db), F.when(F.col("at") % 7 > 0, box).otherwise(F.lit("0 0.5")))
    none = db.nation.select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("").alias("content"))
    write_files(full.unionByName(none).withColumn("name", F.concat("name", F.lit(".txt"))), at)
    return at


def image_table(db: Tables) -> DataFrame:
    sets = parts(db).where("there").select("image").distinct()
    nations = db.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("image"))
    return sets.unionByName(nations).select("image", F.lit(640).alias("width"), F.lit(480).alias("height"))


@query(f"""WITH {SETS_SQL}, p AS (SELECT image, i, round_even(cx * 640 - w * 640 / 2, 0) AS x0, round_even(cy * 480 - h * 480 / 2, 0) AS y0, w * 640 AS bw, h * 480 AS bh FROM y JOIN f USING (image) WHERE there),
c AS (SELECT image, i, greatest(0, x0) AS x0, greatest(0, y0) AS y0, least(640, round_even(x0 + bw, 0)) AS x1, least(480, round_even(y0 + bh, 0)) AS y1 FROM p)
SELECT image, i::INT AS box_index, CASE WHEN x1 - x0 <= 0 OR y1 - y0 <= 0 THEN 'degenerate' ELSE 'ok' END AS status, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM c
UNION ALL SELECT image, -1, 'image missing', NULL, NULL, NULL, NULL FROM f WHERE NOT there""")
def yolo_files(db: Tables) -> DataFrame:
    """The extraction manifest of written label files: places of the boxes of all images, a row for each label without an image."""
    images = image_table(db)
    boxes = labels.yolo_pixels(db.spark, yolo_folder(db), images, "left", "valid_index").drop("category")
    return cat.extraction_manifest(boxes, images).select("image", "box_index", "status", "x0", "y0", "x1", "y1")


@query(f"""WITH {SETS_SQL}, s AS (SELECT image, count(*) AS n, sum(line) AS lines, sum(i) AS valid, round(sum(cy), 6) AS pos_v, round(sum(w * h), 6) AS area FROM y GROUP BY 1),
a AS (SELECT image, count(*) AS n_sized, sum(round_even(w * 640, 0))::BIGINT AS widths, sum(round_even(h * 480, 0))::BIGINT AS heights FROM y JOIN f USING (image) WHERE there AND round_even(w * 640, 0) > 0 AND round_even(h * 480, 0) > 0 GROUP BY 1)
SELECT s.*, coalesce(n_sized, 0) AS n_sized, coalesce(widths, 0) AS widths, coalesce(heights, 0) AS heights FROM s LEFT JOIN a USING (image)""")
def yolo_measures(db: Tables) -> DataFrame:
    """Numbers, shares and sizes in pixels of the boxes of written label files, by image."""
    at = yolo_folder(db)
    whole = labels.yolo(db.spark, at).groupBy("image").agg(F.count("*").alias("n"), F.sum("box_index").alias("lines"), F.sum("valid_index").alias("valid"))
    shares = labels.yolo_shares(db.spark, at).groupBy("image").agg(F.round(F.sum("pos_v"), 6).alias("pos_v"), F.round(F.sum("area"), 6).alias("area"))
    sized = labels.absolute_sizes(db.spark, at, image_table(db).select(F.concat("image", F.lit(".jpg")).alias("name"), "width", "height"))
    sized = sized.groupBy("image").agg(F.count("*").alias("n_sized"), F.sum("bw").alias("widths"), F.sum("bh").alias("heights"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sized", "widths", "heights")]
    return whole.join(shares, "image").join(sized, "image", "left").select("image", "n", "lines", "valid", "pos_v", "area", *zero)


@query(f"""WITH {SETS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY p_partkey) - 1 AS j FROM b WHERE p_partkey % 5 > 0)
SELECT image, j::INT AS box_index, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE p_brand END AS category, p_size AS x0, (p_size + 1)::INT AS y0, (p_size + p_partkey % 9)::INT AS x1, (p_size + 5)::INT AS y1,
 CASE WHEN image LIKE '%1' THEN NULL ELSE 640 END::INT AS width, CASE WHEN image LIKE '%1' THEN NULL ELSE 480 END::INT AS height FROM o UNION ALL SELECT 'nation' || n_nationkey, -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation""")
def voc_files(db: Tables) -> DataFrame:
    """Objects of written XML files, numbered among those that have a box; some files state no size, some hold no object."""
    at = new_path(db.spark, "objects")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    name = F.when(F.col("at") % 4 > 0, tag("name", F.col("p_brand"))).when(F.col("at") % 8 > 0, F.lit("<name></name>")).otherwise("")
    x = F.col("p_size")
    box = F.when(F.col("at") % 5 > 0, F.concat(F.lit("<bndbox>"), tag("xmin", x), tag("ymin", x + 1), tag("xmax", (x + F.col("at") % 9).cast("double")), tag("ymax", x + 5), F.lit("</bndbox>"))).otherwise("")
    full = files_of(parts(db), F.concat(F.lit("<object>"), name, box, F.lit("</object>")))
    size = F.when(F.col("name").endswith("1"), "").otherwise("<size><width>640</width><height>480.0</height></size>")
    none = db.nation.select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("").alias("content"))
    whole = full.unionByName(none).select("name", F.concat(F.lit("<annotation><filename>other.jpg</filename>"), size, "content", F.lit("</annotation>")).alias("content"))
    write_files(whole.withColumn("name", F.concat("name", F.lit(".xml"))), at)
    return labels.voc(db.spark, at, empty=True).select("image", "box_index", "category", "x0", "y0", "x1", "y1", "width", "height")


@query("""SELECT 'img' || l_suppkey AS filename, count(*) AS n, sum((l_linenumber % 3 > 0)::INT)::BIGINT AS n_consistent, sum(l_linenumber)::BIGINT AS sides FROM lineitem GROUP BY 1""")
def box_csv_files(db: Tables) -> DataFrame:
    """Boxes written as CSV and read back: whether stated sides fit the corners, and places in the file."""
    at = new_path(db.spark, "csv")
    side = F.col("l_linenumber")
    rows = db.lineitem.select(F.concat(F.lit("img"), F.col("l_suppkey").cast("string")).alias("filename"), side.alias("width"), side.alias("height"), F.lit("ship").alias("class"), F.lit(3).alias("xmin"), (3 + side + (side % 3 == 0).cast("int")).alias("xmax"), F.lit(5).alias("ymin"), (5 + side).alias("ymax"))
    manifests.write_manifest(rows, at, form="csv")
    b = labels.box_csv(db.spark, at)
    whole = b.groupBy("filename").agg(F.count("*").alias("n"), F.count(F.when(F.col("consistent"), 1)).alias("n_consistent"), F.sum("height").alias("sides"), F.max("box_index").alias("last"))
    return whole.where("last = n - 1").drop("last")  # numbered without gaps


@query("SELECT p_brand, count(*) * 2 AS n, count(CASE WHEN p_partkey % 5 > 0 THEN p_type END) * 2 AS n_types, (SELECT count(*) FROM part) AS n_run, 2::BIGINT AS n_runs FROM part GROUP BY 1")
def manifest_files(db: Tables) -> DataFrame:
    """A manifest of two runs, appended with what is known of each, and a CSV manifest whose empty fields are missing."""
    at = new_path(db.spark, "manifest")
    rows = db.part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("p_type"))
    manifests.write_with_metadata(rows, at, {"seed": "1"})
    runs = manifests.write_with_metadata(rows, at, {"seed": "2"}, append=True).agg(F.max("n_rows").alias("n_run"), F.count("*").alias("n_runs"))  # one row
    manifests.write_manifest(db.spark.read.parquet(at), f"{at}.csv", form="csv")
    back = manifests.manifest(db.spark, f"{at}.csv", "p_partkey bigint, p_brand string, p_type string")
    return back.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("p_type").alias("n_types")).crossJoin(F.broadcast(runs))


@query("SELECT event_type AS run, count(*) AS n, round(sum(round(value, 2)), 2) AS recall, max(event_id) AS last FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def run_metric_files(db: Tables) -> DataFrame:
    """Metrics of runs written as CSV with the names and spaces that trainers write."""
    at = new_path(db.spark, "metrics")
    rows = db.events.where("event_type is not null").select(F.concat(F.lit("  "), F.col("event_id").cast("string")).alias("      epoch"), F.concat(F.lit(" "), F.format_string("%.2f", "value")).alias(" metrics/recall(B)"), F.col("event_type").alias("train/run"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("quoteAll", False).csv(at)
    back = manifests.run_metrics(db.spark, at)
    return back.groupBy(F.col("train_run").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum("metrics_recall_B"), 2).alias("recall"), F.max("epoch").cast("bigint").alias("last"))


@query("SELECT 'images/' || o_custkey || '.jpg' AS value, count(*) AS n FROM orders GROUP BY 1")
def trainlist_files(db: Tables) -> DataFrame:
    """A list of training images as text, repeats kept."""
    at = new_path(db.spark, "trainlist")
    manifests.write_trainlist(db.orders.select(F.concat(F.lit("images/"), F.col("o_custkey").cast("string"), F.lit(".jpg")).alias("path")), at, "path")
    return db.spark.read.text(at).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT vec_id, label, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_files(db: Tables) -> DataFrame:
    """Vectors written with their ids and read back by an index."""
    at = new_path(db.spark, "vectors")
    manifests.write_vectors(db.embeddings, at, "vec_id", "embedding")
    back = manifests.read_vectors(db.spark, at, db.embeddings.select("vec_id", "label"), "vec_id", "embedding")
    return back.select("vec_id", "label", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT page_id || '.html' AS name, octet_length(encode(coalesce(html, ''))) AS bytes, md5(coalesce(html, '')) AS digest FROM pages")
def zip_files(db: Tables) -> DataFrame:
    """Pages packed into archives of eight parts and unpacked member by member."""
    at = new_path(db.spark, "zips")
    rows = db.pages.select(F.lit("pages").alias("site"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    pools.write_zips(rows, at, "site", parts=8)
    members = written(pools.unpack(db.spark, at, f"{at}-members").select("path"), "unpacked")
    parts = max(db.spark.sparkContext.defaultParallelism, -(-members.count() // 1000))
    back = manifests.hashes_of(members.repartition(parts, "path"))
    return back.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("bytes"), F.col("md5").alias("digest"))


@query("SELECT 'size' || p_partkey AS image, p_size::INT AS width, (p_size % 7 + 1)::INT AS height FROM part")
def image_size_files(db: Tables) -> DataFrame:
    """Sizes of written PNG files, by their headers."""
    at = new_path(db.spark, "images")

    def draw(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "content": [pools.png(np.zeros((h, w, 3), np.uint8)) for w, h in zip(pdf["w"], pdf["h"])]})

    sizes = db.part.select(F.concat(F.lit("size"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"), F.col("p_size").alias("w"), (F.col("p_size") % 7 + 1).alias("h"))
    write_files(sizes.mapInPandas(draw, "name string, content binary"), at)
    return annotations.sizes(db.spark, at).select("image", "width", "height")
