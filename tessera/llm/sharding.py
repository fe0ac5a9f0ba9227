"""Shards of shuffled documents by a two-pass external shuffle, with built-in functions alone.

First pass: every record is dealt by seeded hashes to a shard and to one of the shard's buckets, as many as
keep a bucket within memory. Second pass: each bucket is shuffled (Fisher-Yates) and written to
its shard's folder, with its place in the bucket. Where a bucket begins in its shard is a prefix sum over what was written.

The shard follows the ``key`` law: doc_id and number of shards decide, by the highest of a hash per
shard; one more shard so takes rows to itself alone and moves no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

BUCKET_BYTES = 8 << 20
#: Buckets that one step of the prefix sums takes together.
SLICE = 4096


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key (null is a key too): the one whose hash with the key is highest."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s).alias("h"), s.alias("s"))))
    return best["s"].cast("int")


def scattered(docs: DataFrame, shards: int, seed: int, bucket_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as one struct column ``doc`` with ``_shard`` and ``_bucket``. The bucket is a hash of id and
    text; rows that are equal in both and together exceed a bucket are dealt on by their place in the input."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    total = docs.agg(F.sum(size)).first()[0] or 0
    each = max(1, -(-total // (shards * bucket_bytes)))
    mark = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), shard_of(F.col(id_col), shards).alias("_shard"), mark.alias("_mark"), F.monotonically_increasing_id().alias("_place"))
    # rows of one mark: only copies in id and text, as a rule none that fill a bucket
    heavy = docs.select(mark.alias("_mark"), size.alias("n")).groupBy("_mark").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where(f"n > {bucket_bytes} and rows > 1").select("_mark", (F.col("n") / bucket_bytes).cast("long").alias("_parts"))
    if total > bucket_bytes and not heavy.isEmpty():
        rows = rows.join(heavy, "_mark", "left")
        salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), F.col("_place")), F.col("_parts") + 1)).otherwise(0)
    else:
        salt = F.lit(0)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (8 * bucket_bytes))
    return rows.select("doc", "_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_mark"), salt), F.lit(each)).alias("_bucket")).repartition(parts, "_shard", "_bucket")


def write_shards(docs: DataFrame, shards: int = 24, seed: int = 20240501, bucket_bytes: int = BUCKET_BYTES, to: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the documents with all their columns below ``to`` (a new folder of the shared one), a folder a
    shard (``shard=K``), and returns the path. A row holds its document (``doc``), ``bucket`` and ``place``
    in it. Bucket and shard of a row don't change from run to run; the order within a bucket may.

    Null ids are one key and null texts have no bytes; both are kept. Rows that repeat each other are kept, each in its own slot. A bucket
    takes a longer document whole. An empty table writes an empty folder."""
    at = to or new_path(docs.sparkSession, "shards")
    buckets = scattered(docs, shards, seed, bucket_bytes, id_col, text_col)
    shuffled = buckets.groupBy("_shard", "_bucket").agg(F.shuffle(F.collect_list("doc"), F.lit(seed)).alias("docs"))
    rows = shuffled.select(F.col("_shard").alias("shard"), F.col("_bucket").alias("bucket"), F.posexplode("docs").alias("place", "doc"))
    rows.write.partitionBy("shard").parquet(at)
    return at


def bucket_starts(rows: DataFrame) -> DataFrame:
    """(shard, bucket, start): rows of the shard in the buckets before. Sums go by slices of buckets first, so no
    task holds all buckets of a shard."""
    from pyspark.sql import Window

    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("slice", F.expr(f"bucket div {SLICE}"))
    before = Window.orderBy("slice").partitionBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.groupBy("shard", "slice").agg(F.sum("n").alias("n")).select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.orderBy("bucket").partitionBy("shard", "slice").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(slices, ["shard", "slice"]).select("shard", "bucket", (F.col("base") + F.col("inside")).alias("start"))


def shard_rows(spark: SparkSession, at: str, schema) -> DataFrame:
    """What ``write_shards`` wrote: shard, bucket, place and doc, whose fields ``schema`` names."""
    from pyspark.sql.types import IntegerType, LongType, StructType

    return spark.read.schema(StructType().add("bucket", LongType()).add("place", IntegerType()).add("doc", schema).add("shard", IntegerType())).parquet(at)


def with_slots(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` (shard, bucket, place) with ``slot``, from 0 and gapless in its shard, for bucket and place."""
    return rows.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long")).drop("bucket", "place", "start")


def read_shards(spark: SparkSession, at: str, schema) -> DataFrame:
    """The documents of ``write_shards`` as column ``doc`` with shard and slot."""
    rows = shard_rows(spark, at, schema)
    return with_slots(rows, bucket_starts(rows))


def shard_digests(docs: DataFrame, shards: int = 24, seed: int = 20240501, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each document went, from the files: its id, size (bytes of its text and 8), crc32 of the text (null: of the empty one),
    the law, shard, slot, and the shard it would have with one more. Texts end where they are read: digests alone meet the starts of buckets."""
    rows = shard_rows(docs.sparkSession, write_shards(docs, shards, seed, bucket_bytes, None, id_col, text_col), docs.schema)
    text, key = F.col(f"doc.`{text_col}`"), F.col(f"doc.`{id_col}`")
    digests = rows.select(
        "shard", "bucket", "place", key.alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    out = with_slots(digests, bucket_starts(rows))
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("_id"), shards + 1).alias("grown_shard"))
