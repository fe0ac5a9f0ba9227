"""Gates: checks that give rows of what is wrong, and locks that refuse a second run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(RuntimeError):
    """A gate is closed."""


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """check, n: how many rows each check finds wrong."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("check"), F.count("*").alias("n")) for name, df in checks.items()])


def verdict(found: DataFrame) -> DataFrame:
    return found.agg(F.sum("n").cast("bigint").alias("n"), F.when(F.sum("n") == 0, "GO").otherwise("NO-GO").alias("verdict"))


def require(found: DataFrame) -> None:
    bad = found.where("n > 0").collect()  # a row a check
    if bad:
        raise Refused(", ".join(f"{r['check']}: {r['n']}" for r in bad))


def guard_split(split: str, allowed: bool = False) -> None:
    if split == "train" and not allowed:
        raise Refused("the training split needs an explicit permission")


def unlocked(spark: SparkSession, lock: str) -> None:
    """Refused where the lock exists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(lock)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise Refused(f"{lock} exists")


def once(spark: SparkSession, lock: str, content: DataFrame) -> None:
    """Writes the lock; a second time is refused."""
    unlocked(spark, lock)
    content.write.mode("errorifexists").json(lock)


def seal(registry: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The registry with the new entries; an entry that it has already is refused."""
    again = new.join(registry.select(key), key, "left_semi").select(key).limit(5).collect()
    if again:
        raise Refused(f"sealed already: {[r[0] for r in again]}")
    return registry.unionByName(new)


def states(plan: DataFrame, seen: DataFrame, key: list[str], done: str = "done") -> DataFrame:
    """Each planned or seen run as done, pending or violation (seen, but not planned)."""
    both = plan.select(*key, F.lit(True).alias("_plan")).join(seen.select(*key, F.col(done).alias("_done")), key, "full_outer")
    return both.select(*key, F.when(F.col("_plan").isNull(), "violation").when(F.coalesce("_done", F.lit(False)), "done").otherwise("pending").alias("state"))


def map_differences(a, b):
    """Entries of two maps that differ, over the union of their keys."""
    pairs = F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("was"), y.alias("is_now")))
    return F.map_filter(pairs, lambda k, v: ~v["was"].eqNullSafe(v["is_now"]))


def forbidden(df: DataFrame, text: str, markers: list[str]) -> DataFrame:
    """Rows whose text has one of the markers left in it."""
    return df.where(reduce(lambda a, b: a | b, [F.col(text).contains(m) for m in markers]))


def unexpected(found: DataFrame, run: str, document: str, expected: dict[str, int]) -> DataFrame:
    """Values of a JSON document a run that aren't the expected ones: run, name, found (null if absent)."""
    values = F.from_json(document, "map<string, bigint>")
    rows = found.select(run, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.try_element_at(values, F.lit(k)).alias("found"), F.lit(v).cast("bigint").alias("expected")) for k, v in expected.items()])).alias("x"))
    return rows.select(run, "x.*").where(~F.col("found").eqNullSafe(F.col("expected")))


def same_runs(compared: DataFrame, steps_wrong: DataFrame) -> DataFrame:
    """Verdict on two runs: GO if no compared column differs and no step count is wrong."""
    differ = compared.agg(F.coalesce(F.sum("n_differ"), F.lit(0)).cast("bigint").alias("n_differ"))
    wrong = steps_wrong.agg(F.count("*").alias("n_wrong"))
    return differ.crossJoin(F.broadcast(wrong)).withColumn("verdict", F.when((F.col("n_differ") == 0) & (F.col("n_wrong") == 0), "GO").otherwise("NO-GO"))


def check_protocol(epochs: int, checkpoint_epoch: int, warmup_steps: int, batch: int, close_mosaic: int) -> None:
    """Refuses settings of a training run that contradict each other."""
    wrong = [name for name, bad in {"a count isn't positive": min(epochs, checkpoint_epoch, batch) < 1 or min(warmup_steps, close_mosaic) < 0, "the checkpoint comes after the last epoch": checkpoint_epoch > epochs, "mosaic closes before the first epoch": close_mosaic > epochs}.items() if bad]
    if wrong:
        raise Refused("; ".join(wrong))
