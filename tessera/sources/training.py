"""What a training run needs and leaves: lists and settings of its arms, copies of its files, its environment, its weights."""

from __future__ import annotations

import importlib.metadata
import json
import platform
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.designs import trainlist, trainlist_counts
from ..operators.gates import Refused
from .manifests import listed, write_trainlist


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file of the driver's; a file that is there already is refused."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        raise Refused(f"{path} exists")
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def data_config(train: str, val: str, names: list[str]) -> str:
    """The data settings of a detector's trainer, as YAML."""
    return f"train: {train}\nval: {val}\nnc: {len(names)}\nnames:\n" + "".join(f"  - {n}\n" for n in names)


def prepare_arms(real: DataFrame, synthetic: dict[str, DataFrame], arms: DataFrame, path: str, folder: str, val: str, names: list[str], batch: int = 16) -> DataFrame:
    """Lists, settings and counts of the arms of a design below ``folder``.

    ``arms`` has arm, n_synthetic and repeat_real (of ``designs.arms``: a few rows); ``synthetic`` the images
    of each arm, none for an arm that it doesn't name. An arm whose images are not as many as planned is refused before anything is
    written. Each list is written and counted as it is read back. Returns arm, n_real, n_synthetic,
    n_total, real_share, steps_per_epoch; the same rows are in ``counts.json``."""
    spark, plan = real.sparkSession, arms.select("arm", "n_synthetic", "repeat_real").collect()  # a row an arm
    lists = {}
    for arm, n, repeat in plan:
        made = synthetic.get(arm, real.limit(0))
        if (found := made.count()) != n:
            raise Refused(f"{arm}: {found} synthetic images, planned {n}")
        lists[arm] = trainlist(real, made, path, repeat)
    out = []
    for arm, rows in lists.items():
        at = f"{folder}/lists/{arm}"
        write_trainlist(rows, at, path, ("turn",))
        back = spark.read.text(at)
        real_paths = real.select(F.col(path).cast("string").alias("value"), F.lit(True).alias("real"))
        c = trainlist_counts(back.join(real_paths, "value", "left").select(F.coalesce("real", F.lit(False)).alias("real"))).first()
        want = trainlist_counts(rows).first()
        if c != want:
            raise Refused(f"{arm}: the list holds {c.n_real} + {c.n_synthetic}, written {want.n_real} + {want.n_synthetic}")
        write_text(spark, f"{folder}/configs/{arm}.yaml", data_config(at, val, names))
        out.append((arm, *c, -(-c.n_total // batch)))
    counts = spark.createDataFrame(out, "arm string, n_real bigint, n_synthetic bigint, n_total bigint, real_share double, steps_per_epoch bigint")
    write_text(spark, f"{folder}/configs/counts.json", json.dumps([dict(zip(counts.columns, r)) for r in out], indent=2))
    return counts


def copied(spark: SparkSession, source: str, target: str, glob: str = "*") -> DataFrame:
    """Copies the files below a folder to below another, in tasks that stream them, and returns name (below the folder),
    length and sha256 of what was read. A task that is run again writes under a new name first, so half a file
    never stands under a file's own name. A file of the target is replaced. To be run by one action."""
    files = listed(spark, source, glob)
    root, goal = _fully(spark, source), _fully(spark, target)

    def run(batches):
        import hashlib

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                name = _plain(path)[len(_plain(root)) :].lstrip("/")
                (src, a), (dst, b) = _open(path), _open(f"{goal}/{name}")
                part, h, n = f"{b}.{uuid.uuid4().hex}.part", hashlib.sha256(), 0
                dst.create_dir(b.rsplit("/", 1)[0], recursive=True)
                with src.open_input_stream(a) as i, dst.open_output_stream(part) as o:
                    while block := i.read(1 << 20):
                        h.update(block)
                        o.write(block)
                        n += len(block)
                dst.move(part, b)
                out.append((name, n, h.hexdigest()))
            yield pd.DataFrame(out, columns=["name", "length", "sha256"])

    return files.mapInPandas(run, "name string, length bigint, sha256 string")


def _fully(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _plain(uri: str) -> str:
    """A URI's local path, or the URI where it is not local."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def _open(uri: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), _plain(uri)) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def environment(spark: SparkSession, packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy"), probe: Callable[[], dict[str, str]] | None = None) -> DataFrame:
    """One row with a map of versions, to be kept with a run and compared by ``gates.map_differences``. A package that
    is not installed is left out; ``probe`` adds what else a run depends on, such as a graphics card."""
    jvm = spark.sparkContext._jvm.java.lang.System
    seen = {"python": platform.python_version(), "system": platform.platform(), "java": jvm.getProperty("java.version"), "spark": spark.version}
    for name in packages:
        try:
            seen[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            continue
    return spark.createDataFrame([(seen | (probe() if probe else {}),)], "environment map<string, string>")


def weights_compared(a: DataFrame, b: DataFrame, name: str, values: str) -> DataFrame:
    """One row on two tables of tensors: identical, reason (null where the names agree), n_tensors (of the first),
    n_different (null where the names disagree), examples (the first five names that differ). Nulls equal nulls. A
    table that repeats a name is for its writer to refuse."""
    left = a.select(F.col(name).alias("_n"), F.col(values).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(F.col(name).alias("_n"), F.col(values).alias("_b"), F.lit(True).alias("_in_b"))
    both = left.join(right, "_n", "full_outer").select(
        "_n", F.col("_in_a").isNotNull().alias("_in_a"), (F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("_alone"), F.col("_a").eqNullSafe(F.col("_b")).alias("_same"),
    )
    # Names that differ are first thinned to five a part by a limit in order, which Spark merges without a sort of all.
    first = both.where("not _alone and not _same").orderBy("_n").limit(5).agg(F.sort_array(F.collect_list("_n")).alias("_first"))
    n = both.agg(F.count(F.when(F.col("_in_a"), 1)).alias("n_tensors"), F.count(F.when(F.col("_alone"), 1)).alias("_n_alone"), F.count(F.when(~F.col("_alone") & ~F.col("_same"), 1)).alias("_n_diff"))
    agree = F.col("_n_alone") == 0
    return n.join(first).select(  # a row beside a row
        (agree & (F.col("_n_diff") == 0)).alias("identical"),
        F.when(~agree, "names differ").alias("reason"),
        "n_tensors",
        F.when(agree, F.col("_n_diff")).alias("n_different"),
        F.when(agree, F.col("_first")).alias("examples"),
    )
