"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, on one machine alone, below a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at if ':/' in at else 'file://' + os.path.abspath(at)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table: computed once, its lineage cut, safe from lost executors."""
    at = new_path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def files_below(at: str):
    """Tables of the Parquet files of a folder, one by one, as a task reads them; none of a folder that isn't there."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = (fs.LocalFileSystem(), "/" + at.removeprefix("file:").lstrip("/")) if at.startswith("file:") else fs.FileSystem.from_uri(at)
    for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                yield pq.read_table(f)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes a file for each row (name, content) below the folder, in tasks; the number of files. A task that runs again writes the
    same files again."""

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        files, to = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith("file:") else fs.FileSystem.from_uri(folder)
        files.create_dir(to, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with files.open_output_stream(f"{to}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    from pyspark.sql import functions as F

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0
