"""Readers and writers of manifests, run metrics, images and pools."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from datetime import UTC, datetime
from fnmatch import fnmatchcase
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.gates import Refused


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV manifest whose empty fields are missing; without a file, no rows."""
    try:
        return spark.read.csv(path, header=True, schema=schema, nullValue="", enforceSchema=False)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per-epoch metrics: names and values without spaces, names without ``/()``."""
    rows = spark.read.csv(path, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    clean = lambda c: c.strip().replace("/", "_").replace("(", "_").replace(")", "")
    return rows.toDF(*map(clean, rows.columns)).where(F.col(clean(rows.columns[0])).isNotNull())


def write_manifest(df: DataFrame, path: str, append: bool = False, form: str = "parquet") -> None:
    writer = df.write.mode("append" if append else "errorifexists").format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)


def write_trainlist(df: DataFrame, path: str, column: str, order: tuple[str, ...] = ()) -> None:
    """One path a line, repeats kept, in order over the files: by the ``order`` columns, then by path."""
    df.select(F.col(column).cast("string").alias("value"), *order).orderBy(*order, "value").select("value").write.mode("errorifexists").text(path)


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path of every file below a folder. Scans leave out empty files, so the names are those of the scan's index,
    written as scans write them (one slash after a scheme without an authority)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    names = (re.sub(r"^(\w+):///", r"\1:/", unquote(n)) for n in files.inputFiles())
    return spark.createDataFrame([(n,) for n in names if fnmatchcase(n.rsplit("/", 1)[-1], glob)], "path string")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 and md5 of every file below a folder, empty ones too."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    nothing = listed(spark, path).join(f.select("path"), "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("length"), F.lit("").cast("binary").alias("content"))
    return f.select("path", "length", "content").unionByName(nothing).select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def hashes_of(files: DataFrame) -> DataFrame:
    """path, length, sha256 and md5 of files whose paths are known: tasks read them, and no folder is listed."""

    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                of, at = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") or "://" not in path else fs.FileSystem.from_uri(path)
                digests, n = (hashlib.sha256(), hashlib.md5()), 0
                with of.open_input_stream(at) as f:
                    while piece := f.read(1 << 20):
                        n += len(piece)
                        for d in digests:
                            d.update(piece)
                rows.append((path, n, *[d.hexdigest() for d in digests]))
            yield pd.DataFrame(rows, columns=["path", "length", "sha256", "md5"])

    return files.select("path").mapInPandas(run, "path string, length bigint, sha256 string, md5 string")


def zip_pool(spark: SparkSession, path: str) -> DataFrame:
    """name and content of the members of zip archives."""

    def unpack(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for n in sorted(z.namelist()):
                        if not n.endswith("/"):
                            yield pd.DataFrame({"name": [n], "content": [z.read(n)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "name string, content binary")


def write_with_metadata(df: DataFrame, path: str, config: dict[str, str], append: bool = False) -> DataFrame:
    """Writes a manifest as Parquet and, beside it, a JSON row on the run: settings, rows, start and end. Appended runs
    add a row each. The rows are counted while they are written."""
    spark, seen = df.sparkSession, Observation()
    started = datetime.now(UTC)
    write_manifest(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), path, append)
    ended = datetime.now(UTC)
    row = spark.createDataFrame([(config, seen.get["n_rows"], started.isoformat(), ended.isoformat(), (ended - started).total_seconds())], "config map<string, string>, n_rows bigint, started string, ended string, seconds double")
    row.write.mode("append" if append else "errorifexists").json(f"{path.rstrip('/')}.runs")
    return spark.read.schema(row.schema).json(f"{path.rstrip('/')}.runs")


def write_vectors(df: DataFrame, path: str, id_col: str, vector_col: str) -> None:
    """Vectors with their ids; the others' columns are features beside them."""
    df.withColumn(vector_col, F.col(vector_col).cast("array<float>")).sortWithinPartitions(id_col).write.mode("errorifexists").parquet(path)


def read_vectors(spark: SparkSession, path: str, index: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """The vectors of an index, with its columns; Refused where the index names a vector that isn't there, or
    where one has another length than ``dim`` (the most frequent one, if it isn't given)."""
    rows = index.join(spark.read.parquet(path).select(id_col, F.col(vector_col).alias(vector_col)), id_col, "left")
    size = F.size(vector_col)
    want = F.lit(dim) if dim is not None else F.col("_dim")
    common = rows.agg(F.mode(F.when(F.col(vector_col).isNotNull(), size)).alias("_dim"))  # one row
    lost, odd = rows.crossJoin(F.broadcast(common)).agg(F.count(F.when(F.col(vector_col).isNull(), 1)), F.count(F.when(F.col(vector_col).isNotNull() & (size != want), 1))).first()
    if lost or odd:
        raise Refused(f"{lost} vectors are missing, {odd} have another length")
    return rows


def materialise(files: DataFrame, key: str, content: str, expected: DataFrame, digest: str, path: str) -> DataFrame:
    """Writes files of an expected manifest and checks what was written: key, n_bytes, sha256. Refused before
    anything is written if a key of the manifest has no file or several; Refused afterwards
    if a digest read back isn't the expected one."""
    rows = expected.select(key, F.col(digest).alias("_want")).join(files.select(key, content), key, "left")
    bad = rows.groupBy(key).agg(F.count(content).alias("n")).where("n != 1").orderBy(key).limit(5).collect()
    if bad:
        raise Refused(f"not one file each: {[r[0] for r in bad]}")
    rows.select(key, F.col(content).cast("binary").alias(content)).write.mode("errorifexists").parquet(path)
    back = files.sparkSession.read.parquet(path).select(key, F.octet_length(content).alias("n_bytes"), F.sha2(F.col(content), 256).alias("sha256"))
    wrong = back.join(expected.select(key, F.col(digest).alias("_want")), key).where("sha256 != _want").orderBy(key).limit(5).collect()
    if wrong:
        raise Refused(f"changed while written: {[r[0] for r in wrong]}")
    return back


def markdown_table(df: DataFrame, formats: dict[str, str], most: int = 1000) -> str:
    """A small report as Markdown; formats are those of Python by column, nulls are dashes. A report of
    more than ``most`` rows is refused."""
    rows = df.select(*formats).limit(most + 1).collect()
    if len(rows) > most:
        raise Refused(f"a report of more than {most} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line(["-" if v is None else format(v, f) for v, f in zip(r, formats.values())]) for r in rows]
    return "\n".join([line(list(formats)), line(["-"] * len(formats)), *body]) + "\n"
