"""Helpers that the training-data operators share: the shared folder, written
intermediate tables, slices of Arrow batches, a static hash map on numpy arrays."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session, or where that is unset a temporary folder, on one machine alone: a cluster
    has to name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at if "://" in at or at.startswith("file:") else f"file://{os.path.abspath(at)}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    at = new_path(df.sparkSession, what)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._tessera_path = at  # type: ignore[attr-defined]
    return out


def drop_written(*frames: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for df in frames:
        at = getattr(df, "_tessera_path", None)
        if at:
            remove_path(df.sparkSession, at)


def remove_path(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(at: str):
    """pyarrow file system and path of a URI; local paths need no scheme."""
    from pyarrow import fs

    if at.startswith("file:"):
        return fs.LocalFileSystem(), "/" + at.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(at)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, col: str = "text", most: int = 2 << 20):
    """Pieces of a batch with about ``most`` bytes of ``col`` each (a longer value stands
    alone), so that a worker's memory doesn't follow the number of rows in a batch."""
    at = batch.schema.get_field_index(col)
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class StaticMap:
    """int64 keys (not negative) to int32 values, open addressing, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys, dtype=np.int64)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            first = left[free]
            self.keys[slot[first]] = keys[first]  # of several for one slot the last stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is unknown."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes of all places of the spans ``starts[i] .. starts[i] + lengths[i]``, in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


#: Bytes of a batch that goes to Python, unless the session names its own: buffers of batches stand
#: outside the JVM's heap, beside the workers.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


_held: dict = {}  # what the worker process keeps from task to task: one object at most


def held(key: tuple, make):
    """The object of this key, made if need be. A worker keeps the last one alone, so a
    worker that serves several operators in turn doesn't add up their tables."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go(but: tuple | None = None) -> None:
    """Drops what the worker keeps, unless its key is ``but``."""
    if _held and but not in _held:
        _held.clear()
        give_back()


def map_arrow(df: DataFrame, schema: str, start, by: str | None = "text", most: int = 2 << 20, holds: tuple | None = None) -> DataFrame:
    """``df`` through Python by Arrow batches. ``start()`` is called once a task and returns
    the function from a piece of a batch (about ``most`` bytes of column ``by``) to output arrays in
    the order of ``schema``; where it has a ``finish``, that gives a last set of arrays. ``holds``:
    the key of ``held`` that the tasks use; anything else that the worker keeps is dropped first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        let_go(holds)
        make = start()
        for batch in batches:
            for piece in slices(batch, by, most) if by else [batch]:
                if piece.num_rows and (made := make(piece)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(a, type=f.type) if not isinstance(a, pa.Array) else a.cast(f.type) for a, f in zip(made, out)], schema=out)
        if (last := getattr(make, "finish", None)) is not None and (made := last()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(a, type=f.type) for a, f in zip(made, out)], schema=out)
        del make
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers live on after their task."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lists(values: np.ndarray, counts: np.ndarray, kind=pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, type=kind))
