"""Token ids as flat files of unsigned integers, read back by memory mapping.

The documents are dealt out by ranges of their ids and sorted, and each task writes one pair
of files: ``NAME.ids`` holds the ids of its documents without gaps, as little-endian unsigned
integers of 2 or 4 bytes (by the size of the vocabulary), ``NAME.idx`` 64-bit offsets (one
more than documents, counted in ids from the start of the file), 64-bit document ids and a
byte for each document that says whether its id is null. A file's base, the number of ids in
all files before it, is the prefix sum of the counts in the manifest.

A task that is run again writes files with new names; only the files that the written
manifest names count. Defined results: null text is empty (the end id alone); null document
ids come first; rows with the same id are ordered by their text (and dealt to one task, which streams them); equal
rows follow one another; very long texts are written in whole; other columns, whatever their names, are not
read; an empty table gives no files.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import crc32_ids, drop_written, map_arrow, new_path, open_fs, written

MANIFEST = "part int, name string, kind string, n_docs bigint, n_tokens bigint"


def write_token_files(docs: DataFrame, path: str, end_id: int | None = 1, to: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the ids of all documents, ascending by id, each followed by ``end_id``. Returns
    the manifest, one entry a file in document order: name (path without ending), kind (of
    the integers), n_docs, n_tokens and base. Other columns of ``docs`` are not read."""
    spark = docs.sparkSession
    to = to or new_path(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def start():
        from pyspark import TaskContext

        enc = encoder(path)
        kind = "<u2" if max(enc.n_tokens, (end_id or 0) + 1) <= 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        fs, folder = open_fs(to)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        counts, ids_of, nulls, opened = [], [], [], []

        def make(batch):
            if not opened:
                fs.create_dir(folder, recursive=True)
                opened.append(fs.open_output_stream(f"{folder}/{name}.ids"))
            ids, n = enc.encode(batch.column("text").to_pylist())
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            opened[0].write(ids.astype(kind).tobytes())
            counts.append(n)
            ids_of.append(batch.column("id").fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(batch.column("id").is_null().to_numpy(zero_copy_only=False))

        def finish():
            if not opened:
                return None
            opened[0].close()
            n = np.concatenate(counts)
            offsets = np.concatenate([[0], np.cumsum(n)])
            with fs.open_output_stream(f"{folder}/{name}.idx") as f:
                f.write(offsets.astype("<i8").tobytes() + np.concatenate(ids_of).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes())
            return [[part], [f"{to}/{name}"], [kind], [len(n)], [int(offsets[-1])]]

        make.finish = finish
        return make

    manifest = written(map_arrow(rows, MANIFEST, start, holds=("bpe", path)), "token-manifest")
    files = [r.asDict() for r in manifest.orderBy("part").collect()]  # one row a file
    drop_written(manifest)
    base = 0
    for f in files:
        f["base"] = base
        base += f["n_tokens"]
    return files


class Flat:
    """A file as an array: memory-mapped where the file system is local, else read as far as is asked for."""

    def __init__(self, at: str, kind: str):
        from pyarrow import fs as pafs

        fs, path = open_fs(at)
        self.kind, self.file, self.array = np.dtype(kind), None, None
        if not isinstance(fs, pafs.LocalFileSystem):
            self.file = fs.open_input_file(path)
        elif fs.get_file_info(path).size:
            self.array = np.memmap(path, dtype=kind, mode="r")

    def take(self, begin: int, end: int) -> np.ndarray:
        """Entries of the array."""
        if self.file is not None:
            size = self.kind.itemsize
            return np.frombuffer(self.file.read_at((end - begin) * size, begin * size), dtype=self.kind)
        return self.array[begin:end] if self.array is not None else np.empty(0, dtype=self.kind)


def read_token_files(spark: SparkSession, files: list[dict], each, schema: str) -> DataFrame:
    """Documents of the files. ``each(ids)`` gives a document's further columns from its ids;
    ``schema`` names them. Columns: doc_id, start (ids of all documents before it) and these."""
    listing = spark.createDataFrame([(i, f["name"], f["kind"], f["n_docs"], f["base"]) for i, f in enumerate(files)], "i int, name string, kind string, n_docs bigint, base bigint").repartitionById(max(1, len(files)), F.col("i"))

    def start():
        import pyarrow as pa

        def make(batch):
            doc_id, null, begin, more = [], [], [], []
            for f in batch.to_pylist():
                ids, index, n = Flat(f["name"] + ".ids", f["kind"]), Flat(f["name"] + ".idx", "u1"), f["n_docs"]
                offsets = index.take(0, 8 * (n + 1)).view("<i8")
                doc_id.append(np.array(index.take(8 * (n + 1), 8 * (2 * n + 1)).view("<i8")))
                null.append(np.array(index.take(8 * (2 * n + 1), 8 * (2 * n + 1) + n), dtype=bool))
                begin.append(f["base"] + np.array(offsets[:-1]))
                more.extend(each(ids.take(a, b)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            return [pa.array(np.concatenate(doc_id), mask=np.concatenate(null)), np.concatenate(begin), *map(list, zip(*more))]

        return make

    return map_arrow(listing, f"doc_id bigint, start bigint, {schema}", start, by=None)


def token_digests(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes the files and reads back per document: doc_id, start, n_tokens, ids_crc32."""
    files = write_token_files(docs, path, end_id)
    return read_token_files(docs.sparkSession, files, lambda ids: (len(ids), crc32_ids(ids)), "n_tokens bigint, ids_crc32 bigint")
