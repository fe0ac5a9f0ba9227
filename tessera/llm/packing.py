"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Sizes are whole numbers up to the capacity, so the instance is a table of counts by size: at
most 4096 rows whatever the number of documents. The plan is made on it. Reduction: for the
largest size, a set of at most two partners that dominates every other set with it is fixed,
as often as its sizes last (a partner that fills the sequence exactly; the largest partner
where no two fit, or where no two that fit are longer; the largest and the next where no
other two do better). Best-fit by falling size packs the remainder, whole runs of equal sequences at a
time, so the plan is as short as the table. Pieces get their places by (size, rank among
pieces of that size): a rank is the number of such pieces in earlier partitions of the written
pieces plus that in its own, so no task gathers a size.

Defined results: null text is empty (the end id alone, length 1); rows with equal or null ids
are packed each by itself; an empty table gives an empty one; longer documents, however long, are cut into
pieces of full capacity and a rest; pieces of one length are interchangeable, so ties are resolved by the partition and
place they come from. Other columns of the input, whatever their names, are not carried.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import crc32_ids, drop_written, map_arrow, written

#: Up to so many rows of a plan (48 bytes each) are broadcast; more are joined.
BROADCAST_ROWS = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


class Plan:
    """Places for ``counts[size]`` items. ``rows``: size, first and one past the last rank,
    first sequence, items a sequence, offset of the first item in each."""

    def __init__(self, counts: np.ndarray):
        self.capacity, self.left = len(counts) - 1, counts.astype(np.int64).copy()
        self.used = np.zeros(len(counts), dtype=np.int64)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.n_sequences = 0
        self.n_fixed = self._reduce()
        self._best_fit()

    def _put(self, size: int, n: int, sequence: int, each: int, offset: int) -> None:
        rank = int(self.used[size])
        self.rows.append((size, rank, rank + n, sequence, each, offset))
        self.used[size] += n
        self.left[size] -= n

    def _fix(self, items: list[int]) -> None:
        """As many sequences of exactly these items as there are."""
        need = {s: items.count(s) for s in items}
        times = min(int(self.left[s]) // n for s, n in need.items())
        offset = 0
        for s, n in need.items():
            self._put(s, times * n, self.n_sequences, n, offset)
            offset += s * n
        self.n_sequences += times

    def _dominating(self, j: int) -> list[int] | None:
        left = self.left.copy()
        left[j] -= 1
        rest = self.capacity - j
        there = np.flatnonzero(left[: rest + 1])
        if not len(there):
            return [j]
        k = int(there[-1])
        if k == rest:
            return [j, k]
        small = np.repeat(there[:3], np.minimum(left[there[:3]], 3))[:3]
        if len(small) < 2 or small[0] + small[1] > rest:
            return [j, k]
        if len(small) > 2 and small.sum() <= rest:
            return None  # three partners fit: no small set is sure to dominate
        below = np.full(rest + 1, -1, dtype=np.int64)
        below[there] = there
        below = np.maximum.accumulate(below)
        other = below[rest - there]  # the largest that fits beside each size
        pair = (other > there) | ((other == there) & (left[there] > 1))
        if not (pair & (there + other > k)).any():
            return [j, k]
        b = int(below[rest - k])
        if b < 0 or (b == k and left[k] < 2):
            return None
        if (pair & (there > b) & (there + other > k)).any():
            return None
        return [j, k, b]

    def _reduce(self) -> int:
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.left[j] and (items := self._dominating(j)) is not None:
                    self._fix(items)
                    changed = True
        return self.n_sequences

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = {}  # space left -> runs (first sequence, number)
        spaces: list[int] = []

        def add(space: int, first: int, n: int) -> None:
            if n and space:
                if space not in room:
                    room[space] = []
                    insort(spaces, space)
                room[space].append((first, n))

        for s in range(self.capacity, 0, -1):
            while n := int(self.left[s]):
                at = bisect_left(spaces, s)
                if at < len(spaces):
                    space = spaces[at]
                    first, runs = room[space].pop()
                    if not room[space]:
                        del room[space], spaces[at]
                else:
                    space, first, runs = self.capacity, self.n_sequences, -(-n // (self.capacity // s))
                    self.n_sequences += runs
                each = space // s
                full = min(runs, n // each)
                if full:
                    self._put(s, full * each, first, each, self.capacity - space)
                    add(space - each * s, first, full)
                rest = min(n - full * each, each) if full < runs else 0
                if rest:
                    self._put(s, rest, first + full, rest, self.capacity - space)
                    add(space - rest * s, first + full, 1)
                    full += 1
                add(space, first + full, runs - full)


def cut_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Encodes the documents and cuts them: one row a piece, with the partition that made it
    and its number among that partition's pieces of its length. To be written before use."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))

    def start():
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)

        def make(batch):
            ids, counts = enc.encode(batch.column("text").to_pylist())
            ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = piece * capacity
            length = np.minimum(counts[row] - begin, capacity)
            at = (np.cumsum(counts) - counts)[row] + begin
            crc = [crc32_ids(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            sizes, first, n = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(row), dtype=np.int64)
            nth[order] = np.arange(len(row)) - np.repeat(first - seen[sizes], n)
            seen[sizes] += n
            return [batch.column("id").take(np_array(row)), piece, begin, length, crc, np.full(len(row), part), nth]

        return make

    return map_arrow(rows, PIECES, start, holds=("bpe", path))


def np_array(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values)


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to written pieces (columns length, part, nth)."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in per_part.groupBy("length").agg(F.sum("n")).collect():  # a row for each size
        counts[size] = n
    rows = Plan(counts).rows
    n_rows, plan = len(rows), spark.createDataFrame(rows, "size bigint, lo bigint, hi bigint, first bigint, each bigint, at bigint")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The plan has a few rows for each of at most `capacity` sizes, however many pieces there are.
    plan = F.broadcast(plan) if n_rows <= BROADCAST_ROWS else plan
    placed = ranked.join(plan, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("at") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut_pieces(docs, path, capacity, end_id), "pieces")
    out = written(pack_pieces(pieces, capacity), "packed")
    drop_written(pieces)
    return out
