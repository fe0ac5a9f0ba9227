"""Exact nearest neighbours by cosine, with blocks that cannot hold one left unread.

Vectors are filed under the nearest of some pivots, in pieces that a task can hold, and written once. By the triangle inequality of angles,
no vector of a piece is closer than the angle to its pivot less the pivot's radius. A task takes a few pieces, one after the other, starts with
the nearest neighbours within it and goes through the other pieces by rising bound, as long as any of its vectors can still find a closer one there.
What is shuffled and written is each vector once; what is read depends on how far the vectors cluster."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from .scratch import files_below, new_path, remove, written

MOST_PIVOTS = 1024
#: Angles are widened by this, for the rounding of cosines near 1.
SLACK = 1e-6
#: Cosines in single precision are off by less than half of this, for up to thousands of components.
SINGLE = 1e-4
#: Bytes of pieces that a task keeps.
TASK_BYTES = 192 << 20


def directed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v, the vector divided by its norm (a zero vector stays zero), of vectors whose components are all finite numbers."""
    rows = vectors.where(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), unit(vector_col).alias("v"))


def filed(rows: DataFrame, block_rows: int) -> tuple[str, np.ndarray, pd.DataFrame]:
    """Folder of the pieces (``pivot=P/piece=Q``: id, v), the pivots, and of each pivot that has vectors the number of pieces and the radius."""
    spark = rows.sparkSession
    n = rows.count()
    k = 1 if n <= block_rows else min(MOST_PIVOTS, int(np.ceil(np.sqrt(n))))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(k).select("v").collect()  # at most MOST_PIVOTS
    pivots = np.array([r.v for r in chosen]) if chosen else np.zeros((0, 1))

    def file(batches):
        for pdf in batches:
            if len(pdf):
                cos = np.stack(pdf["v"].to_list()) @ pivots.T
                at = cos.argmax(axis=1)
                yield pdf.assign(pivot=at.astype("int32"), angle=np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1)))

    at = new_path(spark, "filed")
    rows.mapInPandas(file, "id bigint, v array<double>, pivot int, angle double").write.parquet(at)
    placed = spark.read.parquet(at)
    cells = placed.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("pieces"), F.max("angle").alias("radius")).toPandas()  # a row a pivot
    to = new_path(spark, "pieces")
    sized = placed.join(F.broadcast(spark.createDataFrame(cells[["pivot", "pieces"]], "pivot int, pieces int")), "pivot").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    sized.select("pivot", "piece", "id", "v").repartition("pivot", "piece").write.partitionBy("pivot", "piece").parquet(to)
    remove(spark, at)
    return to, pivots, cells.sort_values("pivot").reset_index(drop=True)


def _exact(ids, v, other, w, best, near):
    """The highest cosine to nine places, the smaller id of equals."""
    s = np.round(v @ w.T, 9)
    s[ids[:, None] == other[None, :]] = -np.inf
    at = s.argmax(axis=1)
    top, who = s[np.arange(len(ids)), at], other[at]
    take = (top > best) | ((top == best) & np.isfinite(top) & (who < near))
    return np.where(take, top, best), np.where(take, who, near)


def better(own: tuple, others: tuple, best: np.ndarray, near: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Highest cosines to nine places and the smaller ids of equals, of what is known and of other vectors, which are in the order of
    their ids. Cosines in single precision say which pairs can be the highest of a row or reach what is known; these are worked out in double precision,
    a row that has very many of them with all of the others."""
    (ids, v, v1), (other, w, w1) = own, others
    best, near = best.copy(), near.copy()
    step = max(1, cells // len(other))
    lo, hi = np.searchsorted(other, ids), np.searchsorted(other, ids, side="right")
    for a in range(0, len(ids), step):
        rows = slice(a, min(a + step, len(ids)))
        s = v1[rows] @ w1.T
        same = np.flatnonzero(hi[rows] > lo[rows])
        for i in same[hi[rows][same] - lo[rows][same] > 1]:
            s[i, lo[a + i] : hi[a + i]] = -np.inf
        s[same, lo[rows][same]] = -np.inf
        top = s.max(axis=1)
        least = np.maximum(top, best[rows].astype(np.float32)) - np.float32(SINGLE)
        may = np.flatnonzero((top >= least) & np.isfinite(top))
        if not len(may):
            continue
        hits = s[may] >= least[may, None]
        many = hits.sum(axis=1) > 64
        if many.any():
            at = a + may[many]
            best[at], near[at] = _exact(ids[at], v[at], other, w, best[at], near[at])
        may, hits = may[~many], hits[~many]
        row, col = np.nonzero(hits)
        if not len(row):
            continue
        exact = np.round(np.einsum("ij,ij->i", v[a + may[row]], w[col]), 9)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        high = np.maximum.reduceat(exact, first)
        who = np.minimum.reduceat(np.where(exact == high[row], other[col], np.iinfo(np.int64).max), first)
        at = a + may
        take = (high > best[at]) | ((high == best[at]) & (who < near[at]))
        best[at], near[at] = np.where(take, high, best[at]), np.where(take, who, near[at])
    return best, near


def nearest_blocks(vectors: DataFrame, id_col: str, vector_col: str, block_rows: int = 8192) -> DataFrame:
    """id, near_id, cosine and ``n_read``, the pieces that the vector's own piece had to read beside itself."""
    spark = vectors.sparkSession
    rows = written(directed(vectors, id_col, vector_col), "directed")  # read several times below
    straight = F.exists("v", lambda x: x != 0)
    to, pivots, cells = filed(rows.where(straight), block_rows)
    zero = rows.where(~straight).agg(F.min("id")).first()[0]  # every cosine with a zero vector is 0
    tasks = spark.createDataFrame(cells[["pivot", "pieces"]], "pivot int, pieces int").select("pivot", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))

    def read(pivot: int, piece: int) -> tuple[np.ndarray, ...]:
        parts = [t.to_pandas() for t in files_below(f"{to}/pivot={pivot}/piece={piece}")]
        pdf = pd.concat(parts).sort_values("id") if parts else pd.DataFrame({"id": [], "v": []})  # a piece can be empty by its hash
        v = np.stack(pdf["v"].to_list()) if len(pdf) else np.zeros((0, pivots.shape[1]))
        return pdf["id"].to_numpy(np.int64), v, v.astype(np.float32)

    def run(batches):
        kept, held = OrderedDict(), 0

        def load(*at: int) -> tuple[np.ndarray, ...]:
            """A piece, from those that this task has read last."""
            nonlocal held
            if at in kept:
                kept.move_to_end(at)
                return kept[at]
            kept[at] = read(*at)
            held += sum(a.nbytes for a in kept[at])
            while held > TASK_BYTES and len(kept) > 1:
                held -= sum(a.nbytes for a in kept.popitem(last=False)[1])
            return kept[at]

        for pdf in batches:
            for pivot, piece in zip(pdf["pivot"].tolist(), pdf["piece"].tolist()):
                ids, v, single = load(pivot, piece)
                if not len(ids):
                    continue
                best, near = better((ids, v, single), (ids, v, single), np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max))
                reach = np.arccos(np.clip(v @ pivots[cells["pivot"]].T, -1, 1)) - cells["radius"].to_numpy() - SLACK
                bound, n_read = np.cos(np.maximum(reach, 0.0)), 0
                for j in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                    for q in range(int(cells["pieces"][j])):
                        if (int(cells["pivot"][j]), q) == (pivot, piece):
                            continue
                        open_ = bound[:, j] >= best - SLACK
                        if not open_.any():
                            break
                        other = load(int(cells["pivot"][j]), q)
                        n_read += 1
                        if len(other[0]):
                            best[open_], near[open_] = better((ids[open_], v[open_], single[open_]), other, best[open_], near[open_])
                if zero is not None:
                    take = (best < 0) | ((best == 0) & (zero < near))
                    best, near = np.where(take, 0.0, best), np.where(take, zero, near)
                ok = np.isfinite(best)
                yield pd.DataFrame({"id": ids[ok], "near_id": near[ok], "cosine": best[ok], "n_read": n_read})

    n = int(cells["pieces"].sum()) if len(cells) else 1
    # parts of a given number are not merged; a task takes a few pieces, for which it keeps what it has read
    found = tasks.repartition(max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // 8))), "pivot", "piece").mapInPandas(run, "id bigint, near_id bigint, cosine double, n_read int")
    if zero is not None:
        two = [r.id for r in rows.orderBy("id").select("id").limit(2).collect()]
        other = F.when(F.col("id") == two[0], two[-1]).otherwise(two[0])
        found = found.unionByName(rows.where(~straight).where(F.lit(len(two) > 1)).select("id", other.cast("bigint").alias("near_id"), F.lit(0.0).alias("cosine"), F.lit(0).alias("n_read")))
    return found.withColumnRenamed("id", id_col)


def nearest(vectors: DataFrame, id_col: str, vector_col: str, block_rows: int = 8192) -> DataFrame:
    """For each vector the other one of highest cosine (the smaller id of equals), exactly. Vectors that are null or hold
    a component that is no finite number have no row and are no one's nearest; a zero vector's cosines are all 0."""
    return nearest_blocks(vectors, id_col, vector_col, block_rows).drop("n_read")
