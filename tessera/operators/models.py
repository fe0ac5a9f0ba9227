"""Boosted trees as surrogates: folds by group, attributions, their stability and mediation.

Trees are grown on histograms of binned features, by the gradients and curvatures of the log loss. Rows alike in all that a fit reads are one of
more weight, and lie in blocks with their margins in every model. Models of few rows (``TASK_ROWS``) are grown
by a task each. Larger ones, the models of all folds or resamples, are grown side by side: a pass over the cached blocks sums the histograms of all open nodes of all
models, a shuffle by node adds them up, and a task finds a node's best split; a row a node comes to the driver. So the number of passes
is that of one model, and their work grows with the rows. A hashed part of the rows (or of their groups) is held back, and
boosting stops when the loss there falls by less than ``Settings.tolerance`` of itself from one tree to the next, at ``Settings.iterations`` at the
latest. What follows reads a model's table of nodes, at most 2 ** (depth + 1) a tree: attributions are exact
Shapley values of each tree's paths with cover shares as the background, looked up by the cell that a row's features lie in."""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace
from math import factorial, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import Refused
from .sampling import bootstrap_groups, group_folds
from .scratch import new_path, remove, written
from .statistics import importance_ranking, ranking_measures


@dataclass(frozen=True)
class Settings:
    """Of the boosting; one row (or group) in ``held`` is held back to stop by, ``penalty`` is that of squared leaf values, and ``beside``
    models at most are grown in the same passes."""

    iterations: int = 300
    rate: float = 0.05
    depth: int = 4
    least_rows: int = 50
    bins: int = 255
    held: int = 10
    tolerance: float = 1e-4
    seed: int = 42
    beside: int = 64
    penalty: float = 1.0


@dataclass(frozen=True)
class Boosted:
    """A fitted model. ``nodes``: (tree, node, feature, threshold, left, right, value, cover), feature null in leaves, whose
    value is what they add to the log odds, the first tree being the log odds of all rows; ``leaves``: value, and per feature on the path
    (feature, above, at most, cover share)."""

    nodes: list[tuple]
    leaves: list[tuple]


#: A model of at most so many rows is grown by one task, all models beside one another; larger ones are grown by passes over all rows.
TASK_ROWS = 200_000
#: Trees after which margins are worked out from the first tree on again, so that their lineage stays short.
PENDING = 16
#: Rows of a block.
BLOCK = 1 << 16
#: Cells of a table of attributions.
CELLS = 1024


@dataclass
class Block:
    """Rows of a task: bins by feature, labels, how many rows each stands for. The first ``fitted`` are not held back. Runs of rows that are held back or not and of the same weights
    stop at ``ends``; ``weights`` has a line a run (by model; 0: not of the model). ``margins``: by model, those of its rows."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray
    fitted: int
    ends: np.ndarray
    weights: np.ndarray
    margins: list = field(default_factory=list)

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray, w: np.ndarray) -> Block:
        lines, kind = np.unique(w, axis=0, return_inverse=True)
        kind = 2 * kind.reshape(-1) + 1
        order = np.lexsort((kind, held))
        kind = np.where(held, -kind, kind)[order]
        ends = np.append(np.flatnonzero(np.diff(kind)) + 1, len(kind))
        return cls(np.ascontiguousarray(x[:, order]), y[order], n[order], int(len(held) - held.sum()), ends, lines[np.abs(kind[ends - 1]) // 2])

    def each(self) -> np.ndarray:
        """Weights of all rows, by model."""
        return np.repeat(self.weights, np.diff(self.ends, prepend=0), axis=0) * self.n[:, None]

    def of_model(self, model: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Bins, labels and weights of a model's rows, and how many of them are not held back."""
        w = self.weights[:, model]
        turns, starts = np.flatnonzero(np.diff(w != 0, prepend=False, append=False)), np.append(0, self.ends)
        own = [slice(int(starts[a]), int(starts[b])) for a, b in zip(turns[::2], turns[1::2])]
        every = np.repeat(w, np.diff(starts))
        if len(own) == 1:
            pick = lambda a: a[..., own[0]]
        elif 0 < len(own) < 256:
            pick = lambda a: np.concatenate([a[..., r] for r in own], axis=-1)
        else:
            row = np.flatnonzero(every)
            pick = lambda a: np.take(a, row, axis=-1)
        return pick(self.x), pick(self.y), pick(every) * pick(self.n), sum(min(r.stop, self.fitted) - min(r.start, self.fitted) for r in own)

    def moved(self, trees: list[Grown], growing: np.ndarray, depth: int) -> Block:
        """With the trees added to the margins of the models that grow; others need none any more."""
        margins = []
        for m, old in enumerate(self.margins):
            if growing[m]:
                x = self.of_model(m)[0]
                for tree in trees:
                    old = old + tree.value[m][tree.at(x, m, depth)]
            margins.append(old if growing[m] else old[:0])
        return replace(self, margins=margins)


@dataclass
class Grown:
    """One tree of each model, as arrays (model, node) of a complete tree: feature (-1: none asked), bin that is the last to the left,
    value, and per node sums of gradients, curvatures and weights."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    sums: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Grown:
        n = 2 ** (depth + 1) - 1
        return cls(np.full((models, n), -1), np.zeros((models, n), dtype=np.int64), np.zeros((models, n)), np.zeros((models, n, 3)))

    def at(self, x: np.ndarray, model: int, depth: int) -> np.ndarray:
        """Node of a model that each row (a column of ``x``) has come to."""
        node = np.zeros(x.shape[1], dtype=np.uint8 if self.feature.shape[1] < 256 else np.int32)
        kind = node.dtype.type
        for i in range(2**depth - 1):
            f = self.feature[model, i]
            if f >= 0:
                node += (node == i) * ((x[f] > int(self.bin[model, i])) + kind(i + 1))
        return node

    def bare(self) -> Grown:
        """What rows have to know of it."""
        return replace(self, sums=np.zeros(0))


@dataclass
class Growing:
    """What the driver knows of a model while it grows."""

    base: float
    cover: float
    stops: bool
    trees: list = field(default_factory=list)
    best: float = float("inf")
    kept: int = 0
    done: bool = False

    def take(self, tree: int, node: int, feature: int, bin_: int, value: float, cover: float) -> None:
        """A node of a tree that a task has grown; nodes come in order."""
        if tree == len(self.trees):
            self.trees.append(({}, {}, {}, {}))
            self.kept = tree + 1
        for part, v in zip(self.trees[tree], (feature, bin_, value, cover)):
            part[node] = v

    def judge(self, loss: float, tolerance: float) -> None:
        """The held back loss after the last tree: boosting goes on while it falls enough."""
        n = len(self.trees)
        if n == 1:
            self.best, self.kept = loss, 1
        elif self.best - loss < tolerance * max(loss, 0.01):
            self.done = True
        else:
            self.best, self.kept = loss, n


def _count(block: Block, total: np.ndarray, loss: np.ndarray, tree: Grown, slots: np.ndarray, stops: np.ndarray, active: np.ndarray, level: int, settings: Settings) -> None:
    """Adds rows to the histograms (slot, sum of gradients, curvatures, weights; feature; bin) of the open nodes, and to the held back losses. A model's slots follow one another."""
    n_bins = settings.bins
    for m in np.flatnonzero(active):
        x, y, w, fitted = block.of_model(m)
        f, fitted = block.margins[m], fitted if stops[m] else len(y)
        if level == 0 and fitted < len(y):
            loss[:, m] += w[fitted:] @ (np.logaddexp(0, f[fitted:]) - y[fitted:] * f[fitted:]), w[fitted:].sum()
        own = slots[m][slots[m] >= 0]
        if not len(own) or not fitted:
            continue
        x, y, w, f = x[:, :fitted], y[:fitted], w[:fitted], f[:fitted]
        first, k = int(own.min()), len(own)
        cell = np.where(slots[m] >= 0, (slots[m] - first) * n_bins, -1)[tree.at(x, m, level)]
        if len(own) < 2**level:
            kept = np.flatnonzero(cell >= 0)
            x, cell, w, f, y = np.take(x, kept, axis=1), cell[kept], w[kept], f[kept], y[kept]
        p = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        sums = w * (p - y), w * p * (1 - p), w
        for j in range(len(x)):
            own = cell + x[j]
            for i, v in enumerate(sums):
                total[first : first + k, i, j] += np.bincount(own, v, k * n_bins).reshape(k, n_bins)


def _best(sums: np.ndarray, settings: Settings) -> tuple[float, int, int, list, list]:
    """Best split of a node by its histograms (sum, feature, bin): gain, feature, bin, sums of the left side, sums of all."""
    run = sums.cumsum(axis=2)
    whole, left, penalty, least = run[:, :1, -1:], run[:, :, :-1], settings.penalty, max(settings.least_rows, 1e-9)
    right = whole - left
    gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - whole[0] ** 2 / (whole[1] + penalty)
    gain = np.where((left[2] >= least) & (right[2] >= least), gain, -np.inf)
    j, b = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[j, b]), j, b, left[:, j, b].tolist(), whole[:, 0, 0].tolist()


class InTask:
    """Rows of one model in the task that grows it."""

    def __init__(self, blocks: list[Block], settings: Settings):
        self.blocks, self.settings = blocks, settings

    def find(self, tree: Grown, slots: np.ndarray, *rest) -> dict[int, tuple]:
        """Best split by slot (open node of a model); by -1 the held back losses."""
        k = int(slots.max(initial=-1)) + 1
        total, loss = np.zeros((k, 3, len(self.blocks[0].x), self.settings.bins)), np.zeros((2, len(slots)))
        for block in self.blocks:
            _count(block, total, loss, tree, slots, *rest, self.settings)
        return {-1: (loss.ravel(),)} | {s: _best(total[s], self.settings) for s in range(k)}

    def move(self, tree: Grown, growing: np.ndarray) -> None:
        self.blocks = [b.moved([tree], growing, self.settings.depth) for b in self.blocks]


class InPasses:
    """Rows of all models as blocks in a table; what is found takes a pass over them."""

    def __init__(self, rows: RDD, features: int, settings: Settings):
        self.rows, self.features, self.settings = rows, features, settings
        self.state, self.old, self.trees = rows, None, []

    def find(self, tree: Grown, slots: np.ndarray, *rest) -> dict[int, tuple]:
        k, features, settings, tree = int(slots.max(initial=-1)) + 1, self.features, self.settings, tree.bare()
        parts = max(1, min(self.rows.getNumPartitions(), k))
        ends = [k * i // parts for i in range(parts + 1)]

        def count(part, blocks):
            total, loss = np.zeros((k, 3, features, settings.bins)), np.zeros((2, len(slots)))
            for block in blocks:
                _count(block, total, loss, tree, slots, *rest, settings)
            return [(i, (part, total[a:b], loss if i == 0 else None)) for i, (a, b) in enumerate(zip(ends, ends[1:]))]

        def best(i, counted):
            total, loss = 0.0, 0.0
            for _, more, missed in sorted((c for _, c in counted), key=lambda c: c[0]):  # sums don't depend on which task came first
                total = total + more
                loss = loss + missed if i == 0 else loss
            return [(ends[i] + s, _best(sums, settings)) for s, sums in enumerate(total)] + ([(-1, (loss.ravel(),))] if i == 0 else [])

        found = dict(self.state.mapPartitionsWithIndex(count).partitionBy(parts, int).mapPartitionsWithIndex(best).collect())  # a row an open node
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        return found

    def move(self, tree: Grown, growing: np.ndarray) -> None:
        depth, base, trees = self.settings.depth, self.state, [tree.bare()]
        self.trees += trees
        if len(self.trees) % PENDING == 0:
            base, trees = self.rows, list(self.trees)
        self.old, self.state = self.state if self.state is not self.rows else None, base.map(lambda b: b.moved(trees, growing, depth)).persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def end(self) -> None:
        for state in (self.state, self.rows):
            state.unpersist()


def _tree(rows: InTask | InPasses, growing: list[Growing], settings: Settings) -> Grown | None:
    """The next tree of all models that go on; None if there is none."""
    models, tree = len(growing), Grown.empty(len(growing), settings.depth)
    stops = np.array([m.stops for m in growing])
    for level in range(settings.depth):
        active = np.array([not m.done for m in growing])
        last = level == 0 and max(len(m.trees) for m in growing) >= settings.iterations
        slots, begin = np.full(tree.feature.shape, -1), 2**level - 1
        nodes = [(m, i) for m in np.flatnonzero(active & (not last)) for i in range(begin, 2 * begin + 1) if level == 0 or tree.sums[m, i, 2] >= 2 * settings.least_rows and tree.sums[m, i, 2] > 0]
        for s, (m, i) in enumerate(nodes):
            slots[m, i] = s
        if not nodes and not (last and (active & stops).any()):
            break
        found = rows.find(tree, slots, stops, active, level)
        if level == 0:
            loss, weight = np.array(found[-1][-1]).reshape(2, models)
            for m in np.flatnonzero(active & stops):
                if growing[m].trees:
                    growing[m].judge(loss[m] / weight[m], settings.tolerance)
        for s, (m, i) in enumerate(nodes):
            if growing[m].done or s not in found:
                continue
            gain, feature, b, low, whole = found[s]
            tree.sums[m, i] = whole
            if gain > 1e-9:
                tree.feature[m, i], tree.bin[m, i] = feature, b
                tree.sums[m, 2 * i + 1], tree.sums[m, 2 * i + 2] = low, np.array(whole) - low
            elif level == 0:
                growing[m].done = True  # nothing left to ask
    tree.value = np.where(tree.feature < 0, -settings.rate * tree.sums[..., 0] / np.maximum(tree.sums[..., 1] + settings.penalty, 1e-12), 0.0)
    split = tree.feature[:, 0] >= 0
    for m in np.flatnonzero(split):
        growing[m].trees.append((tree.feature[m], tree.bin[m], tree.value[m], tree.sums[m, :, 2]))
    if not split.any():
        return None
    rows.move(tree, split)
    return tree


def _boosted(growing: Growing, cuts: list[np.ndarray]) -> Boosted:
    nodes = [(0, 0, None, None, None, None, growing.base, growing.cover)]
    for t, (feature, bin_, value, cover) in enumerate(growing.trees[: growing.kept if growing.stops else None], 1):
        todo = [0]
        while todo:
            i = todo.pop()
            f = int(feature[i])
            if f < 0:
                nodes.append((t, i, None, None, None, None, float(value[i]), float(cover[i])))
            else:
                nodes.append((t, i, f, float(cuts[f][bin_[i]]), 2 * i + 1, 2 * i + 2, None, float(cover[i])))
                todo += [2 * i + 1, 2 * i + 2]
    return Boosted(nodes, paths(nodes))


def _cuts(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Values of each feature that bins end with, at even ranks, below the largest one; refused unless all are finite numbers and labels 0 or 1."""
    odd = F.lit(False)
    for f in features:
        odd = odd | F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))
    ranks = [i / bins for i in range(1, bins)]
    one = rows.agg(F.count(F.when(odd, 1)), F.count(F.when(~F.col("_y").isin(0.0, 1.0), 1)), *[F.struct(F.percentile_approx(f, ranks, 10000).alias("at"), F.max(f).alias("top")) for f in features]).first()
    if one[0]:
        raise ValueError("a feature is null, NaN or infinite")
    if one[1]:
        raise ValueError("a label is neither 0 nor 1")
    return [np.array(sorted({v for v in s["at"] or [] if v < s["top"]})) for s in one[2:]]


def fit_all(df: DataFrame, features: list[str], label: str, weights: Column, models: int, settings: Settings = Settings(), group: str | None = None) -> list[Boosted]:  # noqa: B008
    """As many models over the labelled rows, grown side by side. ``weights`` gives a row's weight in each of them (0: not of that model). A model of
    one label alone is refused. With ``group``, whole groups are held back."""
    out = []
    for first in range(0, models, settings.beside):
        n = min(settings.beside, models - first)
        out += _grow(df, features, label, F.slice(weights, first + 1, n), n, settings, group)
    return out


def _grow(df: DataFrame, features: list[str], label: str, weights: Column, models: int, settings: Settings, group: str | None) -> list[Boosted]:
    spark = df.sparkSession
    named = df.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"), weights.alias("_w"), *([F.col(group).alias("_group")] if group else []))
    rows = named.withColumn("_held", F.pmod(F.xxhash64(F.lit(settings.seed), *(["_group"] if group else [*features, "_y"])), F.lit(settings.held)) == 0).drop("_group")
    cuts = _cuts(rows, features, settings.bins)
    parts = spark.sparkContext.defaultParallelism
    alike = rows.groupBy(*features, "_y", "_held", "_w").agg(F.count("*").cast("double").alias("_n"))
    at = new_path(spark, "blocks")
    alike.repartition(parts).mapInArrow(_blocks(features, cuts, models, settings.bins), "part int, block binary").write.parquet(at)
    blocks = spark.read.schema("part int, block binary").parquet(at).rdd.map(lambda r: (r.part, pickle.loads(r.block))).partitionBy(parts, int).values().persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def sums(own):
        total = np.zeros((5, models))
        for b in own:
            w, fitted = b.each(), slice(b.fitted)
            total += [w.sum(axis=0), b.y @ w, w[fitted].sum(axis=0), b.y[fitted] @ w[fitted], (w > 0).sum(axis=0)]
        return [total]

    every, ones, fitted, fitted_ones, n = sum(blocks.mapPartitions(sums).collect())  # a row a task
    growing = []
    for m in range(models):
        if not 0 < ones[m] < every[m]:
            raise Refused("the label has one value or no rows")
        stops = fitted[m] < every[m] and 0 < fitted_ones[m] < fitted[m]  # if what isn't held back has one value, there is nothing to stop by
        cover, y = (fitted[m], fitted_ones[m]) if stops else (every[m], ones[m])
        growing.append(Growing(float(np.log(y / (cover - y))), float(cover), bool(stops)))

    if n.max() <= TASK_ROWS:
        own = blocks.flatMap(_by_model).partitionBy(models, int).mapPartitions(_whole(growing, settings))
        for m, *node in sorted(own.collect()):  # bounded by the settings
            growing[m].take(*node)
        blocks.unpersist()
    else:
        bases = [m.base for m in growing]
        passes = InPasses(blocks.map(lambda b: replace(b, margins=[np.full(len(b.of_model(m)[1]), base) for m, base in enumerate(bases)])), len(features), settings)
        while _tree(passes, growing, settings) is not None:
            pass
        passes.end()
        blocks.unpersist()
    remove(spark, at)
    return [_boosted(m, cuts) for m in growing]


def _blocks(features: list[str], cuts: list[np.ndarray], models: int, bins: int):
    """Rows to blocks, with the number of the task."""
    kind = np.uint8 if bins <= 256 else np.int32

    def run(batches):
        part, held = TaskContext.get().partitionId(), []

        def block():
            columns = [np.concatenate(c, axis=-1) for c in zip(*held)]
            held.clear()
            made = Block.of(*columns[:-1], np.ascontiguousarray(columns[-1].T))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([pickle.dumps(made, 5)], pa.binary())})

        for batch in (b for b in batches if b.num_rows):
            one = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            x = np.stack([np.searchsorted(c, one(f)) for f, c in zip(features, cuts)]).astype(kind)
            held.append((x, one("_y"), one("_n"), one("_held").astype(bool), batch.column("_w").flatten().to_numpy(zero_copy_only=False).reshape(-1, models).T))
            if sum(len(h[1]) for h in held) >= BLOCK:
                yield block()
        if held:
            yield block()

    return run


def _by_model(block: Block):
    """The rows of a block that each model has."""
    for m in range(block.weights.shape[1]):
        x, y, w, fitted = block.of_model(m)
        if len(y):
            yield m, (x, y, w, np.arange(len(y)) >= fitted)


def _whole(growing: list[Growing], settings: Settings):
    """Grows models of few rows, each in one task; a row a node of a complete tree that is in use."""

    def run(pieces):
        by_model = defaultdict(list)
        for m, piece in pieces:
            by_model[m].append(piece)
        for m, own in by_model.items():
            x, y, w, held = (np.concatenate(c, axis=-1) for c in zip(*own))
            block = Block.of(x, y, w, held, np.ones((len(y), 1)))  # each row stands for as many as it weighs
            block.margins = [np.full(len(y), growing[m].base)]
            rows, one = InTask([block], settings), [Growing(growing[m].base, growing[m].cover, growing[m].stops)]
            while _tree(rows, one, settings) is not None:
                pass
            kept = one[0].trees[: one[0].kept if one[0].stops else None]
            for t, parts in enumerate(kept):
                yield from ((m, t, i, int(f), int(b), float(v), float(c)) for i, (f, b, v, c) in enumerate(zip(*parts)) if c > 0)

    return run


def paths(nodes: list[tuple]) -> list[tuple]:
    """Leaves of a table of nodes with what their paths ask of each feature."""
    at = {(n[0], n[1]): n for n in nodes}
    out, todo = [], [(t, 0, {}) for t in sorted({n[0] for n in nodes})]
    while todo:
        tree, node, asked = todo.pop()
        _, _, feature, threshold, left, right, value, cover = at[tree, node]
        if feature is None:
            out.append((value, [(f, *bounds) for f, bounds in sorted(asked.items())]))
            continue
        lo, hi, share = asked.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left, (lo, min(hi, threshold))), (right, (max(lo, threshold), hi))):
            part = at[tree, child][7] / cover if cover else 0.0
            todo.append((tree, child, asked | {feature: (*bounds, share * part)}))
    return out


def fit(df: DataFrame, features: list[str], label: str, settings: Settings = Settings(), weight: str | None = None, group: str | None = None) -> Boosted:  # noqa: B008
    """Rows of a null label are left out; a label of one value alone is refused. With ``group``, whole groups are held back."""
    return fit_all(df, features, label, F.array((F.col(weight) if weight else F.lit(1.0)).cast("double")), 1, settings, group)[0]


def _scored(df: DataFrame, features: list[str], models: list[Boosted], which: Column) -> DataFrame:
    """Adds ``score``, the probability of label 1 by the model of the row's number."""
    names, tables = df.columns, []
    for m in models:
        size, trees = max(n[1] for n in m.nodes) + 1, m.nodes[-1][0] + 1
        feature, threshold, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
        for t, i, f, cut, _, _, v, _ in m.nodes:
            feature[t, i], threshold[t, i], value[t, i] = (-1, 0.0, v) if f is None else (f, cut, 0.0)
        tables.append((feature, threshold, value))

    def run(batches):
        for batch in batches:
            pdf = batch.select([f"_x{j}" for j in range(len(features))]).to_pandas()
            x, own = _matrix(pdf, list(pdf.columns)), batch.column("_which").to_numpy(zero_copy_only=False)
            margin = np.zeros(len(x))
            for k in np.unique(own):
                feature, threshold, value = tables[int(k)]
                rows = np.flatnonzero(own == k)
                for t in range(len(feature)):
                    node, f = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), feature[t, 0])
                    while (f >= 0).any():
                        node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[t, node]), node)
                        f = feature[t, node]
                    margin[rows] += value[t, node]
            columns = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))})

    schema = df.select("*", F.lit(0.0).alias("score")).schema
    ready = df.select("*", *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)], which.cast("int").alias("_which"))
    return ready.mapInArrow(run, schema)


def scores(model: Boosted, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``score``, the probability of label 1."""
    return _scored(df, features, [model], F.lit(0))


def cross_validate(df: DataFrame, features: list[str], label: str, group: str, k: int = 5, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Average precision and ROC area of each fold, whose rows a model of the others scores; no group is in two folds."""
    rows = df.where(F.col(label).isNotNull()).select(group, *[F.col(f).cast("double").alias(f) for f in features], label)
    folded = written(group_folds(rows, group, k, settings.seed), "folds")  # features are worked out once for all fits
    weights = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("fold") != i).cast("double"))
    fitted = fit_all(folded, features, label, weights, k, settings, group)
    measures = ranking_measures(_scored(folded.select("fold", *features, label), features, fitted, F.col("fold")), "score", label, ["fold"])
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))  # a fold without a group has no measures
    return every.join(measures, "fold", "left")


def require_precision(folds: DataFrame, least: float = 0.78) -> float:
    """The mean average precision, refused below ``least``."""
    mean = folds.agg(F.avg("ap")).first()[0]
    if mean is None or mean < least:
        raise Refused(f"mean average precision {mean} is under {least}")
    return mean


def games(leaves: list) -> list[tuple]:
    """Each leaf as a game of the features on its path: (conditions, attributions by which of them a row keeps, expected value).

    A known feature gives 1 or 0 as the row keeps its bounds, an unknown one the cover share. Sums over coalitions come
    from a polynomial whose coefficients gather them by size; they are worked out for the 2 ** d ways that a row can keep d bounds,
    for all leaves of d features at once."""
    out, alike = [()] * len(leaves), defaultdict(list)
    for k, (_, conditions) in enumerate(leaves):
        alike[len(conditions)].append(k)
    for d, own in alike.items():
        value = np.array([leaves[k][0] for k in own])
        share = np.array([[c[3] for c in leaves[k][1]] for k in own]).reshape(len(own), d)
        holds = ((np.arange(1 << d) >> np.arange(d)[:, None]) & 1).astype(float)
        weights = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
        phi = np.zeros((len(own), d, 1 << d))
        for i in range(d):
            size = np.zeros((len(own), d, 1 << d))
            size[:, 0] = 1.0
            for j in (j for j in range(d) if j != i):
                size[:, 1:] = size[:, 1:] * share[:, j, None, None] + size[:, :-1] * holds[j]
                size[:, 0] *= share[:, j, None]
            phi[:, i] = value[:, None] * (holds[i] - share[:, i, None]) * np.einsum("k,lkw->lw", weights, size)
        for k, table, expected in zip(own, phi, value * share.prod(axis=1)):
            out[k] = (leaves[k][1], table, float(expected))
    return out


class Played:
    """Attributions of leaves' games to rows. Leaves that ask few different things are summed up in a table by cell, the intervals of the features
    between what they ask: a row looks its cell up instead of every leaf."""

    def __init__(self, leaves: list, features: int):
        self.features, self.tables = features, []
        all_games = games(leaves)
        self.base = sum(g[2] for g in all_games)
        asked, own = set(), []
        self.edges = self._edges({(f, v) for conditions, *_ in all_games for f, lo, hi, _ in conditions for v in (lo, hi)})
        for game in all_games:
            more = {(f, v) for f, lo, hi, _ in game[0] for v in (lo, hi) if np.isfinite(v)} - asked
            sizes = Counter(f for f, _ in asked | more) if more else {}
            if own and prod(n + 1 for n in sizes.values()) > CELLS:
                self._add(own, asked)
                own, asked = [], {(f, v) for f, lo, hi, _ in game[0] for v in (lo, hi) if np.isfinite(v)}
            own.append(game)
            asked = asked | more
        if own:
            self._add(own, asked)

    def _edges(self, asked: set) -> list[list]:
        out = [[] for _ in range(self.features)]
        for f, v in sorted(asked):
            if np.isfinite(v):
                out[f].append(v)
        return out

    def _add(self, own: list[tuple], asked: set) -> None:
        edges = self._edges(asked)
        shape = [len(e) + 1 for e in edges]
        at = [{v: k for k, v in enumerate(e)} | {-np.inf: -1, np.inf: len(e)} for e in edges]
        along = [[-1 if g == f else 1 for g in range(self.features)] for f in range(self.features)]
        phi = np.zeros((self.features, *shape))
        for conditions, table, _ in own:
            way = 0
            for i, (f, lo, hi, _) in enumerate(conditions):
                keeps = np.zeros(shape[f], dtype=np.int64)
                keeps[at[f][lo] + 1 : at[f][hi] + 1] = 1 << i
                way = way + keeps.reshape(along[f])
            for i, (f, *_) in enumerate(conditions):
                phi[f] += table[i][way]
        steps = [(f, np.array([0, *np.searchsorted(edges[f], self.edges[f], "right")]) * prod(shape[f + 1 :])) for f in range(self.features) if edges[f]]
        asks = sorted({f for conditions, *_ in own for f, *_ in conditions})
        self.tables.append((steps, [(f, phi[f].ravel()) for f in asks]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A row for each of x; a row's sum and the expected value, ``base``, give the log odds."""
        out = np.zeros((self.features, len(x)))
        for a in range(0, len(x), BLOCK):
            rank = [np.searchsorted(e, x[a : a + BLOCK, f]) for f, e in enumerate(self.edges)]
            for steps, phi in self.tables:
                cell = np.zeros(len(rank[0]), dtype=np.int64)
                for f, step in steps:
                    cell += step[rank[f]]
                for f, table in phi:
                    out[f, a : a + BLOCK] += table[cell]
        return out.T


def shapley(leaves: list, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Attributions of the leaves' games to rows, and the expected value."""
    played = Played(leaves, x.shape[1])
    return played(x), played.base


def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    x = pdf[features].to_numpy(float)
    if not np.isfinite(x).all():
        raise ValueError("a feature is null, NaN or infinite")
    return x


def attributions(model: Boosted, df: DataFrame, features: list[str]) -> DataFrame:
    """feature, x, phi: a row for each row of ``df`` and feature."""
    leaves = model.leaves

    def run(batches):
        played = Played(leaves, len(features))
        for pdf in batches:
            x = _matrix(pdf, features)
            phi = played(x)
            yield pd.DataFrame({"feature": np.tile(features, len(x)), "x": x.ravel(), "phi": phi.ravel()})

    return df.select(*[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(run, "feature string, x double, phi double")


def ranking(df: DataFrame, features: list[str], label: str, settings: Settings = Settings(), weight: str | None = None) -> DataFrame:  # noqa: B008
    """Features of a fitted model by mean absolute attribution over all rows."""
    rows = _measured(df, features, label, *([weight] if weight else []))
    model = fit(rows, features, label, settings, weight)
    return importance_ranking(attributions(model, rows, features))


def _measured(df: DataFrame, features: list[str], label: str, *more: str) -> DataFrame:
    """The labelled rows as a table: features are worked out once for all passes of the fits and attributions."""
    return written(df.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], label, *more), "rows")


def stability(df: DataFrame, features: list[str], label: str, group: str, replicates: int, top: int, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Mean and spread of each feature's position over resamples of groups, and how often it is
    among the first ``top``. A group drawn several times weighs as much; a row carries its number in every resample, models of all
    are grown side by side and held against the rows in one pass."""
    every = written(df.select(group, *[F.col(f).cast("double").alias(f) for f in features], label), "rows")  # features are worked out once for all fits
    draws = bootstrap_groups(every.select(group), group, replicates, settings.seed).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("replicate", F.col("times").cast("double")))).alias("_n"))
    times = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda i: F.coalesce(F.try_element_at("_n", i), F.lit(0.0)))
    drawn = written(every.where(F.col(label).isNotNull()).join(draws, group).withColumn("_times", times).drop("_n"), "drawn")
    fitted = [m.leaves for m in fit_all(drawn, features, label, F.col("_times"), replicates, settings, group)]

    def run(batches):
        total, held = np.zeros((replicates, len(features) + 1)), []

        def add():
            x, times = (np.concatenate(c) for c in zip(*held))
            held.clear()
            for i, leaves in enumerate(fitted):
                rows = np.flatnonzero(times[:, i])
                total[i, :-1] += times[rows, i] @ np.abs(Played(leaves, len(features))(x[rows]))
                total[i, -1] += times[rows, i].sum()

        for batch in batches:
            if batch.num_rows:
                times = batch.column("_times").flatten().to_numpy(zero_copy_only=False).reshape(-1, replicates)
                held.append((_matrix(batch.select(features).to_pandas(), features), times * batch.column("_alike").to_numpy()[:, None]))
            if sum(len(x) for x, _ in held) >= 2 * BLOCK:
                add()
        if held:
            add()
        i, f = (a.ravel() for a in np.indices((replicates, len(features))))
        yield pa.RecordBatch.from_pydict({"replicate": pa.array(i, pa.int32()), "feature": pa.array([features[j] for j in f]), "total": pa.array(total[:, :-1].ravel()), "weight": pa.array(total[i, -1])})

    alike = drawn.groupBy("_times", *features).agg(F.count("*").cast("double").alias("_alike"))
    parts = alike.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "replicate int, feature string, total double, weight double")
    found = parts.groupBy("replicate", "feature").agg((F.sum("total") / F.sum("weight")).alias("importance"))
    p = found.withColumn("position", F.row_number().over(Window.partitionBy("replicate").orderBy(F.desc("importance"), "feature")))  # a row a feature
    return p.groupBy("feature").agg(F.avg("position").alias("mean_position"), F.coalesce(F.stddev_samp("position"), F.lit(0.0)).alias("sd_position"), F.avg((F.col("position") <= top).cast("double")).alias("top_share"))


def mediation(df: DataFrame, base: list[str], mediators: list[str], cluster: list[str], label: str, settings: Settings = Settings(), least: float = 0.7) -> DataFrame:  # noqa: B008
    """Importance of a cluster without and with mediators, its relative drop, and whether that is
    at least ``least``. Refused if base features contain a mediator."""
    if set(base) & set(mediators):
        raise Refused(f"base features contain mediators: {sorted(set(base) & set(mediators))}")
    df = _measured(df, list(dict.fromkeys([*base, *mediators])), label)
    own = lambda features: ranking(df, features, label, settings).where(F.col("feature").isin(cluster)).agg(F.sum("importance").alias("v"))
    both = own(base).select(F.col("v").alias("without_mediators")).crossJoin(F.broadcast(own([*base, *mediators]).select(F.col("v").alias("with_mediators"))))
    return both.withColumn("drop", F.coalesce(1 - F.try_divide("with_mediators", "without_mediators"), F.lit(0.0))).withColumn("mediated", F.col("drop") >= least)
