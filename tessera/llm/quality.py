"""Quality scores of documents from their statistics.

Statistics of a whole text (shares of kinds of characters, words and lines, repetition) are
standardized and mapped to random Fourier features, whose inner products approximate a Gaussian
kernel. Ridge regression on them is fitted by normal equations that each partition of the fit
sums for itself; isotonic regression on rows set apart turns its values into probabilities.

The fit reads at most about ``rows`` labelled documents, chosen by a hash of the id; all texts
are scored in whole. Defined results: null text counts as empty and is scored; without a
labelled row, or with rows of one label alone, every text gets the share of label 1 (0.5 without
any); rows with a null label aren't learned from; repeated rows, repeated ids and null ids are kept, and each
label of a repeated id counts; equal texts and ties have equal scores; very long texts are measured in whole; an empty
table gives an empty one; other columns, whatever their names, are not carried by ``predict``, and all of them by ``keep``.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow

FEATURES, RIDGE, PARTS = 256, 1e-3, 8
THRESHOLD = 0.7
# Kinds of bytes whose shares count.
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",", b"!?", b"'\"", b":;-_", b"()[]{}<>", b"/\\@", b"#$%&*+=^~", b"|", bytes(range(128, 256))]
_KIND = np.full(256, len(KINDS), dtype=np.intp)
for _i, _k in enumerate(KINDS):
    _KIND[list(_k)] = _i


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode()
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=byte, minlength=len(KINDS) + 1) / max(1, len(raw))
    words = text.split()
    n = len(words)
    seen = Counter(words)
    top = seen.most_common(3)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    size = [len(w) for w in seen]
    lower = sum(c for w, c in seen.items() if w[-1].isalpha())
    return [
        *np.sqrt(kinds).tolist(),
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)),
        len(seen) / max(1, n), pairs / max(1, n - 1), len(set(lines)) / max(1, len(lines)),
        top[0][1] / n if n else 0.0, sum(c for _, c in top) / max(1, n),
        min(30.0, (len(text) - n) / max(1, n)), float(np.mean(size)) if size else 0.0, float(np.std(size)) if size else 0.0,
        lower / max(1, n), np.log1p(n / (1 + byte[46] + byte[33] + byte[63])),
        len(zlib.compress(raw, 1)) / max(20, len(raw)),
    ]


WIDTH = len(statistics(""))


def _fourier(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ model["w"] + model["b"]), np.ones((len(z), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing function nearest to y: pooled adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for xi, yi in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([yi, 1.0, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    s, n, sx = np.array(blocks).T
    return sx / n, s / n


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 30_000, seed: int = 10) -> dict:
    """The model from labels of ids whose crc32 modulo 4 isn't 2."""
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull() & (crc_mod("doc_id", 4) != 2)).select(F.col("doc_id").alias("label_id"), (F.col("quality") >= 1).cast("double").alias("y"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(1_000_000)) < 1_000_000 * min(1.0, rows / max(1, n)))
    # About `rows` pairs of an id and a number; repeated ids of labels may make them more.
    chosen = F.broadcast(chosen) if chosen.count() <= 2 * rows else chosen
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, F.col("id") == F.col("label_id"))
    found = found.select(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5)).cast("int").alias("fold"), "y", "text")
    stats = map_arrow(found, "fold int, y double, x array<double>", lambda: lambda b: [b.column("fold"), b.column("y"), [statistics(t) for t in b.column("text").to_pylist()]])
    from .common import drop_written, written

    table = written(stats.repartition(PARTS), "statistics")
    sums = table.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("y")).orderBy("i").collect()
    share = float(sums[0].y) if sums else 0.5
    if not sums or not 0 < share < 1:
        drop_written(table)
        return {"share": share}
    rng = np.random.default_rng(seed)
    model = {"share": share, "mean": np.array([r.m for r in sums]), "scale": np.array([max(r.s, 1e-6) for r in sums]), "w": rng.normal(size=(WIDTH, FEATURES)) / np.sqrt(WIDTH), "b": rng.uniform(0, 2 * np.pi, FEATURES)}
    shared = spark.sparkContext.broadcast(model)

    def normal():
        size = FEATURES + 1
        total = np.zeros((size, size + 1))

        def make(batch):
            take = batch.filter(pa.array(batch.column("fold").to_numpy() != 0))
            if take.num_rows:
                z = _fourier(shared.value, np.array(take.column("x").to_pylist()))
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ take.column("y").to_numpy()

        make.finish = lambda: [[total.tobytes()]]
        return make

    parts = map_arrow(table, "total binary", normal, by=None).collect()  # one matrix a partition, of at most PARTS
    both = sum(np.frombuffer(r.total).reshape(FEATURES + 1, FEATURES + 2) for r in parts)
    gram = both[:, :-1] + RIDGE * max(1.0, both[-1, -2]) / FEATURES * np.eye(FEATURES + 1)
    model["weights"] = np.linalg.solve(gram, both[:, -1])
    apart = table.where("fold = 0").select("y", "x").toPandas()  # a fifth of the bounded sample
    drop_written(table)
    if len(apart):
        value = _fourier(model, np.array(apart["x"].tolist())) @ model["weights"]
        model["knots"] = isotonic(value, apart["y"].to_numpy())
    else:
        model["knots"] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 of each text."""
    if "weights" not in model:
        return np.full(len(texts), model["share"])
    value = _fourier(model, np.array([statistics(t) for t in texts])) @ model["weights"]
    # between the knots linear, and a little of the value itself, so that equal steps keep their order
    return np.clip(0.999 * np.interp(value, *model["knots"]) + 0.001 * np.clip(value, 0, 1), 0, 1)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, 4) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def start():
        def make(batch):
            score = scores(shared.value, batch.column("text").to_pylist())
            return [batch.column("id"), batch.column("held_out"), score, (score >= THRESHOLD).astype(np.int32)]

        return make

    return map_arrow(rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int", start)


def keep(docs: DataFrame, model: dict, least: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least this, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def make(batch):
            return batch.filter(pa.array(scores(shared.value, batch.column(batch.schema.get_field_index(text_col)).to_pylist()) >= least)).columns

        return make

    return map_arrow(docs, docs.schema, start, by=text_col)
