"""Nearest neighbours against all pairs, and what is left unread."""

import numpy as np

from tessera.operators import nearness


def brute(rows):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.where(n == 0, 1, n)
    out = {}
    for i in range(len(ids)):
        s = np.round(v @ v[i], 9)
        s[ids == ids[i]] = -np.inf
        out[int(ids[i])] = (int(min(ids[s == s.max()])), float(s.max()))
    return out


def test_nearest_in_pieces_equals_all_pairs(spark):
    """Loose vectors, ties, opposite ones and zeros, in pieces of 40."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(20, 6)).repeat(8, axis=0) + rng.normal(scale=1e-4, size=(160, 6)), np.zeros((3, 6)), np.eye(6), np.eye(6), -np.eye(6)])
    rows = [(1000 - 3 * i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows + [(5000, None), (5001, [float("nan")] * 6), (5002, [1.0, None, 1.0, 1.0, 1.0, 1.0])], "id bigint, v array<double>")
    got = {r.id: (r.near_id, r.cosine) for r in nearness.nearest(df, "id", "v", 40).collect()}
    want = brute(rows)
    assert {k: a for k, (a, _) in got.items()} == {k: a for k, (a, _) in want.items()}
    assert max(abs(got[k][1] - want[k][1]) for k in want) < 2e-9


def test_clustered_vectors_leave_most_pieces_unread(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    v = (centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.02, size=(4000, 16))).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "id bigint, v array<double>")
    rows = nearness.nearest_blocks(df, "id", "v", 400).collect()
    assert len(rows) == 4000 and np.mean([r.n_read for r in rows]) < 10  # of 63 others
    want = brute(list(enumerate(v)))
    assert all((r.near_id, round(r.cosine, 6)) == (want[r.id][0], round(want[r.id][1], 6)) for r in rows)


def test_few_vectors(spark):
    for rows, want in (([], []), ([(1, [1.0, 0.0])], []), ([(1, [0.0, 0.0])], []), ([(1, [0.0, 0.0]), (2, [0.0, 1.0])], [(1, 2, 0.0), (2, 1, 0.0)])):
        df = spark.createDataFrame(rows, "id bigint, v array<double>")
        assert sorted(tuple(r) for r in nearness.nearest(df, "id", "v").collect()) == want


def test_better_equals_rounded_cosines():
    """Single precision only sorts out: near ties, equal vectors in plenty, repeated ids and what is known already."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 8))
    v = np.concatenate([v, np.repeat(v[:3], 90, axis=0), v[:60] + rng.normal(scale=1e-6, size=(60, 8))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.sort(rng.permutation(4 * len(v))[: len(v)])
    ids[11] = ids[10]
    piece = lambda rows: (ids[rows], v[rows], v[rows].astype(np.float32))
    best, near = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
    for rows in (slice(0, 250), slice(250, None)):
        best, near = nearness.better(piece(slice(None)), piece(rows), best, near, cells=5000)
    want = brute(list(zip(ids.tolist(), v)))
    assert all(near[i] == want[ids[i]][0] for i in range(len(ids)) if i not in (10, 11)) and near[10] != ids[10] != near[11]
    assert all(abs(best[i] - want[ids[i]][1]) < 2e-9 for i in range(len(ids)) if i not in (10, 11))


def test_a_norm_is_worked_out_once_for_a_vector(spark):
    """Once for each component it would be 800 million products here."""
    import time

    from pyspark.sql import functions as F

    from tessera.functions.vectors import unit

    df = spark.range(0, 1600, 1, 2).select(F.transform(F.sequence(F.lit(1), F.lit(512)), lambda x: (x + F.col("id")).cast("double")).alias("v"))
    begin = time.time()
    assert abs(df.select(unit("v").alias("u")).agg(F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))).first()[0] - 1600) < 1e-6
    assert time.time() - begin < 15
    odd = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), (None,), ([1.0, None],)], "v array<double>").select(unit("v").alias("u"))
    assert [r.u for r in odd.collect()] == [[0.0, 0.0], [0.6, 0.8], None, [None, None]]


def test_distances_are_found_once_for_their_summary(spark):
    from pyspark.sql import functions as F

    from tessera.operators import aggregates

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        seen.add(1)
        return float(x)

    near = spark.range(100).select(costly.asNondeterministic()("id").alias("d"), (F.col("id") % 2).alias("k"))
    row = aggregates.distance_summary(near, "d", F.col("k") == 0).first()
    assert (row.n, row.mean, row["median"], row.same_share, seen.value) == (100, 49.5, 49.5, 0.5, 100)
