"""Step counts as state of a stream against the batch, over restarts."""

import random

from pyspark.sql import functions as F

from tessera.operators import gates
from tessera.streaming import runs


def test_states_equal_the_batch_after_restarts(spark, tmp_path):
    """Rows of plans and steps in any order over three starts; a run without a plan, one without a step, one that goes on after it is done."""
    rnd = random.Random(1)
    plan = [(f"r{i}", 10, None) for i in range(6)] + [("none", 5, None)]
    steps = [(f"r{i}", None, k) for i in range(6) for k in ([4, 6] if i % 2 else [3, 3])] + [("r1", None, 2), ("extra", None, 1), (None, None, 7)]
    rows = plan + steps
    rnd.shuffle(rows)
    session = runs.stateful_session(spark, 2)
    for part in (rows[:8], rows[8:14], rows[14:]):
        spark.createDataFrame(part, runs.ROWS).write.mode("append").parquet(str(tmp_path / "rows"))
        runs.count_steps(session, str(tmp_path / "rows"), str(tmp_path / "out"), str(tmp_path / "state"))
    reports = spark.read.parquet(str(tmp_path / "out"))
    got = {r.run: (r.steps, r.state) for r in runs.latest(reports).collect()}
    every = spark.createDataFrame(rows, runs.ROWS).where("run is not null")
    planned = every.where("planned is not null").select("run", "planned")
    seen = every.groupBy("run").agg(F.coalesce(F.sum("steps"), F.lit(0)).alias("steps")).join(planned, "run", "left")
    done = seen.where("steps > 0").select("run", (F.col("steps") >= F.coalesce("planned", F.lit(0))).alias("done"))
    want = {r.run: r.state for r in gates.states(planned.select("run"), done, ["run"]).collect()}
    assert {k: s for k, (_, s) in got.items()} == want and set(want.values()) == {"done", "pending", "violation"}
    assert {k: n for k, (n, _) in got.items()} == {r.run: r.steps for r in seen.collect()}
    assert reports.count() > len(got)  # a report for each start that touched the run


def test_a_silent_run_is_reported_again(spark, tmp_path):
    session = runs.stateful_session(spark, 2)
    for rows in ([("a", 3, 1)], [("b", 1, 1)], [("c", 1, 1)]):
        spark.createDataFrame(rows, runs.ROWS).write.mode("append").parquet(str(tmp_path / "rows"))
        runs.count_steps(session, str(tmp_path / "rows"), str(tmp_path / "out"), str(tmp_path / "state"), silent_ms=1)
    reports = [(r.run, r.n, r.state) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("run", "n").collect()]
    assert reports == [("a", 1, "pending"), ("a", 2, "pending"), ("b", 1, "done"), ("c", 1, "done")]
