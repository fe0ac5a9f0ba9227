"""Steps of training runs counted as their rows arrive, with a state by run that outlives restarts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Arriving rows: the plan of a run (steps it has to take), or steps that it has taken (a null plan).
ROWS = "run string, planned bigint, steps bigint"
OUT = "run string, n bigint, steps bigint, state string"


class Steps(StatefulProcessor):
    """Counts a run's steps. Each batch that brings rows of it gives its state, numbered: violation (steps without a plan), done (as
    many as planned, or more) or pending; a run that stays silent is reported pending again when its timer ends."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "planned bigint, steps bigint, n bigint, timer bigint")

    def state(self) -> tuple:
        return self.run.get() if self.run.exists() else (-1, 0, 0, -1)

    def report(self, run: str, planned: int, steps: int, n: int) -> pd.DataFrame:
        state = "violation" if planned < 0 else "done" if steps >= planned else "pending"
        return pd.DataFrame({"run": [run], "n": [n], "steps": [steps], "state": [state]})

    def handleInputRows(self, key, rows, timerValues):
        planned, steps, n, timer = self.state()
        for pdf in rows:
            if pdf["planned"].notna().any():
                planned = int(pdf["planned"].max())
            steps += int(pdf["steps"].fillna(0).sum())
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = -1
        if 0 <= planned and steps < planned:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.silent_ms
            self.handle.registerTimer(timer)
        self.run.update((planned, steps, n + 1, timer))
        yield self.report(key[0], planned, steps, n + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        planned, steps, n, _ = self.state()
        self.run.update((planned, steps, n + 1, -1))
        yield self.report(key[0], planned, steps, n + 1)

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession, parts: int | None = None) -> SparkSession:
    """A session of its own whose streams may keep values, maps and timers; the caller's settings stay as they are. Timers end with the next rows:
    batches without rows, which an open timer would ask for without an end, are off."""
    session = spark.newSession()
    store = "spark.sql.streaming.stateStore."
    settings = {"spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"), "spark.sql.shuffle.partitions": str(parts or spark.sparkContext.defaultParallelism), store + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", store + "rocksdb.changelogCheckpointing.enabled": "true", store + "unloadOnCommit": "true", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in settings.items():
        session.conf.set(k, v)
    return session


def count_steps(session: SparkSession, rows_at: str, to: str, checkpoint: str, silent_ms: int = 3_600_000) -> None:
    """Takes in what has arrived below ``rows_at`` (Parquet of ROWS) and ends; a later call goes on from there. Reports go to ``to``."""
    rows = session.readStream.schema(ROWS).parquet(rows_at).where("run is not null")
    found = rows.groupBy("run").transformWithStateInPandas(Steps(silent_ms), OUT, "Append", "ProcessingTime")
    query = found.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(reports: DataFrame) -> DataFrame:
    """run, steps and state of each run's last report."""
    return reports.groupBy("run").agg(F.max(F.struct("n", "steps", "state")).alias("last")).select("run", "last.steps", "last.state")
