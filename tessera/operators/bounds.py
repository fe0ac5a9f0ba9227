"""Checks of size before a table is sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` if it has more than so many rows; else its rows, computed once here, marked for broadcast."""
    rows = df.limit(most + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= most else df


#: Rows of a part that is dealt by a key, at most on average.
PART_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by keys, in as many parts as ``rows`` rows need, so that no task's share grows with the input; tables
    dealt for the same number of rows meet without another shuffle. Few rows are left to adaptive execution."""
    n = -(-rows // PART_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)
