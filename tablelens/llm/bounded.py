"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers or short texts that may be sent to every executor.
MOST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int | None = None, most: int = MOST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, to be joined by shuffle.

    ``rows`` is the count if it is known already. Call it on written tables: the count reads them.
    """
    if rows is None:
        rows = df.limit(most + 1).count()
    return F.broadcast(df) if rows <= most else df
