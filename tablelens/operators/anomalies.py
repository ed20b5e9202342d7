"""Values far from the mean of their column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.operators.columnstats import TableStats, table_stats
from tablelens.schema import as_double, chunks, classify, local_frame, normalize
from tablelens.thresholds import DEFAULTS, LIMITS, Thresholds


def far_values(df: DataFrame, stats: TableStats, exclude: Iterable[str] = (), limits: Thresholds = DEFAULTS) -> dict[str, Column]:
    """The condition of a far value for each numeric column that has some spread."""
    usable = [stats[n] for n in classify(df, exclude).numeric if stats[n].present >= 2 and stats[n].std]
    return {c.name: F.abs((as_double(c.name) - c.mean) / c.std) > limits.z_score for c in usable}


def zscore_outliers(df: DataFrame, exclude: Iterable[str] = (), stats: TableStats | None = None,
                    limits: Thresholds = DEFAULTS, counts: dict[str, int] | None = None) -> DataFrame:
    """``(column_name, outlier_count, outlier_pct)``; columns without outliers are left out.

    ``counts`` gives the far values of each column if another scan has counted them.
    """
    df = normalize(df)
    stats = stats or table_stats(df, classify(df, exclude).numeric, sketch=False, parse=False)
    far = far_values(df, stats, exclude, limits)
    if counts is None:
        counts = {}
        for block in chunks(list(far), LIMITS.columns_per_job):
            counts.update(zip(block, df.agg(*[F.count_if(far[n]).alias(f"c{i}") for i, n in enumerate(block)]).first()))
    rows = [(n, counts[n], round(100 * counts[n] / stats[n].present, 1)) for n in far if counts[n] > 0]
    return local_frame(df, rows, "column_name string, outlier_count bigint, outlier_pct double")
