"""The numbers behind the standard charts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tablelens.operators.columnstats import TableStats, table_stats
from tablelens.operators.quality import missing_by_column
from tablelens.schema import as_double, classify, local_frame, normalize
from tablelens.thresholds import DEFAULTS, Thresholds


def spread_order(df: DataFrame, stats: TableStats, limits: Thresholds = DEFAULTS) -> list[tuple[str, float]]:
    """Numeric columns by absolute coefficient of variation, largest first."""
    ranked = [
        (n, abs(stats[n].std / stats[n].mean)) for n in classify(df).numeric
        if n in stats.columns and stats[n].present >= 2 and stats[n].mean != 0 and stats[n].std is not None
    ]
    ranked.sort(key=lambda p: -p[1])
    return ranked[:limits.max_histograms]


def spread_ranking(df: DataFrame, stats: TableStats | None = None, limits: Thresholds = DEFAULTS) -> DataFrame:
    df = normalize(df)
    stats = stats or table_stats(df, classify(df).numeric, sketch=False, parse=False)
    return local_frame(df, [(i + 1, n, s) for i, (n, s) in enumerate(spread_order(df, stats, limits))],
                       "rank int, column_name string, spread double")


def histogram(df: DataFrame, columns: Iterable[str] | None = None, stats: TableStats | None = None,
              limits: Thresholds = DEFAULTS) -> DataFrame:
    """``(column_name, bin, lower, upper, n)``: equal-width bins, the last one closed, empty ones kept.

    One scan with the limits as literals; at most columns times bins rows leave each task.
    """
    df = normalize(df)
    stats = stats or table_stats(df, list(columns) if columns is not None else classify(df).numeric,
                                 sketch=False, parse=False)
    names = list(columns) if columns is not None else [n for n, _ in spread_order(df, stats, limits)]
    names = [n for n in names if stats[n].present]
    schema = "column_name string, bin int, lower double, upper double, n bigint"
    if not names:
        return local_frame(df, [], schema)
    bins, edges, cells = limits.histogram_bins, [], []
    for n in names:
        low, high = stats[n].low, stats[n].high
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        edges += [(n, i, low + i * width, high if i == bins - 1 else low + (i + 1) * width) for i in range(bins)]
        v = as_double(n)
        # `least` passes over NULL, so missing values need a condition of their own.
        at = F.when(v.isNotNull(), F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int"))
        cells.append(F.struct(F.lit(n).alias("column_name"), at.alias("bin")))
    counted = (df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("bin IS NOT NULL")
               .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("n")))
    frame = local_frame(df, edges, "column_name string, bin int, lower double, upper double")
    # The left side has at most a few dozen rows per column.
    return (frame.join(counted, ["column_name", "bin"], "left")
            .select("column_name", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n")))


def missingness(df: DataFrame) -> DataFrame:
    """Share of missing values of each column that has any, smallest first."""
    return missing_by_column(df).select("column_name", "missing_pct").orderBy("missing_pct", "column_name")
