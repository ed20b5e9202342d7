"""Column profile, sample rows and schema description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.operators.columnstats import table_stats
from tablelens.operators.frequency import distinct_counts
from tablelens.operators.quality import duplicate_rows
from tablelens.schema import col, local_frame, normalize, stack_rows
from tablelens.thresholds import DEFAULTS


def schema_description(df: DataFrame) -> DataFrame:
    """``(position, column_name, dtype)``."""
    return local_frame(df, [(i, n, t) for i, (n, t) in enumerate(df.dtypes)],
                       "position int, column_name string, dtype string")


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, NULL count and distinct count of each column.

    The distinct counts are exact unless ``approximate`` asks for sketches, which need no shuffle.
    """
    df = normalize(df)
    names = df.columns
    if approximate:
        stats = table_stats(df, parse=False)
        return local_frame(df, [
            (i, c.name, c.dtype, c.missing, c.distinct_estimate)
            for i, c in enumerate(stats.columns.values())
        ], "position int, column_name string, dtype string, null_count bigint, unique_count bigint")
    nulls = stack_rows(
        df.agg(*[F.count_if(col(n).isNull()).alias(f"n{i}") for i, n in enumerate(names)]),
        [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.lit(t).alias("dtype"),
                  F.col(f"n{i}").alias("null_count")) for i, (n, t) in enumerate(df.dtypes)])
    return (nulls.join(distinct_counts(df), "column_name", "left")
            .select("position", "column_name", "dtype", "null_count",
                    F.col("distinct_count").alias("unique_count")))


def sample_rows(df: DataFrame, n: int = DEFAULTS.sample_rows, order_by: list[str | Column] | None = None) -> DataFrame:
    """The first ``n`` rows; Spark tables have no order, so give one to get the same rows each time."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def profile(df: DataFrame, sample_size: int = DEFAULTS.sample_rows, order_by: list[str] | None = None) -> dict:
    """Shape, columns, duplicate rows and sample rows as a small dict."""
    df = normalize(df)
    columns = [r.asDict() for r in profile_columns(df).orderBy("position").collect()]
    dup = duplicate_rows(df).first()
    return {
        "shape": {"rows": dup["row_count"], "columns": len(columns)},
        "columns": [{"name": c["column_name"], "dtype": c["dtype"], "null_count": c["null_count"],
                     "unique_count": c["unique_count"]} for c in columns],
        "duplicate_rows": dup["duplicate_count"],
        "sample_rows": [r.asDict(recursive=True) for r in sample_rows(df, sample_size, order_by).collect()],
    }
