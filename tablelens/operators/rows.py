"""Row filters and line extraction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tablelens.functions.parse import strip
from tablelens.schema import col, normalize

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def complete_cases(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows in which every one of ``columns`` has a value."""
    kinds = dict(df.dtypes)
    for name in (columns if columns is not None else df.columns):
        # On the stored column, so that the condition reaches the scan.
        df = df.filter(col(name).isNotNull())
        if kinds[name] in ("float", "double"):
            df = df.filter(~F.isnan(col(name)))
    return normalize(df)


def marked_lines(df: DataFrame, key: str, text: str, marker: str = "INSIGHT: ") -> DataFrame:
    """``(key, line_no, line)``: lines that begin with ``marker`` once stripped, without the marker."""
    lines = df.select(col(key), F.posexplode(F.split(col(text), LINE_ENDS)).alias("line_no", "line"))
    stripped = strip(F.col("line"))
    return (lines.withColumn("line", stripped).filter(F.startswith(F.col("line"), F.lit(marker)))
            .withColumn("line", strip(F.substring(F.col("line"), F.lit(len(marker) + 1), F.length("line")))))
