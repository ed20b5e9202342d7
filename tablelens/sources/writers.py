"""Sinks for cleaned tables and reports; every task writes its own part."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_cleaned(df: DataFrame, path: str, log: list | None = None, fmt: str = "csv") -> str | None:
    """Write the cleaned table; nothing is written if the change log is given and empty."""
    if log is not None and not log:
        return None
    writer = df.write.mode("overwrite")
    (writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path))
    return path


def write_report(report: DataFrame, path: str, fmt: str = "json") -> str:
    """Write long-form report rows, one folder per report."""
    report.write.mode("overwrite").partitionBy("report").format(fmt).save(path)
    return path
