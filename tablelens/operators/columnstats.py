"""One-scan statistics of all columns: the input of every threshold decision.

The result is one small record per column on the driver. Nothing here shuffles data: each task sends
one aggregation buffer. Wide tables are split over several jobs; each job reads only its own columns.
Sketches keep their state in objects, which would take the counts and moments next to them out of
generated code; they have a job of their own, several times cheaper than one mixed job.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.parse import parse_number, parse_timestamp
from tablelens.schema import as_double, chunks, classify, col, comparable
from tablelens.thresholds import LIMITS

# log2 of the registers of a distinct-count sketch (64 KiB per column and task): the relative
# standard error is 1.04 / sqrt(2 ** 16) = 0.41 %.
SKETCH_LG_K = 16
# Six standard errors: a decision further from its threshold than this needs no exact count.
SKETCH_MARGIN = 0.025


@dataclass
class ColumnStats:
    name: str
    dtype: str
    present: int = 0
    missing: int = 0
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    distinct_estimate: int | None = None
    number_rate: float | None = None
    date_rate: float | None = None


@dataclass
class TableStats:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)

    def __getitem__(self, name: str) -> ColumnStats:
        return self.columns[name]

    def numeric(self, df: DataFrame) -> dict[str, ColumnStats]:
        """The numeric columns that have values."""
        return {n: self[n] for n in classify(df).numeric if n in self.columns and self[n].present}


def _column_aggregates(df: DataFrame, i: int, name: str, kinds, parse: bool) -> list[Column]:
    """All with buffers of fixed width, so that the aggregation stays in generated code."""
    cell = comparable(df, name)
    out = [F.count(cell).alias(f"present_{i}")]
    if name in kinds.numeric:
        v = as_double(name)
        out += [
            F.avg(v).alias(f"mean_{i}"), F.stddev_samp(v).alias(f"std_{i}"),
            F.min(v).alias(f"low_{i}"), F.max(v).alias(f"high_{i}"),
        ]
    if parse and name in kinds.text:
        out += [
            F.count(parse_number(col(name))).alias(f"numbers_{i}"),
            F.count(parse_timestamp(col(name))).alias(f"dates_{i}"),
        ]
    return out


def distinct_estimates(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Distinct values per column by sketch: one sketch per task and column is shuffled, no data.

    The sketches of many tasks are merged in two levels, since hundreds of thousands of them would
    otherwise meet in one task.
    """
    found: dict[str, int] = {}
    for block in chunks(names, LIMITS.columns_per_job):
        cells = [comparable(df, n) for n in block]
        merged = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(LIMITS.merge_tasks)).alias("_part")).agg(*[
            F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), SKETCH_LG_K).alias(f"d{i}")
            for i, c in enumerate(cells)])
        row = merged.agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"d{i}")) for i in range(len(block))]).first()
        found.update({n: d or 0 for n, d in zip(block, row)})
    return found


def table_stats(df: DataFrame, columns: Iterable[str] | None = None, *, sketch: bool = True,
                parse: bool = True) -> TableStats:
    """Counts, moments, ranges, distinct estimates and parse rates; ``df`` must be normalised."""
    names = list(columns) if columns is not None else list(df.columns)
    kinds = classify(df)
    types = dict(df.dtypes)
    stats: TableStats | None = None
    for block in chunks(names, LIMITS.columns_per_job) or [[]]:
        wanted = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(block):
            wanted += _column_aggregates(df, i, name, kinds, parse)
        row = df.agg(*wanted).first()
        stats = stats or TableStats(row["rows"])
        have = row.asDict()
        for i, name in enumerate(block):
            present = row[f"present_{i}"]
            stats.columns[name] = ColumnStats(
                name=name, dtype=types[name], present=present, missing=row["rows"] - present,
                mean=have.get(f"mean_{i}"), std=have.get(f"std_{i}"),
                low=have.get(f"low_{i}"), high=have.get(f"high_{i}"),
                number_rate=have[f"numbers_{i}"] / present if f"numbers_{i}" in have and present else None,
                date_rate=have[f"dates_{i}"] / present if f"dates_{i}" in have and present else None,
            )
    if sketch:
        for name, estimate in distinct_estimates(df, names).items():
            stats[name].distinct_estimate = estimate
    return stats
