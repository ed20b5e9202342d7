"""Exact, linearly interpolated quantiles of any number of columns at any table size.

``percentile`` is exact, but its buffer holds every distinct value of the column and ends up in one
task. Here the wanted order statistics are closed in by counting, at every table size the same way:
one scan counts the values of all columns in a few thousand equal bins, together with the smallest and
largest value of each bin; the bin that holds the rank becomes the range of the next scan, until it
holds one value or few enough to be ordered. A scan is a generated hash aggregation whose shuffle is
columns times bins rows, whatever the table size, and a value that fills a third of the table costs
nothing extra. Twelve significant bits are settled per scan, so that two or three scans are typical.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.operators.columnstats import ColumnStats, table_stats
from tablelens.schema import as_double, chunks
from tablelens.thresholds import LIMITS

_BINS = 4096


@dataclass
class _Range:
    """Values of ``column`` in [low, high]: ``inside`` of them, after ``below`` smaller ones."""

    column: str
    low: float
    high: float
    below: int
    inside: int
    ranks: set[int] = field(default_factory=set)   # zero-based order statistics wanted from here

    def bin_of(self) -> Column:
        """Bin number, growing with the value; infinities go to bins of their own. NULL outside."""
        v = as_double(self.column)
        low, high = (b if math.isfinite(b) else math.copysign(1.7e308, b) for b in (self.low, self.high))
        # The distance of two doubles may exceed the largest double; halved it does not.
        scale = 1.0 if math.isfinite(high - low) else 0.5
        place = F.floor((v * scale - low * scale) / F.lit(high * scale - low * scale) * _BINS)
        finite = F.greatest(F.lit(0), F.least(place, F.lit(_BINS - 1))).cast("int")
        kept = (F.when(v == float("inf"), F.lit(_BINS)).when(v == float("-inf"), F.lit(-1)).otherwise(finite)
                if math.isinf(self.low) or math.isinf(self.high) else finite)
        return F.when(v.between(self.low, self.high), kept)


def _cells(df: DataFrame, ranges: list[_Range]) -> DataFrame:
    """``(r, bin, v)``: every value once for each range that holds it."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("r"), r.bin_of().alias("bin"), as_double(r.column).alias("v"))
        for i, r in enumerate(ranges)
    ])).alias("c")).select("c.r", "c.bin", "c.v").filter("bin IS NOT NULL")


def _split(df: DataFrame, ranges: list[_Range]) -> list[_Range]:
    """The bins that hold the wanted ranks, as the next ranges."""
    counted = (_cells(df, ranges).groupBy("r", "bin")
               .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    order = Window.partitionBy("r").orderBy("bin")
    running = counted.withColumn("upto", F.sum("n").over(order))
    wanted = reduce(lambda a, b: a | b, [
        (F.col("r") == i) & (F.col("upto") > k - r.below) & (F.col("upto") - F.col("n") <= k - r.below)
        for i, r in enumerate(ranges) for k in r.ranks])
    found = []
    for row in running.filter(wanted).collect():
        r = ranges[row["r"]]
        below = r.below + row["upto"] - row["n"]
        found.append(_Range(r.column, row["low"], row["high"], below, row["n"],
                            {k for k in r.ranks if below <= k < below + row["n"]}))
    return found


def _order(df: DataFrame, ranges: list[_Range]) -> dict[tuple[str, int], float]:
    """Read the wanted values out of ranges with few values each."""
    counted = _cells(df, ranges).groupBy("r", "v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("r").orderBy("v")
    running = counted.withColumn("upto", F.sum("n").over(order))
    wanted = F.array(*[F.array(*[F.lit(k - r.below) for k in sorted(r.ranks)]) for r in ranges])
    hits = running.select("r", "v", F.explode(F.filter(
        F.element_at(wanted, F.col("r") + 1),
        lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n")))).alias("k"))
    return {(ranges[h["r"]].column, h["k"] + ranges[h["r"]].below): h["v"] for h in hits.collect()}


def exact_quantiles(df: DataFrame, probs: Sequence[float], stats: Mapping[str, ColumnStats], *,
                    buffer: int | None = None) -> dict[str, list[float | None]]:
    """Quantiles of the columns in ``stats``, which gives their counts and extreme values."""
    buffer = buffer or LIMITS.quantile_buffer
    found: dict[str, list[float | None]] = {n: [None] * len(probs) for n, c in stats.items() if not c.present}
    answers: dict[tuple[str, int], float] = {}
    open_ = [
        _Range(n, c.low, c.high, 0, c.present,
               {f(p * (c.present - 1)) for p in probs for f in (math.floor, math.ceil)})
        for n, c in stats.items() if n not in found]
    while open_:
        for r in [r for r in open_ if r.low == r.high]:
            answers.update({(r.column, k): r.low for k in r.ranks})
        open_ = [r for r in open_ if r.low != r.high]
        for block in chunks([r for r in open_ if r.inside <= buffer], LIMITS.columns_per_job):
            answers.update(_order(df, block))
        open_ = [s for block in chunks([r for r in open_ if r.inside > buffer], LIMITS.columns_per_job)
                 for s in _split(df, block)]
    for name, c in stats.items():
        if name not in found:
            at = [p * (c.present - 1) for p in probs]
            ends = [(answers[name, math.floor(r)], answers[name, math.ceil(r)]) for r in at]
            found[name] = [lo + (hi - lo) * (r - math.floor(r)) if hi > lo else lo
                           for r, (lo, hi) in zip(at, ends)]
    return found


def quantile(df: DataFrame, name: str, prob: float) -> float | None:
    """One exact quantile of one numeric column."""
    stats = table_stats(df, [name], sketch=False, parse=False)
    return exact_quantiles(df, [prob], stats.columns)[name][0] if stats[name].present else None
