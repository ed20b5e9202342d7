"""Descriptive statistics, top categories, correlations and the usual grouped questions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablelens.operators.columnstats import TableStats, table_stats
from tablelens.operators.frequency import value_frequency
from tablelens.operators.quality import small_text_columns
from tablelens.operators.quantiles import exact_quantiles
from tablelens.schema import as_double, classify, col, local_frame, normalize
from tablelens.thresholds import DEFAULTS, Thresholds


def numeric_summary(df: DataFrame, stats: TableStats | None = None,
                    medians: dict[str, list[float | None]] | None = None) -> DataFrame:
    """``(column_name, mean, median, std, min, max)``, two decimals, columns without values left out."""
    df = normalize(df)
    stats = stats or table_stats(df, classify(df).numeric, sketch=False, parse=False)
    present = stats.numeric(df)
    if medians is None:
        medians = exact_quantiles(df, [0.5], present)
    return local_frame(df, [
        (n, round(c.mean, 2), round(medians[n][0], 2), round(c.std, 2) if c.std is not None else 0.0,
         round(c.low, 2), round(c.high, 2))
        for n, c in present.items()
    ], "column_name string, mean double, median double, std double, min double, max double")


def top_categories(df: DataFrame, exclude: Iterable[str] = (), stats: TableStats | None = None,
                   limits: Thresholds = DEFAULTS, frequency: DataFrame | None = None) -> DataFrame:
    """``(column_name, rank, value, n)`` for text columns with few distinct values."""
    df = normalize(df)
    names = [n for n in small_text_columns(df, limits.top_categories_max_distinct, stats) if n not in set(exclude)]
    if frequency is None:
        frequency = value_frequency(df, names)
    per_column = Window.partitionBy("column_name")
    # The window sees at most about twenty rows per column.
    return (frequency.filter(F.col("column_name").isin(names))
            .withColumn("distinct_values", F.count(F.lit(1)).over(per_column))
            .withColumn("rank", F.row_number().over(per_column.orderBy(F.desc("n"), "value")))
            .filter((F.col("distinct_values") <= limits.top_categories_max_distinct)
                    & (F.col("rank") <= limits.top_categories))
            .select("column_name", "rank", "value", "n"))


# --- correlations ---------------------------------------------------------------------------------

#: Columns whose pairs are merged as rows; more are merged as tiles of so many columns each way.
NARROW, TILE = 64, 128
#: Groups that the partial tiles of all tasks are merged in before the last merge.
TILE_GROUPS = 32
_TILES = "ti int, tj int, part int, cells binary"


def _tiles(both: np.ndarray, sums: np.ndarray, squares: np.ndarray, products: np.ndarray,
           tile: int, groups: int) -> Iterator[pa.RecordBatch]:
    """One row per tile on or above the diagonal: n, sx, sy, sxx, syy, sxy of its pairs of columns as bytes."""
    part = TaskContext.get().partitionId() % groups
    starts = range(0, len(both), tile)
    for i, j in combinations_with_replacement(starts, 2):
        a, b = slice(i, i + tile), slice(j, j + tile)
        cells = np.stack([both[a, b], sums[a, b], sums[b, a].T, squares[a, b], squares[b, a].T, products[a, b]])
        yield pa.RecordBatch.from_pydict({
            "ti": pa.array([i], pa.int32()), "tj": pa.array([j], pa.int32()), "part": pa.array([part], pa.int32()),
            "cells": pa.array([cells.tobytes()], pa.binary())})


def _tile_sum(table: pa.Table) -> np.ndarray:
    total = np.zeros(len(table["cells"][0].as_py()) // 8)
    for cell in table["cells"]:
        total += np.frombuffer(cell.as_buffer(), float)
    return total


def _merged_tiles(tiles: DataFrame, c: int) -> np.ndarray:
    """Correlations of ``c`` columns, NaN where there is none. Tiles are added up in two levels; the driver gets coefficients."""
    def add(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(3, "cells", pa.array([_tile_sum(table).tobytes()], pa.binary()))

    def finish(table: pa.Table) -> pa.Table:
        n, sx, sy, sxx, syy, sxy = _tile_sum(table).reshape(6, -1)
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        flat = (n < 2) | (vx <= 1e-12 * n * sxx) | (vy <= 1e-12 * n * syy)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(flat, np.nan, np.clip((n * sxy - sx * sy) / (np.sqrt(vx) * np.sqrt(vy)), -1.0, 1.0))
        return table.slice(0, 1).set_column(3, "cells", pa.array([r.tobytes()], pa.binary()))

    merged = tiles.groupBy("ti", "tj", "part").applyInArrow(add, _TILES).groupBy("ti", "tj").applyInArrow(finish, _TILES)
    out = np.full((c, c), np.nan)
    for t in merged.collect():  # 8 bytes per pair of columns
        rows, columns = min(TILE, c - t["ti"]), min(TILE, c - t["tj"])
        out[t["ti"]:t["ti"] + rows, t["tj"]:t["tj"] + columns] = np.frombuffer(t["cells"], float).reshape(rows, columns)
    return out


def pair_correlations(df: DataFrame, stats: TableStats | None = None) -> list[tuple[str, str, float | None]]:
    """Pearson's r over the rows where both columns have a value; None where it is undefined.

    One scan for all pairs: each task multiplies its batches as matrices and emits one partial matrix;
    the partial matrices are added up by position. Thirty aggregate expressions would already leave
    generated code, and their number grows with the square of the columns. Values are centred by the
    column means first, so that the sums of squares keep their precision.
    """
    names = list(classify(df).numeric)
    if len(names) < 2:
        return []
    stats = stats or table_stats(df, names, sketch=False, parse=False)
    centre = np.array([stats[n].mean or 0.0 for n in names])
    c, tile, groups = len(names), TILE, TILE_GROUPS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, sums, squares, products = (np.zeros((c, c)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([a.to_numpy(zero_copy_only=False) for a in batch.columns]).astype(float) - centre
            seen = ~np.isnan(x)
            m = seen.astype(float)
            x = np.where(seen, x, 0.0)
            both += m.T @ m
            sums += x.T @ m
            squares += (x * x).T @ m
            products += x.T @ x
        if c > NARROW:
            yield from _tiles(both, sums, squares, products, tile, groups)
            return
        i, j = np.triu_indices(c, 1)
        yield pa.RecordBatch.from_pydict({
            "i": i.astype(np.int32), "j": j.astype(np.int32), "n": both[i, j], "sx": sums[i, j], "sy": sums[j, i],
            "sxx": squares[i, j], "syy": squares[j, i], "sxy": products[i, j],
        })

    cells = df.select(*[as_double(n).alias(f"c{k}") for k, n in enumerate(names)])
    if c > NARROW:
        found = _merged_tiles(cells.mapInArrow(partial, _TILES), c)
        return [(names[i], names[j], None if np.isnan(found[i, j]) else float(found[i, j])) for i, j in combinations(range(c), 2)]
    totals = (cells.mapInArrow(partial, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
              .groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in ("n", "sx", "sy", "sxx", "syy", "sxy")]))
    found = {}
    for t in totals.collect():
        vx, vy = t["n"] * t["sxx"] - t["sx"] ** 2, t["n"] * t["syy"] - t["sy"] ** 2
        # Spread that is rounding noise of the centred sums counts as none.
        flat = t["n"] < 2 or vx <= 1e-12 * t["n"] * t["sxx"] or vy <= 1e-12 * t["n"] * t["syy"]
        found[t["i"], t["j"]] = None if flat else float(
            np.clip((t["n"] * t["sxy"] - t["sx"] * t["sy"]) / (vx ** 0.5 * vy ** 0.5), -1.0, 1.0))
    return [(names[i], names[j], found.get((i, j))) for i, j in combinations(range(c), 2)]


def correlation_matrix(df: DataFrame, pairs: list[tuple[str, str, float | None]] | None = None,
                       stats: TableStats | None = None) -> DataFrame:
    """``(column_a, column_b, correlation)``, both triangles and the diagonal; heat-map data."""
    df = normalize(df)
    stats = stats or table_stats(df, classify(df).numeric, sketch=False, parse=False)
    pairs = pair_correlations(df, stats) if pairs is None else pairs
    rows = [(a, b, r) for a, b, r in pairs] + [(b, a, r) for a, b, r in pairs]
    if pairs:
        rows += [(n, n, 1.0 if stats[n].std else None) for n in classify(df).numeric]
    return local_frame(df, rows, "column_a string, column_b string, correlation double")


def top_correlations(df: DataFrame, pairs: list[tuple[str, str, float | None]] | None = None,
                     limits: Thresholds = DEFAULTS) -> DataFrame:
    """The strongest relations, each pair once, by absolute value of the rounded coefficient."""
    df = normalize(df)
    pairs = pair_correlations(df) if pairs is None else pairs
    kept = [(a, b, round(r, 2)) for a, b, r in pairs if r is not None and abs(r) >= limits.min_correlation]
    kept.sort(key=lambda p: -abs(p[2]))
    return local_frame(df, [(i + 1, *p) for i, p in enumerate(kept[:limits.top_correlations])],
                       "rank int, column_a string, column_b string, correlation double")


# --- grouped questions ----------------------------------------------------------------------------

_MEASURES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def group_aggregate(df: DataFrame, keys: list[str], value: str, measures: Iterable[str] = ("sum", "avg")) -> DataFrame:
    """Sum, average and the like of ``value`` by category."""
    return df.groupBy(*[col(k) for k in keys]).agg(*[
        _MEASURES[m](col(value)).alias(f"{m}_{value}") for m in measures])


def top_k_entities(df: DataFrame, keys: list[str], value: str, k: int = 10, measure: str = "sum") -> DataFrame:
    """The ``k`` groups with the largest total; ties go to the smaller key."""
    name = f"{measure}_{value}"
    return (df.groupBy(*[col(c) for c in keys]).agg(_MEASURES[measure](col(value)).alias(name))
            .orderBy(F.desc(name), *[col(c) for c in keys]).limit(k))


def period_change(df: DataFrame, time: str, value: str, segment: str, unit: str = "month") -> DataFrame:
    """Change of a total between neighbouring periods and what each segment contributed to it.

    ``contribution`` is the change of the segment divided by the change of the whole. A segment that is
    absent in a period counts as 0 there. The windows run over totals only (periods times segments).
    """
    totals = df.groupBy(F.date_trunc(unit, col(time)).cast("timestamp_ntz").alias("period"), col(segment).alias("segment")) \
        .agg(F.sum(col(value)).alias("total"))
    periods = totals.groupBy("period").agg(F.sum("total").alias("whole"))
    order = Window.orderBy("period")
    periods = periods.select("period", "whole", F.lag("period").over(order).alias("before"),
                             F.lag("whole").over(order).alias("whole_before"))
    link = periods.filter("before IS NOT NULL")
    now = totals.join(link, "period").select(
        "period", "segment", "total", F.lit(0.0).alias("earlier"))
    then = totals.withColumnRenamed("period", "before").join(link.select("period", "before"), "before").select(
        "period", "segment", F.lit(0.0).alias("total"), F.col("total").alias("earlier"))
    moved = now.unionByName(then).groupBy("period", "segment").agg(
        F.sum("total").alias("total"), F.sum("earlier").alias("earlier"))
    change = F.col("total") - F.col("earlier")
    return moved.join(link.select("period", (F.col("whole") - F.col("whole_before")).alias("whole_change")), "period") \
        .select("period", "segment", "total", change.alias("change"), "whole_change",
                F.try_divide(change, F.col("whole_change")).alias("contribution"))
