"""Value frequencies and exact distinct counts of many columns in one shuffle.

``count_distinct`` over N columns plans an Expand that keeps every row N times up to the shuffle keys
of *all* columns together. Here the columns are unpivoted and counted per (column, value): the partial
aggregation collapses frequent values before the shuffle, so that a value which fills a third of the
table costs one row per task, and rare ones are spread by hash.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.parse import fold_category
from tablelens.schema import classify, comparable, local_frame


def _unpivot(df: DataFrame, cells: list[Column]) -> DataFrame:
    """``(c, value)`` with the number of the column: grouping by a number is cheaper than by a name."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), v.alias("value")) for i, v in enumerate(cells)
    ])).alias("cell")).select("cell.c", "cell.value")


def _name(names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1).alias("column_name")


def value_frequency(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``(column_name, value, n)``, values as text, NULLs left out."""
    names = list(columns) if columns is not None else list(classify(df).text)
    if not names:
        return local_frame(df, [], "column_name string, value string, n bigint")
    cells = [comparable(df, n).cast("string") for n in names]
    return (_unpivot(df, cells).filter("value IS NOT NULL").groupBy("c", "value")
            .agg(F.count(F.lit(1)).alias("n")).select(_name(names), "value", "n"))


def _family(kind: T.DataType) -> str:
    """The narrowest common type under which different values stay different."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return "timestamp_ntz"
    if isinstance(kind, T.TimestampType):
        return "timestamp"
    return "string"


#: Longest text that is compared as it is. A fingerprint is written with one byte more, so no text equals one.
LONG_TEXT = 32


def _short(text: Column) -> Column:
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), text)), 16, "0") for seed in (1, 2)]
    return F.when(F.octet_length(text) > LONG_TEXT, F.concat(F.lit("#"), *halves)).otherwise(text)


def distinct_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``(column_name, distinct_count)``, NULLs left out, 0 for columns without values. Exact.

    A text of over ``LONG_TEXT`` bytes is counted by a fingerprint of 128 bits, so what is shuffled per row does not
    grow with its length.
    """
    names = list(columns) if columns is not None else list(df.columns)
    if not names:
        return local_frame(df, [], "column_name string, distinct_count bigint")
    families: dict[str, list[str]] = {}
    for n in names:
        families.setdefault(_family(df.schema[n].dataType), []).append(n)
    parts = []
    for kind, members in families.items():
        cells = [comparable(df, n).cast(kind) for n in members]
        cells = [_short(c) for c in cells] if kind == "string" else cells
        parts.append(_unpivot(df, cells).distinct().groupBy("c").agg(F.count("value").alias("distinct_count"))
                     .select(_name(members), "distinct_count"))
    return reduce(DataFrame.unionAll, parts)


def most_frequent_value(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The mode of each column; the smaller value wins a tie."""
    v = value_frequency(df, columns)
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
    return v.groupBy("column_name").agg(best.alias("b")).select(
        "column_name", F.col("b.value").alias("value"), (-F.col("b.neg")).alias("n"))


def spelling_groups(frequency: DataFrame) -> DataFrame:
    """Frequencies with the folded form of each value added."""
    return frequency.withColumn("folded", fold_category(F.col("value")))


def canonical_spellings(frequency: DataFrame) -> DataFrame:
    """``(column_name, folded, canonical)``: the commonest spelling of each folded value."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
    return (spelling_groups(frequency).groupBy("column_name", "folded").agg(best.alias("b"))
            .select("column_name", "folded", F.col("b.value").alias("canonical")))
