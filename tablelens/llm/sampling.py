"""Bounded samples of labelled rows: the only rows that ever reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.bounded import broadcast_if_small
from tablelens.llm.shared import written

#: Share of the 64-bit hashes that pass, taken this much larger than asked for, so that a sample is hardly ever short.
SPARE = 1.5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _uniform(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def sample_per_class(rows: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """About ``most`` to 1.5 * ``most`` rows per value of ``label`` (all rows of rarer values), one per ``key``.

    Rows are chosen by a hash of ``key``, so the sample is the same on any partitioning. Rows with equal keys
    collapse before the shuffle; without them a hot key could carry any number of rows into the sample.
    """
    sizes = rows.groupBy(label).count().collect()  # one row per class
    chance = F.lit(0.0)
    for r in sizes:
        chance = F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, SPARE * most / r["count"]))).otherwise(chance)
    return rows.withColumn("sample_key", key).where(_uniform(key) < chance).dropDuplicates([label, "sample_key"])


def sample_per_value(rows: DataFrame, label: str, key: Column, most: int, value: Column) -> DataFrame:
    """(label, sample_key, value): a sample as of ``sample_per_class`` for a column of any number of values.

    The sizes are a table that is joined, not a plan with a branch per value. Only ``value``, made of the rows
    that were drawn, is shuffled. Rows without a label go.
    """
    sizes = written(rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("class_rows")), "sizes")
    drawn = rows.withColumn("sample_key", key).join(broadcast_if_small(sizes), F.col(label) == F.col("class"))
    drawn = drawn.where(_uniform(F.col("sample_key")) < SPARE * most / F.col("class_rows"))
    return drawn.select(label, "sample_key", value.alias("value")).dropDuplicates([label, "sample_key"])
