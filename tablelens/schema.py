"""Type classes, column references and the one missing marker."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Columns:
    numeric: tuple[str, ...]
    text: tuple[str, ...]
    temporal: tuple[str, ...]
    boolean: tuple[str, ...]
    other: tuple[str, ...]


def classify(df: DataFrame, exclude: Iterable[str] = ()) -> Columns:
    """Split the columns of ``df`` by type class, keeping schema order."""
    skip = set(exclude)
    found: dict[str, list[str]] = {k: [] for k in Columns.__dataclass_fields__}
    for field in df.schema.fields:
        if field.name in skip:
            continue
        kind = field.dataType
        if isinstance(kind, T.NumericType):
            found["numeric"].append(field.name)
        elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            found["text"].append(field.name)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            found["temporal"].append(field.name)
        elif isinstance(kind, T.BooleanType):
            found["boolean"].append(field.name)
        else:
            found["other"].append(field.name)
    return Columns(**{k: tuple(v) for k, v in found.items()})


def col(name: str) -> Column:
    """Reference a column whose name may hold dots, blanks or back-quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalize(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL, so that there is one missing marker. One projection, and none on top of another."""
    if getattr(df, "_normalized", False):
        return df
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if floats:
        df = df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns])
        df._normalized = True
    return df


def comparable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be grouped, ordered and hashed."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(col(name))))
    if isinstance(kind, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(col(name))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name) + F.lit(0.0))
    return col(name)


def as_double(name: str) -> Column:
    return col(name).cast("double")


def chunks(items: Sequence, size: int) -> list[list]:
    return [list(items[i:i + size]) for i in range(0, len(items), size)]


def stack_rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn every row of ``df`` into one row per struct (all structs of one type)."""
    return df.select(F.inline(F.array(*structs)))


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def local_frame(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A report of a few driver-side rows (bounded by the number of columns); read without a job."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    columns = zip(*rows) if rows else [()] * len(fields)
    table = pa.table({n: pa.array(list(c), _ARROW[t]) for (n, t), c in zip(fields, columns)})
    return df.sparkSession.createDataFrame(table)


def local_rows(df: DataFrame, few: DataFrame) -> DataFrame:
    """A table whose rows are bounded by the number of columns, computed now and held by the driver."""
    return df.sparkSession.createDataFrame(few.toArrow())
