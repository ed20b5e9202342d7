"""Column helpers for whole texts, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words: blank, and tab to carriage return.
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def space_words(text: Column) -> Column:
    """Maximal runs of characters other than SPACES; none for null and blank texts."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+")
    )


def positions(first: int, last: Column) -> Column:
    """The whole numbers from ``first`` to ``last``; none if ``last`` is smaller."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def texts(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """Only the named columns, so that extra columns, whatever their names, can't clash."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
