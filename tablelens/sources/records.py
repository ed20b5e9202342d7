"""Records that span lines, found in parallel: what a split does to the state of a reader is a function of that state.

A quoted CSV value may hold line breaks, and a JSON list may be one line of any length; where a record begins depends
on everything before it. But a reader at a delimiter is in one of few states, so each split tells in one pass where it
leads from each of them; these functions, one small row per split, are composed from the start of the file on. A
second pass then knows the state in which each split begins and cuts it into records. Only records that cross the
border of splits are put together, by a grouping of their fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablelens.sources.scratch import materialize
from tablelens.thresholds import LIMITS

_KEY = "file string, block bigint"


@dataclass(frozen=True)
class QuotedLines:
    """CSV: a line ends a record unless a quoted value is open. A quote opens a value only where the value begins."""

    encoding: str = "UTF-8"
    delimiter = "\n"
    closing = ""
    _complete = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+')
    _inside = re.compile(r'[^"]*+(?:""[^"]*+)*+')

    def plain(self, piece: str) -> bool:
        return '"' not in piece

    def step(self, open_: int, depth: int, piece: str) -> tuple[int, int]:
        at = 0
        if open_:
            at = self._inside.match(piece).end()
            if at == len(piece):
                return 1, 0
            at = piece.find(",", at + 1) + 1  # what follows a closing quote belongs to the value
            if not at:
                return 0, 0
        at = self._complete.match(piece, at).end()
        if piece[at:at + 1] != '"':
            return 0, 0
        return int(self._inside.match(piece, at + 1).end() == len(piece)), 0

    def ends(self, open_: int, depth: int) -> bool:
        return not open_

    def blank(self, text: str) -> bool:
        return text in ("", "\r")


@dataclass(frozen=True)
class ListedObjects:
    """A JSON list of objects, read from one closing brace to the next: one that leaves depth 1 ends a record."""

    encoding: str = "UTF-8"
    delimiter = "}"
    closing = "}"
    _string = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
    _inside = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+', re.S)

    def plain(self, piece: str) -> bool:
        return False

    def step(self, open_: int, depth: int, piece: str) -> tuple[int, int]:
        if open_:
            at = self._inside.match(piece).end()
            if at >= len(piece) or piece[at] != '"':
                return 1, depth
            piece = piece[at + 1:]
        bare = self._string.sub("", piece) if '"' in piece else piece
        start = bare.find('"')
        if start >= 0:
            bare = bare[:start]
        depth += bare.count("{") + bare.count("[") - bare.count("]")
        return (1, depth) if start >= 0 else (0, depth - 1)

    def ends(self, open_: int, depth: int) -> bool:
        return not open_ and depth == 1

    def blank(self, text: str) -> bool:
        return False


Format = QuotedLines | ListedObjects


def _pieces(spark: SparkSession, files: str | list[str], form: Format) -> DataFrame:
    """(file, block, piece) in file order inside each split; bytes, since the encoding is the format's."""
    return spark.read.option("lineSep", form.delimiter).text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"), F.monotonically_increasing_id().alias("nth"))


def _ends_of_splits(pieces: DataFrame, form: Format) -> DataFrame:
    """(file, block, open0, depth0, open1, depth1): the state at a split's end, from outside and from inside a quoted value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, None

        def told() -> pa.RecordBatch:
            (o0, d0), (o1, d1) = states
            return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "open0": [o0], "depth0": [d0], "open1": [o1], "depth1": [d1]})

        for b in batches:
            for file, block, piece in zip(*(b.column(i).to_pylist() for i in range(3))):
                if key != (file, block):
                    if key is not None:
                        yield told()
                    key, states = (file, block), ((0, 0), (1, 0))
                piece = piece.decode(form.encoding, "replace")
                if not form.plain(piece):
                    states = tuple(form.step(o, d, piece) for o, d in states)
        if key is not None:
            yield told()

    return pieces.select("file", "block", "piece").mapInArrow(run, f"{_KEY}, open0 bigint, depth0 bigint, open1 bigint, depth1 bigint")


def _starts(ends: DataFrame) -> DataFrame:
    """(file, block, open, depth): the state in which each split begins; the rows of a file are its splits."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        open_, depth, out = 0, 0, []
        for r in pdf.itertuples(index=False):
            out.append((r.file, r.block, open_, depth))
            open_, depth = (r.open1, depth + r.depth1) if open_ else (r.open0, depth + r.depth0)
        return pd.DataFrame(out, columns=["file", "block", "open", "depth"])

    return ends.groupBy("file").applyInPandas(compose, f"{_KEY}, open bigint, depth bigint")


def _cut(pieces: DataFrame, form: Format) -> DataFrame:
    """(file, block, n, head, open, text): records and fragments. A head continues the split before, an open one goes on in the next."""
    schema = f"{_KEY}, n bigint, head boolean, open boolean, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, n, head, out = None, (0, 0), [], 0, False, []

        def close(open_: bool) -> None:
            nonlocal n, head, held
            text, held = form.delimiter.join(held) + ("" if open_ else form.closing), []
            if head or open_ or not form.blank(text):
                out.append((*key, n, head, open_, text))
                n += 1
            head = False

        def told() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.bool_()),
                 pa.array(columns[4], pa.bool_()), pa.array(columns[5], pa.string())], ["file", "block", "n", "head", "open", "text"])

        for b in batches:
            for file, block, piece, open_, depth in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "block", "piece", "open", "depth"))):
                if key != (file, block):
                    if held:
                        close(True)
                    key, state, n = (file, block), (open_, depth), 0
                    head = block > 0 and not form.ends(*state)
                piece = piece.decode(form.encoding, "replace")
                held.append(piece)
                if not form.plain(piece):
                    state = form.step(*state, piece)
                if form.ends(*state):
                    close(False)
            if out:
                yield told()
        if held:
            close(True)
        if out:
            yield told()

    return pieces.mapInArrow(run, schema)


def records(spark: SparkSession, files: str | list[str], form: Format) -> DataFrame:
    """(file, first, closed, text): every record of the files; ``first`` marks a file's first, ``closed`` is false for what is left at its end."""
    pieces = _pieces(spark, files, form)
    starts = materialize(_starts(_ends_of_splits(pieces, form)), "splits")
    if starts.limit(LIMITS.broadcast_rows + 1).count() <= LIMITS.broadcast_rows:
        begun = pieces.join(F.broadcast(starts), ["file", "block"])  # keeps the order inside a split
    else:
        begun = pieces.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "nth")
    cut = _cut(begun.select("file", "block", "piece", "open", "depth"), form)
    across = F.col("head") | F.col("open")
    # at most two fragments per split
    group = F.sum(F.when(F.col("head"), 0).otherwise(1)).over(Window.partitionBy("file").orderBy("block", "n"))
    joined = cut.where(across).withColumn("record", group).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "n", "open", "text"))).alias("parts"))
    place = (F.col("parts")[0]["block"] == 0) & (F.col("parts")[0]["n"] == 0)
    joined = joined.select("file", place.alias("first"), (~F.element_at("parts", -1)["open"]).alias("closed"),
                           F.array_join(F.col("parts")["text"], form.delimiter).alias("text"))
    alone = cut.where(~across).select("file", ((F.col("block") == 0) & (F.col("n") == 0)).alias("first"), F.lit(True).alias("closed"), "text")
    return alone.unionByName(joined)
