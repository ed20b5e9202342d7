"""Line dedup by pairwise alignment: documents that share lines are patience-aligned, later copies of blocks go."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces, strings
from tablelens.llm.bounded import MOST_ROWS
from tablelens.llm.shared import written
from tablelens.llm.textcols import let

#: Words of a block that is deleted, and words that at least one of its lines must have: short lines repeat by chance.
BLOCK_WORDS, LINE_WORDS = 10, 4
#: A run's hash is a polynomial in the hashes of its lines, so that it costs the same for any number of lines (fixed values).
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
_PLACES = ("nth", "last", "line", "last_line", "before", "through")
RUNS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("key", T.LongType()),
    *[T.StructField(n, T.IntegerType()) for n in _PLACES],
])


def shortest_runs(words: Sequence[int], block_words: int, line_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of lines that make a block: from each line on, and up to each line.

    A block is a run of ``block_words`` words or more, one of whose lines has ``line_words`` or more. Every line of any
    block lies in one of its shortest runs, so whoever has the block has those runs too.
    """
    runs, start, total, long = set(), 0, 0, deque()
    n, end = len(words), 0
    for start in range(n):  # forward
        while end < n and (total < block_words or not long):
            total += words[end]
            if words[end] >= line_words:
                long.append(end)
            end += 1
        if total < block_words or not long:
            break
        runs.add((start, end - 1))
        total -= words[start]
        if long[0] == start:
            long.popleft()
    start, total, long = 0, 0, deque()
    for last in range(n):  # backward: the latest start that still makes a block
        total += words[last]
        if words[last] >= line_words:
            long.append(last)
        while start < last and total - words[start] >= block_words and (long and (long[0] > start or len(long) > 1)):
            if long[0] == start:
                long.popleft()
            total -= words[start]
            start += 1
        if total >= block_words and long:
            runs.add((start, last))
    return sorted(runs)


def run_rows(docs: DataFrame, block_words: int = BLOCK_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """One row per shortest run of lines: its hash and its place.

    ``nth`` and ``last`` number its first and last line among the lines that hold a word, ``line`` and ``last_line`` among
    all lines; ``before`` and ``through`` count the words of the text up to it and up to its end. Outer white space is no
    part of a line. A text has at most two runs for each line.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, key, places = [], [], []
            for r, text in enumerate(strings(b)):
                held = [(i, x.strip(), w) for i, x in enumerate(text.split("\n")) if (w := len(x.split()))]
                upto, hashed, power = [0], [0], [1]
                for _, x, w in held:
                    upto.append(upto[-1] + w)
                    hashed.append((hashed[-1] * _BASE + xxhash.xxh64_intdigest(x) + 1) % _PRIME)
                    power.append(power[-1] * _BASE % _PRIME)
                for first, last in shortest_runs([w for _, _, w in held], block_words, line_words):
                    rows.append(r)
                    key.append((hashed[last + 1] - hashed[first] * power[last + 1 - first]) % _PRIME)
                    places.append((first, last, held[first][0], held[last][0], upto[first], upto[last + 1]))
            take = pa.array(rows, pa.int64())
            at = np.array(places, np.int32).reshape(-1, len(_PLACES))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(2).take(take), pa.array(key, pa.int64()), *(pa.array(c) for c in at.T.copy())], names=RUNS.names)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, RUNS)


def _longest_chain(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (the piles of patience sorting, linked back)."""
    tops, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p], at[p] = v, i
        back[i] = at[p - 1] if p else -1
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = back[i]
    return chain[::-1]


def _aligned(runs: list[tuple], moved: bool) -> list[tuple]:
    """The common runs of a pair that are deleted: all of them, or those in the order of both documents.

    The patience chain is the longest series of runs that stand in one order in both; blocks beside it have ``moved``.
    """
    if moved:
        return runs
    order = sorted(runs, key=lambda r: (r[1], -r[0]))  # of runs with one start in the later document the chain takes one
    return [order[i] for i in _longest_chain([r[0] for r in order])]


def _cuts(runs: list[tuple], moved: bool) -> list[tuple[int, int, int, int]]:
    """(first, last, lines, words) of the ranges to delete from one document; runs are (owner, owner_hash, owner_nth, *_PLACES).

    Each run is a block by itself and has no gap in either document. What overlaps or touches is one range.
    """
    pairs: dict[tuple, list[tuple]] = {}
    for owner, owner_hash, *at in runs:
        pairs.setdefault((owner, owner_hash), []).append(at)
    out: list[list[int]] = []
    for _, nth, last, line, last_line, before, through in sorted((r for p in pairs.values() for r in _aligned(p, moved)), key=lambda r: r[1:3]):
        if out and nth <= out[-1][1] + 1:
            if last > out[-1][1]:
                out[-1][1], out[-1][3], out[-1][5] = last, last_line, through
        else:
            out.append([nth, last, line, last_line, before, through])
    return [(line, last_line, last - nth + 1, through - before) for nth, last, line, last_line, before, through in out]


def later_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, line_words: int = LINE_WORDS, moved: bool = True) -> DataFrame:
    """(doc_id, text_hash, cuts array<struct<first, last, lines, words>>): the line ranges to delete, 0-based.

    Documents are paired through runs of lines that just make a block, which are rare by their length: each run links a
    document to the earliest (least doc_id) one that has it, so a passage that a million documents share makes a million
    links, not their square, and no list of its owners is ever gathered. A block that a document shares with any
    earlier one is found, since that one, or a still earlier one, owns each of its runs. Common lines are then
    aligned pair by pair. Runs are compared by 64-bit hashes.
    """
    rows = written(run_rows(docs, block_words, line_words), "runs")
    owners = rows.groupBy("key").agg(
        F.min(F.struct("doc_id", "text_hash", "nth")).alias("o"), F.max("doc_id").alias("latest")
    ).where("o.doc_id < latest").select(
        "key", F.col("o.doc_id").alias("owner"), F.col("o.text_hash").alias("owner_hash"), F.col("o.nth").alias("owner_nth"))
    # written, so that both sides of the join are plain shuffles and Spark can split the runs of a frequent key
    common = rows.join(written(owners, "owners"), "key").where("owner < doc_id").drop("key")
    ordered = common.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    fields = ("owner", "owner_hash", "owner_nth", *_PLACES)
    cut = T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "last", "lines", "words")])
    schema = T.StructType([*RUNS.fields[:2], T.StructField("cuts", T.ArrayType(cut))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close() -> None:
            if now is not None and (found := _cuts(held, moved)):
                out.append((*now, [dict(zip(cut.names, c)) for c in found]))
            held.clear()

        def told() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([(n, pa.int32()) for n in cut.names])))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=schema.names)

        for b in batches:
            column = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "text_hash", *fields)}
            for doc, *row in zip(zip(column["doc_id"], column["text_hash"]), *(column[n] for n in fields)):
                if doc != now:
                    close()
                    now = doc
                held.append(row)
            if out:
                yield told()
        close()
        if out:
            yield told()

    return ordered.mapInArrow(run, schema)


def _without(text: Column, cuts: Column) -> Column:
    def rest(lines: Column, c: Column) -> Column:
        start = lambda i: F.coalesce(F.get(c, i - 1)["last"] + 1, F.lit(0))
        return F.array_join(F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(c)),
            lambda i: F.slice(lines, start(i) + 1, F.coalesce(F.get(c, i)["first"], F.size(lines)) - start(i)),
        )), "\n")

    return let(F.split(text, "\n"), lambda lines: let(cuts, lambda c: rest(lines, c)))


def dedup_lines(
    docs: DataFrame, block_words: int = BLOCK_WORDS, line_words: int = LINE_WORDS,
    names: Sequence[str] = ("n_removed_lines", "n_removed_words"), moved: bool = True,
) -> DataFrame:
    """Every row of ``docs``, repeated rows too, with ``text`` shortened, and the numbers of removed lines and words.

    A run of lines is deleted if a document of smaller doc_id has the same run, it has ``block_words`` words or more
    and one of its lines ``line_words`` or more; blank lines inside go with it, and so does every further copy of the
    run in the later document. A document that is a copy loses its whole text and keeps its row. Null texts stay
    null, rows without a doc_id stay as they are, rows that share a doc_id never cost each other lines, and a row
    that occurs twice has the same result twice.
    """
    cuts = written(later_blocks(docs, block_words, line_words, moved), "cuts")
    ranges = cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0
    cuts = F.broadcast(cuts) if ranges <= MOST_ROWS else cuts
    c = cuts.select(F.col("doc_id").alias("cut_doc"), F.col("text_hash").alias("cut_hash"), F.col("cuts").alias("cut_list"))
    d = docs.alias("d")
    joined = d.join(c, (F.col("d.doc_id") == F.col("cut_doc")) & (F.xxhash64("d.text") == F.col("cut_hash")), "left")
    total = lambda field: F.coalesce(F.aggregate("cut_list", F.lit(0).cast("bigint"), lambda a, x: a + x[field]), F.lit(0).cast("bigint"))
    text = F.when(F.col("cut_list").isNull(), F.col("d.text")).otherwise(_without(F.col("d.text"), F.col("cut_list")))
    return joined.select(
        *[text.alias("text") if n == "text" else F.col(f"d.`{n}`") for n in docs.columns],
        total("lines").alias(names[0]), total("words").alias(names[1]),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
