"""SimHash near-duplicates: fingerprints, a pigeonring index over their segments, and linked groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces, strings
from tablelens.llm.components import components
from tablelens.llm.shared import written

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str, width: int) -> int:
    """Majority of the bits of the XXH64 of every shingle of ``width`` words, repeats included."""
    words = text.encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        spans = zip(starts[at:upto].tolist(), ends[at + width - 1:upto + width - 1].tolist())
        h = np.fromiter((hashed(joined[s:e], SEED) for s, e in spans), np.uint64, upto - at)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp bigint) for every row of ``docs``; the text never leaves its task.

    A null or blank text has fingerprint zero; a text of fewer than ``width`` words is one shingle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(t, width) for t in strings(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["text_hash"], T.StructField("fp", T.LongType())]))


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments of the ring: three for each bit that may differ."""
    n = min(BITS, 3 * max(distance, 1))
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _budgets(n: int, distance: int) -> list[int]:
    """Length of the longest prefix of a chain that may hold t differing bits, for every t, below the whole ring."""
    return [max(i for i in range(1, n) if i * distance // n == t) for t in range((n - 1) * distance // n + 1)]


def _chains(n: int, distance: int) -> dict[tuple[int, ...], list[int]]:
    """Sets of segments to list fingerprints under, each with the starts of the chains that it stands for.

    By the pigeonring principle two fingerprints within ``distance`` have a start on the ring of n segments from which
    every prefix of i segments holds at most i * distance / n differing bits. Chains of n - 1 segments are used here.
    Such a chain begins with equal segments, and those of its segments that differ leave a set of equal ones: all such
    sets are the keys.
    """
    found: dict[tuple[int, ...], list[int]] = {}
    most = (n - 1) * distance // n

    def grow(start: int, length: int, equal: tuple[int, ...]):
        spent = length - len(equal)
        if length == n - 1:
            if spent == most:
                starts = found.setdefault(tuple(sorted(equal)), [])
                starts.extend([start] if start not in starts else [])
            return
        grow(start, length + 1, (*equal, (start + length) % n))
        if (spent + 1) * n <= (length + 1) * distance:
            grow(start, length + 1, equal)

    for start in range(n):
        grow(start, 0, ())
    return dict(sorted(found.items()))


def _mask(segments: list[tuple[int, int]], chosen: tuple[int, ...]) -> int:
    bits = reduce(lambda m, s: m | (((1 << segments[s][1]) - 1) << segments[s][0]), chosen, 0)
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _chain_ok(x: Column, chain: Column, segments: list[tuple[int, int]], distance: int) -> Column:
    """Whether a chain behind the shared key keeps the cumulative differences ``x`` of its prefixes within their budgets."""
    n, starts = len(segments), list(_chains(len(segments), distance).values())

    def spent(alternative: int, length: int) -> Column:
        masks = [_mask(segments, tuple((s[alternative % len(s)] + i) % n for i in range(length))) for s in starts]
        return F.bit_count(x.bitwiseAND(F.element_at(F.lit(masks), chain + 1)))

    return reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [spent(k, length) <= t for t, length in enumerate(_budgets(n, distance))])
        for k in range(max(map(len, starts)))
    ])


def candidates(prints: DataFrame, distance: int = 2, pruned: bool = True) -> DataFrame:
    """(a, b) with a < b for values of ``fp`` that share a key, once per key; ``pruned``: and pass a chain's budgets.

    With six segments for two bits a key spans about 43 bits, so the lists stay short even for billions of
    fingerprints. A pair of one key may differ at will in the two other segments; the chains behind the key allow
    one bit in the segment that they hold, so most pairs that meet by chance go before their full distance is taken.
    """
    segments = _segments(distance)
    one = prints.select("fp").where("fp is not null").distinct()
    keys = F.array(*[
        F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(F.lit(_mask(segments, c))).alias("part"))
        for i, c in enumerate(_chains(len(segments), distance))
    ])
    listed = one.select("fp", F.explode(keys).alias("k")).select("fp", "k.chain", "k.part")
    left = listed.select(F.col("fp").alias("a"), "chain", "part")
    right = listed.select(F.col("fp").alias("b"), "chain", "part")
    pairs = left.join(right, ["chain", "part"]).where("a < b")
    if pruned:
        pairs = pairs.where(_chain_ok(F.col("a").bitwiseXOR(F.col("b")), F.col("chain"), segments, distance))
    return pairs.select("a", "b")


def close_pairs(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) with a < b: all pairs of different values of ``fp`` at most ``distance`` bits apart, found by chains."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return candidates(prints, distance).where(near).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id) for every row of ``docs``, repeated rows too.

    ``component_id`` is the least doc_id that can be reached over links of at most ``distance`` bits, ``label`` a
    fingerprint of the group. Copies share a fingerprint and are one node of the graph, so groups of any size cost
    one row. Rows without a doc_id get the least doc_id of their group, or null if it has none.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(close_pairs(prints, distance))
    grouped = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        nodes["fp"].alias("key"), "first", F.coalesce("component", nodes["fp"]).alias("label")
    )
    least = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    labels = grouped.join(least, "label")
    return prints.join(labels, prints["fp"] == labels["key"]).select("doc_id", "text_hash", "fp", "label", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the least (doc_id, text hash) stays, once."""
    found = near_duplicates(docs, width, distance)
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(
        F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash")
    )
    keyed = docs.alias("d").join(
        first.hint("merge"),
        F.col("d.doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("d.text") == F.col("kept_hash")),
    )
    return keyed.dropDuplicates(["kept_id", "kept_hash"]).select("d.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
