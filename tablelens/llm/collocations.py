"""Phrase collocations from count streams kept in prefix and suffix order and merge-joined in lockstep."""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.batches import pieces
from tablelens.llm.bounded import broadcast_if_small
from tablelens.llm.shared import delete, written

#: Least occurrences of a phrase, most words in it, phrases reported for each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Share of a phrase's occurrences, in percent, that a longer one must hold to replace it.
INSIDE = 100
#: Bits of the filter of frequent words or word pairs: 8 MB, whatever the number of phrases. It lets some rare ones
#: pass, which are counted and then dropped like any other, and stops no frequent one.
FILTER_BITS = 1 << 26
#: Bits that one aggregate of bitmap_construct_agg covers.
_CHUNK = 32_768

#: Ends of pieces become " . ", which no word is; words lie between blanks and tabs. Only A to Z are lowered.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def _tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in order, with b"." between pieces and between texts."""
    return b".".join(texts).lower().translate(_ENDS).replace(b".", b" . ").split()


def _bits(lang: bytes, grams: list[bytes], mask: bytes) -> np.ndarray:
    """Which grams the filter lets pass."""
    start = crc32(lang + b"\n")
    at = np.fromiter((crc32(g, start) for g in grams), np.int64, len(grams)) % (8 * len(mask))
    held = np.frombuffer(mask, np.uint8)
    return (held[at >> 3] >> (at & 7)) & 1 == 1


def _counted(lang: bytes, tokens: list[bytes], lo: int, hi: int, filters: dict[int, bytes]) -> Iterator[tuple[list[bytes], int, np.ndarray]]:
    """(grams, their number of words, their counts) for each length from ``lo`` to ``hi``; a filtered gram starts no longer one.

    A gram of k words is a pair of overlapping grams of k - 1 words, so each length needs one sort of numbers.
    """
    encoded = pa.array(tokens, pa.binary()).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary)  # numbers in the order of words: grams leave in prefix order
    words = encoded.dictionary.take(order).to_pylist()
    number = np.empty(len(words), np.int64)
    number[order.to_numpy()] = np.arange(len(words))
    code = number[encoded.indices.to_numpy()]
    ok = np.array([w != b"." for w in words], bool)
    if lo == 1:
        n = np.bincount(code, minlength=len(words))[ok]
        yield [b""], 0, n.sum(keepdims=True)
        yield [w for w, x in zip(words, ok) if x], 1, n
    for k in range(1, hi + 1):
        if k > 1:
            at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
            pair = code[at] * (code.max(initial=0) + 1) + code[at + 1]
            _, first, inverse, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            words = [b" ".join(tokens[i:i + k]) for i in at[first].tolist()]
            code = np.full(len(code), -1, np.int64)
            code[at] = inverse
            ok = np.ones(len(words), bool)
            if k >= lo:
                yield words, k, n
        if k < hi and words:
            if k in filters:
                ok &= _bits(lang, words, filters[k])
            code = np.where((code >= 0) & ok[code], code, -1)


def _grams(docs: DataFrame, lo: int, hi: int, filters: dict[int, bytes]) -> DataFrame:
    """(lang, gram, k, n) of every gram of ``lo`` to ``hi`` words; with ``lo`` 1 also k = 0, the empty gram: all words."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, rows=1 << 16):
            by_lang = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                for grams, k, n in _counted(lang.encode(), _tokens(texts), lo, hi, shared.value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(lang, len(grams)), pa.array(grams, pa.binary()).cast(pa.string()),
                         pa.repeat(pa.scalar(k, pa.int32()), len(grams)), pa.array(n, pa.int64())], ["lang", "gram", "k", "n"])

    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(
        run, "lang string, gram string, k int, n bigint"
    )
    # counted per batch already: dealt by gram at once, so that no task holds a table of its own grams
    return each.repartition("lang", "gram").groupBy("lang", "gram", "k").agg(F.sum("n").alias("n"))


def _filter(frequent: DataFrame, bits: int) -> bytes:
    """A bitmap of the checksums of (lang, gram); built by the executors in pieces of 4 KB, its size is fixed."""
    h = F.crc32(F.concat("lang", F.lit("\n"), "gram").cast("binary")) % bits + 1
    rows = frequent.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")
    ).collect()  # at most bits / 32768 rows
    whole = bytearray(-(-bits // _CHUNK) * _CHUNK // 8)
    for r in rows:
        start = (r["chunk"] - 1) * _CHUNK // 8
        whole[start:start + len(r["bits"])] = r["bits"]
    return bytes(whole)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, gram, k, n): exact counts of every phrase of 1 to ``longest`` words that occurs at least ``least`` times.

    k = 0 is the empty phrase, counted once for each word of the language. A phrase can only be frequent if its
    parts are: pairs are counted among frequent words, longer phrases among frequent pairs.
    """
    if bits % _CHUNK:
        raise ValueError(f"bits must be a multiple of {_CHUNK}")
    frequent = (F.col("n") >= least) | (F.col("k") == 0)
    tables, filters = [], {}
    for lo, hi in ((1, 1), (2, 2), (3, longest)):
        if lo <= min(hi, longest):
            tables.append(written(_grams(docs, lo, hi, filters).where(frequent), f"grams-{lo}"))
            if lo < min(longest, 3):
                filters[lo] = _filter(tables[-1].where("k > 0"), bits)
    counts = tables[0]
    for t in tables[1:]:
        counts = counts.union(t)
    kept = written(counts, "phrase-counts")
    for t in tables:
        delete(t)
    return kept


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A to Z), cut at sentence marks and line ends, then at blanks; a null lang is ``und``, a
    null text is empty, extra columns are not read and every row counts, repeated ones too. score is
    floor(1000 * a * n / (l * r)) at the cut where that is least, the first of equal cuts. Phrases that stand inside a
    longer frequent one ``inside`` percent of the time are left out.

    The counts are kept as two streams: cuts in the order of their first part and in the order of their rest, each
    merge-joined in lockstep with the counts. A part with very many phrases is split by the skew join. In the
    same streams the longest proper parts carry the count of their extension.
    """
    counts = phrase_counts(docs, least, longest, bits)
    words = F.split("gram", " ")
    cuts = counts.where("k >= 2").select(
        "lang", F.col("gram").alias("phrase"), "k", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).select(
        "lang", "phrase", "k", "a", "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " ").alias("rest"),
    )
    first = counts.where("k > 0").select("lang", F.col("gram").alias("first"), F.col("n").alias("l"))
    rest = counts.where("k > 0").select("lang", F.col("gram").alias("rest"), F.col("n").alias("r"))
    total = counts.where("k = 0").select("lang", F.col("n").alias("n"))
    both = cuts.join(first.hint("merge"), ["lang", "first"]).join(rest.hint("merge"), ["lang", "rest"]).join(broadcast_if_small(total), "lang")
    exact = {c: f"CAST({c} AS DECIMAL(18,0))" for c in "anlr"}
    score = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {exact['a']} * {exact['n']}) DIV ({exact['l']} * {exact['r']})")
    scored = both.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))
    longer = cuts.where("k >= 3")
    extended = longer.where("cut = k - 1").select("lang", F.col("first").alias("phrase"), "a").union(
        longer.where("cut = 1").select("lang", F.col("rest").alias("phrase"), "a")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("extension"))
    open_ends = F.coalesce(100 * F.col("extension") < inside * F.col("a"), F.lit(True))
    free = scored.join(extended.hint("merge"), ["lang", "phrase"], "left").where(open_ends)
    # only the first `top` rows of a language in each task reach the ranking
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), F.asc("phrase")))
    ranked = free.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n",
                         F.col("s.score").alias("score"), F.col("s.cut").alias("cut"))


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE) -> str:
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?
-
]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {longest + 1}) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT *, string_split(phrase, ' ') AS x, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, l.a AS l, r.a AS r, n.n, (1000 * c.a * n.n) // (l.a * r.a) AS score
      FROM c JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.x[:c.cut], ' ')
      JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.x[c.cut + 1:], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
free AS (SELECT * FROM best AS b WHERE NOT EXISTS (
      SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND 100 * f.a >= {inside} * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, cut::INTEGER AS cut
FROM o WHERE rank <= {top}
"""
