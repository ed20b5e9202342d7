"""Benchmark decontamination by winnowing: shared fingerprints, extended to exact spans, without user functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.bounded import broadcast_if_small
from tablelens.llm.shared import written
from tablelens.llm.textcols import let, positions

#: Words of a window; a shared span of at least this length is always found.
SPAN = 13
#: Words of a fingerprinted gram. Of every SPAN - GRAM + 1 consecutive grams the one with the least hash is kept.
GRAM = 5


def item_words(text: Column) -> Column:
    """Runs of digits, letters a to z (A to Z lowered) and characters beyond ASCII; none for a null text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _schemes(short: list[int], span: int, gram: int) -> list[tuple[int, int]]:
    """(words of a gram, grams of a window): winnowing for full windows, whole items for each shorter length."""
    return [(gram, span - gram + 1), *((n, 1) for n in short)]


def _grams(words: Column, k: int) -> Column:
    return F.transform(positions(1, F.size(words) - (k - 1)), lambda i: F.xxhash64(F.lit(k), F.slice(words, i, k)))


def _least(grams: Column, w: int) -> Column:
    return F.transform(positions(1, F.size(grams) - (w - 1)), lambda j: F.array_min(F.slice(grams, j, w)))


def _prints(words: Column, schemes: list[tuple[int, int]]) -> Column:
    """The distinct fingerprints of a text."""
    each = [let(_grams(words, k), lambda g, w=w: g if w == 1 else _least(g, w)) for k, w in schemes]
    return F.array_distinct(F.concat(*each))


def _places(words: Column, schemes: list[tuple[int, int]]) -> Column:
    """Every place of a fingerprint: its position and gram length, the words before it (nearest first) and from it on."""
    def of(k: int, w: int) -> Column:
        def places(g: Column, m: Column) -> Column:
            at = positions(1, F.size(g))
            kept = at if w == 1 else F.filter(
                at,
                lambda i: F.exists(
                    F.sequence(F.greatest(F.lit(1), i - (w - 1)), F.greatest(F.lit(1), F.least(i, F.size(m)))),
                    lambda j: F.coalesce(F.get(m, j - 1) == F.get(g, i - 1), F.lit(False)),
                ),
            )
            return F.transform(
                kept,
                lambda i: F.struct(
                    i.alias("pos"), F.lit(k).alias("k"), F.lit(w).alias("w"), F.get(g, i - 1).alias("fp"),
                    F.reverse(F.slice(words, F.greatest(F.lit(1), i - (w - 1)), F.least(i - 1, F.lit(w - 1)))).alias("before"),
                    F.slice(words, i, k + w - 1).alias("after"),
                ),
            )

        return let(_grams(words, k), lambda g: let(g if w == 1 else _least(g, w), lambda m: places(g, m)))

    return F.concat(*[of(k, w) for k, w in schemes])


def _same(a: Column, b: Column) -> Column:
    """How many words two lists have in common from their start."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(equal, False)
    return F.when(differs == 0, F.size(equal)).otherwise(differs - 1).cast("int")


def benchmark_prints(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(item_id, pos, k, w, fp, before, after) of every item with a word, written to the shared folder."""
    rows = items.select("item_id", item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.size("words")
    short = [r[0] for r in rows.where(size < span).select(size.alias("n")).distinct().orderBy("n").collect()]  # below span
    parts = []
    for k, w in _schemes(short, span, gram):
        own = rows.where(size >= span) if w > 1 else rows.where(size == k)
        parts.append(own.select("item_id", F.explode(let(F.col("words"), lambda x, s=(k, w): _places(x, [s]))).alias("p")))
    table = parts[0]
    for p in parts[1:]:
        table = table.union(p)
    return written(table.select("item_id", "p.*"), "benchmark"), _schemes(short, span, gram)


def contaminated_spans(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, item_id, first, last): word spans of documents that windows of items cover, 1-based.

    Every window shared by a document and an item holds a gram whose hash is least in it, in both. So the
    documents that share a fingerprint are found first, by fingerprints alone; only their words are then
    compared around each shared place. A window is at most span - gram words away from its fingerprint, and
    that much context goes with each place. Items without a word have no windows; repeated rows and documents
    with the same id and text give their spans once.
    """
    prints, schemes = benchmark_prints(items, span, gram)
    count = prints.limit(200_001).count()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    doc_prints = keyed.select(
        "doc_id", "text_hash", F.explode(let(item_words(F.col("text")), lambda x: _prints(x, schemes))).alias("fp")
    )
    sharing = written(
        doc_prints.join(broadcast_if_small(prints.select("fp").distinct(), count), "fp", "left_semi")
        .select("doc_id", "text_hash").distinct(),
        "sharing",
    )
    near = sharing.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    again = keyed.join(
        broadcast_if_small(near), keyed["doc_id"].eqNullSafe(near["d"]) & (keyed["text_hash"] == near["h"]), "left_semi"
    )
    places = again.select(
        "doc_id", "text_hash", F.explode(let(item_words(F.col("text")), lambda x: _places(x, schemes))).alias("p")
    ).select("doc_id", "text_hash", "p.pos", "p.fp", "p.before", "p.after")
    other = prints.select("item_id", "k", "w", "fp", F.col("before").alias("b2"), F.col("after").alias("a2"))
    met = places.join(broadcast_if_small(other, count), "fp").select(
        "doc_id", "text_hash", "item_id", "pos", "k", "w", _same(F.col("before"), F.col("b2")).alias("left"),
        _same(F.col("after"), F.col("a2")).alias("right"),
    )
    return met.where((F.col("right") >= F.col("k")) & (F.col("left") + F.col("right") >= F.col("k") + F.col("w") - 1)).select(
        "doc_id", "text_hash", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right") - 1).alias("last")
    )


def _union_length(spans: Column) -> Column:
    """Number of words in the union of (first, last) spans."""
    return F.aggregate(
        F.sort_array(spans),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["last"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["upto"], s["first"] - 1))).alias("n"),
        ),
        lambda a: a["n"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) for every row of ``docs``, repeated rows too.

    A null or wordless text has no words and no hits; with an empty benchmark nothing is contaminated. An item
    repeated under several ids counts once per id.
    """
    spans = contaminated_spans(docs, items, span, gram)
    hits = spans.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "last")).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    ).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), _union_length(F.col("spans")).alias("hit"), "items")
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.size(item_words(F.col("text"))).cast("bigint").alias("n_words")
    )
    joined = base.join(hits, base["doc_id"].eqNullSafe(hits["d"]) & (base["text_hash"] == hits["h"]), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_hash",
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items).drop("text_hash")


def oracle() -> str:
    def words(source: str) -> str:
        return (f"regexp_extract_all(translate(coalesce({source}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
                r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS w FROM documents),
b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), {SPAN}) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
lengths AS (SELECT DISTINCT n FROM n),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
met AS (SELECT rid, item_id, i, n FROM dw JOIN bw USING (n, x)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM met) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM met) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
