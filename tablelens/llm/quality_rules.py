"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.textcols import let, positions, space_words, texts

#: Frequent function words of the languages of the corpus, lower case, no punctuation.
STOP_WORDS = {
    "de": "als auch auf aus bei das dem den der des die ein eine für im in ist mit nicht sich sie und von war wie zu".split(),
    "en": "a and are as at be by for from in is it not of on or that the this to was what with you".split(),
    "es": "al con de del el en es la las lo los no para por que se su un una y".split(),
    "fr": "au avec dans de des du elle en est et il la le les ne pas pour que qui sur un une".split(),
}
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``percent * of`` bounds ``100 * metric`` from above (``most``) or below (``least``)."""

    name: str
    metric: str
    of: str
    most: int | None = None
    least: int | None = None


#: The verdict after the base rule. Ratios are compared as whole numbers, so that no rounding decides.
RULES = (
    Rule("words_too_long", "word_chars", "n_words", most=2000),
    Rule("words_too_short", "word_chars", "n_words", least=200),
    Rule("symbols", "n_symbols", "word_chars", most=8),
    Rule("few_stop_words", "n_stop_words", "n_words", least=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=60),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the text, the first one included."""

    def covered(hashes: Column) -> Column:
        # equal windows are neighbours after sorting; the union of their spans is added up from left to right
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda o: F.filter(
                o,
                lambda w, k: F.coalesce(F.get(o, k - 1)["h"] == w["h"], F.lit(False))
                | F.coalesce(F.get(o, k + 1)["h"] == w["h"], F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda w: w["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("total")),
            lambda a, s: F.struct(s.alias("last"), (a["total"] + F.least(F.lit(WINDOW), s - a["last"])).alias("total")),
            lambda a: a["total"],
        )

    hashes = F.transform(positions(1, F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)),
    )


def _metrics(words: Column, text: Column) -> Column:
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.octet_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: w.isin(stop))).cast("bigint").alias("n_stop_words"),
    )


def verdict(rules: Sequence[Rule]) -> Column:
    """Names of the rules that a row breaks, in the order of the table."""
    broken = []
    for r in rules:
        value, base = 100 * F.col(r.metric), F.col(r.of)
        for bad in ([value > r.most * base] if r.most is not None else []) + ([value < r.least * base] if r.least is not None else []):
            broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs`` (repeated rows too): ``keep`` columns, the metrics, ``base_failed``, ``broken``, ``kept``.

    Nothing is shuffled. A null or blank text has no words, so it fails the base rule; lines without a word
    don't count as lines; a document of one word has no windows. An empty table gives an empty result.
    """
    rows = texts(docs, (*keep, "text"))
    m = let(F.coalesce(F.col("text"), F.lit("")), lambda t: let(space_words(t), lambda w: _metrics(w, t)))
    flat = rows.select(*keep, m.alias("m")).select(*keep, "m.*").select("*", "lines.*").drop("lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        flat.withColumn("base_failed", failed)
        .withColumn("broken", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_stop_words", "base_failed", "kept",
    )


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    bad = []
    for r in RULES:
        if r.most is not None:
            bad.append(f"100 * {r.metric} > {r.most} * {r.of}")
        if r.least is not None:
            bad.append(f"100 * {r.metric} < {r.least} * {r.of}")
    space = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{space}+') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x
        FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{space}') GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0)::BIGINT AS n_lines,
             len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN l USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({' OR '.join(bad)}) AS kept FROM b
"""
