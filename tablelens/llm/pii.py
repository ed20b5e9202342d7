"""Personal data: exact patterns, and terms whose co-occurrence with the values found discloses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.bounded import broadcast_if_small
from tablelens.llm.shared import written
from tablelens.llm.textcols import let

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
NAMES = (*KINDS, "term")

# Leftmost non-overlapping matches of the contract's patterns, written so that each text is read once: a lookbehind
# skips starts inside a run that has failed already, possessive repeats never step back.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits, single blanks or hyphens between them; only runs of 14 to 19 digits can be cards.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A text without a match of these has none of the kind; they are cheap to test.
_HINTS = (r"@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9]")

#: Distinct lines in which a term must stand beside a value before it can disclose it.
LEAST_LINES = 3
#: Share of a value's information (pointwise mutual information over information content) that a term may give away.
DISCLOSES, REMOVES = 0.9, 0.97
#: Letters and digits; shorter runs are no terms.
_TERM_GAP, TERM_CHARS = r"[^\p{L}\p{N}]+", 3


def _luhn(match: Column) -> Column:
    digits = F.filter(F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), ""), lambda c: c != "")

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    if kind == 1:
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == 2:
        return _luhn(match)
    if kind == 3:
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str | Column, kind: int) -> Column:
    """(start, kind, end, value) of every match, in code points, end exclusive."""
    column = pattern if isinstance(pattern, Column) else F.lit(pattern)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = F.struct(F.split(text, column, -1).alias("gaps"), F.regexp_extract_all(text, column, F.lit(0)).alias("m"))

    def placed(f: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(f["m"], F.slice(f["gaps"], 1, F.size(f["m"])).alias("gap")),
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda a, x: let(
                a["at"] + F.char_length(x["gap"]),
                lambda s: F.struct(
                    (s + F.char_length(x["m"])).alias("at"),
                    F.concat(a["out"], F.array(F.struct(
                        s.alias("start"), F.lit(kind).alias("kind"), (s + F.char_length(x["m"])).alias("end"), x["m"].alias("value"),
                    ))).alias("out"),
                ),
            ),
            lambda a: a["out"],
        )

    return let(found, lambda f: placed(f))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds in one array, ordered by start, then kind; ``text`` must be bound (see ``let``)."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    parts = []
    for kind, (pattern, hint) in enumerate(zip((_EMAIL, _IP, _CARD, _PHONE), _HINTS)):
        some = text.contains("@") if kind == 0 else text.rlike(hint)
        parts.append(F.when(some, F.filter(_spans(text, pattern, kind), _checker(kind))).otherwise(empty))
    return F.sort_array(F.concat(*parts))


def _checker(kind: int):
    return lambda s: _valid(kind, s["value"])


def _normal(s: Column) -> Column:
    """One form of a value that is written in several ways, marked with its kind."""
    value, digits = s["value"], F.regexp_replace(s["value"], "[^0-9]", "")
    form = F.when(s["kind"] == 0, F.lower(value)).when(s["kind"] == 1, F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")).otherwise(digits)
    return F.concat(s["kind"].cast("string"), F.lit(":"), form)


def _lines_with_values(docs: DataFrame) -> DataFrame:
    """(line_hash, value, terms) for every line and every protected value in it, in its normal form."""
    line = F.col("line")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(
        line.contains("@") | line.rlike("|".join(_HINTS[1:]))
    )
    found = lines.select("line", let(line, lambda t: base_spans(t)).alias("spans")).where(F.size("spans") > 0)
    bare = line
    for pattern in (_EMAIL, _IP, _CARD, _PHONE):
        bare = F.regexp_replace(bare, pattern, "\n")
    return found.select(
        F.xxhash64("line").alias("line_hash"), F.explode(F.array_distinct(F.transform("spans", _normal))).alias("value"),
        F.array_distinct(F.split(bare, _TERM_GAP)).alias("terms"),
    )


def disclosing_terms(docs: DataFrame, least_lines: int = LEAST_LINES, discloses: float = DISCLOSES) -> DataFrame:
    """(term, strength): terms that give away at least ``discloses`` of the information of some protected value.

    Over all lines of the corpus, strength is pmi(term, value) / information(value), the largest over the values
    that share at least ``least_lines`` different lines with the term; 1 means that every line with the term
    holds the value. A value is the same in capitals or with other blanks and marks. Repeated lines count in the estimates, but not as evidence.
    """
    near = written(_lines_with_values(docs), "value-lines")
    term = F.col("term")
    pairs = near.select("value", "line_hash", F.explode("terms").alias("term")).where(F.length(term) >= TERM_CHARS)
    candidates = written(
        pairs.groupBy("value", "term", "line_hash").agg(F.count("*").alias("n"))
        .groupBy("value", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("lines"))
        .where(F.col("lines") >= least_lines),
        "candidates",
    )
    values = near.groupBy("value").agg(F.count("*").alias("n_value"))
    wanted = written(candidates.select("term").distinct(), "candidate-terms")
    everywhere = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(
        F.explode(F.array_distinct(F.split("line", _TERM_GAP))).alias("term")
    ).where(F.length(term) >= TERM_CHARS)
    n_term = everywhere.join(broadcast_if_small(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    n_lines = F.lit(float(docs.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0))
    scored = candidates.join(values, "value").join(n_term, "term")
    info = F.log2(n_lines / F.col("n_value"))
    pmi = F.log2(n_lines * F.col("n_both") / (F.col("n_value").cast("double") * F.col("n_term")))
    return scored.where(info > 0).groupBy("term").agg(F.max(pmi / info).alias("strength")).where(F.col("strength") >= discloses)


def find_personal_data(docs: DataFrame, least_lines: int = LEAST_LINES, discloses: float = DISCLOSES) -> DataFrame:
    """(doc_id, text, spans) for every row of ``docs``, repeated rows too; spans are (start, kind, end, value, strength).

    A null text is empty. Terms are found in every text that holds them, with or without the value, outside the
    base spans; upper and lower case differ. With no disclosing terms only the base spans remain.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    strong = written(disclosing_terms(source, least_lines, discloses), "disclosing")
    few = broadcast_if_small(strong)
    held = source.select("doc_id", "text_hash", F.explode(F.array_distinct(F.split("text", _TERM_GAP))).alias("term"))
    by_doc = written(
        held.where(F.length("term") >= TERM_CHARS).join(few, "term").groupBy("doc_id", "text_hash")
        .agg(F.map_from_entries(F.collect_set(F.struct("term", "strength"))).alias("found")),
        "terms-by-document",
    ).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "found")
    joined = source.join(
        broadcast_if_small(by_doc), source["doc_id"].eqNullSafe(by_doc["d"]) & (source["text_hash"] == by_doc["h"]), "left"
    )
    kinds = "array<struct<start:int,kind:int,end:int,value:string,strength:double>>"
    base = let(F.col("text"), lambda t: base_spans(t))
    rows = joined.select("doc_id", "text", "found", base.alias("base"))

    def terms(found: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(F.map_keys(found)), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        return let(F.col("text"), lambda t: let(pattern, lambda p: _spans(t, p, TERM)))

    free = F.filter(terms(F.col("found")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = F.transform(free, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"),
        F.element_at("found", s["value"]).alias("strength"),
    ))
    known = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.lit(1.0).alias("strength"),
    ))
    return rows.select("doc_id", "text", F.sort_array(F.concat(
        known, F.when(F.col("found").isNull(), F.array().cast(kinds)).otherwise(added)
    )).alias("spans"))


def sanitise(found: DataFrame) -> DataFrame:
    """(doc_id, text): values become ``<KIND>``; disclosing terms become ``<NUMBER>``, ``<NAME>`` or ``<TERM>``, the strongest go.

    Of overlapping spans the first stays.
    """
    def shown(s: Column) -> Column:
        general = F.when(s["value"].rlike("[0-9]"), F.lit("<NUMBER>")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("<NAME>")).otherwise(F.lit("<TERM>"))
        term = F.when(s["strength"] >= REMOVES, F.lit("")).otherwise(general)
        base = F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)), F.lit(">"))
        return F.when(s["kind"] == TERM, term).otherwise(base)

    text = F.col("text")
    done = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), shown(s))).alias("out"),
        )),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    return found.select("doc_id", done.alias("text"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.col("spans")
    return found.select(
        "doc_id", *[_count(spans, i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"] < TERM)), 256).alias("base_sha256"),
        _listed(spans).alias("spans"), _count(spans, TERM).alias("n_term"),
    )
