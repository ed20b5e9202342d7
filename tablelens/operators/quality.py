"""Data quality: four scores, their details and four kinds of structural flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, functions as F

from tablelens.functions.fingerprint import fingerprint
from tablelens.operators.columnstats import SKETCH_MARGIN, TableStats, distinct_estimates, table_stats
from tablelens.operators.frequency import distinct_counts, spelling_groups, value_frequency
from tablelens.operators.quantiles import exact_quantiles
from tablelens.schema import as_double, chunks, classify, col, comparable, local_frame, normalize, stack_rows
from tablelens.thresholds import DEFAULTS, LIMITS, Thresholds


# --- missing values -------------------------------------------------------------------------------

def missing_by_column(df: DataFrame) -> DataFrame:
    """``(column_name, missing_count, missing_pct)`` of the columns that lack values."""
    df = normalize(df)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(col(n).isNull()).alias(f"n{i}") for i, n in enumerate(df.columns)])
    return stack_rows(counts, [
        F.struct(F.lit(n).alias("column_name"), F.col(f"n{i}").alias("missing_count"),
                 F.bround(F.try_divide(100 * F.col(f"n{i}"), F.col("rows")), 1).alias("missing_pct"))
        for i, n in enumerate(df.columns)
    ]).filter("missing_count > 0")


def _score(pct: float) -> int:
    return max(0, round(100 - pct))


def _missing_score(stats: TableStats) -> tuple[int, float]:
    cells = stats.rows * len(stats.columns)
    pct = round(100 * sum(c.missing for c in stats.columns.values()) / cells, 1) if cells else 0.0
    return _score(pct), pct


def missing_score(df: DataFrame) -> DataFrame:
    """Share of missing cells in the whole table and the score made of it."""
    df = normalize(df)
    holes = sum((F.count_if(col(n).isNull()) for n in df.columns), F.lit(0))
    pct = F.coalesce(F.bround(F.try_divide(100 * holes, F.count(F.lit(1)) * len(df.columns)), 1), F.lit(0.0))
    return df.agg(holes.cast("bigint").alias("missing_cells"), pct.alias("missing_pct")).select(
        "missing_cells", "missing_pct",
        F.greatest(F.lit(0), F.bround(100 - F.col("missing_pct"))).cast("bigint").alias("score"))


# --- duplicates -----------------------------------------------------------------------------------

def duplicate_rows(df: DataFrame, exact: bool = False) -> DataFrame:
    """Repeats of an earlier identical row, counted by fingerprint.

    Only 16 bytes and a count per row are shuffled, and copies collapse before the shuffle, however
    many there are. ``exact=True`` groups by the row contents instead and shuffles whole rows.
    """
    df = normalize(df)
    if not df.columns:
        return local_frame(df, [(0, 0, 0.0, 100)],
                           "row_count bigint, duplicate_count bigint, duplicate_pct double, score bigint")
    keys = ([comparable(df, n).alias(f"k{i}") for i, n in enumerate(df.columns)] if exact
            else fingerprint(df))
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    pct = F.coalesce(F.bround(F.try_divide(100 * F.col("duplicate_count"), F.col("row_count")), 1), F.lit(0.0))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    ).withColumn("duplicate_pct", pct).withColumn(
        "score", F.greatest(F.lit(0), F.bround(100 - F.col("duplicate_pct"))).cast("bigint"))


# --- types ----------------------------------------------------------------------------------------

def _type_flags(stats: TableStats, limits: Thresholds) -> list[tuple[str, str, float]]:
    flags = []
    for c in stats.columns.values():
        if c.number_rate is not None and c.number_rate >= limits.type_parse_ratio:
            flags.append((c.name, "numeric", round(c.number_rate, 2)))
        elif c.date_rate is not None and c.date_rate >= limits.type_parse_ratio:
            flags.append((c.name, "date", round(c.date_rate, 2)))
    return flags


def type_consistency(df: DataFrame, stats: TableStats | None = None,
                     limits: Thresholds = DEFAULTS) -> DataFrame:
    """Text columns most of whose values are numbers, or else dates."""
    df = normalize(df)
    stats = stats or table_stats(df, classify(df).text, sketch=False)
    return local_frame(df, _type_flags(stats, limits),
                       "column_name string, looks_like string, parse_rate double")


# --- outliers -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Fence:
    column: str
    low: float
    high: float
    n: int


def iqr_fences(df: DataFrame, stats: TableStats, limits: Thresholds = DEFAULTS,
               quartiles: dict[str, list[float | None]] | None = None) -> list[Fence]:
    """Limits of the columns that have enough values and some spread between the quartiles."""
    usable = {n: c for n, c in stats.numeric(df).items() if c.present >= limits.iqr_min_rows}
    if quartiles is None:
        quartiles = exact_quantiles(df, [0.25, 0.75], usable)
    fences = []
    for name, c in usable.items():
        q1, q3 = quartiles[name][0], quartiles[name][-1]
        if q3 - q1 != 0:
            reach = limits.iqr_factor * (q3 - q1)
            fences.append(Fence(name, q1 - reach, q3 + reach, c.present))
    return fences


def count_beyond(df: DataFrame, fences: list[Fence], far: dict[str, Column] | None = None) -> tuple[dict[str, int], dict[str, int]]:
    """Values strictly outside the limits, and values for which a condition of their column holds: all in one scan."""
    wanted = [(0, f.column, (as_double(f.column) < f.low) | (as_double(f.column) > f.high)) for f in fences]
    wanted += [(1, n, c) for n, c in (far or {}).items()]
    found: tuple[dict[str, int], dict[str, int]] = {}, {}
    for block in chunks(wanted, LIMITS.columns_per_job):
        row = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(block)]).first()
        for (kind, name, _), n in zip(block, row):
            found[kind][name] = n
    return found


def count_outside(df: DataFrame, fences: list[Fence]) -> dict[str, int]:
    """Values strictly outside the limits, all columns in one scan."""
    return count_beyond(df, fences)[0]


_IQR_SCHEMA = ("column_name string, lower_fence double, upper_fence double, outlier_count bigint, "
               "outlier_fraction double")


def iqr_outliers(df: DataFrame, stats: TableStats | None = None, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Columns with values outside the quartile fences, and the share of such values."""
    df = normalize(df)
    stats = stats or table_stats(df, classify(df).numeric, sketch=False, parse=False)
    fences = iqr_fences(df, stats, limits)
    outside = count_outside(df, fences)
    return local_frame(df, [
        (f.column, f.low, f.high, outside[f.column], round(outside[f.column] / f.n, 3))
        for f in fences if outside[f.column] > 0
    ], _IQR_SCHEMA)


def outlier_score(fractions: list[float]) -> int:
    """Average over the offending columns only."""
    return max(0, round(100 * (1 - sum(fractions) / len(fractions)))) if fractions else 100


def iqr_score(df: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    rows = iqr_outliers(df, limits=limits).collect()
    return local_frame(df, [(len(rows), outlier_score([r["outlier_fraction"] for r in rows]))],
                       "offending_columns bigint, score bigint")


# --- structural flags -----------------------------------------------------------------------------

def _near(value: float, threshold: float) -> bool:
    return abs(value - threshold) <= threshold * SKETCH_MARGIN


def _few(limits: Thresholds) -> int:
    """Columns with up to this many values are counted value by value."""
    return 4 * limits.high_cardinality_min


def small_frequency(df: DataFrame, stats: TableStats, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Values and counts of all text columns with few values: one scan for every check that asks for them.

    A few hundred rows per column, so the result is kept while several checks read it.
    """
    return value_frequency(df, small_text_columns(df, _few(limits), stats)).persist()


def settled_distinct_counts(df: DataFrame, stats: TableStats, limits: Thresholds = DEFAULTS,
                            frequency: DataFrame | None = None) -> dict[str, int]:
    """Distinct counts that are exact wherever a threshold could go either way.

    A sketch decides the columns that are clear of every threshold by more than six standard errors;
    only the others, and those with few values, are counted exactly.
    """
    counts = {c.name: min(c.distinct_estimate, c.present) for c in stats.columns.values()}
    known: set[str] = set()
    if frequency is not None:
        known = {n for n in small_text_columns(df, _few(limits), stats) if stats[n].present}
        counts.update({r["column_name"]: r["d"] for r in frequency.groupBy("column_name").agg(
            F.count("value").alias("d")).collect()})
    doubtful = []
    for c in stats.columns.values():
        ratio = c.distinct_estimate / stats.rows if stats.rows else 0.0
        if c.distinct_estimate <= _few(limits) or _near(ratio, limits.id_like_ratio) \
                or (c.dtype == "string" and _near(ratio, limits.high_cardinality_ratio)):
            if c.name not in known and c.present:
                doubtful.append(c.name)
    if doubtful:
        counts.update({r["column_name"]: r["distinct_count"] for r in distinct_counts(df, doubtful).collect()})
    return counts


@dataclass
class Flags:
    constant: list[str] = field(default_factory=list)
    id_like: list[str] = field(default_factory=list)
    high_cardinality: list[str] = field(default_factory=list)
    inconsistent: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    @property
    def junk(self) -> set[str]:
        return set(self.constant) | set(self.id_like)


def column_flags(df: DataFrame, stats: TableStats, counts: dict[str, int], limits: Thresholds) -> Flags:
    flags = Flags(constant=[n for n in df.columns if counts[n] <= 1])
    if stats.rows:
        flags.id_like = [n for n in df.columns if counts[n] / stats.rows > limits.id_like_ratio]
        flags.high_cardinality = [
            n for n in classify(df).text if n not in flags.junk
            and (counts[n] >= limits.high_cardinality_min
                 or counts[n] / stats.rows > limits.high_cardinality_ratio)
        ]
    return flags


def structural_flags(df: DataFrame, stats: TableStats | None = None, limits: Thresholds = DEFAULTS) -> DataFrame:
    """``(flag, column_name)``: constant, id_like or high_cardinality."""
    df = normalize(df)
    stats = stats or table_stats(df, parse=False)
    flags = column_flags(df, stats, settled_distinct_counts(df, stats, limits), limits)
    return local_frame(df, [("constant", n) for n in flags.constant]
                       + [("id_like", n) for n in flags.id_like]
                       + [("high_cardinality", n) for n in flags.high_cardinality],
                       "flag string, column_name string")


def small_text_columns(df: DataFrame, most: int, stats: TableStats | None = None) -> list[str]:
    """Text columns that may have at most ``most`` distinct values, judged by sketch with a margin."""
    text = list(classify(df).text)
    found = {n: stats[n].distinct_estimate for n in text} if stats else distinct_estimates(df, text)
    return [n for n in text if found[n] <= most * (1 + SKETCH_MARGIN) + 1]


def inconsistent_categories(df: DataFrame, stats: TableStats | None = None, limits: Thresholds = DEFAULTS,
                            frequency: DataFrame | None = None) -> DataFrame:
    """``(column_name, folded, spellings)``: values that differ only in case or surrounding space."""
    df = normalize(df)
    if frequency is None:
        frequency = value_frequency(df, small_text_columns(df, limits.category_check_max, stats))
    few = frequency.groupBy("column_name").agg(F.count("value").alias("d")).filter(
        F.col("d") <= limits.category_check_max).select("column_name")
    return (spelling_groups(frequency).join(few, "column_name", "left_semi")
            .groupBy("column_name", "folded")
            .agg(F.array_sort(F.collect_set("value")).alias("spellings"))
            .filter(F.size("spellings") > 1))


# --- the whole report -----------------------------------------------------------------------------

@dataclass
class QualityReport:
    rows: int
    overall: int
    scores: dict[str, int]
    missing_pct: float
    missing: dict[str, int]
    duplicates: int
    duplicate_pct: float
    type_flags: list[tuple[str, str, float]]
    outliers: dict[str, float]
    flags: Flags
    distinct: dict[str, int]
    outlier_counts: dict[str, int] = field(default_factory=dict)
    # What the checks were made of, for the cleaning that follows.
    stats: TableStats | None = None
    medians: dict[str, float | None] = field(default_factory=dict)

    def to_dict(self) -> dict:
        # The names of the nested keys.
        return {
            "overall_score": self.overall,
            "scores": self.scores,
            "details": {
                "missing_values": {
                    "overall_missing_pct": self.missing_pct,
                    "by_column": {n: {"missing_count": c, "missing_pct": round(100 * c / self.rows, 1)}
                                  for n, c in self.missing.items()},
                },
                "duplicates": {"duplicate_count": self.duplicates, "duplicate_pct": self.duplicate_pct},
                "type_consistency": {"flagged_columns": [
                    {"column": c, "looks_like": k, "parse_rate": r} for c, k, r in self.type_flags]},
                "outliers": {"by_column": self.outliers},
            },
            "structural_flags": {
                "constant_columns": self.flags.constant,
                "id_like_columns": self.flags.id_like,
                "high_cardinality_columns": self.flags.high_cardinality,
                "inconsistent_categories": self.flags.inconsistent,
            },
        }


def assess_data_quality(df: DataFrame, stats: TableStats | None = None, limits: Thresholds = DEFAULTS,
                        quartiles: dict[str, list[float | None]] | None = None,
                        frequency: DataFrame | None = None, *, duplicates: Row | None = None,
                        outside: dict[str, int] | None = None, distinct: dict[str, int] | None = None,
                        spellings: list[Row] | None = None) -> QualityReport:
    """All checks, those whose counts are given without a further scan: two scans for the statistics, two or three for the quartiles, one for the outliers,
    one narrow shuffle for the duplicates and one small one for the categories."""
    df = normalize(df)
    stats = stats or table_stats(df)
    if quartiles is None:
        quartiles = exact_quantiles(df, [0.25, 0.5, 0.75], stats.numeric(df))
    own = frequency is None and (distinct is None or spellings is None)
    frequency = small_frequency(df, stats, limits) if own else frequency
    missing, missing_pct = _missing_score(stats)
    dup = duplicates if duplicates is not None else duplicate_rows(df).first()
    types = _type_flags(stats, limits)
    fences = iqr_fences(df, stats, limits, quartiles)
    outside = outside if outside is not None else count_outside(df, fences)
    fractions = {f.column: round(outside[f.column] / f.n, 3) for f in fences if outside[f.column] > 0}
    counts = distinct if distinct is not None else settled_distinct_counts(df, stats, limits, frequency)
    flags = column_flags(df, stats, counts, limits)
    if spellings is None:
        spellings = inconsistent_categories(df, stats, limits, frequency).orderBy("column_name", "folded").collect()
    for r in spellings:
        flags.inconsistent.setdefault(r["column_name"], {})[r["folded"]] = list(r["spellings"])
    if own:
        frequency.unpersist()
    flags.inconsistent = {n: flags.inconsistent[n] for n in df.columns if n in flags.inconsistent}
    scores = {
        "missing_values": missing,
        "duplicates": int(dup["score"]),
        "type_consistency": max(0, round(100 * (1 - len(types) / len(stats.columns)))) if stats.columns else 100,
        "outliers": outlier_score(list(fractions.values())),
    }
    return QualityReport(
        rows=stats.rows, overall=round(sum(scores.values()) / 4), scores=scores, missing_pct=missing_pct,
        missing={c.name: c.missing for c in stats.columns.values() if c.missing},
        duplicates=dup["duplicate_count"], duplicate_pct=dup["duplicate_pct"], type_flags=types,
        outliers=fractions, flags=flags, distinct=counts,
        outlier_counts={f.column: outside[f.column] for f in fences if outside[f.column] > 0},
        stats=stats, medians={n: q[1] for n, q in quartiles.items() if len(q) == 3})


def quality_score(df: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """The four scores and their unweighted mean as one row."""
    report = assess_data_quality(df, limits=limits)
    s = report.scores
    return local_frame(df, [(s["missing_values"], s["duplicates"], s["type_consistency"], s["outliers"],
                             report.overall)],
                       "missing_values bigint, duplicates bigint, type_consistency bigint, "
                       "outliers bigint, overall_score bigint")
