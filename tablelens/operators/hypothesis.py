"""Is a number different between categories? Welch's t for two groups, one-way ANOVA for three to six.

Everything follows from the size, mean and variance of each group, which Spark merges from per-task
moments. The values of a group are never brought together.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.pvalues import p_value
from tablelens.operators.columnstats import TableStats
from tablelens.operators.frequency import distinct_counts
from tablelens.operators.quality import small_text_columns
from tablelens.schema import as_double, chunks, classify, col, local_frame, normalize
from tablelens.thresholds import DEFAULTS, LIMITS, Thresholds

_MOMENTS = ("categorical_column string, category string, numeric_column string, n bigint, "
            "mean double, variance double")
T_TEST, ANOVA = "two-sample t-test", "one-way ANOVA"


def grouping_columns(df: DataFrame, exclude: Iterable[str] = (), stats: TableStats | None = None,
                     limits: Thresholds = DEFAULTS, distinct: dict[str, int] | None = None) -> list[str]:
    """Text columns with two to six distinct values. ``distinct`` gives counts that are known already."""
    names = [n for n in small_text_columns(df, limits.max_groups, stats) if n not in set(exclude)]
    counts = distinct
    if counts is None:
        counts = {r["column_name"]: r["distinct_count"] for r in distinct_counts(df, names).collect()}
    return [n for n in names if limits.min_groups <= counts.get(n, 0) <= limits.max_groups]


def group_moments(df: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Size, mean and variance of each numeric column in each category of each categorical column."""
    df = normalize(df)
    if not categorical or not numeric:
        return local_frame(df, [], _MOMENTS)
    parts = []
    for block in chunks(numeric, LIMITS.columns_per_job):
        tall = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("categorical_column"),
                                         col(c).cast("string").alias("category")) for c in categorical])).alias("g"),
            *[as_double(n).alias(f"v{i}") for i, n in enumerate(block)])
        wide = tall.filter("g.category IS NOT NULL").groupBy("g.categorical_column", "g.category").agg(*[
            m for i in range(len(block)) for m in (
                F.count(f"v{i}").alias(f"n{i}"), F.avg(f"v{i}").alias(f"m{i}"), F.var_samp(f"v{i}").alias(f"s{i}"))
        ])
        parts.append(wide.select("categorical_column", "category", F.inline(F.array(*[
            F.struct(F.lit(n).alias("numeric_column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                     F.col(f"s{i}").alias("variance")) for i, n in enumerate(block)]))))
    return reduce(DataFrame.unionAll, parts)


def _groups(moments: DataFrame, limits: Thresholds, bounded: bool) -> DataFrame:
    """One row per pair of columns with its usable groups in order of the category.

    Pairs with more groups than a test takes leave by their count, before any groups are gathered, unless the
    categories are known to be few (``bounded``). The counts have one row per pair of columns, a bound that
    does not grow with the data.
    """
    pair = ["categorical_column", "numeric_column"]
    usable = moments.filter(F.col("n") >= limits.min_group_size)
    if not bounded:
        few = usable.groupBy(*pair).agg(F.count(F.lit(1)).alias("groups")).filter(F.col("groups") <= limits.max_groups)
        usable = usable.join(F.broadcast(few.select(*pair)), pair, "left_semi")
    gathered = usable.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("category", "n", "mean", "variance"))).alias("g"))
    return gathered.withColumn("groups_compared", F.size("g")).filter(F.col("groups_compared").between(limits.min_groups, limits.max_groups))


def _infinite_unless_equal(difference: Column) -> Column:
    """The statistic without any spread inside the groups: infinite, or undefined if nothing differs."""
    return F.when(difference > 0, F.lit(float("inf"))).when(difference < 0, F.lit(float("-inf")))


def _total(term) -> Column:
    return F.aggregate("g", F.lit(0.0), lambda acc, x: acc + term(x))


def test_statistics(moments: DataFrame, limits: Thresholds = DEFAULTS, bounded: bool = False) -> DataFrame:
    """``test``, ``statistic``, ``df1`` and ``df2`` of every pair with two to six usable groups."""
    k, n = F.col("groups_compared"), F.col("n_all")
    between, within = F.col("between"), F.col("within")
    a, b = F.get("g", F.lit(0)), F.get("g", F.lit(1))
    va, vb = a["variance"] / a["n"], b["variance"] / b["n"]
    gap = a["mean"] - b["mean"]
    t = F.when(va + vb == 0, _infinite_unless_equal(gap)).otherwise(F.try_divide(gap, F.sqrt(va + vb)))
    t_df = F.coalesce(F.try_divide((va + vb) * (va + vb), va * va / (a["n"] - 1) + vb * vb / (b["n"] - 1)), F.lit(1.0))
    f = F.when(within == 0, _infinite_unless_equal(between)).otherwise(
        F.try_divide(between / (k - 1), within / (n - k)))
    two = k == 2
    return (_groups(moments, limits, bounded)
            .withColumn("n_all", _total(lambda x: x["n"].cast("double")))
            .withColumn("grand", _total(lambda x: x["n"] * x["mean"]) / n)
            .withColumn("between", _total(lambda x: x["n"] * F.pow(x["mean"] - F.col("grand"), 2)))
            .withColumn("within", _total(lambda x: (x["n"] - 1) * x["variance"]))
            .select("categorical_column", "numeric_column", F.when(two, T_TEST).otherwise(ANOVA).alias("test"),
                    "groups_compared", "g", F.when(two, t).otherwise(f).alias("statistic"),
                    F.when(two, t_df).otherwise((k - 1).cast("double")).alias("df1"),
                    F.when(~two, n - k).alias("df2")))


def welch_t(moments: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """The pairs that have exactly two usable groups."""
    return test_statistics(moments, limits).filter(F.col("test") == T_TEST)


def anova_f(moments: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """The pairs that have three to six usable groups."""
    return test_statistics(moments, limits).filter(F.col("test") == ANOVA)


def hypothesis_tests(df: DataFrame, exclude: Iterable[str] = (), stats: TableStats | None = None,
                     limits: Thresholds = DEFAULTS, moments: DataFrame | None = None,
                     distinct: dict[str, int] | None = None) -> DataFrame:
    """One row per pair that could be tested; pairs with an undefined p-value are left out."""
    df = normalize(df)
    bounded = moments is None  # at most ``max_groups`` categories
    if moments is None:
        moments = group_moments(df, grouping_columns(df, exclude, stats, limits, distinct),
                                list(classify(df, exclude).numeric))
    p = F.col("p")
    return (test_statistics(moments, limits, bounded).withColumn("p", p_value("statistic", "df1", "df2")).filter(p.isNotNull() & ~F.isnan(p))
            .select("categorical_column", "numeric_column", "test", "groups_compared",
                    F.map_from_entries(F.transform("g", lambda x: F.struct(
                        x["category"], F.bround(x["mean"], 2)))).alias("group_means"),
                    F.bround("statistic", 3).alias("statistic"), F.bround(p, 4).alias("p_value"),
                    (p < limits.significance).alias("likely_significant")))


def top_significant(tests: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """The clearest differences, by the rounded p-value."""
    return (tests.filter("likely_significant")
            .orderBy("p_value", "categorical_column", "numeric_column").limit(limits.top_tests))


def sweep_summary(tests: DataFrame) -> DataFrame:
    """How many tests were run and how many look significant, with a caution for the reader."""
    note = F.concat(F.lit("No correction for multiple comparisons: among "), F.col("total_tests_run"),
                    F.lit(" tests some differences look significant by chance."))
    return tests.agg(F.count(F.lit(1)).alias("total_tests_run"),
                     F.count_if("likely_significant").alias("significant_results_count")) \
        .withColumn("note", F.when(F.col("total_tests_run") > 0, note))
