"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from harness.views import table, view
from tablelens.functions.parse import parse_number, parse_timestamp
from tablelens.operators import (
    anomalies, chartdata, cleaning, eda, forecast, frequency, hypothesis, isolation, profile, quality, rows, sqlguard,
)
from tablelens.plans.analysis import Analysis
from tablelens.schema import local_frame
from tablelens.sources.readers import infer_types, load_data_file
from tablelens.sources.scratch import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.bround(n, places) + F.lit(0.0) for n in names})


# --- sources and profile --------------------------------------------------------------------------

@query
def infer_types_csv(spark, sf):
    return infer_types(view(spark, sf, "order_strings"))


def _folder(spark, suffix: str) -> str:
    return f"{scratch_folder(spark)}/files-{uuid.uuid4().hex}.{suffix}"


@query
def csv_by_column_name(spark, sf):
    """Orders as CSV files whose columns stand in three orders, one with a column more, read as one table."""
    o, folder = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")), _folder(spark, "csv")
    for i, columns in enumerate((["o_orderkey", "o_totalprice", "o_orderdate"], ["o_orderdate", "o_orderkey", "o_totalprice"],
                                 ["o_orderpriority", "o_totalprice", "o_orderkey", "o_orderdate"])):
        o.filter(F.col("o_orderkey") % 3 == i).select(*columns).write.mode("append").option("header", True).csv(folder)
    return load_data_file(spark, folder).select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")


@query
def csv_quoted_lines(spark, sf):
    """Documents with their line breaks and quotes as CSV, cut into records in parallel."""
    folder = _folder(spark, "csv")
    table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "\r\n?", "\n").alias("text"), "lang").write.option(
        "header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(folder)
    return load_data_file(spark, folder).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "lang")


@query
def json_list(spark, sf):
    """Documents as JSON lists on one line, cut into records in parallel."""
    folder = _folder(spark, "json")

    def listed(batches):
        before = "["
        for pdf in batches:
            for value in pdf["value"]:
                yield pd.DataFrame({"value": [before + value]})
                before = ","
        yield pd.DataFrame({"value": ["]" if before == "," else "[]"]})

    rows = table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text", F.struct("lang", "source").alias("of"))).alias("value"))
    rows.mapInPandas(listed, "value string").write.option("lineSep", " ").text(folder)
    return load_data_file(spark, folder).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "of.lang", "of.source")


@query
def profile_columns(spark, sf):
    return profile.profile_columns(table(spark, sf, "lineitem"))


@query
def schema_description(spark, sf):
    return profile.schema_description(table(spark, sf, "orders"))


@query
def sample_rows(spark, sf):
    return profile.sample_rows(table(spark, sf, "part"), 5, ["p_partkey"])


@query
def distinct_counts(spark, sf):
    return frequency.distinct_counts(table(spark, sf, "part"))


@query
def value_frequency(spark, sf):
    return frequency.value_frequency(table(spark, sf, "documents"), ["lang", "source"])


@query
def complete_cases(spark, sf):
    return rows.complete_cases(view(spark, sf, "dirty_orders"))


@query
def marked_lines(spark, sf):
    return rows.marked_lines(table(spark, sf, "documents"), "doc_id", "text", "Licensed")


@query
def parse_values(spark, sf):
    """Prices and dates written in several notations and read back."""
    o = table(spark, sf, "orders")
    shapes = ["yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "MMM d, yyyy", "yyyy/MM/dd", "d MMMM yyyy"]
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(shapes) == i, F.date_format("o_orderdate", s))
                        for i, s in enumerate(shapes)])
    number = F.concat(F.lit(" "), F.col("o_totalprice").cast("string"),
                      F.when(F.col("o_orderkey") % 5 == 0, F.lit("e0")).when(F.col("o_orderkey") % 5 == 1, F.lit("d"))
                      .otherwise(F.lit(" ")))
    return o.select("o_orderkey", parse_number(number).alias("price"), parse_timestamp(text).alias("day"))


# --- quality --------------------------------------------------------------------------------------

@query
def missing_by_column(spark, sf):
    return quality.missing_by_column(view(spark, sf, "dirty_orders"))


@query
def missing_score(spark, sf):
    return quality.missing_score(view(spark, sf, "dirty_orders"))


@query
def duplicate_rows(spark, sf):
    return quality.duplicate_rows(view(spark, sf, "line_terms"))


@query
def duplicate_documents(spark, sf):
    return quality.duplicate_rows(table(spark, sf, "documents").select("text"))


@query
def type_consistency(spark, sf):
    return quality.type_consistency(view(spark, sf, "order_texts"))


@query
def iqr_outliers(spark, sf):
    return rounded(quality.iqr_outliers(view(spark, sf, "dirty_orders")), 2, "lower_fence", "upper_fence")


@query
def iqr_score(spark, sf):
    return quality.iqr_score(view(spark, sf, "dirty_orders"))


@query
def quality_score(spark, sf):
    return quality.quality_score(view(spark, sf, "dirty_status"))


@query
def structural_flags(spark, sf):
    return quality.structural_flags(view(spark, sf, "part_extra"))


@query
def inconsistent_categories(spark, sf):
    return quality.inconsistent_categories(view(spark, sf, "dirty_orders")).withColumn(
        "spellings", F.array_join("spellings", "|"))


# --- descriptive statistics -----------------------------------------------------------------------

@query
def numeric_summary(spark, sf):
    return eda.numeric_summary(table(spark, sf, "lineitem"))


@query
def excluded_categories(spark, sf):
    return eda.top_categories(view(spark, sf, "order_lines"), exclude={"c_mktsegment"})


@query
def top_categories(spark, sf):
    return eda.top_categories(table(spark, sf, "part"))


@query
def most_frequent_value(spark, sf):
    return frequency.most_frequent_value(table(spark, sf, "events"), ["event_type", "props"])


@query
def correlation_matrix(spark, sf):
    return rounded(eda.correlation_matrix(view(spark, sf, "line_amounts")), 6, "correlation")


@query
def top_correlations(spark, sf):
    return eda.top_correlations(view(spark, sf, "line_amounts"))


@query
def group_aggregate(spark, sf):
    return rounded(eda.group_aggregate(view(spark, sf, "order_lines"), ["c_mktsegment"], "o_totalprice",
                                       ("sum", "avg", "min", "max", "count")), 2, "sum_o_totalprice", "avg_o_totalprice")


@query
def top_k_entities(spark, sf):
    return rounded(eda.top_k_entities(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", 10), 2, "sum_o_totalprice")


@query
def period_change(spark, sf):
    df = eda.period_change(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", "quarter")
    return rounded(df, 2, "total", "change", "whole_change", "contribution")


# --- chart data -----------------------------------------------------------------------------------

@query
def spread_ranking(spark, sf):
    return rounded(chartdata.spread_ranking(table(spark, sf, "lineitem")), 6, "spread")


@query
def histogram(spark, sf):
    return rounded(chartdata.histogram(table(spark, sf, "lineitem"), ["l_extendedprice", "l_orderkey"]), 4, "lower", "upper")


@query
def missingness(spark, sf):
    return chartdata.missingness(view(spark, sf, "dirty_orders"))


# --- anomalies ------------------------------------------------------------------------------------

@query
def zscore_outliers(spark, sf):
    return anomalies.zscore_outliers(view(spark, sf, "dirty_orders"))


@query
def isolation_forest(spark, sf):
    lines = table(spark, sf, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate")
    report = isolation.isolation_forest(lines, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return report.scored.filter(F.col("anomaly_score") < report.threshold)


#: A small forest, written down so that SQL can walk it too: (column, split, up to it, above it) or the rows of a leaf.
FOREST_ROWS = 64
FOREST = [
    ("l_quantity", 25.5, ("l_extendedprice", 9000.0, ("l_tax", 0.035, 3, 9), 20), ("l_discount", 0.085, 30, 2)),
    ("l_extendedprice", 52000.0, ("l_quantity", 3.5, 4, ("l_discount", 0.005, 6, 50)), ("l_tax", 0.065, 4, 1)),
    ("l_discount", 0.015, ("l_quantity", 45.5, 10, 1), ("l_tax", 0.005, 5, ("l_extendedprice", 2500.0, 2, 46))),
    ("l_tax", 0.075, ("l_extendedprice", 80000.0, 55, 1), ("l_quantity", 10.5, ("l_discount", 0.05, 1, 2), 5)),
]


@query
def forest_scores(spark, sf):
    """All lines scored by a given forest, and which of them are flagged."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    report = isolation.judge(lines, isolation.forest_of(features, FOREST, FOREST_ROWS), lines.count(), ["l_orderkey", "l_linenumber"])
    return report.scored.select(
        "l_orderkey", "l_linenumber", F.bround("anomaly_score", 6).alias("anomaly_score"),
        (F.col("anomaly_score") < report.threshold).alias("flagged"))


# --- hypothesis tests -----------------------------------------------------------------------------

CATEGORICAL, NUMERIC = ["o_orderstatus", "o_orderpriority", "c_mktsegment"], ["o_totalprice", "c_acctbal"]


@query
def group_moments(spark, sf):
    return rounded(hypothesis.group_moments(view(spark, sf, "order_lines"), CATEGORICAL, NUMERIC), 1, "mean").withColumn(
        "variance", F.bround("variance", -2))


@query
def welch_t(spark, sf):
    m = hypothesis.group_moments(table(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag"],
                                 ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(hypothesis.welch_t(m), 4, "statistic").select(
        "categorical_column", "numeric_column", "groups_compared", "statistic", F.bround("df1", 2).alias("df"))


@query
def anova_f(spark, sf):
    m = hypothesis.group_moments(view(spark, sf, "order_lines"), CATEGORICAL, NUMERIC)
    return rounded(hypothesis.anova_f(m), 4, "statistic").select(
        "categorical_column", "numeric_column", "groups_compared", "statistic", "df1", "df2")


@query
def hypothesis_sweep(spark, sf):
    return hypothesis.hypothesis_tests(view(spark, sf, "order_lines")).drop("group_means")


@query
def sweep_summary(spark, sf):
    return hypothesis.sweep_summary(hypothesis.hypothesis_tests(view(spark, sf, "order_lines")))


@query
def top_significant(spark, sf):
    return hypothesis.top_significant(hypothesis.hypothesis_tests(view(spark, sf, "order_lines"))).drop("group_means")


# --- cleaning -------------------------------------------------------------------------------------

@query
def cleaning_suggestions(spark, sf):
    df = view(spark, sf, "dirty_status")
    return cleaning.actions_frame(df, cleaning.suggest_cleaning_actions(df)).select(
        "seq", "type", "column_name", "auto_applied")


@query
def cleaned_table(spark, sf):
    df = view(spark, sf, "dirty_status")
    report = quality.assess_data_quality(df)
    return cleaning.apply_cleaning_actions(df, cleaning.suggest_cleaning_actions(df, report), report).df


@query
def cleaning_log(spark, sf):
    df = view(spark, sf, "dirty_status")
    report = quality.assess_data_quality(df)
    return cleaning.apply_cleaning_actions(df, cleaning.suggest_cleaning_actions(df, report), report).log_frame().select(
        "seq", "action", "column_name", "affected")


@query
def fill_median(spark, sf):
    return rounded(cleaning.fill_median(view(spark, sf, "dirty_orders"), ["o_totalprice"])[0], 2, "o_totalprice")


@query
def fill_unknown(spark, sf):
    return cleaning.fill_unknown(view(spark, sf, "dirty_orders"), ["o_orderpriority"])


@query
def drop_duplicates(spark, sf):
    return cleaning.drop_duplicates(view(spark, sf, "line_terms"))


@query
def standardize_categories(spark, sf):
    return cleaning.standardize_categories(view(spark, sf, "dirty_orders"), ["o_orderpriority"])[0]


# --- forecasts ------------------------------------------------------------------------------------

@query
def date_columns(spark, sf):
    """Which text columns are dates, in the order in which a forecast would take them."""
    df = view(spark, sf, "order_texts")
    return local_frame(df, list(enumerate(forecast.date_like_columns(df), 1)), "place int, column_name string")


@query
def chosen_series(spark, sf):
    """The series that a forecast takes by itself: first date-like column, first number that is not excluded."""
    df = view(spark, sf, "order_texts").select(
        "*", F.length("price_text").alias("width"), F.col("price_text").try_cast("double").alias("price"))
    return rounded(forecast.series_points(df, *forecast.choose_series(df, exclude={"width"})), 8, "value")


@query
def daily_mean_series(spark, sf):
    return rounded(forecast.series_points(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 8, "value")


def _event_points(spark, sf):
    return forecast.series_points(view(spark, sf, "event_days"), "day", "value", ["event_type"])


@query
def series_step(spark, sf):
    points = forecast.series_points(table(spark, sf, "events"), "ts", "value", ["event_type"])
    return forecast.series_step(points, ["event_type"])


@query
def naive_forecast(spark, sf):
    return forecast.naive_forecast(_event_points(spark, sf), ["event_type"])


@query
def holt_forecast(spark, sf):
    return forecast.holt_forecast(_event_points(spark, sf), ["event_type"])


def _line_points(spark, sf):
    return forecast.series_points(view(spark, sf, "trend_lines"), "day", "value", ["line"])


@query
def holt_lines(spark, sf):
    return forecast.holt_forecast(_line_points(spark, sf), ["line"])


@query
def chart_lines(spark, sf):
    points = _line_points(spark, sf)
    return forecast.chart_series(points, forecast.holt_forecast(points, ["line"]), ["line"])


@query
def skipped_series(spark, sf):
    return forecast.skipped_series(forecast.series_points(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_custkey"]), ["o_custkey"])


@query
def forecast_chart(spark, sf):
    points = _event_points(spark, sf)
    return forecast.chart_series(points, forecast.holt_forecast(points, ["event_type"]), ["event_type"])


# --- SQL ------------------------------------------------------------------------------------------

@query
def audit_sql(spark, sf):
    return sqlguard.audit_queries(view(spark, sf, "query_log"), "query").select(
        "o_orderkey", "safe", F.array_join("violations", " | ").alias("violations"))


SQL = {
    "sql_readonly": "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM data",
    "sql_group_avg": "SELECT o_orderpriority, CAST(avg(o_totalprice) AS DECIMAL(18,1)) AS avg_price FROM data GROUP BY o_orderpriority",
    "sql_cte_limit": "WITH top AS (SELECT o_orderkey, o_totalprice FROM data ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) "
                     "SELECT * FROM top",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM data WHERE o_totalprice > 1000 GROUP BY o_custkey HAVING count(*) > 12",
    "sql_self_join": "SELECT a.o_custkey, count(*) AS pairs FROM data a JOIN data b ON a.o_custkey = b.o_custkey "
                     "AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority = b.o_orderpriority GROUP BY a.o_custkey",
    "sql_semi_anti": "SELECT count(*) AS n FROM data d WHERE o_custkey IN (SELECT o_custkey FROM data WHERE o_orderstatus = 'P') "
                     "AND NOT EXISTS (SELECT 1 FROM data e WHERE e.o_custkey = d.o_custkey AND e.o_totalprice > 499000)",
    "sql_setops": "SELECT o_custkey FROM data WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM data WHERE "
                  "o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM data WHERE o_orderpriority = '1-URGENT'",
    "sql_window_rank": "SELECT * FROM (SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority "
                       "ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rk FROM data) t WHERE rk <= 3",
    "sql_case_string_date": "SELECT CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS band, "
                            "upper(substring(o_orderpriority, 3)) AS word, CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n "
                            "FROM data GROUP BY 1, 2, 3",
}


def _sql(text: str) -> Query:
    def run(spark, sf):
        result = sqlguard.query_readonly(table(spark, sf, "orders"), text)
        if not result.success:
            raise ValueError(result.error)
        return result.df
    return run


QUERIES.update({name: _sql(text) for name, text in SQL.items()})


# --- everything -----------------------------------------------------------------------------------

@query
def analyze_overview(spark, sf):
    analysis = Analysis(table(spark, sf, "orders"), key=("o_orderkey",))
    report, _ = analysis.run()
    analysis.close()
    return report
