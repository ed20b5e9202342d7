import random

import pytest

from tablelens.operators import frequency, quality
from tablelens.operators.columnstats import table_stats


def test_missing_score_and_details(rows):
    df = rows([(1.0, 1), (None, 2), (float("nan"), 3), (4.0, 4)], "a double, b bigint")
    report = quality.assess_data_quality(df).to_dict()
    assert report["scores"]["missing_values"] == 75
    assert report["details"]["missing_values"]["by_column"] == {"a": {"missing_count": 2, "missing_pct": 50.0}}
    assert quality.missing_by_column(df).collect()[0]["missing_count"] == 2
    assert quality.missing_score(df).first().asDict() == {"missing_cells": 2, "missing_pct": 25.0, "score": 75}


def test_duplicates_count_repeats_only(rows):
    df = rows([(1, "x"), (1, "x"), (1, "x"), (2, "y")], "a bigint, b string")
    for exact in (False, True):
        assert quality.duplicate_rows(df, exact).first().asDict() == {
            "row_count": 4, "duplicate_count": 2, "duplicate_pct": 50.0, "score": 50}


def test_duplicates_tell_nulls_in_different_places_apart(rows):
    df = rows([("a", None), (None, "a"), (None, None), (None, None)], "x string, y string")
    assert quality.duplicate_rows(df).first()["duplicate_count"] == 1


def test_duplicates_of_nested_columns(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, array(1, 2) AS v UNION ALL SELECT map('b', 2, 'a', 1), array(1, 2)")
    assert quality.duplicate_rows(df).first()["duplicate_count"] == 1


def test_hot_copies_count_right(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "'x' AS c")
    assert quality.duplicate_rows(df).first()["duplicate_count"] == 9_999


def test_type_consistency(rows):
    df = rows([(str(i), f"2024-01-0{i}", "word", None) for i in range(1, 6)], "q string, d string, w string, e string")
    got = {r["column_name"]: (r["looks_like"], r["parse_rate"]) for r in quality.type_consistency(df).collect()}
    assert got == {"q": ("numeric", 1.0), "d": ("date", 1.0)}
    assert quality.assess_data_quality(df).scores["type_consistency"] == 50


def test_iqr_outlier(rows):
    df = rows([(v,) for v in (10, 11, 12, 13, 14, 1000)], "value bigint")
    out = quality.iqr_outliers(df).first()
    assert (out["outlier_count"], out["outlier_fraction"]) == (1, 0.167)
    assert quality.iqr_score(df).first()["score"] == 83


def test_iqr_skips_short_and_flat_columns(rows):
    assert quality.iqr_outliers(rows([(1,), (2,), (900,)], "v bigint")).count() == 0
    assert quality.iqr_outliers(rows([(5,)] * 9 + [(900,)], "v bigint")).count() == 0


def test_structural_flags(rows):
    df = rows([(f"ORD{i}", "done", i % 60, str(i % 60)) for i in range(100)], "order_id string, status string, n int, code string")
    got = {(r["flag"], r["column_name"]) for r in quality.structural_flags(df).collect()}
    assert got == {("id_like", "order_id"), ("constant", "status"), ("high_cardinality", "code")}


def test_all_null_column_is_constant(rows):
    flags = quality.assess_data_quality(rows([(1, None), (2, None)], "a bigint, b string")).flags
    assert flags.constant == ["b"]


def test_one_row_is_constant_and_id_like(rows):
    flags = quality.assess_data_quality(rows([(1, "x")], "a bigint, b string")).flags
    assert flags.constant == flags.id_like == ["a", "b"]


@pytest.mark.parametrize("distinct, expected", [(9_400, False), (9_501, True), (9_500, False)])
def test_identifier_threshold_is_exact(spark, distinct, expected):
    df = spark.range(10_000).selectExpr(f"CASE WHEN id < {distinct} THEN id ELSE 0 END AS k", "id % 2 AS v")
    names = [r["column_name"] for r in quality.structural_flags(df).filter("flag = 'id_like'").collect()]
    assert ("k" in names) is expected


def test_inconsistent_categories(rows):
    df = rows([("HR",), ("hr",), (" HR \t",), ("Sales",), ("Sales",)], "dept string")
    got = quality.inconsistent_categories(df).collect()
    assert [(r["column_name"], r["folded"], r["spellings"]) for r in got] == [("dept", "hr", [" HR \t", "HR", "hr"])]


def test_more_than_fifty_values_are_not_checked(rows):
    df = rows([(f"v{i}",) for i in range(50)] + [("V1",)], "c string")
    assert quality.inconsistent_categories(df).count() == 0


def test_no_columns(spark):
    df = spark.range(0).select()
    report = quality.assess_data_quality(df)
    assert report.overall == 100 and report.flags.constant == []


def test_no_rows(rows):
    report = quality.assess_data_quality(rows([], "a double, b string")).to_dict()
    assert report["overall_score"] == 100
    assert report["structural_flags"]["id_like_columns"] == []


def test_column_names_with_dots_and_quotes(rows):
    df = rows([(1.5, "a"), (None, "b")], "`19.99` double, `x ``y` string")
    assert quality.missing_by_column(df).first()["column_name"] == "19.99"
    assert quality.assess_data_quality(df).missing == {"19.99": 1}


def test_wide_tables_are_split_over_jobs(spark):
    df = spark.range(50).selectExpr(*[f"id + {i} AS c{i}" for i in range(130)])
    stats = table_stats(df)
    assert stats.rows == 50 and len(stats.columns) == 130
    assert stats["c129"].low == 129 and stats["c129"].distinct_estimate == 50


def test_scores_do_not_depend_on_partitioning(rows):
    random.seed(3)
    data = [(random.choice("abc"), random.gauss(0, 1), i % 17 or None) for i in range(400)]
    df = rows(data, "c string, v double, k bigint")
    assert quality.assess_data_quality(df.repartition(1)).to_dict() == quality.assess_data_quality(df.repartition(7)).to_dict()


def test_long_texts_are_counted_by_fingerprint(spark):
    texts = ["x" * 32, "x" * 33, "x" * 33, "y" * 5000, "y" * 5000 + "z", None, "", "#" + "0" * 32]
    df = spark.createDataFrame([(t, [t or ""]) for t in texts], "t string, a array<string>")
    assert {r["column_name"]: r["distinct_count"] for r in frequency.distinct_counts(df).collect()} == {"t": 6, "a": 6}
