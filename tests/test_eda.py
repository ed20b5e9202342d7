import random

import pytest

from tablelens.operators import chartdata, eda, frequency, profile, rows as row_ops
from tablelens.operators.quality import missing_by_column


def collect(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_numeric_summary(rows):
    df = rows([(float(v), None) for v in (10, 20, 30, 40, 50)], "value double, empty double")
    assert collect(eda.numeric_summary(df), "column_name", "mean", "median", "std", "min", "max") == [
        ("value", 30.0, 30.0, 15.81, 10.0, 50.0)]


def test_single_value_has_no_spread(rows):
    assert eda.numeric_summary(rows([(3,)], "v int")).first()["std"] == 0.0


def test_top_categories(rows):
    df = rows([(d, f"n{i}") for i, d in enumerate(["HR", "HR", "Sales", "Eng", "Eng", "Eng", None])], "dept string, name string")
    assert collect(eda.top_categories(df, exclude={"name"}).orderBy("rank"), "value", "n") == [("Eng", 3), ("HR", 2), ("Sales", 1)]
    assert eda.top_categories(df, exclude={"dept", "name"}).count() == 0


def test_top_categories_shows_five_and_skips_many(rows):
    df = rows([(f"a{i % 8}", f"b{i % 21}") for i in range(168)], "a string, b string")
    got = eda.top_categories(df)
    assert collect(got.orderBy("rank"), "column_name", "value") == [("a", f"a{i}") for i in range(5)]


def test_correlations(rows):
    df = rows([(i, 2 * i, 5) for i in range(1, 6)], "a int, b int, c int")
    assert collect(eda.top_correlations(df), "column_a", "column_b", "correlation") == [("a", "b", 1.0)]
    weak = rows(list(zip(range(1, 7), (3, 1, 4, 1, 5, 2))), "a int, b int")
    assert eda.top_correlations(weak).count() == 0
    matrix = {(r["column_a"], r["column_b"]): r["correlation"] for r in eda.correlation_matrix(df).collect()}
    assert len(matrix) == 9 and matrix["b", "a"] == pytest.approx(1.0) and matrix["a", "c"] is None and matrix["c", "c"] is None


def test_correlation_uses_complete_pairs(spark):
    random.seed(5)
    data = [(random.gauss(1e6, 1), None if i % 4 == 0 else i * 1.0, random.random()) for i in range(300)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    pdf = df.toPandas().corr()
    for a, b, r in eda.pair_correlations(df):
        assert r == pytest.approx(pdf.loc[a, b], abs=1e-9)


def test_one_numeric_column_has_no_correlation(rows):
    df = rows([(1, "x"), (2, "y")], "a int, b string")
    assert eda.correlation_matrix(df).count() == 0 and eda.top_correlations(df).count() == 0


def test_histogram_and_ranking(rows):
    df = rows([(None if i == 3 else i, 10 * i, 4) for i in range(1, 9)], "a int, b int, flat int")
    got = chartdata.histogram(df, ["a", "flat"])
    assert got.count() == 40
    assert got.filter("column_name = 'a'").agg({"n": "sum"}).first()[0] == 7
    assert collect(got.filter("column_name = 'a' AND n > 0 AND bin IN (0, 19)").orderBy("bin"), "bin", "n") == [(0, 1), (19, 1)]
    assert got.filter("column_name = 'flat' AND n = 8").first()["lower"] == 4.0
    wide = rows([tuple(i + j for j in range(10)) for i in range(20)], ", ".join(f"col_{j} int" for j in range(10)))
    assert chartdata.histogram(wide).select("column_name").distinct().count() == 4
    assert chartdata.spread_ranking(wide).first()["column_name"] == "col_0"


def test_missingness_order(rows):
    df = rows([(None, None, 1), (None, 2, 2), (3, 3, 3)], "a int, b int, c int")
    assert collect(chartdata.missingness(df), "column_name", "missing_pct") == [("b", 33.3), ("a", 66.7)]
    assert missing_by_column(df.select("c")).count() == 0


def test_profile(rows):
    df = rows([(1, "x", 1.5), (1, "x", 1.5), (2, None, float("nan"))], "a bigint, b string, c double")
    got = profile.profile(df, 2, ["a", "b"])
    assert got["shape"] == {"rows": 3, "columns": 3} and got["duplicate_rows"] == 1
    assert got["columns"] == [
        {"name": "a", "dtype": "bigint", "null_count": 0, "unique_count": 2},
        {"name": "b", "dtype": "string", "null_count": 1, "unique_count": 1},
        {"name": "c", "dtype": "double", "null_count": 1, "unique_count": 1}]
    assert got["sample_rows"] == [{"a": 1, "b": "x", "c": 1.5}] * 2
    assert profile.profile_columns(df, approximate=True).orderBy("position").collect() == \
        profile.profile_columns(df).orderBy("position").collect()
    assert collect(profile.schema_description(df), "column_name", "dtype") == [("a", "bigint"), ("b", "string"), ("c", "double")]


def test_mode_and_counts(rows):
    df = rows([("b", 1), ("a", 1), (None, 2)], "k string, v int")
    assert collect(frequency.most_frequent_value(df, ["k"]), "value", "n") == [("a", 1)]
    assert {tuple(r) for r in frequency.distinct_counts(df).collect()} == {("k", 2), ("v", 2)}


def test_grouped_questions(rows):
    df = rows([("x", "2024-01-05", 10.0), ("y", "2024-01-09", 5.0), ("x", "2024-02-01", 4.0), ("z", "2024-02-02", 1.0)],
              "s string, d string, v double").selectExpr("s", "CAST(d AS date) AS d", "v")
    assert collect(eda.group_aggregate(df, ["s"], "v").orderBy("s"), "s", "sum_v", "avg_v")[0] == ("x", 14.0, 7.0)
    assert collect(eda.top_k_entities(df, ["s"], "v", 2), "s", "sum_v") == [("x", 14.0), ("y", 5.0)]
    got = {r["segment"]: (r["change"], r["contribution"]) for r in eda.period_change(df, "d", "v", "s").collect()}
    assert got == {"x": (-6.0, 0.6), "y": (-5.0, 0.5), "z": (1.0, -0.1)}


def test_complete_cases(rows):
    df = rows([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "v double, t string")
    assert row_ops.complete_cases(df).count() == 1 and row_ops.complete_cases(df, ["v"]).count() == 2


def test_marked_lines(rows):
    df = rows([(1, "  INSIGHT: up 5%  \nother\r\nINSIGHT:none\nINSIGHT: down"), (2, "no INSIGHT: here")], "k int, t string")
    assert collect(row_ops.marked_lines(df, "k", "t").orderBy("line_no"), "k", "line_no", "line") == [(1, 0, "up 5%"), (1, 3, "down")]


def test_wide_correlations_are_merged_as_tiles(spark, monkeypatch):
    monkeypatch.setattr(eda, "NARROW", 3)
    monkeypatch.setattr(eda, "TILE", 4)
    monkeypatch.setattr(eda, "TILE_GROUPS", 2)
    random.seed(6)
    data = [tuple(None if random.random() < 0.1 else 7.0 if k == 5 else random.gauss(1e5 * k, 1 + k) for k in range(11)) for _ in range(200)]
    df = spark.createDataFrame(data, ", ".join(f"c{k} double" for k in range(11)))
    want = df.toPandas().corr()
    found = eda.pair_correlations(df.repartition(5))
    assert len(found) == 55
    for a, b, r in found:
        assert r is None if "c5" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-9)
