import math
import random

import pytest

from tablelens.functions.pvalues import f_upper, incomplete_beta, t_two_sided
from tablelens.operators import hypothesis


def test_known_tail_probabilities():
    assert t_two_sided(2.0, 5) == pytest.approx(0.10193947883, abs=1e-10)
    assert t_two_sided(0.0, 3) == pytest.approx(1.0)
    assert f_upper(4.0, 1, 5) == pytest.approx(t_two_sided(2.0, 5), abs=1e-12)
    assert t_two_sided(math.inf, 1) == 0.0
    # One and two degrees of freedom have closed forms.
    for t in (0.3, 1.7, 25.0):
        assert t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    # I_x(1, b) = 1 - (1 - x)^b
    assert incomplete_beta(1, 7, 0.2) == pytest.approx(1 - 0.8 ** 7, abs=1e-13)
    # A large sample is nearly normal.
    assert t_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)


def normal(n, mean):
    return [random.gauss(mean, 5) for _ in range(n)]


def by_group(spark, **groups):
    return spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double")


def test_two_groups(spark):
    random.seed(42)
    df = by_group(spark, A=normal(100, 50), B=normal(100, 70))
    r = hypothesis.hypothesis_tests(df).first()
    assert (r["test"], r["groups_compared"], r["likely_significant"], r["p_value"]) == ("two-sample t-test", 2, True, 0.0)
    assert r["statistic"] < 0 and set(r["group_means"]) == {"A", "B"}
    summary = hypothesis.sweep_summary(hypothesis.hypothesis_tests(df)).first()
    assert (summary["total_tests_run"], summary["significant_results_count"]) == (1, 1) and "1 tests" in summary["note"]


def test_no_difference(spark):
    random.seed(7)
    values = normal(200, 50)
    df = by_group(spark, A=values[:100], B=values[100:])
    tests = hypothesis.hypothesis_tests(df)
    assert not tests.first()["likely_significant"] and hypothesis.top_significant(tests).count() == 0


def test_three_groups(spark):
    random.seed(1)
    r = hypothesis.hypothesis_tests(by_group(spark, A=normal(40, 50), B=normal(40, 50), C=normal(40, 90))).first()
    assert (r["test"], r["groups_compared"], r["likely_significant"]) == ("one-way ANOVA", 3, True)


@pytest.mark.parametrize("groups", [1, 50])
def test_too_few_or_many_categories(spark, groups):
    df = spark.range(100).selectExpr(f"CAST(id % {groups} AS string) AS g", "CAST(id AS double) AS v")
    tests = hypothesis.hypothesis_tests(df)
    assert tests.count() == 0
    assert hypothesis.sweep_summary(tests).first()["note"] is None


def test_small_groups_are_dropped_before_the_test_is_chosen(spark):
    df = by_group(spark, A=[1.0, 2.0, 3.0], B=[4.0, 6.0, 5.0], C=[9.0])
    r = hypothesis.hypothesis_tests(df).first()
    assert (r["test"], r["groups_compared"]) == ("two-sample t-test", 2)


def test_no_spread_inside_groups(spark):
    r = hypothesis.hypothesis_tests(by_group(spark, A=[1.0, 1.0], B=[2.0, 2.0])).first()
    assert (r["statistic"], r["p_value"], r["likely_significant"]) == (float("-inf"), 0.0, True)
    assert hypothesis.hypothesis_tests(by_group(spark, A=[1.0, 1.0], B=[1.0, 1.0])).count() == 0
    three = hypothesis.hypothesis_tests(by_group(spark, A=[1.0] * 2, B=[2.0] * 2, C=[3.0] * 2)).first()
    assert three["statistic"] == float("inf")


def test_large_offsets_keep_their_variance(spark):
    df = by_group(spark, A=[1e9 + i % 3 for i in range(99)], B=[1e9 + i % 3 + 1 for i in range(99)])
    m = {r["category"]: r["variance"] for r in hypothesis.group_moments(df, ["g"], ["v"]).collect()}
    assert m["A"] == pytest.approx(m["B"], rel=1e-6) == pytest.approx(66 / 98, rel=1e-6)


def test_empty(spark):
    assert hypothesis.hypothesis_tests(spark.range(0).selectExpr("'a' AS g", "1.0D AS v")).count() == 0
