import math
import random

import numpy as np
import pytest

from tablelens.operators.columnstats import table_stats
from tablelens.operators.quantiles import exact_quantiles, quantile

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(df, names, buffer):
    stats = table_stats(df, names, sketch=False, parse=False)
    got = exact_quantiles(df, PROBS, stats.columns, buffer=buffer)
    for name in names:
        values = np.array([r[0] for r in df.select(name).collect() if r[0] is not None], dtype=float)
        assert got[name] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("buffer", [1, 10, 100_000])
def test_against_numpy(spark, buffer):
    random.seed(1)
    data = [(random.gauss(0, 1), random.expovariate(1.0) ** 8, float(random.randint(0, 3)),
             None if i % 5 == 0 else random.uniform(-1e9, 1e-9), 7.0) for i in range(3_000)]
    df = spark.createDataFrame(data, "n double, tail double, few double, gaps double, same double")
    check(df, ["n", "tail", "few", "gaps", "same"], buffer)


def test_one_value_holds_a_third(spark):
    df = spark.range(9_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0.5D ELSE pow(id, 3) END AS v")
    check(df, ["v"], 1)


def test_extreme_doubles(spark):
    values = [-1.7e308, -1e300, -5e-324, 0.0, 5e-324, 1e-310, 1.0, 1e300, 1.7e308]
    check(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], 1)


def test_infinities(spark):
    df = spark.createDataFrame([(v,) for v in (-math.inf, 1.0, 2.0, 3.0, math.inf)], "v double")
    stats = table_stats(df, ["v"], sketch=False, parse=False)
    assert exact_quantiles(df, [0.0, 0.25, 0.5, 1.0], stats.columns, buffer=1)["v"] == [-math.inf, 1.0, 2.0, math.inf]


def test_small_tables_use_one_aggregate(spark):
    check(spark.range(101).selectExpr("CAST(id AS double) AS v"), ["v"], 1_000)
    assert quantile(spark.range(4), "id", 0.5) == 1.5
    assert quantile(spark.range(0), "id", 0.5) is None
