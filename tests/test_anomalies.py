import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import anomalies, isolation
from tablelens.sources.scratch import materialize, scratch_folder


def test_zscore(rows):
    df = rows([(v,) for v in [10] * 30 + [1000]], "value bigint")
    assert [tuple(r) for r in anomalies.zscore_outliers(df).collect()] == [("value", 1, 3.2)]
    assert anomalies.zscore_outliers(df, exclude={"value"}).count() == 0
    assert anomalies.zscore_outliers(rows([(5,)] * 4, "v int")).count() == 0


@pytest.fixture(scope="module")
def cloud(spark):
    random.seed(42)
    data = [(i, random.gauss(50, 5), random.gauss(100, 10)) for i in range(400)] + [(400, 500.0, -300.0)]
    return spark.createDataFrame(data, "record_id bigint, a double, b double")


def test_forest_flags_about_five_percent(cloud):
    report = isolation.isolation_forest(cloud, ["record_id"])
    assert report.ran and report.rows_checked == 401 and 4.0 <= report.pct <= 6.0
    top = report.top.collect()
    assert len(top) == 5 and top[0]["record_id"] == 400
    assert all(-1.0 <= r["anomaly_score"] < 0.0 for r in top)
    assert set(report.top.columns) == {"record_id", "a", "b", "anomaly_score"}


def test_forest_is_the_same_on_any_partitioning(cloud):
    a = isolation.isolation_forest(cloud.repartition(1), ["record_id"])
    b = isolation.isolation_forest(cloud.repartition(9, F.rand(5)), ["record_id"])
    assert sorted(a.scored.collect()) == sorted(b.scored.collect()) and a.threshold == b.threshold


def test_forest_needs_rows_and_columns(rows):
    assert "rows" in isolation.isolation_forest(rows([(i, i) for i in range(3)], "a int, b int")).reason
    assert "columns" in isolation.isolation_forest(rows([(i,) for i in range(20)], "a int")).reason


def test_forest_excludes_columns_and_incomplete_rows(cloud):
    df = cloud.withColumn("c", F.lit(1.0)).unionByName(cloud.limit(5).withColumn("c", F.lit(None).cast("double")))
    report = isolation.isolation_forest(df, exclude={"record_id"})
    assert report.rows_checked == 401 and "record_id" not in report.top.columns


def test_copies_of_one_row_are_not_drawn_all_or_none(spark):
    """A key that repeats is not used for the draws: a third of the rows share it here."""
    df = spark.range(3_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k",
                                       "CASE WHEN id % 3 = 0 THEN 1.0D ELSE rand(1) END AS a",
                                       "CASE WHEN id % 3 = 0 THEN 1.0D ELSE rand(2) END AS b")
    report = isolation.isolation_forest(df, ["k"])
    assert report.ran and report.rows_checked == 3_000
    share = isolation.tree_samples(df, ["a", "b"], [], 3_000).agg(F.avg((F.col("x")[0] == 1.0).cast("int"))).first()[0]
    assert 0.28 < share < 0.39


def test_samples_have_the_right_size(cloud):
    sizes = isolation.tree_samples(cloud, ["a", "b"], ["record_id"], 401).groupBy("tree").count().collect()
    assert len(sizes) == 100 and {r["count"] for r in sizes} == {256}


@pytest.mark.parametrize("key", [[], ["id"]])
@pytest.mark.parametrize("n", [2_000, 90_000])
def test_samples_do_not_depend_on_partitions(spark, key, n):
    df = spark.range(n).selectExpr("id", "CAST(id * 7919 % 1000 AS double) AS a", "CAST(id * 31 % 97 AS double) AS b")
    one, many = ({(r["tree"], r["draw"], tuple(r["x"])) for r in isolation.tree_samples(d, ["a", "b"], key, n).collect()}
                 for d in (df.coalesce(1), df.repartition(7)))
    assert one == many and len(one) == 100 * 256


def test_every_row_of_a_large_table_can_be_drawn(spark):
    """Above any size: the draws spread over the whole table, and a row with many copies is drawn by its share."""
    df = spark.range(120_000).selectExpr("id", "CAST(IF(id % 2 = 0, -1, id) AS double) AS a", "1.0D AS b")
    for key in ([], ["id"]):
        x = [r["x"][0] for r in isolation.tree_samples(df, ["a", "b"], key, 120_000).collect()]
        assert 0.47 < sum(v == -1 for v in x) / len(x) < 0.53
        rest = [v for v in x if v != -1]
        assert len(set(rest)) > 0.8 * len(rest) and 0.45 < sum(v < 60_000 for v in rest) / len(rest) < 0.55


def test_score_formula():
    """A forest of one split: the path length of both sides is one plus the depth saved in the leaf."""
    leaf = isolation._mean_depth(np.array([4]))[0]
    tree = (np.array([0, 0, 0]), np.array([0.5, np.inf, np.inf]), np.array([1, 2, 1, 1, 2, 2]), np.array([0.0, 1.0, 1.0 + leaf]))
    got = isolation.Forest(("a",), 5, (tree,), 3).score(np.array([[0.2], [0.9]]))
    norm = isolation._mean_depth(np.array(5))
    assert got == pytest.approx([-2.0 ** (-1.0 / norm), -2.0 ** (-(1.0 + leaf) / norm)])
    assert list(isolation._mean_depth(np.array([0, 1, 2]))) == [0.0, 0.0, 1.0]


class Settings:
    """A session with the given settings."""

    def __init__(self, **values):
        self.conf = {k.replace("_", "."): v for k, v in values.items()}


def test_scratch_folder():
    assert scratch_folder(Settings(spark_checkpoint_dir="hdfs:///shared", spark_master="yarn")) == "hdfs:///shared"
    assert "tablelens-" in scratch_folder(Settings(spark_master="local[4]"))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_folder(Settings(spark_master="yarn"))


def test_materialize_reads_back_what_it_wrote(spark):
    assert materialize(spark.range(3), "t").count() == 3


def test_release_deletes_the_files(spark, tmp_path):
    import os
    from urllib.parse import urlparse

    from tablelens.sources.scratch import release

    df = materialize(spark.range(3), "gone")
    folder = os.path.dirname(urlparse(df.inputFiles()[0]).path)
    assert os.path.isdir(folder)
    release(df)
    assert not os.path.exists(folder)


def test_given_trees_score_like_a_walk(rows):
    trees = [("a", 2.5, 4, ("b", 1.0, 2, 1)), ("b", 0.5, ("a", 7.0, 3, 1), 5)]
    df = rows([(a, b) for a in range(10) for b in (0, 1, 2)], "a int, b int")

    def depth(tree, row, d=0):
        if isinstance(tree, tuple):
            return depth(tree[3] if row[tree[0]] > tree[1] else tree[2], row, d + 1)
        return d + (0 if tree < 2 else 1 if tree == 2 else 2 * (np.log(tree - 1) + np.euler_gamma) - 2 * (tree - 1) / tree)

    norm = 2 * (np.log(7) + np.euler_gamma) - 2 * 7 / 8
    report = isolation.judge(df, isolation.forest_of(["a", "b"], trees, 8), 30, ["a", "b"])
    for r in report.scored.collect():
        assert np.isclose(r["anomaly_score"], -2 ** (-sum(depth(t, r) for t in trees) / 2 / norm))
    assert report.anomalous == report.scored.filter(F.col("anomaly_score") < report.threshold).count() and report.rows_checked == 30
