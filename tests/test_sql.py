import pytest
from pyspark.sql import functions as F

from tablelens.operators import sqlguard

CASES = {
    "SELECT category, AVG(price) FROM data GROUP BY category": True,
    "WITH top AS (SELECT * FROM data LIMIT 5) SELECT * FROM top": True,
    "select 1;": True,
    "SELECT dropoff_location, updated_at FROM data": True,
    "SELECT 1 -- drop table data": True,
    "SELECT /* delete\nupdate */ 1": True,
    "DROP TABLE data": False,
    "SELECT * FROM data; DROP TABLE data;": False,
    "SELECT 1; SELECT 2": False,
    "PRAGMA table_info(data)": False,
    "": False, "   ": False, "-- nothing": False, ";": False,
    "EXPLAIN SELECT 1": False,
    "WITH x AS (SELECT 1) DELETE FROM data": False,
}


def test_audit(spark):
    df = spark.createDataFrame(list(CASES.items()), "q string, want boolean")
    got = sqlguard.audit_queries(df, "q").collect()
    assert [r["q"] for r in got if r["safe"] != r["want"]] == []
    by_text = {r["q"]: r["violations"] for r in got}
    assert by_text[""] == ["empty query"] and by_text["SELECT 1"] if "SELECT 1" in by_text else True
    assert by_text["DROP TABLE data"] == ["starts with 'DROP' instead of SELECT or WITH", "banned words: DROP"]
    assert by_text["SELECT 1; SELECT 2"] == ["one statement expected, found 2"]


@pytest.fixture
def data(rows):
    return rows([("a", 10.0), ("a", 20.0), ("b", 5.0)], "category string, price double")


def test_query(data):
    r = sqlguard.query_readonly(data, "SELECT category, avg(price) AS p FROM data GROUP BY category ORDER BY 1 -- note")
    assert r.success and r.columns == ["category", "p"] and [tuple(x) for x in r.df.collect()] == [("a", 15.0), ("b", 5.0)]


@pytest.mark.parametrize("sql", [
    "DROP TABLE data", "SELECT * FROM data; SELECT 1", "SELECT nothing FROM data", "SELEC 1", "WITH t AS (SELECT 1 AS a) INSERT INTO data SELECT * FROM t",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('java.lang.Math', 'abs', -1)", "SELECT `reflect`('a', 'b')",
    "SELECT try_reflect('a', 'b')", "SELECT 1) UNION (SELECT 2", "SET spark.sql.ansi.enabled = false", "WITH t AS (SELECT 1) FROM data INSERT OVERWRITE x SELECT *",
])
def test_refused(data, sql):
    r = sqlguard.query_readonly(data, sql)
    assert not r.success and r.error and r.df is None


def test_files_are_no_tables(spark, data, tmp_path):
    path = str(tmp_path / "t")
    data.write.parquet(path)
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    assert not sqlguard.query_readonly(data, f"SELECT * FROM parquet.`{path}`").success
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before


def test_several_tables(data, rows):
    names = rows([("a", "first")], "category string, name string")
    r = sqlguard.query_readonly({"data": data, "names": names}, "SELECT name, sum(price) AS s FROM data JOIN names USING (category) GROUP BY name")
    assert r.df.first().asDict() == {"name": "first", "s": 30.0}


def test_other_views_are_out_of_reach(spark, data):
    spark.range(3).createOrReplaceTempView("secret_other")
    spark.range(7).createOrReplaceTempView("data")
    try:
        for sql in ("SELECT * FROM secret_other", "SELECT (SELECT max(id) FROM secret_other) AS m FROM data",
                    "WITH t AS (SELECT * FROM secret_other) SELECT * FROM t", "SELECT price FROM data WHERE price IN (SELECT id FROM secret_other)"):
            r = sqlguard.query_readonly(data, sql)
            assert not r.success and "secret_other" in r.error
        assert sqlguard.query_readonly(data, "SELECT count(*) AS n FROM data").df.first()["n"] == 3
        assert spark.table("data").count() == 7
        assert {t.name for t in spark.catalog.listTables()} >= {"data", "secret_other"}
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("tablelens_")]
    finally:
        spark.catalog.dropTempView("secret_other")
        spark.catalog.dropTempView("data")


@pytest.mark.parametrize("sql", ["SELECT count(*) AS n FROM data; -- done", "SELECT count(*) AS n FROM data /* a */ ; /* b; */ -- c",
                                 "SELECT count(*) AS n FROM data -- x", "WITH data2 AS (SELECT * FROM data) SELECT count(*) AS n FROM data2;"])
def test_comments_after_the_statement(data, sql):
    assert sqlguard.query_readonly(data, sql).df.first()["n"] == 3


def test_relations_are_read_from_the_nodes_of_a_plan(spark, data, tmp_path):
    spark.range(3).createOrReplaceTempView("`odd (name, x)`")
    spark.sql("CREATE OR REPLACE TEMP VIEW outer_view AS SELECT 1 AS id, (SELECT max(id) FROM `odd (name, x)`) AS m")
    try:
        for sql in ("SELECT * FROM `odd (name, x)`", "SELECT price FROM data WHERE EXISTS (SELECT 1 FROM (SELECT id FROM `odd (name, x)`) t WHERE t.id = price)",
                    "SELECT * FROM data, LATERAL (SELECT max(m) AS m FROM outer_view)"):
            r = sqlguard.query_readonly(data, sql)
            assert not r.success and "reads other tables" in r.error
        r = sqlguard.query_readonly(data, "SELECT 'View (`x`, y)' AS t, 'SubqueryAlias a.b.c' AS u FROM data")  # text is no relation
        assert r.success and r.df.count() == 3
        over = spark.table("outer_view").select(F.col("id").alias("price"))
        assert sqlguard.query_readonly(over, "SELECT sum(price) AS s FROM data").df.first()["s"] == 1
    finally:
        spark.catalog.dropTempView("odd (name, x)")
        spark.catalog.dropTempView("outer_view")
