"""Derived tables, written once and run by both engines.

The test tables have no missing values and no repeated rows, so these views put some in by a rule on the
key. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # Missing prices and priorities, some prices twenty times too high, three spellings per priority.
    "dirty_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL
                    WHEN o_orderkey % 101 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL
                    WHEN o_orderkey % 7 = 1 THEN lower(o_orderpriority)
                    WHEN o_orderkey % 7 = 2 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    # The same without a key: many rows repeat.
    "dirty_status": """
        SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE floor(o_totalprice / 50000) END AS price_band,
               o_orderstatus,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL
                    WHEN o_orderkey % 7 = 1 THEN lower(o_orderpriority)
                    WHEN o_orderkey % 7 = 2 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "line_terms": "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem",
    "line_amounts": """
        SELECT l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS revenue,
               l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice * l_tax AS tax_amount,
               CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity * 2 + l_tax END AS doubled,
               1 AS one
        FROM lineitem""",
    "part_extra": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, 'EUR' AS currency FROM part",
    "order_texts": """
        SELECT CAST(o_custkey AS VARCHAR(20)) AS cust_text,
               CASE WHEN o_orderkey % 10 = 0 THEN 'not known' ELSE CAST(o_totalprice AS VARCHAR(30)) END AS price_text,
               CASE WHEN o_orderkey % 10 < 3 THEN 'later' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS late_text,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS date_text, o_orderpriority
        FROM orders""",
    "order_strings": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS o_orderkey,
               CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE CAST(o_totalprice AS VARCHAR(30)) END AS o_totalprice,
               CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS finished,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS o_orderdate, o_orderpriority
        FROM orders""",
    "order_days": """
        SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders""",
    "event_days": "SELECT event_type, CAST(ts AS DATE) AS day, value FROM events",
    # Exact straight lines of different lengths, one point a day.
    "trend_lines": """
        SELECT line, DATE '2000-01-01' + CAST(i AS INTEGER) AS day, 10 * line + i / 2.0 AS value
        FROM (SELECT o_custkey % 5 AS line, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS i FROM orders) AS numbered""",
    "order_lines": """
        SELECT o_orderstatus, o_orderpriority, c_mktsegment, o_totalprice, c_acctbal
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # A log of query texts, one per order, some of them unsafe.
    "query_log": """
        SELECT o_orderkey, CASE o_orderkey % 9
            WHEN 0 THEN concat('SELECT * FROM data WHERE id = ', CAST(o_orderkey AS VARCHAR(20)))
            WHEN 1 THEN concat('DELETE FROM data WHERE id = ', CAST(o_orderkey AS VARCHAR(20)))
            WHEN 2 THEN concat('SELECT 1; drop table ', o_orderstatus)
            WHEN 3 THEN concat('WITH t AS (SELECT 1 AS a) SELECT a FROM t -- update ', o_orderpriority)
            WHEN 4 THEN '  /* nothing */ '
            WHEN 5 THEN concat('select dropoff, updated FROM data LIMIT ', CAST(o_custkey AS VARCHAR(20)), ';')
            WHEN 6 THEN concat('SELECT 1; SELECT ', CAST(o_custkey AS VARCHAR(20)))
            WHEN 7 THEN concat('PRAGMA table_info(', o_orderstatus, ')')
            ELSE concat('explain insert into data select ', CAST(o_custkey AS VARCHAR(20))) END AS query
        FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SOURCES = ("orders", "lineitem", "part", "events", "customer")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = [t for t in _SOURCES if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def cte(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
