"""Read-only SQL over DataFrames, and the audit of query texts as a column operator."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablelens.functions.parse import strip

# Words that have no place in a read-only query.
BANNED_WORDS = (
    "ALTER", "ATTACH", "CREATE", "DELETE", "DETACH", "DROP", "GRANT", "INSERT", "PRAGMA", "REINDEX",
    "REPLACE", "REVOKE", "TRUNCATE", "UPDATE", "VACUUM",
)
# Functions that call arbitrary JVM methods although they are part of an ordinary SELECT.
_METHOD_CALLS = r"(?i)\b(?:try_reflect|reflect|java_method)\b`?\s*\("


# The semicolon that ends a statement, with whatever comments follow it.
_AFTER_LAST = re.compile(r";(?:\s|;|--[^\n]*(?:\n|\Z)|/\*(?:(?!\*/).)*\*/)*\Z", re.S)


def _without_comments(sql: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*(?:\n|\z)", " "), r"(?s)/\*.*?\*/", " "))


def audit_queries(df: DataFrame, text: str) -> DataFrame:
    """Add ``safe`` and ``violations`` to a log of query texts. A projection without shuffle.

    Intermediate values are columns of their own, so that each pattern runs once per text.
    """
    words = "|".join(BANNED_WORDS)
    bare, first, found = F.col("_bare"), F.col("_first"), F.col("_found")
    statements = F.size(F.filter(F.split(bare, ";"), lambda s: strip(s) != ""))
    problems = F.array_compact(F.array(
        F.when(F.col("_statements") != 1,
               F.concat(F.lit("one statement expected, found "), F.col("_statements").cast("string"))),
        F.when(~first.isin("SELECT", "WITH"),
               F.concat(F.lit("starts with '"), first, F.lit("' instead of SELECT or WITH"))),
        F.when(F.size(found) > 0, F.concat(F.lit("banned words: "), F.array_join(found, ", "))),
    ))
    return (df.withColumn("_bare", _without_comments(F.coalesce(F.col(text), F.lit(""))))
            .withColumns({
                "_statements": statements, "_first": F.upper(F.regexp_extract(bare, r"^(\w+)", 1)),
                "_found": F.array_sort(F.array_distinct(F.transform(
                    F.regexp_extract_all(bare, F.lit(rf"(?i)\b(?:{words})\b"), F.lit(0)), F.upper))),
            })
            .withColumn("violations", F.when(bare == "", F.array(F.lit("empty query"))).otherwise(problems))
            .withColumn("safe", F.size("violations") == 0)
            .select(*df.columns, "safe", "violations"))


@dataclass
class QueryResult:
    success: bool
    df: DataFrame | None
    error: str | None

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []


def register_table(df: DataFrame, name: str = "data") -> None:
    df.createOrReplaceTempView(name)


def _violations(spark: SparkSession, sql: str) -> list[str]:
    one = spark.range(1).select(F.lit(sql).alias("sql"), _without_comments(F.lit(sql)).rlike(_METHOD_CALLS).alias("calls"))
    row = audit_queries(one, "sql").first()
    return list(row["violations"]) + (["calls a JVM method"] if row["calls"] else [])


def _sequence(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _relations(df: DataFrame) -> set[str]:
    """Views, catalog tables and files that an analysed plan reads: a walk over its nodes, sub-queries included.

    A view is named and not entered, since what it reads was decided when it was made.
    """
    found, todo = set(), [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "View":
            found.add(node.desc().identifier().unquotedString())
            continue
        if kind == "LogicalRelation" and node.catalogTable().isDefined():
            found.add(node.catalogTable().get().identifier().unquotedString())
        elif kind in ("HiveTableRelation", "UnresolvedCatalogRelation"):
            found.add(node.tableMeta().identifier().unquotedString())
        elif kind in ("RelationV2", "DataSourceV2Relation") and node.identifier().isDefined():
            found.add(node.name())
        todo += _sequence(node.children()) + _sequence(node.subqueries())
    return found


def query_readonly(tables: DataFrame | Mapping[str, DataFrame], sql: str) -> QueryResult:
    """Run one SELECT over ``data`` (or the given names); anything else comes back as an error.

    The given tables are common table expressions around the text, over views of unique names that are dropped
    again: no view of the session is replaced, and a plan that reads any other relation is refused. The
    text must be a statement by itself and a sub-query, a place where the grammar admits no commands; file paths
    are no table names.
    """
    named = dict(tables) if isinstance(tables, Mapping) else {"data": tables}
    spark = next(iter(named.values())).sparkSession
    problems = _violations(spark, sql)
    if problems:
        return QueryResult(False, None, "; ".join(problems))
    hidden = {name: f"tablelens_{uuid.uuid4().hex}" for name in named}
    setting = "spark.sql.runSQLOnFiles"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        for name, df in named.items():
            register_table(df, hidden[name])
        given = ", ".join(f"`{n.replace('`', '``')}` AS (SELECT * FROM {h})" for n, h in hidden.items())
        body = _AFTER_LAST.sub("", sql)
        spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
        found = spark.sql(f"WITH {given} SELECT * FROM (\n{body}\n)")
        allowed = set(hidden.values()).union(*map(_relations, named.values()))
        others = _relations(found) - allowed
        if others:
            return QueryResult(False, None, f"reads other tables: {', '.join(sorted(others))}")
        return QueryResult(True, found, None)
    except (PySparkException, Py4JJavaError) as e:
        return QueryResult(False, None, str(e))
    finally:
        spark.conf.set(setting, before)
        for h in hidden.values():
            spark.catalog.dropTempView(h)
