import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.functions.parse import fold_category, parse_number, parse_timestamp

NUMBERS = {" 1e5 ": 1e5, "-3": -3.0, ".5": 0.5, "5.": 5.0, "inf": float("inf"), "-Infinity": float("-inf"),
           "1d": None, "1f": None, "1,000": None, "1_000": None, "NaN": None, "": None, "twenty": None, "1 2": None, "0x1p3": None}
DAY = dt.datetime(2024, 1, 5)
DATES = {
    "2024-01-05": DAY, "2024-1-5": DAY, " 2024-01-05 ": DAY, "2024/01/05": DAY, "20240105": DAY, "01/05/2024": DAY,
    "1-5-2024": DAY, "Jan 5, 2024": DAY, "January 5 2024": DAY, "5 Jan 2024": DAY, "5th january 2024": DAY,
    "31/01/2024": dt.datetime(2024, 1, 31), "2024": dt.datetime(2024, 1, 1), "2024-05": dt.datetime(2024, 5, 1),
    "2024-01-05 10:30": DAY.replace(hour=10, minute=30), "2024-01-05T10:30:15.25": dt.datetime(2024, 1, 5, 10, 30, 15, 250000),
    "05/01/2024 08:00": dt.datetime(2024, 5, 1, 8), "2024-13-01": None, "2024-02-30": None, "12:30": None, "now": None,
    "1": None, "12": None, "1.5": None, "Foo 5 2024": None, "Marble 5 2024": None, "hello": None, "": None, "99999999": None,
    "5-LOW": None, "Brand#12": None,
}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_numbers(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(k,) for k in NUMBERS], "s string")
        assert {r["s"]: r["n"] for r in df.select("s", parse_number(F.col("s")).alias("n")).collect()} == NUMBERS
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", parse_timestamp(F.col("s")).alias("t")).collect()} == DATES


def test_fold(spark):
    df = spark.createDataFrame([("\t Hr \n",)], "s string")
    assert df.select(fold_category(F.col("s"))).first()[0] == "hr"
