"""Files to DataFrames: CSV, JSON, Parquet and Excel, with types found in the data."""

from __future__ import annotations

import os
import re
import uuid
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelens.functions.parse import BOOLEAN, INTEGER, null_tokens_to_null, parse_number
from tablelens.schema import chunks, classify, col
from tablelens.sources.records import ListedObjects, QuotedLines, records
from tablelens.sources.scratch import materialize, release, scratch_folder
from tablelens.thresholds import LIMITS

# A failed task reaches the driver as the one, a failed plan as the other.
READ_ERRORS = (PySparkException, Py4JJavaError)
SUPPORTED = (".csv", ".json", ".parquet", ".xls", ".xlsx")


def require_rows(df: DataFrame, path: str) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} contains no rows.")
    return df


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns a type if every value fits: whole number, number, truth value, else text.

    One scan decides for the whole column; known tokens for "missing" become NULL. Dates stay text.
    """
    names = classify(df).text
    types: dict[str, str] = {}
    for block in chunks(names, LIMITS.columns_per_job):
        wanted = []
        for i, n in enumerate(block):
            c = null_tokens_to_null(col(n))
            wanted += [
                F.count(c).alias(f"all{i}"),
                F.count(F.when(c.rlike(INTEGER), F.trim(c).try_cast("bigint"))).alias(f"int{i}"),
                F.count(parse_number(c)).alias(f"num{i}"),
                F.count_if(c.rlike(BOOLEAN)).alias(f"bool{i}"),
            ]
        row = df.agg(*wanted).first()
        for i, n in enumerate(block):
            full = row[f"all{i}"]
            types[n] = next((t for t, k in (("bigint", "int"), ("double", "num"), ("boolean", "bool"))
                             if full and row[f"{k}{i}"] == full), "double" if not full else "string")
    cells = []
    for n in df.columns:
        if n not in types:
            cells.append(col(n))
            continue
        c = null_tokens_to_null(col(n))
        if types[n] == "double":
            c = parse_number(c)
        elif types[n] != "string":
            c = F.trim(c).try_cast(types[n])
        cells.append(c.alias(n))
    return df.select(*cells)


def _same(path: str) -> str:
    """A file's path in one spelling, whether Spark quoted it or not."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(path))


def _files_by_kind(spark: SparkSession, path: str | list[str], probe: DataFrame) -> dict[str, str | list[str]]:
    """Paths to read for each ``kind`` in ``probe`` (file, kind); ``path`` itself if all files are of one kind.

    Only the paths of the files that are not of the commonest kind are collected.
    """
    probe = probe.persist()
    try:
        kinds = [r["kind"] for r in probe.groupBy("kind").count().orderBy(F.desc("count"), "kind").collect()]
        if len(kinds) < 2:
            return {k: path for k in kinds}
        others: dict[str, str | list[str]] = {}
        for r in probe.filter(F.col("kind") != kinds[0]).collect():
            others.setdefault(r["kind"], []).append(unquote(r["file"]))
    finally:
        probe.unpersist()
    taken = {_same(f) for files in others.values() for f in files}
    return {kinds[0]: [unquote(f) for f in spark.read.text(path).inputFiles() if _same(f) not in taken], **others}


_CSV = {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _csv_probe(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind): encoding, way of reading and first line of each file, from one scan of the lines.

    The first line is part of the kind: files are read together only if their columns stand in the same order.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    bare = F.regexp_replace(line, "\r$", "")
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    probe = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place")).groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(line)).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open_quotes"), F.bool_or(bare.contains("\r")).alias("returns"),
        F.min_by(F.when(F.trim(bare) != "", bare), F.when(F.trim(bare) != "", F.col("place"))).alias("header"))
    odd = (F.length("header") - F.length(F.replace("header", F.lit('"'), F.lit("")))) % 2 == 1
    way = F.when(~F.col("open_quotes"), F.lit("lines")).when(F.col("returns"), F.lit("whole")).otherwise(F.lit("quoted"))
    return probe.select("file", F.concat_ws(
        " ", F.when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")), way, "header", F.when(odd, F.col("file"))).alias("kind"))


def _quoted_csv(spark: SparkSession, files: str | list[str], encoding: str) -> DataFrame:
    """Files with line breaks in quoted values, split like any other."""
    names = spark.read.options(**_CSV, multiLine=True, encoding=encoding).csv(files).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    # line ends inside values become \n, as a reader of whole files has it
    text = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "\r\n", "\n")
    found = records(spark, files, QuotedLines(encoding)).where("NOT first").select(
        F.from_csv(text, schema, {k: str(v) for k, v in _CSV.items() if k != "header"}).alias("r"))
    return found.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header in the first row of each file; UTF-8, or Latin-1 for a file that is not valid UTF-8.

    Columns go by name: files whose header differs are read apart and put together, a column that a file lacks is
    NULL there. One cheap scan of the lines finds header, encoding and open quotes file by file. Files with quotes
    that stay open at the end of a line are cut into records in parallel; only those with bare carriage returns as
    well are read whole, one per task.
    """
    try:
        kinds = _files_by_kind(spark, path, _csv_probe(spark, path))
        if not kinds:
            raise ValueError(f"{path} is empty.")
        parts = []
        for kind, files in kinds.items():
            encoding, way = kind.split(" ", 2)[:2]
            if way == "quoted":
                parts.append(_quoted_csv(spark, files, encoding))
            else:
                parts.append(spark.read.options(**_CSV, multiLine=way == "whole", encoding=encoding).csv(files))
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return infer_types(require_rows(found, path))
    except READ_ERRORS as e:
        raise _unreadable(path, "CSV", e) from e


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, an object of columns, or one record per line; recognised file by file from its beginning.

    Lists are cut into records in parallel, also on a single line. Only first characters and the ends of first
    lines are looked at, so that a file on a single line never reaches the driver.
    """
    try:
        text = F.btrim("value", F.lit(" \t\r\n\ufeff"))
        pieces = spark.read.option("lineSep", "}").text(path).where(text != "").select(
            F.col("_metadata.file_path").alias("file"), F.substring(text, 1, 1).alias("head"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
        probe = pieces.groupBy("file").agg(F.min_by("head", "place").alias("head"))
        kinds = _files_by_kind(spark, path, probe.select("file", F.when(F.col("head") != "{", F.lit("list")).otherwise(F.lit("objects")).alias("kind")))
        if not kinds:
            raise ValueError(f"{path} is empty.")
        parts = []
        if "list" in kinds:
            parts.append(_listed_objects(spark, path, kinds["list"]))
        if "objects" in kinds:
            parts += _objects(spark, kinds["objects"])
        return require_rows(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), path)
    except READ_ERRORS as e:
        raise _unreadable(path, "JSON", e) from e


def _objects(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """Files that begin with an object: one record per line, or columns."""
    text = F.trim("value")
    lines = spark.read.text(path).filter(text != "").select(
        F.col("_metadata.file_path").alias("file"), F.substring(text, -1, 1).alias("tail"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    probe = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("tail", "place").alias("tail"))
    is_records = (F.col("n") > 1) & (F.col("tail") == "}")
    kinds = _files_by_kind(spark, path, probe.select("file", F.when(is_records, F.lit("records")).otherwise(F.lit("columns")).alias("kind")))
    read = {
        "records": lambda files: spark.read.option("mode", "FAILFAST").json(files),
        "columns": lambda files: _column_objects(spark, files),
    }
    return [read[kind](files) for kind, files in kinds.items()]


def _listed_objects(spark: SparkSession, path: str, files: str | list[str]) -> DataFrame:
    """``[{...}, {...}]`` on one line or many: cut into objects in parallel, then read as one object per line."""
    found = materialize(records(spark, files, ListedObjects()), "json-objects")
    text = F.btrim("text", F.lit(" \t\r\n\ufeff"))
    begins = F.when(F.col("first"), F.lit("[")).otherwise(F.lit(","))
    end = F.regexp_replace(text, r"\s", "")
    per_file = found.groupBy("file").agg(
        F.count_if("closed").alias("n"), F.count_if(F.col("closed") & ~F.startswith(text, begins)).alias("odd"),
        F.count_if(~F.col("closed") & end.isin("]", "[]")).alias("ends"), F.count_if(~F.col("closed") & (end == "")).alias("blank"))
    if not per_file.where("NOT (odd = 0 AND (ends = 1 OR (n = 0 AND blank = 1)))").isEmpty():
        raise ValueError(f"Could not read {path} as JSON: a list does not hold objects only, or ends too early.")
    line = F.regexp_replace(F.substring(text, F.lit(2), F.length(text)), "[\r\n]", " ").alias("value")
    lines = f"{scratch_folder(spark)}/json-lines-{uuid.uuid4().hex}"
    found.where("closed").select(line).write.text(lines)
    release(found)
    return spark.read.option("mode", "FAILFAST").json(lines)


def _column_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``{"column": {"row": value}}`` or ``{"column": [values]}``, one object per file."""
    whole = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,string>").alias("m"), F.col("_metadata.file_path").alias("file"))
    if not whole.filter("m IS NULL").isEmpty():
        raise ValueError(f"Could not read {path} as JSON: neither records nor columns.")
    columns = whole.select("file", F.explode("m").alias("column_name", "body"))
    by_row = columns.select("file", "column_name", F.explode(F.from_json("body", "map<string,string>")).alias("row", "value"))
    by_place = columns.filter(F.startswith(F.col("body"), F.lit("["))).select(
        "file", "column_name", F.posexplode(F.from_json("body", "array<string>")).alias("row", "value"))
    cells = by_row.unionByName(by_place.withColumn("row", F.col("row").cast("string")))
    # Names only, in the order of the first object.
    order = [r["column_name"] for r in columns.select("column_name").distinct().collect()]
    seen = [r["column_name"] for r in columns.select("column_name").limit(len(order)).collect()]
    order.sort(key=lambda n: seen.index(n) if n in seen else len(seen))
    if not order:
        raise ValueError(f"{path} contains no rows.")
    wide = cells.groupBy("file", "row").pivot("column_name", order).agg(F.first("value"))
    return infer_types(wide.select(*[col(n) for n in order]))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return require_rows(spark.read.parquet(path), path)
    except READ_ERRORS as e:
        raise _unreadable(path, "Parquet", e) from e


def _unreadable(path: str, kind: str, error: Exception) -> Exception:
    text = str(error)
    if "PATH_NOT_FOUND" in text:
        return FileNotFoundError(f"No file found at {path}.")
    return ValueError(f"Could not read {path} as {kind}: {' '.join(text.split())[:300]}")


def load_data_file(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader by suffix; folders and glob patterns work as long as the name ends in a suffix."""
    from tablelens.sources.excel import read_excel

    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUPPORTED:
        raise ValueError(f"Unsupported file type '{suffix}'. Supported: {', '.join(SUPPORTED)}.")
    if suffix == ".xls":
        raise ValueError(f"Could not read {path}: the binary .xls format is not supported, save it as .xlsx.")
    readers = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet, ".xlsx": read_excel}
    return readers[suffix](spark, path)
