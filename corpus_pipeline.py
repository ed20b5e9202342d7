"""From raw documents to token ids: five stages, each a training-data operator at work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import bpe, decontaminate, language, linededup, simhash
from tablelens.llm.bounded import broadcast_if_small
from tablelens.llm.shared import written

#: Least probability of the predicted language; a tie of two languages has one half.
LEAST_SCORE = 0.4
#: Names for what a stage adds for itself, which no table has.
OWN = ("pipeline: first", "pipeline: second")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Texts that are null or have no letter go, as do ties of three languages."""
    found = language.identify_languages(docs, language.fit_languages(docs), keep=docs.columns, names=OWN)
    return found.where((F.col(f"`{OWN[0]}`") != language.UNKNOWN) & (F.col(f"`{OWN[1]}`") >= LEAST_SCORE)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of blocks are cut out and n_chars follows; documents of which no word is left go."""
    found = linededup.dedup_lines(docs, names=OWN)
    removed = F.col(f"`{OWN[0]}`")
    left = (removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(removed > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.where(left).withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints (shingles of 3 words, 2 bits)."""
    return simhash.one_of_each(docs, width=3, distance=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items).where("contaminated")
    bad = written(found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    same = F.col("d.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("d.text") == F.col("bad_hash"))
    return docs.alias("d").join(broadcast_if_small(bad), same, "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.encode_and_decode(docs, ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Context trees, alignments and merges have no SQL; the stages are tested against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
