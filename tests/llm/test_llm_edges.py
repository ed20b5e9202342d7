"""Every operator on rows that invite a crash: one result per row, and none from an empty table."""

import pytest

import corpus_pipeline
from tablelens.llm import (
    bpe, collocations, decontaminate, html_text, language, lexical_search, linededup, pii, quality_model, quality_rules, secrets, simhash,
    toxicity,
)

OPERATORS = {
    "rules": lambda d, i, l: quality_rules.quality_rules(d),
    "pii": lambda d, i, l: pii.find_personal_data(d),
    "sanitised": lambda d, i, l: pii.sanitise(pii.find_personal_data(d)),
    "language": lambda d, i, l: language.identify_languages(d, language.fit_languages(d)),
    "lines": lambda d, i, l: linededup.dedup_lines(d),
    "simhash": lambda d, i, l: simhash.near_duplicates(d),
    "quality": lambda d, i, l: quality_model.score_quality(d, quality_model.fit_quality(d, l)),
    "decontaminate": lambda d, i, l: decontaminate.decontaminate(d, i),
    "toxicity": lambda d, i, l: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, l)),
    "bpe": lambda d, i, l: bpe.encode_and_decode(d),
    "secrets": lambda d, i, l: secrets.find_secrets(d),
}


@pytest.fixture
def items(spark):
    return spark.createDataFrame(
        [(1, None), (2, ""), (3, "lazy dog"), (4, "word " * 40), (4, "word " * 40), (None, "quick brown")], "item_id bigint, text string"
    )


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [(5, 1, 0), (5, 0, 1), (8, None, 1), (None, 1, 1), (99, 1, 1), (4, 0, 0), (9, 1, None)], "doc_id bigint, quality int, toxic int"
    )


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_per_row(messy, items, labels, name):
    got = OPERATORS[name](messy, items, labels)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in messy.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(messy, items, labels, name):
    assert OPERATORS[name](messy.limit(0), items.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["decontaminate", "toxicity", "quality"])
def test_empty_side_tables(messy, items, labels, name):
    assert OPERATORS[name](messy, items.limit(0), labels.limit(0)).count() == messy.count()


def test_phrases_and_search(messy, items):
    assert {r["phrase"] for r in collocations.collocations(messy, least=20_000, inside=99).collect()} == {"word word word word word"}
    assert collocations.collocations(messy.limit(0)).collect() == []
    found = lexical_search.search(messy, items, top=3).collect()
    assert {r["item_id"] for r in found} == {3, 4, None} and [r["rank"] for r in found if r["item_id"] == 4] == [1, 1]
    assert [r["doc_id"] for r in found if r["item_id"] == 3] == [5, 5, 8]
    assert lexical_search.search(messy.limit(0), items).collect() == [] == lexical_search.search(messy, items.limit(0)).collect()


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "x"), (1, None, "", "x"), (2, "u", "<p>" * 20_000 + "deep", "x"), (None, "u", "<a <b \"<", "x")],
        "page_id bigint, url string, html string, text string",
    )
    assert html_text.extract_text(pages).count() == 4
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_stages_on_messy_rows(spark, messy, tmp_path):
    spark.createDataFrame([(3, "lazy dog")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (messy, messy.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}-in")
            after = stage(spark, spark.read.parquet(f"{tmp_path}/{name}-in"), str(tmp_path))
            if name != "tokens":
                assert after.columns == rows.columns
            docs = after
        docs.collect()
