"""Files cut into records in parallel, next to the reader of whole files."""

import json
import random

import pytest

from tablelens.sources import readers
from tablelens.sources.records import ListedObjects, QuotedLines, records


@pytest.fixture
def small_splits(spark):
    """Splits of a few dozen bytes, so that records cross them."""
    names = {"spark.sql.files.maxPartitionBytes": "37b", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def whole(spark, path, encoding="UTF-8"):
    """One task per file."""
    return spark.read.options(**readers._CSV, multiLine=True, encoding=encoding).csv(path)


def random_csv(seed: int) -> str:
    r = random.Random(seed)
    words = ["x", "", "two\nlines", 'say "hi"', "a,b", "\n", "é", '"', "plain text", 'in 5" wide', "  ", "long " * 12]

    def value() -> str:
        w = r.choice(words)
        if w == 'in 5" wide':
            return w  # a quote inside a bare value is a character like any other
        return '"' + w.replace('"', '""') + '"' if r.random() < 0.4 or set(w) & set('",\n') else w

    end = r.choice(["\n", "\r\n"])
    lines = ["a,b,c"] + [",".join(value() for _ in range(3)) for _ in range(r.randrange(1, 30))]
    return end.join(lines) + r.choice(["", end])


@pytest.mark.parametrize("seed", range(6))
def test_quoted_records_equal_those_of_a_whole_reader(small_splits, tmp_path, seed):
    (tmp_path / "q.csv").write_bytes(random_csv(seed).encode())
    path = str(tmp_path / "q.csv")
    got = readers._quoted_csv(small_splits, path, "UTF-8")
    assert got.columns == ["a", "b", "c"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole(small_splits, path).collect()))


def test_a_quoted_file_is_many_tasks(small_splits, tmp_path):
    (tmp_path / "q.csv").write_text("a,b\n" + "".join(f'{i},"line\n{i}"\n' for i in range(60)))
    cut = records(small_splits, str(tmp_path / "q.csv"), QuotedLines())
    assert cut.count() == 61 and cut.where("first").count() == 1
    assert small_splits.read.option("lineSep", "\n").text(str(tmp_path / "q.csv")).rdd.getNumPartitions() > 8
    df = readers.read_csv(small_splits, str(tmp_path / "q.csv"))
    assert {(r["a"], r["b"]) for r in df.collect()} == {(i, f"line\n{i}") for i in range(60)} and dict(df.dtypes)["a"] == "bigint"


def test_columns_go_by_name(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n2,y\n")
    (folder / "2.csv").write_text("b,a\nz,3\n")
    (folder / "3.csv").write_bytes("c,b\r\n7,é\r\n".encode("latin-1"))
    (folder / "4.csv").write_text('b,a\n"two\nlines",4\n')
    (folder / "5.csv").write_text("\n\na,b\n5,v\n")
    df = readers.read_csv(spark, str(folder))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "bigint"}
    assert {(r["a"], r["b"], r["c"]) for r in df.collect()} == {
        (1, "x", None), (2, "y", None), (3, "z", None), (None, "é", 7), (4, "two\nlines", None), (5, "v", None)}


def test_bare_returns_are_read_whole(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'a,b\n1,"x\ry\nz"\n2,w\n')
    assert sorted(map(repr, readers.read_csv(spark, str(tmp_path / "r.csv")).collect())) == sorted(
        map(repr, readers.infer_types(whole(spark, str(tmp_path / "r.csv"))).collect()))


def random_records(seed: int) -> list[dict]:
    r = random.Random(seed)
    texts = ["", "x", "}", "{[", '"', "\\", '\\"}', "],[", "é\n", "long " * 15]
    return [{"k": i, "t": r.choice(texts), "n": {"v": [r.choice(texts)], "d": {}}} for i in range(r.randrange(1, 25))]


@pytest.mark.parametrize("seed, indent", [(0, None), (1, None), (2, 1), (3, 3)])
def test_listed_objects_equal_the_list(small_splits, tmp_path, seed, indent):
    rows = random_records(seed)
    (tmp_path / "l.json").write_text(json.dumps(rows, indent=indent))
    got = readers.read_json(small_splits, str(tmp_path / "l.json")).select("k", "t", "n.v").collect()
    assert sorted((r["k"], r["t"], r["v"][0]) for r in got) == [(r["k"], r["t"], r["n"]["v"][0]) for r in rows]


def test_a_list_on_one_line_is_many_tasks(small_splits, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"k": i, "s": "} {"} for i in range(50)]))
    cut = records(small_splits, str(tmp_path / "l.json"), ListedObjects())
    assert cut.where("closed").count() == 50 and cut.where("NOT closed").first()["text"] == "]"
    assert small_splits.read.option("lineSep", "}").text(str(tmp_path / "l.json")).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("text", ["[1, 2]", '[{"a": 1}', '[{"a": 1}, 2]', '[{"a": 1}, {"a"', '[{"a": 1} {"a": 2}]'])
def test_other_lists_are_refused(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError, match="Could not read"):
        readers.read_json(spark, str(tmp_path / "x.json"))


def test_empty_list(spark, tmp_path):
    (tmp_path / "e.json").write_text(" [ ] ")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_json(spark, str(tmp_path / "e.json"))
