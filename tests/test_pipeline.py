import pytest

from tablelens import Analysis, analyze, analyze_file, load_data_file
from tablelens.plans import analysis as plan


@pytest.fixture(scope="module")
def sales(spark):
    """Daily figures with gaps, repeated spellings and an identifier."""
    return spark.range(60).selectExpr(
        "id AS order_id", "CASE id % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'North' ELSE 'east' END AS region",
        "CASE WHEN id % 20 = 0 THEN NULL ELSE 100 + id * 0.5 + (id % 7) END AS amount", "'shop' AS source",
        "CAST(date_add(DATE'2024-01-01', CAST(id AS int)) AS string) AS day", "CAST(id % 5 AS double) AS rating")


def test_all_reports(sales):
    report, status = analyze(sales, key=["order_id"])
    assert {r["report"]: r["ran"] for r in status.collect()} == dict.fromkeys(
        ["profile", "quality", "eda", "charts", "anomalies", "isolation_forest", "tests", "cleaning", "forecast"], True)
    rows = report.collect()
    value = {(r["report"], r["section"], r["column_name"], r["metric"]): r["value"] for r in rows}
    assert value["profile", "table", None, "rows"] == 60.0
    assert value["profile", "column", "region", "unique_count"] == 4.0
    assert value["quality", "missing", "amount", "missing_count"] == 3.0
    assert ("quality", "flag", "source", "constant") in value and ("quality", "flag", "order_id", "id_like") in value
    assert ("charts", "histogram", "amount", "n") in value
    assert len([r for r in rows if r["section"] == "point" and r["metric"] == "predicted_value"]) == 7


def test_each_report_has_its_own_exclusions(sales):
    a = Analysis(sales.selectExpr("region", "amount + order_id * 1e-6 AS metric", "source", "7 AS seven", "rating"))
    assert "metric" not in a.junk and a.constant == {"source", "seven"}
    b = Analysis(sales.selectExpr("region", "order_id * 1.5 AS metric", "source", "7 AS seven", "rating"))
    assert "metric" in b.junk
    tested = {r["numeric_column"] for r in b.tests.collect()}
    assert "metric" in tested and "seven" not in tested
    assert "metric" not in b.isolation.scored.columns if b.isolation.ran else True
    assert {r["column_name"] for r in b.top_categories.collect()} == {"region"}


def test_a_failing_report_leaves_the_others(sales, monkeypatch):
    monkeypatch.setattr(plan.eda, "numeric_summary", lambda *a, **k: 1 / 0)
    report, status = analyze(sales)
    got = {r["report"]: (r["ran"], r["reason"]) for r in status.collect()}
    assert got["eda"] == (False, "ZeroDivisionError: division by zero") and got["quality"][0] and got["cleaning"][0]
    assert report.filter("report = 'quality'").count() > 0


def test_own_steps(sales):
    a = Analysis(sales).add_step("by_region", lambda df: df.groupBy("region").count())
    a.add_step("broken", lambda df: df.select("no_such_column"))
    report, status = a.run()
    a.close()
    assert report.filter("report = 'by_region'").first()["value"] == 4.0
    assert not status.filter("report = 'broken'").first()["ran"]


def test_forecasts_per_series_stay_on_the_cluster(sales):
    report, status = analyze(sales.drop("rating"), key=["order_id"], series_keys=["region"])
    assert status.filter("report = 'forecast'").first()["ran"]
    points = report.filter("section = 'point' AND metric = 'predicted_value'")
    assert {(r["column_name"], r["count"]) for r in points.groupBy("column_name").count().collect()} == {
        (f'{{"region":"{k}"}}', 7) for k in ("north", "south", "North", "east")}


def test_nothing_to_analyse(spark):
    report, status = analyze(spark.createDataFrame([], "a double, b string"))
    got = {r["report"]: r["ran"] for r in status.collect()}
    assert got["profile"] and got["quality"] and got["cleaning"] and not got["forecast"] and not got["isolation_forest"]


def movie_like(tmp_path):
    """Two columns with gaps, three identifiers and seven genres, so nothing to test and no date."""
    lines = ["movie_id,genre,release_year,rating,votes"]
    for i in range(200):
        rating = "" if i % 50 == 3 else f"{5 + (i * 7 % 41) / 10:.1f}"
        lines.append(f"{i},g{i % 7},{1990 + i % 32},{rating},{1000 + 13 * i}")
    path = tmp_path / "movies.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_file_to_reports(spark, tmp_path):
    a = Analysis(load_data_file(spark, movie_like(tmp_path)))
    assert a.quality.overall == 100 and a.tests.count() == 0 and not a.forecast.ran and a.isolation.ran
    assert [(s.type, s.column) for s in a.suggestions] == [
        ("fill_missing_numeric", "rating"), ("drop_id_column", "movie_id"), ("drop_id_column", "votes")]
    a.close()


def test_file_in_reports_out(spark, tmp_path):
    report, status = analyze_file(spark, movie_like(tmp_path))
    assert status.first()["report"] == "load" and status.filter("NOT ran").collect()[0]["report"] == "forecast"
    assert report.filter("section = 'sample_row'").count() == 5
    assert report.filter("report = 'profile' AND metric = 'unique_count' AND column_name = 'votes'").first()["value"] == 200.0
    for path in (f"{tmp_path}/none.csv", f"{tmp_path}/notes.txt"):
        report, status = analyze_file(spark, path)
        assert report.count() == 0 and [(r["report"], r["ran"]) for r in status.collect()] == [("load", False)] and status.first()["reason"]


def test_details_of_the_reports(sales):
    a = Analysis(sales, key=("order_id",)).add_step("by_region", lambda df: df.groupBy("region").count())
    report, _ = a.run()
    rows = report.collect()
    found = {(r["report"], r["section"], r["column_name"], r["metric"]): r["value"] if r["text"] is None else r["text"] for r in rows}
    assert found["quality", "missing", "amount", "missing_pct"] == 5.0 and found["quality", "duplicates", None, "duplicate_count"] == 0.0
    assert found["quality", "missing", None, "overall_missing_pct"] > 0
    assert found["forecast", "header", None, "date_column"] == "day" and found["forecast", "header", None, "historical_points"] == 60.0
    assert a.results["by_region"].count() == 4
    significant = {(r["column_name"], r["item"]) for r in rows if r["section"] == "significant"}
    assert {(r["column_name"], r["item"].split(": ")[0]) for r in rows if r["section"] == "group"} == significant
    a.close()


def test_estimates_are_named_so(sales):
    a = Analysis(sales, approximate=True)
    report, _ = a.run()
    assert {r["metric"] for r in report.filter("report = 'profile' AND section = 'column'").collect()} == {"null_count", "unique_count_estimate", "dtype"}


def test_a_shared_part_fails_once(sales, monkeypatch):
    calls = []
    monkeypatch.setattr(plan.quality, "assess_data_quality", lambda *a, **k: calls.append(1) or 1 / 0)
    Analysis(sales).run()
    assert len(calls) == 1


def test_reports_do_not_depend_on_running_side_by_side(sales):
    apart, together = (sorted(map(repr, Analysis(sales, key=("order_id",), concurrent=n).run()[0].collect())) for n in (1, 8))
    assert apart == together


def test_a_part_is_computed_once_by_many_threads():
    from concurrent.futures import ThreadPoolExecutor
    from time import sleep

    from tablelens.plans.parts import computed, part

    class Owner:
        calls = 0

        @part
        def value(self):
            Owner.calls += 1
            sleep(0.2)
            return [1]

        @part
        def broken(self):
            Owner.calls += 1
            raise ValueError("no")

    owner = Owner()
    assert computed(owner, "value") is None
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda _: owner.value, range(8)))
    assert Owner.calls == 1 and all(f is found[0] for f in found) and computed(owner, "value") == [1]
    for _ in range(2):
        with pytest.raises(ValueError):
            owner.broken
    assert Owner.calls == 2
