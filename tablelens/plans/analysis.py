"""All reports of one table from shared statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tablelens.operators import anomalies, chartdata, cleaning, eda, forecast, hypothesis, isolation, quality
from tablelens.operators.columnstats import TableStats, distinct_estimates, table_stats
from tablelens.operators.frequency import distinct_counts
from tablelens.operators.profile import sample_rows
from tablelens.operators.quantiles import exact_quantiles
from tablelens.plans.parts import computed, part
from tablelens.schema import col, local_frame, local_rows, normalize
from tablelens.sources.scratch import materialize, release
from tablelens.thresholds import DEFAULTS, LIMITS, Thresholds

REPORT_SCHEMA = ("report string, section string, column_name string, item string, metric string, "
                 "value double, text string, rank int")
_STATUS = "report string, ran boolean, reason string"


@dataclass
class _Long:
    """A typed report to be told in long form: one row per metric of each of its rows."""

    df: DataFrame
    report: str
    section: str
    metrics: Iterable[str] = ()
    texts: Iterable[str] = ()
    column: str | None = None
    item: str | None = None
    rank: str | None = None

    def rows(self) -> list[tuple]:
        """For a report whose rows grow with the columns of the table only."""
        found = []
        for r in self.df.collect():
            column, item = (None if n is None or r[n] is None else str(r[n]) for n in (self.column, self.item))
            rank = None if self.rank is None else r[self.rank]
            found += [(self.report, self.section, column, item, m, None if r[m] is None else float(r[m]), None, rank) for m in self.metrics]
            found += [(self.report, self.section, column, item, t, None, None if r[t] is None else str(r[t]), rank) for t in self.texts]
        return found

    def frame(self) -> DataFrame:
        nothing: Column = F.lit(None).cast("string")

        def cell(metric: str, value: Column, text: Column) -> Column:
            return F.struct(
                F.lit(self.report).alias("report"), F.lit(self.section).alias("section"),
                (F.col(self.column).cast("string") if self.column else nothing).alias("column_name"),
                (F.col(self.item).cast("string") if self.item else nothing).alias("item"),
                F.lit(metric).alias("metric"), value.alias("value"), text.alias("text"),
                (F.col(self.rank) if self.rank else F.lit(None)).cast("int").alias("rank"))

        cells = [cell(m, F.col(m).cast("double"), nothing) for m in self.metrics]
        cells += [cell(t, F.lit(None).cast("double"), F.col(t).cast("string")) for t in self.texts]
        return self.df.select(F.inline(F.array(*cells)))


#: A report in long form: rows that the driver has, or a typed table.
Told = list[tuple] | _Long


@dataclass
class _Step:
    name: str
    run: Callable[[], list[Told]]
    bounded: bool = True    # the rows grow with the columns of the table only


@dataclass
class Analysis:
    """Reports of ``df``; each is computed when first asked for and shares the earlier results.

    ``key`` names columns that identify a row. Which columns a report leaves out differs: constant and
    identifier-like ones for categories and anomalies, constant ones only for tests and forecasts.

    Each job reads only the columns it needs, so a columnar source is best read again. ``keep=True``
    caches the table instead, for sources that are slow to parse or to compute and fit the cluster;
    ``partitions`` splits small inputs that come in fewer pieces than there are cores. Distinct values are counted
    exactly unless ``approximate`` asks for estimates, which are named so. What a step of one's own returns is
    found in ``results``.
    """

    source: DataFrame
    key: tuple[str, ...] = ()
    series_keys: tuple[str, ...] = ()
    limits: Thresholds = DEFAULTS
    keep: bool = False
    partitions: int | None = None
    extra: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    approximate: bool = False
    results: dict[str, DataFrame] = field(default_factory=dict)
    concurrent: int = LIMITS.concurrent_reports

    def __post_init__(self) -> None:
        self.df = normalize(self.source)
        if self.partitions:
            self.df = self.df.repartition(self.partitions)
        if self.keep:
            # Spills to local disks and is recomputed from the source if an executor is lost.
            self.df = self.df.persist()

    def close(self) -> None:
        """Give back caches and scratch files; reports that were not read by then can't be any more."""
        found = computed(self, "isolation")
        if found is not None and found.scored is not None:
            release(found.scored)
        if self.keep:
            self.df.unpersist()
        if (kept := computed(self, "frequency")) is not None:
            kept.unpersist()

    def add_step(self, name: str, run: Callable[[DataFrame], DataFrame]) -> Analysis:
        """Add a computation of one's own; it gets the table and must return a DataFrame."""
        self.extra[name] = run
        return self

    # --- shared parts: each is one or two jobs, and asks for no more than it needs, so that many can run at once ----

    @part
    def moments(self) -> TableStats:
        """Counts, moments, ranges and parse rates."""
        return table_stats(self.df, sketch=False)

    @part
    def distinct(self) -> dict[str, int]:
        """Distinct values of each column: exact, or exact where a threshold could go either way."""
        if self.approximate:
            return quality.settled_distinct_counts(self.df, self.stats, self.limits, self.frequency)
        found = {r["column_name"]: r["distinct_count"] for r in distinct_counts(self.df).collect()}
        return {n: found.get(n, 0) for n in self.df.columns}

    @part
    def stats(self) -> TableStats:
        """The moments with distinct counts; without ``approximate`` these are the exact ones of the profile."""
        counts = distinct_estimates(self.df, list(self.df.columns)) if self.approximate else self.distinct
        return TableStats(self.moments.rows, {n: replace(c, distinct_estimate=counts[n]) for n, c in self.moments.columns.items()})

    @part
    def quantiles(self) -> dict[str, list[float | None]]:
        return exact_quantiles(self.df, [0.25, 0.5, 0.75], self.moments.numeric(self.df))

    @part
    def frequency(self) -> DataFrame:
        return quality.small_frequency(self.df, self.stats, self.limits)

    @part
    def duplicates(self) -> Row:
        return quality.duplicate_rows(self.df).first()

    @part
    def beyond(self) -> tuple[dict[str, int], dict[str, int]]:
        """Values outside the quartile fences and far from the mean, counted in one scan."""
        fences = quality.iqr_fences(self.df, self.moments, self.limits, self.quantiles)
        return quality.count_beyond(self.df, fences, anomalies.far_values(self.df, self.moments, limits=self.limits))

    @part
    def spellings(self) -> list[Row]:
        return quality.inconsistent_categories(self.df, self.stats, self.limits, self.frequency).orderBy("column_name", "folded").collect()

    @part
    def flags(self) -> quality.Flags:
        return quality.column_flags(self.df, self.moments, self.distinct, self.limits)

    @part
    def quality(self) -> quality.QualityReport:
        return quality.assess_data_quality(
            self.df, self.stats, self.limits, self.quantiles, duplicates=self.duplicates, outside=self.beyond[0],
            distinct=self.distinct, spellings=self.spellings)

    @property
    def junk(self) -> set[str]:
        return self.flags.junk

    @property
    def constant(self) -> set[str]:
        return set(self.flags.constant)

    @part
    def sample(self) -> list[Row]:
        if not self.df.columns:
            return []
        shown = sample_rows(self.df, self.limits.sample_rows, [col(k) for k in self.key])
        return shown.select(F.to_json(F.struct(*map(col, self.df.columns)), {"ignoreNullFields": "false"}).alias("row")).collect()

    @part
    def numeric_summary(self) -> DataFrame:
        return eda.numeric_summary(self.df, self.moments, {n: [q[1]] for n, q in self.quantiles.items()})

    @part
    def top_categories(self) -> DataFrame:
        return eda.top_categories(self.df, self.junk, self.stats, self.limits, self.frequency)

    @part
    def correlations(self) -> list[tuple[str, str, float | None]]:
        return eda.pair_correlations(self.df, self.moments)

    @part
    def histograms(self) -> DataFrame:
        return chartdata.histogram(self.df, stats=self.moments, limits=self.limits)

    @part
    def zscore(self) -> DataFrame:
        return anomalies.zscore_outliers(self.df, self.junk, self.moments, self.limits, self.beyond[1])

    @part
    def isolation(self) -> isolation.IsolationReport:
        return isolation.isolation_forest(self.df, self.key, self.junk - set(self.key), self.limits)

    @part
    def tests(self) -> DataFrame:
        return local_rows(self.df, hypothesis.hypothesis_tests(self.df, self.constant, self.stats, self.limits, distinct=self.distinct))

    @part
    def suggestions(self) -> list[cleaning.Action]:
        return cleaning.suggest_cleaning_actions(self.df, self.quality)

    @part
    def cleaned(self) -> cleaning.CleaningResult:
        return cleaning.apply_cleaning_actions(self.df, self.suggestions, self.quality)

    @part
    def forecast(self) -> forecast.ForecastReport:
        return forecast.forecast_time_series(self.df, exclude=self.constant, series_keys=self.series_keys,
                                             stats=self.moments, limits=self.limits)

    # --- long form --------------------------------------------------------------------------------

    def _profile(self) -> list[Told]:
        name = "unique_count_estimate" if self.approximate else "unique_count"
        rows = [("profile", "column", c.name, None, m, float(v), None, None)
                for c in self.moments.columns.values() for m, v in (("null_count", c.missing), (name, self.distinct.get(c.name, 0)))]
        rows += [("profile", "sample_row", None, None, "row", None, r["row"], i) for i, r in enumerate(self.sample, 1)]
        rows += [("profile", "column", c.name, None, "dtype", None, c.dtype, None) for c in self.moments.columns.values()]
        rows += [("profile", "table", None, None, m, float(v), None, None) for m, v in (
            ("rows", self.moments.rows), ("columns", len(self.df.columns)), ("duplicate_rows", self.duplicates["duplicate_count"]))]
        return [rows]

    def _quality(self) -> list[Told]:
        q = self.quality
        rows = [("quality", "score", None, None, m, float(v), None, None)
                for m, v in [*q.scores.items(), ("overall", q.overall)]]
        rows += [("quality", "missing", None, None, "overall_missing_pct", float(q.missing_pct or 0), None, None)]
        rows += [("quality", "missing", n, None, m, float(x), None, None) for n, v in q.missing.items()
                 for m, x in (("missing_count", v), ("missing_pct", round(100 * v / q.rows, 1)))]
        rows += [("quality", "duplicates", None, None, m, float(v), None, None)
                 for m, v in (("duplicate_count", q.duplicates), ("duplicate_pct", q.duplicate_pct or 0))]
        rows += [("quality", "outliers", n, None, "outlier_count", float(v), None, None) for n, v in q.outlier_counts.items()]
        rows += [("quality", "type", n, k, "parse_rate", r, None, None) for n, k, r in q.type_flags]
        rows += [("quality", "outliers", n, None, "outlier_fraction", v, None, None) for n, v in q.outliers.items()]
        rows += [("quality", "flag", n, None, f, None, None, None) for f, names in (
            ("constant", q.flags.constant), ("id_like", q.flags.id_like),
            ("high_cardinality", q.flags.high_cardinality)) for n in names]
        rows += [("quality", "inconsistent", n, folded, "spellings", float(len(s)), " | ".join(s), None)
                 for n, groups in q.flags.inconsistent.items() for folded, s in groups.items()]
        return [rows]

    def _eda(self) -> list[Told]:
        corr = eda.top_correlations(self.df, self.correlations, self.limits)
        return [
            _Long(self.numeric_summary, "eda", "numeric", ("mean", "median", "std", "min", "max"), column="column_name"),
            _Long(self.top_categories, "eda", "top_category", ("n",), column="column_name", item="value", rank="rank"),
            _Long(corr, "eda", "correlation", ("correlation",), column="column_a", item="column_b", rank="rank"),
        ]

    def _charts(self) -> list[Told]:
        matrix = eda.correlation_matrix(self.df, self.correlations, self.moments)
        rows = [("charts", "missingness", c.name, None, "missing_pct", 100.0 * c.missing / self.moments.rows, None, None)
                for c in self.moments.columns.values() if c.missing]
        return [
            _Long(self.histograms, "charts", "histogram", ("lower", "upper", "n"), column="column_name", item="bin",
                  rank="bin"),
            _Long(matrix, "charts", "heatmap", ("correlation",), column="column_a", item="column_b"),
            rows,
        ]

    def _anomalies(self) -> list[Told]:
        return [_Long(self.zscore, "anomalies", "z_score", ("outlier_count", "outlier_pct"), column="column_name")]

    def _isolation(self) -> list[Told]:
        f = self.isolation
        if not f.ran:
            raise _NotRun(f.reason)
        rows = [("isolation_forest", "summary", None, None, m, float(v), None, None) for m, v in (
            ("rows_checked", f.rows_checked), ("anomalous_rows", f.anomalous), ("anomalous_pct", f.pct))]
        top = f.top.withColumn("row", F.to_json(F.struct(*[c for c in f.top.columns if c != "anomaly_score"])))
        return [rows,
                _Long(top, "isolation_forest", "row", ("anomaly_score",), item="row")]

    def _tests(self) -> list[Told]:
        found = self.tests
        best = local_rows(self.df, hypothesis.top_significant(found, self.limits))
        means = best.select("numeric_column", F.explode("group_means").alias("group", "group_mean"), F.concat_ws(": ", "categorical_column", "group").alias("item"))
        return [
            _Long(means, "tests", "group", ("group_mean",), column="numeric_column", item="item"),
            _Long(hypothesis.sweep_summary(found), "tests", "summary",
                  ("total_tests_run", "significant_results_count"), ("note",)),
            _Long(best, "tests", "significant",
                  ("statistic", "p_value", "groups_compared"), ("test",), column="numeric_column", item="categorical_column"),
        ]

    def _cleaning(self) -> list[Told]:
        rows = [("cleaning", "suggestion", a.column, "auto" if a.auto_applied else "manual", a.type, None,
                 a.description, i + 1) for i, a in enumerate(self.suggestions)]
        rows += [("cleaning", "log", c, None, k, float(n), t, i) for i, k, c, n, t in self.cleaned.log]
        return [rows]

    def _forecast(self) -> list[Told]:
        f = self.forecast
        if not f.ran:
            raise _NotRun(f.reason)
        header = [("forecast", "header", None, None, m, None, t, None)
                  for m, t in (("date_column", f.date_column), ("value_column", f.value_column))]
        header.append(("forecast", "header", None, None, "historical_points", float(f.historical_points), None, None))
        return [header,
                _Long(f.forecast.withColumn("series", F.to_json(F.struct(*self.series_keys)) if self.series_keys
                                            else F.lit("all")),
                      "forecast", "point", ("predicted_value", "naive_baseline"), ("date",), column="series",
                      item="date", rank="step_no")]

    def _steps(self) -> list[_Step]:
        def own(name: str, run: Callable[[DataFrame], DataFrame]) -> _Step:
            # A row count starts the computation, so that a failure stays with its step.
            def go() -> list[Told]:
                result = run(self.df)
                rows = float(result.count())
                self.results[name] = result
                return [[(name, "result", None, None, "rows", rows, None, None)]]
            return _Step(name, go)

        return [
            _Step("profile", self._profile), _Step("quality", self._quality), _Step("eda", self._eda),
            _Step("charts", self._charts), _Step("anomalies", self._anomalies),
            _Step("isolation_forest", self._isolation), _Step("tests", self._tests),
            _Step("cleaning", self._cleaning), _Step("forecast", self._forecast, bounded=not self.series_keys),
            *[own(n, f) for n, f in self.extra.items()],
        ]

    #: What reports wait for, longest chains first; started ahead of them, so that independent jobs overlap.
    _AHEAD = ("moments", "distinct", "duplicates", "sample", "quantiles", "correlations", "flags", "beyond", "spellings", "isolation",
              "forecast", "tests")

    def _computed(self, step: _Step) -> tuple[list[tuple | DataFrame], tuple[str, bool, str | None]]:
        """A report's rows, or tables of rows, and its status; a failing report does not take others along."""
        try:
            told: list[tuple | DataFrame] = []
            for t in step.run():
                if isinstance(t, _Long):
                    told += t.rows() if step.bounded else [materialize(t.frame(), "report")]
                else:
                    told += t
            return told, (step.name, True, None)
        except _NotRun as e:
            return [], (step.name, False, str(e))
        except Exception as e:
            return [], (step.name, False, f"{type(e).__name__}: {str(e).splitlines()[0]}")

    def _ahead(self, name: str) -> None:
        try:
            getattr(self, name)
        except Exception:  # remembered, and told by each report that needs the part
            pass

    def run(self) -> tuple[DataFrame, DataFrame]:
        """``(report rows, status)``: what could be computed, and why the rest could not.

        Reports run side by side as far as they do not wait for a shared part: a report of few rows is one chain
        of short jobs, and a large one leaves cores idle at the end of each stage. ``concurrent`` bounds how many
        jobs are under way; with a fair scheduler each report has a pool of its own.
        """
        spark = self.df.sparkSession
        steps = self._steps()

        def pooled(name: str, run: Callable):
            def go():
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
                return run()
            return inheritable_thread_target(spark)(go)

        with ThreadPoolExecutor(max(1, self.concurrent)) as pool:
            if self.concurrent > 1:
                for name in self._AHEAD:
                    pool.submit(pooled(name, partial(self._ahead, name)))
            done = [f.result() for f in [pool.submit(pooled(s.name, partial(self._computed, s))) for s in steps]]
        told, status = [t for part_, _ in done for t in part_], [s for _, s in done]
        rows = local_frame(self.df, [t for t in told if isinstance(t, tuple)], REPORT_SCHEMA)
        return reduce(DataFrame.unionAll, [t for t in told if isinstance(t, DataFrame)], rows), local_frame(self.df, status, _STATUS)


class _NotRun(Exception):
    """A report that does not apply to the table."""


def analyze(df: DataFrame, key: Iterable[str] = (), series_keys: Iterable[str] = (),
            limits: Thresholds = DEFAULTS, keep: bool = False, partitions: int | None = None) \
        -> tuple[DataFrame, DataFrame]:
    """All reports of ``df`` in long form and the status of each."""
    analysis = Analysis(df, tuple(key), tuple(series_keys), limits, keep, partitions)
    try:
        return analysis.run()
    finally:
        analysis.close()


def analyze_file(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """``analyze`` for a file, folder or pattern; the status begins with ``load``, which alone is left if reading fails."""
    from tablelens.sources.readers import load_data_file

    try:
        df = load_data_file(spark, path)
    except (ValueError, OSError) as e:
        return spark.createDataFrame([], REPORT_SCHEMA), spark.createDataFrame([("load", False, str(e))], _STATUS)
    report, status = analyze(df, **options)
    return report, spark.createDataFrame([("load", True, None)], _STATUS).unionAll(status)
