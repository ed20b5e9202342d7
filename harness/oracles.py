"""The same results in ANSI SQL."""

from __future__ import annotations

from harness.queries import CATEGORICAL, FOREST, FOREST_ROWS, NUMERIC, SQL
from harness.views import cte

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
LINE_NUMBERS = [n for n, t in LINEITEM.items() if t in ("bigint", "int", "double")]
ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
          "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
DIRTY = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
DIRTY_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
STATUS = ["price_band", "o_orderstatus", "o_orderpriority"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "currency"]
AMOUNTS = ["l_quantity", "l_extendedprice", "l_discount", "revenue", "charge", "tax_amount", "doubled", "one"]


EULER = 0.5772156649015329


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def tall(source: str, names, cast: str) -> str:
    """(position, column_name, v) of several columns."""
    return union(f"SELECT {i} AS position, '{n}' AS column_name, CAST({n} AS {cast}) AS v FROM {source}"
                 for i, n in enumerate(names))


def mean_depth(n: int) -> str:
    """Average depth of an unsuccessful search among ``n`` values, as SQL."""
    return "0e0" if n <= 1 else "1e0" if n == 2 else f"(2 * (ln({n - 1}e0) + {EULER}e0) - 2 * {n - 1}e0 / {n}e0)"


def walk(tree, depth: int = 0) -> str:
    """Path length of a row in one tree."""
    if not isinstance(tree, tuple):
        return f"({depth}e0 + {mean_depth(tree)})"
    column, split, upto, above = tree
    return f"CASE WHEN {column} > {split}e0 THEN {walk(above, depth + 1)} ELSE {walk(upto, depth + 1)} END"


def missing(source: str, names) -> str:
    return (f"SELECT column_name, CAST(count(*) - count(v) AS BIGINT) AS missing_count, "
            f"round_even(100.0 * (count(*) - count(v)) / count(*), 1) AS missing_pct "
            f"FROM ({tall(source, names, 'VARCHAR')}) GROUP BY column_name HAVING count(*) > count(v)")


def missing_total(source: str, names) -> str:
    return (f"SELECT CAST(count(*) - count(v) AS BIGINT) AS missing_cells, "
            f"round_even(100.0 * (count(*) - count(v)) / count(*), 1) AS missing_pct FROM ({tall(source, names, 'VARCHAR')})")


def duplicates(source: str, names) -> str:
    return (f"SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_count, "
            f"round_even(100.0 * sum(n - 1) / sum(n), 1) AS duplicate_pct, "
            f"CAST(greatest(0, round_even(100 - round_even(100.0 * sum(n - 1) / sum(n), 1), 0)) AS BIGINT) AS score "
            f"FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(names)})")


def iqr(source: str, names) -> str:
    return f"""
        SELECT column_name, low AS lower_fence, high AS upper_fence,
               CAST(sum(CASE WHEN v < low OR v > high THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count,
               round_even(1.0 * sum(CASE WHEN v < low OR v > high THEN 1 ELSE 0 END) / count(v), 3) AS outlier_fraction
        FROM ({tall(source, names, 'DOUBLE')}) JOIN (
            SELECT column_name, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
                SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(v) AS n
                FROM ({tall(source, names, 'DOUBLE')}) GROUP BY column_name) WHERE n >= 4 AND q3 <> q1
        ) USING (column_name) GROUP BY column_name, low, high
        HAVING sum(CASE WHEN v < low OR v > high THEN 1 ELSE 0 END) > 0"""


def spellings(source: str, name: str) -> str:
    """Spellings with their category and the commonest spelling of it."""
    folded = f"lower(trim({name}))"
    return f"""
        SELECT value, folded, n, first_value(value) OVER (PARTITION BY folded ORDER BY n DESC, value) AS canonical
        FROM (SELECT {name} AS value, {folded} AS folded, count(*) AS n FROM {source}
              WHERE {name} IS NOT NULL GROUP BY 1, 2)"""


def moments(source: str, categorical, numeric) -> str:
    return union(
        f"SELECT '{c}' AS categorical_column, {c} AS category, '{v}' AS numeric_column, count({v}) AS n, "
        f"avg({v}) AS mean, var_samp({v}) AS variance FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in categorical for v in numeric)


def anova(source: str) -> str:
    return f"""
        SELECT categorical_column, numeric_column, groups_compared, (ssb / df1) / (ssw / df2) AS statistic, df1, df2 FROM (
            SELECT categorical_column, numeric_column, CAST(count(*) AS INTEGER) AS groups_compared,
                   sum(n * (mean - grand) * (mean - grand)) AS ssb, sum((n - 1) * variance) AS ssw,
                   CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2
            FROM (SELECT *, sum(n * mean) OVER w / sum(n) OVER w AS grand FROM ({moments(source, CATEGORICAL, NUMERIC)})
                  WHERE n >= 2 WINDOW w AS (PARTITION BY categorical_column, numeric_column))
            GROUP BY categorical_column, numeric_column)
        WHERE groups_compared BETWEEN 3 AND 6"""


# Words that have no place in a read-only query.
def _audit() -> str:
    words = ["ALTER", "ATTACH", "CREATE", "DELETE", "DETACH", "DROP", "GRANT", "INSERT", "PRAGMA", "REINDEX",
             "REPLACE", "REVOKE", "TRUNCATE", "UPDATE", "VACUUM"]
    found = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN regexp_matches(t, '(?i)\\b{w}\\b') THEN '{w}' END" for w in words) + ")"
    return cte("query_log") + f"""
        SELECT o_orderkey, violations = '' AS safe, violations FROM (
            SELECT o_orderkey, CASE WHEN t = '' THEN 'empty query' ELSE concat_ws(' | ',
                CASE WHEN statements <> 1 THEN 'one statement expected, found ' || statements END,
                CASE WHEN first NOT IN ('SELECT', 'WITH') THEN 'starts with ''' || first || ''' instead of SELECT or WITH' END,
                CASE WHEN words <> '' THEN 'banned words: ' || words END) END AS violations
            FROM (SELECT *, len(regexp_extract_all(t, '[^;]*[^;\\s][^;]*')) AS statements,
                         upper(regexp_extract(t, '^\\w+')) AS first, {found} AS words
                  FROM (SELECT o_orderkey, trim(regexp_replace(regexp_replace(query, '--[^\n]*', ' ', 'g'),
                               '/\\*.*?\\*/', ' ', 'g')) AS t FROM query_log)))"""


def _quality_score() -> str:
    return cte("dirty_status") + f""",
        m AS (SELECT CAST(round_even(100 - missing_pct, 0) AS BIGINT) AS s FROM ({missing_total('dirty_status', STATUS)})),
        d AS (SELECT score AS s FROM ({duplicates('dirty_status', STATUS)})),
        o AS (SELECT CAST(coalesce(round_even(100 * (1 - avg(outlier_fraction)), 0), 100) AS BIGINT) AS s
              FROM ({iqr('dirty_status', ['price_band'])}))
        SELECT m.s AS missing_values, d.s AS duplicates, CAST(100 AS BIGINT) AS type_consistency, o.s AS outliers,
               CAST(round_even((m.s + d.s + 100 + o.s) / 4.0, 0) AS BIGINT) AS overall_score FROM m, d, o"""


def _cleaned() -> str:
    """Fills, then duplicates, then spellings."""
    return cte("dirty_status") + f""",
        filled AS (SELECT coalesce(price_band, (SELECT quantile_cont(price_band, 0.5) FROM dirty_status)) AS price_band,
                          o_orderstatus, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM dirty_status),
        deduplicated AS (SELECT DISTINCT * FROM filled),
        canon AS ({spellings('deduplicated', 'o_orderpriority')})"""


def _naive() -> str:
    return cte("event_days") + """,
        points AS (SELECT event_type, CAST(day AS TIMESTAMP) AS ts, avg(value) AS value FROM event_days
                   WHERE value IS NOT NULL GROUP BY event_type, day),
        steps AS (SELECT event_type, quantile_cont(CAST(epoch_us(ts) - epoch_us(before) AS DOUBLE), 0.5) AS step_us
                  FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM points)
                  WHERE before IS NOT NULL GROUP BY event_type),
        ends AS (SELECT event_type, max(ts) AS ts, arg_max(value, ts) AS value, count(*) AS n FROM points GROUP BY event_type)
        SELECT event_type, CAST(k AS INTEGER) AS step_no,
               CAST(make_timestamp(CAST(epoch_us(ts) + floor(step_us * k) AS BIGINT)) AS DATE) AS date,
               round_even(value, 2) AS naive_baseline
        FROM ends JOIN steps USING (event_type), range(1, 8) r(k) WHERE n >= 5"""


def _sweep() -> str:
    """The upper tail of F has a closed form for the even numerator degrees of freedom found here."""
    return f"""
            SELECT categorical_column, numeric_column, 'one-way ANOVA' AS test, groups_compared,
                   round_even(statistic, 3) AS statistic, round_even(p, 4) AS p_value, p < 0.05 AS likely_significant
            FROM (SELECT *, CASE df1 WHEN 2 THEN pow(x, df2 / 2) WHEN 4 THEN pow(x, df2 / 2) * (1 + df2 / 2 * (1 - x)) END AS p
                  FROM (SELECT *, df2 / (df2 + df1 * statistic) AS x FROM ({anova('order_lines')})))"""


def oracles() -> dict[str, str]:
    dirty = cte("dirty_orders")
    out = {
        "infer_types_csv": """
            SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
                   o_orderstatus = 'F' AS finished, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority
            FROM orders""",
        "csv_by_column_name": """
            SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate,
                   CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS o_orderpriority FROM orders""",
        "csv_quoted_lines": """
            SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS text_sha256, lang
            FROM (SELECT doc_id, nullif(regexp_replace(text, '\r\n?', '\n', 'g'), '') AS t, lang FROM documents WHERE text IS NOT NULL)""",
        "json_list": "SELECT doc_id, sha256(text) AS text_sha256, lang, source FROM documents",
        "profile_columns": union(
            f"SELECT CAST({i} AS INTEGER) AS position, '{n}' AS column_name, '{t}' AS dtype, "
            f"CAST(count(*) - count({n}) AS BIGINT) AS null_count, CAST(count(DISTINCT {n}) AS BIGINT) AS unique_count FROM lineitem"
            for i, (n, t) in enumerate(LINEITEM.items())),
        "schema_description": union(
            f"SELECT CAST({i} AS INTEGER) AS position, '{n}' AS column_name, '{t}' AS dtype"
            for i, (n, t) in enumerate(ORDERS.items())),
        "sample_rows": "SELECT * FROM part ORDER BY p_partkey LIMIT 5",
        "distinct_counts": union(
            f"SELECT '{n}' AS column_name, CAST(count(DISTINCT {n}) AS BIGINT) AS distinct_count FROM part" for n in PART[:-1]),
        "value_frequency": union(
            f"SELECT '{n}' AS column_name, {n} AS value, count(*) AS n FROM documents WHERE {n} IS NOT NULL GROUP BY {n}"
            for n in ("lang", "source")),
        "complete_cases": f"{dirty} SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
        "marked_lines": """
            SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, trim(substring(trim(line), 9)) AS line FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                       unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
            WHERE starts_with(trim(line), 'Licensed')""",
        "parse_values": """
            SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_totalprice END AS price,
                   CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders""",
        "missing_by_column": f"{dirty} {missing('dirty_orders', DIRTY)}",
        "missing_score": f"{dirty} SELECT missing_cells, missing_pct, CAST(round_even(100 - missing_pct, 0) AS BIGINT) AS score "
                         f"FROM ({missing_total('dirty_orders', DIRTY)})",
        "duplicate_rows": cte("line_terms") + duplicates(
            "line_terms", ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]),
        "duplicate_documents": duplicates("documents", ["text"]),
        "type_consistency": cte("order_texts") + """
            SELECT column_name, looks_like, round_even(rate, 2) AS parse_rate FROM (
                SELECT column_name, CASE WHEN numbers >= 0.8 THEN 'numeric' WHEN dates >= 0.8 THEN 'date' END AS looks_like,
                       CASE WHEN numbers >= 0.8 THEN numbers ELSE dates END AS rate
                FROM (SELECT column_name, avg(CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN 0 ELSE 1 END) AS numbers,
                             avg(CASE WHEN TRY_CAST(v AS DATE) IS NULL THEN 0 ELSE 1 END) AS dates
                      FROM (""" + tall("order_texts", ["cust_text", "price_text", "late_text", "date_text",
                                                       "o_orderpriority"], "VARCHAR") + """) GROUP BY column_name))
            WHERE looks_like IS NOT NULL""",
        "iqr_outliers": f"{dirty} SELECT column_name, round_even(lower_fence, 2) AS lower_fence, "
                        f"round_even(upper_fence, 2) AS upper_fence, outlier_count, outlier_fraction "
                        f"FROM ({iqr('dirty_orders', DIRTY_NUMBERS)})",
        "iqr_score": f"{dirty} SELECT count(*) AS offending_columns, CAST(coalesce(round_even("
                     f"100 * (1 - avg(outlier_fraction)), 0), 100) AS BIGINT) AS score "
                     f"FROM ({iqr('dirty_orders', DIRTY_NUMBERS)})",
        "quality_score": _quality_score(),
        "structural_flags": cte("part_extra") + ", c AS (" + union(
            f"SELECT '{n}' AS column_name, {n in ('p_name', 'p_brand', 'p_type', 'currency')} AS is_text, "
            f"count(DISTINCT {n}) AS d, count(*) AS n FROM part_extra" for n in PART) + """)
            SELECT 'constant' AS flag, column_name FROM c WHERE d <= 1
            UNION ALL SELECT 'id_like', column_name FROM c WHERE 1.0 * d / n > 0.95
            UNION ALL SELECT 'high_cardinality', column_name FROM c
            WHERE is_text AND d > 1 AND 1.0 * d / n <= 0.95 AND (d >= 50 OR 1.0 * d / n > 0.5)""",
        "inconsistent_categories": f"{dirty} " + union(
            f"SELECT '{n}' AS column_name, lower(trim({n})) AS folded, string_agg(DISTINCT {n}, '|' ORDER BY {n}) AS spellings "
            f"FROM dirty_orders WHERE {n} IS NOT NULL GROUP BY 2 HAVING count(DISTINCT {n}) > 1"
            for n in ("o_orderstatus", "o_orderpriority")),
        "numeric_summary": "SELECT column_name, round_even(avg(v), 2) AS mean, round_even(median(v), 2) AS median, "
                           "round_even(stddev_samp(v), 2) AS std, round_even(min(v), 2) AS min, round_even(max(v), 2) AS max "
                           f"FROM ({tall('lineitem', LINE_NUMBERS, 'DOUBLE')}) GROUP BY column_name",
        "excluded_categories": cte("order_lines") + """
            SELECT column_name, CAST(rank AS INTEGER) AS rank, value, n FROM (
                SELECT column_name, v AS value, count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, v) AS rank
                FROM (""" + tall("order_lines", ["o_orderstatus", "o_orderpriority"], "VARCHAR") + """)
                WHERE v IS NOT NULL GROUP BY column_name, v) WHERE rank <= 5""",
        "top_categories": """
            SELECT column_name, CAST(rank AS INTEGER) AS rank, value, n FROM (
                SELECT column_name, v AS value, count(*) AS n, count(*) OVER (PARTITION BY column_name) AS d,
                       row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, v) AS rank
                FROM (""" + tall("part", ["p_name", "p_brand", "p_type"], "VARCHAR") + """)
                WHERE v IS NOT NULL GROUP BY column_name, v) WHERE d <= 20 AND rank <= 5""",
        "most_frequent_value": """
            SELECT column_name, value, n FROM (
                SELECT column_name, v AS value, count(*) AS n,
                       row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, v) AS rank
                FROM (""" + tall("events", ["event_type", "props"], "VARCHAR") + """)
                WHERE v IS NOT NULL GROUP BY column_name, v) WHERE rank = 1""",
        "group_aggregate": cte("order_lines") + """
            SELECT c_mktsegment, round_even(sum(o_totalprice), 2) AS sum_o_totalprice,
                   round_even(avg(o_totalprice), 2) AS avg_o_totalprice, min(o_totalprice) AS min_o_totalprice,
                   max(o_totalprice) AS max_o_totalprice, count(o_totalprice) AS count_o_totalprice
            FROM order_lines GROUP BY c_mktsegment""",
        "top_k_entities": "SELECT o_custkey, round_even(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders "
                          "GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10",
        "period_change": """
            WITH t AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS period, o_orderpriority AS segment,
                              sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
            w AS (SELECT period, sum(total) AS whole, lag(period) OVER (ORDER BY period) AS before,
                         lag(sum(total)) OVER (ORDER BY period) AS whole_before FROM t GROUP BY period),
            s AS (SELECT DISTINCT segment FROM t)
            SELECT w.period, s.segment, round_even(coalesce(a.total, 0), 2) AS total,
                   round_even(coalesce(a.total, 0) - coalesce(b.total, 0), 2) AS change,
                   round_even(whole - whole_before, 2) AS whole_change,
                   round_even((coalesce(a.total, 0) - coalesce(b.total, 0)) / (whole - whole_before), 2) AS contribution
            FROM w CROSS JOIN s LEFT JOIN t a ON a.period = w.period AND a.segment = s.segment
            LEFT JOIN t b ON b.period = w.before AND b.segment = s.segment
            WHERE w.before IS NOT NULL AND (a.total IS NOT NULL OR b.total IS NOT NULL)""",
        "spread_ranking": "SELECT CAST(row_number() OVER (ORDER BY spread DESC) AS INTEGER) AS rank, column_name, "
                          "round_even(spread, 6) AS spread FROM (SELECT column_name, abs(stddev_samp(v) / avg(v)) AS spread "
                          f"FROM ({tall('lineitem', LINE_NUMBERS, 'DOUBLE')}) GROUP BY column_name "
                          "HAVING count(v) >= 2 AND avg(v) <> 0) ORDER BY spread DESC LIMIT 4",
        "histogram": f"""
            WITH t AS ({tall('lineitem', ['l_extendedprice', 'l_orderkey'], 'DOUBLE')}),
            e AS (SELECT column_name, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 20 AS w FROM t GROUP BY column_name),
            b AS (SELECT column_name, CAST(least(floor((v - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n
                  FROM t JOIN e USING (column_name) GROUP BY 1, 2)
            SELECT column_name, CAST(k AS INTEGER) AS bin, round_even(lo + k * w, 4) AS lower,
                   round_even(CASE WHEN k = 19 THEN hi ELSE lo + (k + 1) * w END, 4) AS upper, coalesce(n, 0) AS n
            FROM e CROSS JOIN range(0, 20) r(k) LEFT JOIN b ON b.column_name = e.column_name AND b.bin = k""".replace(
                "SELECT column_name, CAST(k", "SELECT e.column_name, CAST(k"),
        "missingness": f"{dirty} SELECT column_name, missing_pct FROM ({missing('dirty_orders', DIRTY)})",
        "zscore_outliers": f"""{dirty}, t AS ({tall('dirty_orders', DIRTY_NUMBERS, 'DOUBLE')}),
            m AS (SELECT column_name, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS n FROM t GROUP BY column_name)
            SELECT column_name, CAST(count(*) AS BIGINT) AS outlier_count, round_even(100.0 * count(*) / n, 1) AS outlier_pct
            FROM t JOIN m USING (column_name) WHERE n >= 2 AND std <> 0 AND abs((v - mean) / std) > 3 GROUP BY column_name, n""",
        "forest_scores": f"""
            WITH s AS (SELECT l_orderkey, l_linenumber,
                       -pow(2e0, -({' + '.join(map(walk, FOREST))}) / {len(FOREST)}e0 / {mean_depth(FOREST_ROWS)}) AS score FROM lineitem)
            SELECT l_orderkey, l_linenumber, round_even(score, 6) AS anomaly_score,
                   score < (SELECT quantile_cont(score, 0.05) FROM s) AS flagged FROM s""",
        "group_moments": cte("order_lines") + " SELECT categorical_column, category, numeric_column, n, "
                         "round_even(mean, 1) AS mean, round_even(variance, -2) AS variance "
                         f"FROM ({moments('order_lines', CATEGORICAL, NUMERIC)})",
        "welch_t": f"""
            SELECT a.categorical_column, a.numeric_column, CAST(2 AS INTEGER) AS groups_compared,
                   round_even((a.mean - b.mean) / sqrt(a.variance / a.n + b.variance / b.n), 4) AS statistic,
                   round_even(pow(a.variance / a.n + b.variance / b.n, 2) / (pow(a.variance / a.n, 2) / (a.n - 1)
                              + pow(b.variance / b.n, 2) / (b.n - 1)), 2) AS df
            FROM ({moments('lineitem', ['l_linestatus'], ['l_quantity', 'l_extendedprice', 'l_discount'])}) a
            JOIN ({moments('lineitem', ['l_linestatus'], ['l_quantity', 'l_extendedprice', 'l_discount'])}) b
              ON a.numeric_column = b.numeric_column AND a.category < b.category""",
        "anova_f": cte("order_lines") + " SELECT categorical_column, numeric_column, groups_compared, "
                   f"round_even(statistic, 4) AS statistic, df1, df2 FROM ({anova('order_lines')})",
        "hypothesis_sweep": cte("order_lines") + _sweep(),
        "sweep_summary": cte("order_lines") + f""", s AS ({_sweep()})
            SELECT count(*) AS total_tests_run, count(*) FILTER (likely_significant) AS significant_results_count,
                   CASE WHEN count(*) > 0 THEN 'No correction for multiple comparisons: among ' || count(*)
                        || ' tests some differences look significant by chance.' END AS note FROM s""",
        "top_significant": cte("order_lines") + f""", s AS ({_sweep()})
            SELECT * FROM s WHERE likely_significant ORDER BY p_value, categorical_column, numeric_column LIMIT 5""",
        "holt_lines": f"""{cte("trend_lines")}, n AS (SELECT line, count(*) AS n FROM trend_lines GROUP BY line)
            SELECT line, CAST(s AS INTEGER) AS step_no, DATE '2000-01-01' + CAST(n + s AS INTEGER) AS date,
                   CAST(10 * line + (n + s) / 2.0 AS DOUBLE) AS predicted_value, CAST(10 * line + n / 2.0 AS DOUBLE) AS naive_baseline
            FROM n CROSS JOIN range(1, 8) r(s) WHERE n >= 5""",
        "chart_lines": f"""{cte("trend_lines")}, n AS (SELECT line, count(*) AS n FROM trend_lines GROUP BY line)
            SELECT line, 'history' AS kind, day AS date, CAST(value AS DOUBLE) AS value FROM trend_lines
            UNION ALL SELECT line, 'forecast', DATE '2000-01-01' + CAST(n + s AS INTEGER), CAST(10 * line + (n + s) / 2.0 AS DOUBLE)
            FROM n CROSS JOIN range(1, 8) r(s) WHERE n >= 5""",
        "skipped_series": """
            SELECT o_custkey, count(DISTINCT o_orderdate) AS points,
                   'too short: ' || count(DISTINCT o_orderdate) || ' of the 5 points that a forecast takes' AS reason
            FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderdate) < 5""",
        "cleaning_suggestions": cte("dirty_status") + """
            SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, type, column_name, auto_applied FROM (
                SELECT 1 AS k, 'fill_missing_numeric' AS type, 'price_band' AS column_name, true AS auto_applied, count(*) AS n
                FROM dirty_status WHERE price_band IS NULL
                UNION ALL SELECT 2, 'fill_missing_categorical', 'o_orderpriority', true, count(*)
                FROM dirty_status WHERE o_orderpriority IS NULL
                UNION ALL SELECT 3, 'drop_duplicates', NULL, true, sum(n - 1) FROM (
                    SELECT count(*) AS n FROM dirty_status GROUP BY price_band, o_orderstatus, o_orderpriority)
                UNION ALL SELECT 4, 'standardize_categories', 'o_orderpriority', true, count(*) FROM (
                    SELECT lower(trim(o_orderpriority)) FROM dirty_status WHERE o_orderpriority IS NOT NULL
                    GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1)
            ) WHERE n > 0""",
        "cleaned_table": _cleaned() + """
            SELECT price_band, o_orderstatus, canonical AS o_orderpriority
            FROM deduplicated JOIN canon ON o_orderpriority = value""",
        "cleaning_log": _cleaned() + """
            SELECT CAST(seq AS INTEGER) AS seq, action, column_name, CAST(affected AS BIGINT) AS affected FROM (
                SELECT 1 AS seq, 'fill_missing_numeric' AS action, 'price_band' AS column_name, count(*) AS affected
                FROM dirty_status WHERE price_band IS NULL
                UNION ALL SELECT 2, 'fill_missing_categorical', 'o_orderpriority', count(*)
                FROM dirty_status WHERE o_orderpriority IS NULL
                UNION ALL SELECT 3, 'drop_duplicates', NULL, (SELECT count(*) FROM filled) - (SELECT count(*) FROM deduplicated)
                UNION ALL SELECT 4, 'standardize_categories', 'o_orderpriority',
                                 (SELECT sum(n) FROM canon WHERE value <> canonical))""",
        "fill_median": f"""{dirty} SELECT o_orderkey, o_custkey, o_orderstatus, round_even(coalesce(o_totalprice,
            (SELECT median(o_totalprice) FROM dirty_orders)), 2) AS o_totalprice, o_orderpriority FROM dirty_orders""",
        "fill_unknown": f"{dirty} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                        "coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM dirty_orders",
        "drop_duplicates": cte("line_terms") + " SELECT DISTINCT * FROM line_terms",
        "standardize_categories": f"""{dirty}, canon AS ({spellings('dirty_orders', 'o_orderpriority')})
            SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, canonical AS o_orderpriority
            FROM dirty_orders LEFT JOIN canon ON o_orderpriority = value""",
        "date_columns": cte("order_texts") + """
            SELECT CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS place, column_name FROM (
                SELECT 1 AS i, 'cust_text' AS column_name, avg(CASE WHEN TRY_CAST(cust_text AS DATE) IS NULL THEN 0 ELSE 1 END) AS rate FROM order_texts
                UNION ALL SELECT 2, 'price_text', avg(CASE WHEN TRY_CAST(price_text AS DATE) IS NULL THEN 0 ELSE 1 END) FROM order_texts
                UNION ALL SELECT 3, 'late_text', avg(CASE WHEN TRY_CAST(late_text AS DATE) IS NULL THEN 0 ELSE 1 END) FROM order_texts
                UNION ALL SELECT 4, 'date_text', avg(CASE WHEN TRY_CAST(date_text AS DATE) IS NULL THEN 0 ELSE 1 END) FROM order_texts
                UNION ALL SELECT 5, 'o_orderpriority', avg(CASE WHEN TRY_CAST(o_orderpriority AS DATE) IS NULL THEN 0 ELSE 1 END) FROM order_texts)
            WHERE rate >= 0.8""",
        "chosen_series": cte("order_texts") + """
            SELECT CAST(date_text AS TIMESTAMP) AS ts, round_even(avg(TRY_CAST(price_text AS DOUBLE)), 8) AS value
            FROM order_texts WHERE TRY_CAST(price_text AS DOUBLE) IS NOT NULL GROUP BY 1""",
        "daily_mean_series": "SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, round_even(avg(o_totalprice), 8) AS value "
                             "FROM orders GROUP BY 1",
        "series_step": """
            SELECT event_type, quantile_cont(CAST(epoch_us(ts) - epoch_us(before) AS DOUBLE), 0.5) AS step_us FROM (
                SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before
                FROM (SELECT DISTINCT event_type, ts FROM events WHERE value IS NOT NULL)) WHERE before IS NOT NULL
            GROUP BY event_type""",
        "naive_forecast": _naive(),
        "audit_sql": _audit(),
    }
    corr = union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {i} AS i, {j} AS j, "
        + (f"corr({a}, {b}) AS r FROM line_amounts" if "one" not in (a, b) else "CAST(NULL AS DOUBLE) AS r")
        for i, a in enumerate(AMOUNTS) for j, b in enumerate(AMOUNTS) if i < j)
    out["correlation_matrix"] = cte("line_amounts") + f""", c AS ({corr})
        SELECT column_a, column_b, round_even(r, 6) AS correlation FROM c
        UNION ALL SELECT column_b, column_a, round_even(r, 6) FROM c
        UNION ALL """ + union(
        f"SELECT '{a}', '{a}', CAST({1 if a != 'one' else 'NULL'} AS DOUBLE)" for a in AMOUNTS)
    out["top_correlations"] = cte("line_amounts") + f""", c AS ({corr})
        SELECT CAST(row_number() OVER (ORDER BY abs(correlation) DESC, i, j) AS INTEGER) AS rank, column_a, column_b, correlation
        FROM (SELECT *, round_even(r, 2) AS correlation FROM c WHERE r IS NOT NULL AND abs(r) >= 0.3)
        ORDER BY rank LIMIT 5"""
    out.update({name: f"WITH data AS (SELECT * FROM orders) SELECT * FROM ({text})" for name, text in SQL.items()})
    return out
