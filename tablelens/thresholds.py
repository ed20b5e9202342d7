"""Decision constants of all reports."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # The reports are defined by these numbers.
    id_like_ratio: float = 0.95
    high_cardinality_ratio: float = 0.5
    high_cardinality_min: int = 50
    type_parse_ratio: float = 0.8
    category_check_max: int = 50
    iqr_factor: float = 1.5
    iqr_min_rows: int = 4
    top_categories_max_distinct: int = 20
    top_categories: int = 5
    top_correlations: int = 5
    min_correlation: float = 0.3
    max_histograms: int = 4
    histogram_bins: int = 20
    z_score: float = 3.0
    forest_min_rows: int = 10
    forest_min_columns: int = 2
    forest_top_rows: int = 5
    forest_trees: int = 100
    forest_subsample: int = 256
    contamination: float = 0.05
    seed: int = 42
    min_groups: int = 2
    max_groups: int = 6
    min_group_size: int = 2
    significance: float = 0.05
    top_tests: int = 5
    min_forecast_points: int = 5
    forecast_periods: int = 7
    sample_rows: int = 5
    fill_text: str = "Unknown"


@dataclass(frozen=True)
class Limits:
    """Sizes up to which a simpler physical strategy is used. No result depends on them."""

    # Values of one range that may be put in order inside one task; larger ranges are split first.
    quantile_buffer: int = 200_000
    # Tasks between which large aggregation states are merged before the last one.
    merge_tasks: int = 256
    # Aggregate expressions are spread over several jobs beyond this many columns each.
    columns_per_job: int = 60
    # Rows of a lookup table that may be broadcast.
    broadcast_rows: int = 100_000
    # Points of one series fitted inside one task; longer series are cut into fragments.
    local_series_points: int = 50_000
    # Points of short series that one task fits.
    points_per_task: int = 5_000
    # Reports of one table that run side by side.
    concurrent_reports: int = 8


DEFAULTS = Thresholds()
LIMITS = Limits()
