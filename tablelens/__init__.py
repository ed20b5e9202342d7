"""Spark-native first-pass analysis of any table."""

from tablelens.plans.analysis import Analysis, analyze, analyze_file
from tablelens.sources.readers import load_data_file
from tablelens.thresholds import DEFAULTS, Thresholds

__all__ = ["DEFAULTS", "Analysis", "Thresholds", "analyze", "analyze_file", "load_data_file"]
