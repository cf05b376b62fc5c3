"""Operators with the defaults that requests give them: interval-sized gaps, minutes, a lookback of three days of hours."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import detect, series, windows
from ..spec import SeriesSpec, duration

#: Fixed values of requests.
GAP_INTERVALS, STEP, LOOKBACK = 10, "1m", 72


def interpolate(df: DataFrame, spec: SeriesSpec, field: str, interval: str, method: str = "linear", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Gaps up to ten intervals, filled at the interval."""
    return series.interpolate(df, spec, field, interval, GAP_INTERVALS * duration(interval), method, partition_by)


def moving(df: DataFrame, spec: SeriesSpec, field: str, minutes: int, name: str = "avg", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Windows of so many minutes, every minute."""
    return windows.moving(df, spec, field, f"{minutes}m", STEP, name, partition_by)


def anomalies(df: DataFrame, spec: SeriesSpec, field: str, method: str = "zscore", threshold: float = 3.0, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Against the 72 values before."""
    return detect.anomalies(df, spec, field, method, LOOKBACK, threshold, partition_by)
