"""Anomalies against the values just before: z-score, quartile fences, median deviation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accumulators import number
from ..spec import SeriesSpec
from .ordered import n_ranges, ranged, with_halo

_FLAT = 1e-10


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(values: Column, p: float) -> Column:
    """Linear-interpolated quantile of an ascending array that is at hand."""
    rank = F.lit(p) * (F.size(values) - 1)
    low = F.floor(rank).cast("int")
    left, right = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
    return left + (rank - low) * (right - left)


def anomalies(df: DataFrame, spec: SeriesSpec, field: str, method: str = "zscore", lookback: int = 10, threshold: float = 3.0, partition_by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Rows whose value is unusual against the ``lookback`` values before it, with ``<field>_anomaly``.

    The first ``lookback`` values are never flagged; rows without a numeric value are left out first.
    A spread of 0 flags nothing by z-score and median deviation. Unknown methods are z-score. The
    window streams through sorted rows and holds ``lookback`` values. A series is worked on in
    ``ranges`` of time, each with the rows before it that it needs: by default one for each key, and
    one a shuffle partition where there are no keys.
    """
    n = n_ranges(df, partition_by, ranges)
    rows = df.withColumn("_v", number(df, field)).where("_v is not null")
    rows = with_halo(ranged(rows, spec, n), spec, lookback, partition_by, n)
    frame = Window.partitionBy(*partition_by, "_r").orderBy(*spec.order).rowsBetween(-lookback, -1)
    v = F.col("_v")
    if method in ("iqr", "mad"):
        past = F.col("_past")
        rows = rows.withColumn("_past", F.sort_array(F.collect_list("_v").over(frame))).where(~F.col("_halo") & (F.size("_past") == lookback))
        if method == "iqr":
            fences = _with(past, lambda w: F.struct(_at(w, 0.25).alias("low"), _at(w, 0.75).alias("high")))
            flag = _with(fences, lambda q: (v < q["low"] - threshold * (q["high"] - q["low"])) | (v > q["high"] + threshold * (q["high"] - q["low"])))
        else:

            def unusual(mid: Column, deviation: Column) -> Column:
                return (deviation >= _FLAT) & (F.abs(v - mid) > threshold * deviation)

            def judged(mid: Column) -> Column:
                return _with(_with(F.sort_array(F.transform(past, lambda x: F.abs(x - mid))), lambda w: _at(w, 0.5)), lambda d: unusual(mid, d))

            flag = _with(_with(past, lambda w: _at(w, 0.5)), judged)
    else:
        rows = rows.withColumn("_n", F.count("_v").over(frame)).withColumn("_mu", F.avg("_v").over(frame)).withColumn("_sd", F.stddev_samp("_v").over(frame))
        rows = rows.where(~F.col("_halo") & (F.col("_n") == lookback))
        flag = (F.col("_sd") >= _FLAT) & (F.abs(v - F.col("_mu")) > threshold * F.col("_sd"))
    return rows.where(flag).select(*df.columns, F.lit(True).alias(f"{field}_anomaly"))
