"""Accumulators by name. Non-numeric values count but add nothing; empty sums and means are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..spec import SeriesSpec

NAMES = ("avg", "sum", "min", "max", "count", "first", "last")


def number(df: DataFrame, field: str) -> Column:
    """The field as double; null where its type is not numeric."""
    kind = df.schema[field].dataType
    return F.col(field).cast("double") if isinstance(kind, NumericType) else F.lit(None).cast("double")


def accumulate(df: DataFrame, field: str, name: str, spec: SeriesSpec | None = None) -> Column:
    value = number(df, field)
    if name == "count":
        return F.count(F.col(field))
    if name in ("first", "last"):
        if spec is None:
            raise ValueError(f"{name} needs the order of a series")
        order = F.when(value.isNotNull(), F.struct(*spec.order))
        return F.min_by(value, order) if name == "first" else F.max_by(value, order)
    plain = {"avg": lambda: F.coalesce(F.avg(value), F.lit(0.0)), "sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)), "min": lambda: F.min(value), "max": lambda: F.max(value)}
    if name not in plain:
        raise ValueError(f"unknown accumulator: {name}")
    return plain[name]()


def percentile_rank(df: DataFrame, field: str, p: float) -> Column:
    """Nearest-rank percentile; p outside 0 to 100 counts as 95."""
    p = p if 0 <= p <= 100 else 95.0
    value = number(df, field)
    return F.expr(f"percentile_disc({p / 100!r}) within group (order by cast(`{field}` as double))") if isinstance(df.schema[field].dataType, NumericType) else F.max(value)


def percentile_linear(df: DataFrame, field: str, p: float) -> Column:
    return F.percentile(number(df, field), F.lit(p / 100))


def mean_and_deviation(df: DataFrame, field: str) -> tuple[Column, Column]:
    """Mean, and sample deviation (0 of a single value)."""
    value = number(df, field)
    return F.coalesce(F.avg(value), F.lit(0.0)), F.coalesce(F.stddev_samp(value), F.lit(0.0))
