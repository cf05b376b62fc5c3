"""Filter documents compiled to one Catalyst predicate, so that comparisons reach the Parquet scan."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import SeriesSpec


def _compare(value: Column, operator: str, operand: Any) -> Column:
    table = {
        "$eq": lambda: value == operand,
        "$ne": lambda: value != operand,
        "$gt": lambda: value > operand,
        "$gte": lambda: value >= operand,
        "$lt": lambda: value < operand,
        "$lte": lambda: value <= operand,
        "$in": lambda: value.isin(list(operand)),
        "$nin": lambda: ~value.isin(list(operand)),
        "$regex": lambda: value.rlike(operand),
        "$like": lambda: value.like(operand),
        "$contains": lambda: value.contains(str(operand).replace("%", "")),
        "$prefix": lambda: value.startswith(operand),
        "$exists": lambda: value.isNotNull() if operand else value.isNull(),
    }
    if operator not in table:
        raise ValueError(f"unknown operator: {operator}")
    return table[operator]()


def compile_filter(document: dict[str, Any], spec: SeriesSpec, inclusive: bool = False) -> Column:
    """A conjunction of all entries; rows that lack a named column's value never match.

    ``timestamp`` is the time column, ``tags.x`` a tag, anything else a field. A value means
    equality, a document of operators a comparison each. ``inclusive`` reads ``$gt`` and ``$lt`` on
    time as including their bounds.
    """
    parts = []
    for key, condition in document.items():
        if key == "tags" and isinstance(condition, dict):
            parts += [compile_filter({f"tags.{k}": v}, spec) for k, v in condition.items()]
            continue
        name = spec.time if key == "timestamp" else key.removeprefix("tags.")
        operators = condition if isinstance(condition, dict) else {"$eq": condition}
        for operator, operand in operators.items():
            if inclusive and key == "timestamp" and operator in ("$gt", "$lt"):
                operator += "e"
            parts.append(_compare(F.col(name), operator, operand))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def differs(column: str, value: Any) -> Column:
    """Every row that holds another value, or none."""
    return ~F.col(column).eqNullSafe(value)


def composite_prefix(columns: list[str], values: list[str]) -> Column:
    """Leading columns equal, the last given value a prefix."""
    parts = [F.col(c) == v for c, v in zip(columns, values[:-1], strict=False)]
    return reduce(lambda a, b: a & b, [*parts, F.col(columns[len(values) - 1]).startswith(values[-1])])


def between(column: str, low: Any = None, high: Any = None, include_low: bool = True, include_high: bool = True) -> Column:
    """A range, open where a bound is None."""
    out = F.col(column).isNotNull()
    if low is not None:
        out = out & (F.col(column) >= low if include_low else F.col(column) > low)
    if high is not None:
        out = out & (F.col(column) <= high if include_high else F.col(column) < high)
    return out


def same_period(spec: SeriesSpec, unit: str, when: str) -> Column:
    """Times in the same year, month, day, hour, minute or second as ``when``; a range, so that files can be skipped."""
    start = F.date_trunc(unit, F.lit(when).cast("timestamp_ntz")).cast("timestamp_ntz")
    return (F.col(spec.time) >= start) & (F.col(spec.time) < start + F.expr(f"interval 1 {unit}"))


#: Levels of time from the coarsest on, with the shortest range (microseconds) that is searched at each; fixed values.
LEVELS = (("year", 365 * 86_400_000_000), ("month", 30 * 86_400_000_000), ("day", 86_400_000_000), ("hour", 3_600_000_000), ("minute", 60_000_000), ("second", 0))


def period_range(spec: SeriesSpec, start: str, end: str, include_start: bool = True, include_end: bool = True) -> Column:
    """Times in the periods from that of ``start`` to that of ``end``.

    The longer the range, the longer the periods: see ``LEVELS``. A period that is not included goes
    whole. The comparisons are on the time itself, so that files can be skipped.
    """
    first, last = (dt.datetime.fromisoformat(x) for x in (start, end))
    span = (last - first) // dt.timedelta(microseconds=1)
    unit = next(name for name, least in LEVELS if span >= least or name == "second")
    at = lambda x, more: F.date_trunc(unit, F.lit(x)).cast("timestamp_ntz") + F.expr(f"interval {more} {unit}")
    return (F.col(spec.time) >= at(first, int(not include_start))) & (F.col(spec.time) < at(last, int(include_end)))
