"""Aggregation pipelines: a list of stages compiled to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.accumulators import accumulate
from ..functions.filters import compile_filter
from ..operators.windows import tumbling_epoch
from ..spec import SeriesSpec


def _name(path: str) -> str:
    return path.removeprefix("$").removeprefix("tags.")


def _accumulator(df: DataFrame, spec: SeriesSpec, document: dict[str, Any]) -> Column:
    ((operator, argument),) = document.items()
    if operator == "$count" and not (isinstance(argument, str) and argument.startswith("$")):
        return F.count("*")
    if isinstance(argument, (int, float)) and operator == "$sum":
        return F.sum(F.lit(argument))
    return accumulate(df, _name(argument), operator.removeprefix("$"), spec)


def _group(df: DataFrame, spec: SeriesSpec, body: dict[str, Any]) -> DataFrame:
    key = body.get("_id")
    if isinstance(key, str):
        keys = [F.col(_name(key)).alias("_id")]
    else:
        keys = [F.col(_name(path)).alias(alias) for alias, path in (key or {}).items()]
    values = [_accumulator(df, spec, x).alias(name) for name, x in body.items() if name != "_id"]
    if not values:
        return df.select(*keys).distinct() if keys else df
    return df.groupBy(*keys).agg(*values) if keys else df.agg(*values)


def _sort(body: dict[str, int]) -> list[Column]:
    return [F.col(_name(c)).asc() if way > 0 else F.col(_name(c)).desc() for c, way in body.items()]


def aggregate(df: DataFrame, spec: SeriesSpec, stages: list[dict[str, Any]]) -> DataFrame:
    """$match, $group, $sort, $skip, $limit, $project, $count and $timeWindow, in the order given.

    ``{"$count": "$x"}`` counts the rows that have x, ``{"$count": {}}`` all rows.
    A group key that a row lacks is a group of its own (null). Without keys there is one row, also
    for no input. Aggregates are partial before the shuffle; $sort with $limit keeps only the top rows.
    """
    for stage in stages:
        ((name, body),) = stage.items()
        if name == "$match":
            df = df.where(compile_filter(body, spec))
        elif name == "$group":
            df = _group(df, spec, body)
        elif name == "$sort":
            df = df.orderBy(*_sort(body))
        elif name == "$skip":
            df = df.offset(body)
        elif name == "$limit":
            df = df.limit(body)
        elif name == "$project":
            df = df.select(*[F.col(_name(c)) if on == 1 else F.col(_name(on)).alias(c) for c, on in body.items() if on])
        elif name == "$count":
            df = df.agg(F.count("*").alias(body))
        elif name == "$timeWindow":
            df = tumbling_epoch(df, spec, body["window"], body.get("aggregations", {"value": "avg"}), tuple(body.get("by", ())))
        else:
            raise ValueError(f"unknown stage: {name}")
    return df


@dataclass
class Find:
    """A filter query: predicate, order, offset and limit."""

    where: dict[str, Any] = field(default_factory=dict)
    sort: dict[str, int] = field(default_factory=dict)
    skip: int = 0
    limit: int | None = None

    def on(self, df: DataFrame, spec: SeriesSpec) -> DataFrame:
        out = df.where(compile_filter(self.where, spec))
        if self.sort:
            out = out.orderBy(*_sort(self.sort))
        if self.skip:
            out = out.offset(self.skip)
        return out if self.limit is None else out.limit(self.limit)

    def batches(self, df: DataFrame, spec: SeriesSpec, size: int = 101) -> Iterator[list[Row]]:
        """The rows in lists of ``size``, as a cursor gives them; the driver holds one partition at a time."""
        rows = self.on(df, spec).toLocalIterator()
        while batch := list(islice(rows, size)):
            yield batch
