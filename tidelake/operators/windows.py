"""Tumbling and moving windows, downsampling and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.accumulators import accumulate, number
from ..functions.clock import epoch_bucket, micros, moment
from ..spec import SeriesSpec, duration
from .ordered import following, n_ranges, ranged

Aggregates = dict[str, str | list[str]]


def _columns(df: DataFrame, spec: SeriesSpec, aggregates: Aggregates) -> list[Column]:
    out = []
    for field, names in aggregates.items():
        for name in [names] if isinstance(names, str) else names:
            out.append(accumulate(df, field, name, spec).alias(f"{field}_{name}"))
    return out


def tumbling_epoch(df: DataFrame, spec: SeriesSpec, width: str | int, aggregates: Aggregates, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each window with rows, windows aligned to 1970. A partial aggregate runs before the only shuffle."""
    start = epoch_bucket(F.col(spec.time), duration(width)).alias("_start")
    return df.groupBy(*partition_by, start).agg(*_columns(df, spec, aggregates)).withColumn(spec.time, moment(F.col("_start"))).drop("_start")


#: Entries of an array that a row is exploded by.
_BLOCK = 4096


def counted(df: DataFrame, name: str, n: Column) -> DataFrame:
    """Each row n times, numbered from 0; in two steps, so that no row makes an array of n entries."""
    last = F.greatest(n, F.lit(1)) - 1
    out = df.withColumn("_last_n", last.cast("long")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_last_n div {_BLOCK}"))))
    low = F.col("_block") * _BLOCK
    return out.withColumn(name, F.explode(F.sequence(low, F.least(F.col("_last_n"), low + _BLOCK - 1)))).drop("_last_n", "_block")


def _since_first(df: DataFrame, spec: SeriesSpec, partition_by: tuple[str, ...]) -> DataFrame:
    """Adds _t (microseconds) and _t0 (those of the series' first row)."""
    df = df.withColumn("_t", micros(F.col(spec.time)))
    if not partition_by:
        return df.withColumn("_t0", F.lit(df.agg(F.min("_t")).first()[0]).cast("long"))
    first = df.groupBy(*partition_by).agg(F.min("_t").alias("_t0"))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in partition_by]
    right = first.alias("r")
    return df.alias("l").join(right, keys).select("l.*", "r._t0")


def tumbling_first(df: DataFrame, spec: SeriesSpec, width: str | int, aggregates: Aggregates, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Like ``tumbling_epoch``, with windows that begin at the first row of the series."""
    w = duration(width)
    timed = _since_first(df, spec, partition_by)
    start = (F.col("_t") - F.pmod(F.col("_t") - F.col("_t0"), F.lit(w))).alias("_start")
    return timed.groupBy(*partition_by, start).agg(*_columns(df, spec, aggregates)).withColumn(spec.time, moment(F.col("_start"))).drop("_start")


def downsample(df: DataFrame, spec: SeriesSpec, field: str, width: str | int, name: str = "avg", fill: str = "none", partition_by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """One field in windows from the first row on, with the tags of each window's first row.

    ``fill`` gives windows without rows too: ``previous`` value, ``zero`` or ``linear`` between
    neighbours; windows filled have null tags. Windows are filled in ``ranges`` of time, by default
    one for each key, and one a shuffle partition without keys.
    """
    w = duration(width)
    timed = _since_first(df, spec, partition_by)
    start = (F.col("_t") - F.pmod(F.col("_t") - F.col("_t0"), F.lit(w))).alias("_start")
    order = F.struct(*spec.order)
    tags = [F.min_by(F.col(t), order).alias(t) for t in spec.tags if t not in partition_by]
    out = timed.groupBy(*partition_by, start).agg(accumulate(df, field, name, spec).alias(f"{field}_{name}"), *tags)
    if fill != "none":
        out = _fill(out, f"{field}_{name}", w, fill, partition_by, ranges)
    return out.withColumn(spec.time, moment(F.col("_start"))).drop("_start")


def _fill(windows: DataFrame, value: str, width: int, method: str, partition_by: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """Adds rows for missing windows from each window's successor, so no grid is joined."""
    if method not in ("previous", "zero", "linear"):
        raise ValueError(f"unknown fill: {method}")
    n = n_ranges(windows, partition_by, ranges)
    order = SeriesSpec("_start")
    placed = ranged(windows.withColumn("_w", moment(F.col("_start"))), SeriesSpec("_w"), n).drop("_w")
    out = following(placed, order, ["_start", value], partition_by, n)
    out = out.withColumn("_n", (F.col("_next__start") - F.col("_start")) / width).withColumnRenamed(f"_next_{value}", "_next")
    out = counted(out, "_j", F.coalesce(F.col("_n").cast("long"), F.lit(1).cast("long")))
    own = F.col("_j") == 0
    share = F.col("_j") / F.col("_n")
    filled = {"previous": F.col(value), "zero": F.lit(0.0), "linear": F.col(value) + share * (F.col("_next") - F.col(value))}[method]
    blank = [c for c in windows.columns if c not in (*partition_by, value, "_start")]
    return out.select(*partition_by, (F.col("_start") + F.col("_j") * width).cast("long").alias("_start"), F.when(own, F.col(value)).otherwise(filled).alias(value), *[F.when(own, F.col(c)).alias(c) for c in blank])


def downsample_policy(df: DataFrame, spec: SeriesSpec, width: str | int, name: str = "avg") -> DataFrame:
    """Every field by window and full set of tags, windows aligned to 1970; counts are doubles, as other results."""
    aggregates: Aggregates = {f: name for f in spec.fields}
    out = tumbling_epoch(df, spec, width, aggregates, spec.tags)
    return out.withColumns({f"{f}_{name}": F.col(f"{f}_{name}").cast("double") for f in spec.fields})


def downsample_due(df: DataFrame, spec: SeriesSpec, width: str | int, now: str, name: str = "avg", lag: str | int = "1h", intervals: int = 10) -> DataFrame:
    """``downsample_policy`` of what a run at ``now`` covers: ``intervals`` windows' time up to ``lag`` before it, both ends included."""
    back = lambda micros: F.lit(now).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {micros} / 1000000.0)")
    w, late = duration(width), duration(lag)
    due = df.where((F.col(spec.time) >= back(late + intervals * w)) & (F.col(spec.time) <= back(late)))
    return downsample_policy(due, spec, w, name)


#: How results of panes are put together to those of a window, by accumulator.
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def moving(df: DataFrame, spec: SeriesSpec, field: str, size: str | int, step: str | int = 0, name: str = "avg", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Windows of ``size`` every ``step`` from the first row on; those without rows are left out.

    The time of a window is its end less half its size; tags are those of its first row. Where steps
    divide windows, rows are first aggregated to panes of one step, before and in one shuffle, and
    only panes are sent to the size / step windows that hold them; else each row is.
    """
    w = duration(size)
    s = duration(step) or w
    timed = _since_first(df, spec, partition_by)
    since = F.col("_t") - F.col("_t0")
    order = F.struct(*spec.order)
    tags = [t for t in spec.tags if t not in partition_by]
    keys = (*partition_by, "_t0", "_k")
    if w % s:
        first = F.greatest(F.floor((since - w) / s) + 1, F.lit(0)).cast("long")
        spread = timed.withColumn("_k", F.explode(F.sequence(first, F.floor(since / s).cast("long"))))
        out = spread.groupBy(*keys).agg(accumulate(df, field, name, spec).alias("_x"), *[F.min_by(F.col(t), order).alias(t) for t in tags])
    else:
        value = number(df, field)
        panes = timed.withColumn("_k", F.call_function("div", since, F.lit(s)))
        made = [accumulate(df, field, name, spec).alias("_x")]
        if name == "avg":
            made = [F.sum(value).alias("_sum"), F.count(value).alias("_n")]
        elif name in ("first", "last"):
            made.append((F.min if name == "first" else F.max)(F.when(value.isNotNull(), order)).alias("_at"))
        panes = panes.groupBy(*keys).agg(*made, F.min(order).alias("_o"), *[F.min_by(F.col(t), order).alias(t) for t in tags])
        spread = panes.withColumn("_k", F.explode(F.sequence(F.greatest(F.col("_k") - (w // s - 1), F.lit(0).cast("long")), F.col("_k"))))
        if name == "avg":
            result = F.coalesce(F.sum("_sum") / F.when(F.sum("_n") > 0, F.sum("_n")), F.lit(0.0))
        elif name in ("first", "last"):
            result = (F.min_by if name == "first" else F.max_by)("_x", "_at")
        else:
            result = _MERGE[name]("_x")
        out = spread.groupBy(*keys).agg(result.alias("_x"), *[F.min_by(F.col(t), F.col("_o")).alias(t) for t in tags])
    return out.withColumnRenamed("_x", f"{field}_{name}").withColumn(spec.time, moment(F.col("_t0") + F.col("_k") * s + (w - w // 2))).drop("_t0", "_k")
