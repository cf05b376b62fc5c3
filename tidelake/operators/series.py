"""Operators on consecutive points: interpolation, exponential average, windowed percentile, dedup."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.accumulators import number, percentile_rank
from ..functions.clock import micros, moment
from ..runtime import ship
from ..spec import SeriesSpec, duration
from .ordered import following, n_ranges, ranged
from .windows import _since_first, counted

METHODS = ("linear", "previous", "next", "zero")


def _smoothing(alpha: float) -> float:
    return alpha if 0 < alpha <= 1 else 0.2


def interpolate(df: DataFrame, spec: SeriesSpec, field: str, resolution: str | int = "1m", max_gap: str | int = 0, method: str = "linear", partition_by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """All rows (columns time, partition keys, tags, field) and the points set into gaps between them.

    A gap of n resolutions gets n - 1 points that carry the tags of the row before; ``linear`` goes
    by the point's number among n. Gaps up to ``resolution``, or above ``max_gap`` where that is
    not 0, are left. A series is worked on in ``ranges`` of time, by default one for each key, and
    one a shuffle partition where there are no keys.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    r, most = duration(resolution), duration(max_gap)
    keys = [c for c in dict.fromkeys((*partition_by, *spec.tags))]
    out = df.select(*keys, spec.time, *spec.tiebreak, micros(F.col(spec.time)).alias("_t"), number(df, field).alias("_v"))
    n = n_ranges(df, partition_by, ranges)
    out = following(ranged(out, spec, n), spec, ["_t", "_v"], partition_by, n)
    out = out.withColumn("_gap", F.col("_next__t") - F.col("_t")).withColumnRenamed("_next__v", "_next")
    fits = (F.col("_gap") > r) & F.col("_v").isNotNull() & F.col("_next").isNotNull()
    if most:
        fits = fits & (F.col("_gap") <= most)
    out = out.withColumn("_n", F.when(fits, F.floor(F.col("_gap") / r)).otherwise(F.lit(1)).cast("long"))
    out = counted(out, "_j", F.col("_n"))
    own, share = F.col("_j") == 0, F.col("_j") / F.col("_n")
    value = {"linear": F.col("_v") + share * (F.col("_next") - F.col("_v")), "previous": F.col("_v"), "next": F.col("_next"), "zero": F.lit(0.0)}[method]
    return out.select(*keys, moment(F.col("_t") + F.col("_j") * r).alias(spec.time), F.when(own, F.col("_v")).otherwise(value).alias(field), (~own).alias("inserted"))


def _folder(a: float, from_zero: bool):
    """Smooths sorted rows; a series or range begins where _i is 1. One value is all that is carried on."""

    def fold(batches):
        e = 0.0
        for batch in batches:
            out = []
            for v, i in zip(batch.column("_v").to_pylist(), batch.column("_i").to_pylist(), strict=True):
                if i == 1:
                    e = a * v if from_zero else v
                else:
                    e += a * (v - e)
                out.append(e)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "_e"])

    return fold


def ema(df: DataFrame, spec: SeriesSpec, field: str, alpha: float = 0.2, partition_by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Exponential average over (time, tiebreak): the first value, then alpha v + (1 - alpha) e.

    Rows are sorted once and stream through a task in Arrow batches. A series may be cut into
    ``ranges`` of time, by default one for each key and one a shuffle partition without keys.
    Smoothing is linear: a range's results are those from a start of 0 plus (1 - alpha)^i times the
    value before it, so each range gives an end and a factor, the ranges' starts follow from those
    few rows, and only then are points added up.
    """
    ship(df.sparkSession)
    a, n = _smoothing(alpha), n_ranges(df, partition_by, ranges)
    keys = list(partition_by)
    points = df.select(*dict.fromkeys((*keys, *spec.tags, spec.time, *spec.tiebreak)), number(df, field).alias("_v")).where("_v is not null")
    points = ranged(points, spec, n).withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(*spec.order)))
    schema = StructType([*points.schema.fields, StructField("_e", DoubleType())])
    folded = points.mapInArrow(_folder(a, n > 1), schema)
    if n == 1:
        return folded.withColumnRenamed("_e", f"{field}_ema").drop("_v", "_r", "_i")
    ends = folded.groupBy(*keys, "_r").agg(F.max_by("_e", "_i").alias("end"), F.pow(F.lit(1 - a), F.max("_i")).alias("factor"), F.min_by("_v", "_i").alias("first"))
    # at most MOST ranges for each key
    chain = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "end", "factor", "first"))).alias("_c"))
    start = F.struct(F.get("_c", F.lit(0))["first"].alias("seed"), F.lit(None).cast("array<struct<_r:int,_seed:double>>").alias("seeds"))
    step = lambda s, x: F.struct(
        (x["end"] + x["factor"] * s["seed"]).alias("seed"),
        F.concat(F.coalesce(s["seeds"], F.array().cast("array<struct<_r:int,_seed:double>>")), F.array(F.struct(x["_r"].alias("_r"), s["seed"].alias("_seed")))).alias("seeds"),
    )
    seeds = chain.select(*keys, F.explode(F.aggregate("_c", start, step)["seeds"]).alias("_s")).select(*keys, "_s._r", "_s._seed")
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, "_r")]
    joined = folded.alias("p").join((seeds if keys else F.broadcast(seeds)).alias("s"), on).select("p.*", "s._seed")
    value = F.col("_e") + F.pow(F.lit(1 - a), F.col("_i")) * F.col("_seed")
    return joined.withColumn(f"{field}_ema", value).drop("_r", "_e", "_i", "_v", "_seed")


def ema_level(df: DataFrame, spec: SeriesSpec, field: str, alpha: float = 0.2, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The exponential average as an aggregate: its last value in each group."""
    smooth = ema(df.select(*dict.fromkeys((*partition_by, *spec.tags, *spec.order, field))), spec, field, alpha, partition_by)
    return smooth.groupBy(*partition_by).agg(F.max_by(f"{field}_ema", F.struct(*spec.order)).alias(f"{field}_ema"))


def percentile_windows(df: DataFrame, spec: SeriesSpec, field: str, p: float, width: str | int = 0, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank percentile in windows from the first row on; without a width, of the whole series."""
    timed = _since_first(df, spec, partition_by)
    w = duration(width)
    start = (F.col("_t") - F.pmod(F.col("_t") - F.col("_t0"), F.lit(w)) if w > 0 else F.col("_t0")).alias("_start")
    out = timed.groupBy(*partition_by, start).agg(percentile_rank(df, field, p).alias(f"{field}_p{p:.0f}"))
    return out.withColumn(spec.time, moment(F.col("_start"))).drop("_start")


def dedup_by_time(df: DataFrame, spec: SeriesSpec, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each time, by the series' order. An aggregate, so rows are reduced before the shuffle."""
    keys = list(dict.fromkeys((*partition_by, spec.time)))
    row = F.struct(*[c for c in df.columns if c not in keys])
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*spec.order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def latest_version(df: DataFrame, key: list[str], sequence: list[str], deleted: str | None = None) -> DataFrame:
    """The row with the highest sequence of each key; none where that one is marked deleted."""
    row = F.struct(*[c for c in df.columns if c not in key])
    out = df.groupBy(*key).agg(F.max_by(row, F.struct(*sequence)).alias("_row")).select(*key, "_row.*").select(*df.columns)
    return out.where(f"not coalesce({deleted}, false)") if deleted else out


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def merge_runs(runs: list[DataFrame], spec: SeriesSpec) -> DataFrame:
    """Sorted runs as one table in ranges of time, each partition sorted."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.repartitionByRange(*spec.order).sortWithinPartitions(*spec.order)
