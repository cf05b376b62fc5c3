"""Ranges of time in which an ordered series is worked on in parallel, and what a range needs from its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..spec import SeriesSpec

#: Ranges are told apart by an expression with as many branches.
MOST = 256


def n_ranges(df: DataFrame, partition_by: tuple[str, ...], ranges: int | None) -> int:
    """As many as asked for; by default one for each key, and one a shuffle partition without keys."""
    if ranges is None:
        ranges = 1 if partition_by else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(ranges, MOST))


def ranged(df: DataFrame, spec: SeriesSpec, ranges: int) -> DataFrame:
    """Adds _r, the number of a row's range of time. Rows of one time share a range.

    Borders are approximate quantiles from one pass over the time column, run when the plan is made.
    """
    if ranges == 1:
        return df.withColumn("_r", F.lit(0))
    t = micros(F.col(spec.time))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(t, shares, 100 * ranges)).first()[0]
    borders = sorted(set(found or []))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("_t_r") < borders[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    return df.withColumn("_t_r", t).withColumn("_r", place(0, len(borders))).drop("_t_r")


def _equal(a: str, b: str, keys: list[str]) -> Column | list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def following(df: DataFrame, spec: SeriesSpec, values: list[str], partition_by: tuple[str, ...] = (), ranges: int = 1) -> DataFrame:
    """Adds _next_<value> for each of ``values``: that of the next row in its series. ``df`` has _r."""
    keys = list(partition_by)
    inside = Window.partitionBy(*keys, "_r").orderBy(*spec.order)
    out = df.withColumns({f"_next_{c}": F.lead(c).over(inside) for c in values})
    if ranges == 1:
        return out
    heads = df.groupBy(*keys, "_r").agg(F.min_by(F.struct(*values), F.struct(*spec.order)).alias("_head"))
    after = heads.select(*keys, "_r", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_r")).alias("_after"))
    after = after if keys else F.broadcast(after)  # without keys a row for each of at most MOST ranges
    out = out.withColumn("_last", F.lead(F.lit(False), 1, True).over(inside))
    out = out.alias("a").join(after.alias("b"), _equal("a", "b", [*keys, "_r"]), "left").select("a.*", "_after")
    return out.withColumns({f"_next_{c}": F.when(F.col("_last"), F.col(f"_after.{c}")).otherwise(F.col(f"_next_{c}")) for c in values}).drop("_last", "_after")


def with_halo(df: DataFrame, spec: SeriesSpec, rows: int, partition_by: tuple[str, ...] = (), ranges: int = 1) -> DataFrame:
    """``df``, which has _r, with _halo = false, and for each range the ``rows`` rows before it with _halo = true.

    The last rows of the ranges, ``rows`` each at most, are numbered in their series; each range takes
    those with the numbers below its own first. Only they are ordered in one task for each key.
    """
    own = df.withColumn("_halo", F.lit(False))
    if ranges == 1:
        return own
    keys = list(partition_by)
    back = Window.partitionBy(*keys, "_r").orderBy(*[F.col(c).desc() for c in spec.order])
    tails = df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= rows).drop("_back")
    tails = tails.withColumn("_g", F.row_number().over(Window.partitionBy(*keys).orderBy(*spec.order)))
    wants = tails.groupBy(*keys, "_r").agg((F.min("_g") - 1).alias("_s")).where("_s > 0")
    wants = wants.select(*keys, F.col("_r").alias("_to"), F.explode(F.sequence(F.greatest(F.col("_s") - rows + 1, F.lit(1)), F.col("_s"))).alias("_g"))
    halo = tails.alias("a").join(wants.alias("b"), _equal("a", "b", [*keys, "_g"])).select(*[F.col(f"a.{c}") for c in df.columns if c != "_r"], F.col("b._to").alias("_r"), F.lit(True).alias("_halo"))
    return own.unionByName(halo)
