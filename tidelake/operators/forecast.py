"""Short-horizon forecasts: regression line, mean, simple exponential smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accumulators import number
from ..functions.clock import micros, moment
from ..spec import SeriesSpec, duration
from .series import _smoothing, ema

_HOUR = 3_600_000_000
#: Times are taken since 2020, so that their squares keep their digits.
_SINCE = 1_577_836_800_000_000


def forecast(df: DataFrame, spec: SeriesSpec, field: str, method: str = "linear", horizon: int = 10, interval: str | int = 0, history: int = 0, alpha: float = 0.2, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``horizon`` rows after the end of each series, with the tags of its last row and _forecast = "true".

    Rows are ``interval`` apart, by default the series' mean spacing (an hour for one row). The line
    is fitted to the last ``history`` values (0: all) and read at steps of the history's own mean
    spacing. All of it is one aggregate with a partial step (and a sort where ``history`` is given),
    then ``horizon`` rows for each series.
    """
    horizon = horizon if horizon > 0 else 10
    keys = list(partition_by)
    rows = df.select(*dict.fromkeys((*keys, *spec.tags, *spec.order)), micros(F.col(spec.time)).alias("_t"), number(df, field).alias("_v")).where("_v is not null")
    tags = [t for t in spec.tags if t not in keys]
    order = F.struct(*spec.order)
    used = F.col("_used")
    if history > 0:
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in spec.order])
        rows = rows.withColumn("_used", F.row_number().over(back) <= history)
    else:
        rows = rows.withColumn("_used", F.lit(True))
    # the line goes through the means, so one pass with times since a fixed moment gives all of it
    t, x, v = F.when(used, F.col("_t")), F.when(used, (F.col("_t") - _SINCE) / 1e6), F.when(used, F.col("_v"))
    out = rows.groupBy(*keys).agg(
        F.min("_t").alias("_t0"), F.max("_t").alias("_tn"), F.count("*").alias("_n"), *[F.max_by(c, order).alias(c) for c in tags],
        F.regr_slope(v, x).alias("_slope"), F.avg(v).alias("_mean"), F.avg(x).alias("_xmean"), ((F.max(t) - F.min(t)) / 1e6).alias("_xn"), ((F.max(t) - _SINCE) / 1e6).alias("_end"), F.count(v).alias("_hn"), F.max_by("_v", order).alias("_last"),
    )
    out = out.where("_n > 0")
    if method == "ses":
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or F.lit(True)
        smooth = ema(rows.where("_used").withColumnRenamed("_v", field), spec, field, _smoothing(alpha), partition_by).groupBy(*keys).agg(F.max_by(f"{field}_ema", order).alias("_level"))
        out = out.alias("a").join(smooth.alias("b"), on).select("a.*", "b._level")
    step = F.lit(duration(interval)) if duration(interval) > 0 else F.when(F.col("_n") > 1, F.expr("(_tn - _t0) div (_n - 1)")).otherwise(F.lit(_HOUR))
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_step", step)
    line = F.when(F.col("_hn") < 2, F.col("_last")).otherwise(F.col("_slope") * (F.col("_end") - F.col("_xmean") + F.col("_i") * F.col("_xn") / (F.col("_hn") - 1)) + F.col("_mean"))
    value = {"average": F.col("_mean"), "ses": F.col("_level") if method == "ses" else None}.get(method, line)
    return out.select(*keys, *tags, moment(F.col("_tn") + F.col("_i") * F.col("_step")).alias(spec.time), value.alias(field), F.lit("true").alias("_forecast"))
