"""Policy downsampling and upkeep of tiers as streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.accumulators import accumulate
from ..functions.clock import moment
from ..sources import store
from ..spec import SeriesSpec, duration


def downsample_stream(stream: DataFrame, spec: SeriesSpec, width: str, name: str = "avg", lag: str = "1 hour", by: tuple[str, ...] | None = None) -> DataFrame:
    """Windows aligned to 1970 by tags, each given once, when the watermark ``lag`` behind the latest time has passed it.

    State is one row for each open window and set of tags. Windows that begin at a series' first row
    have no streaming form, as that row can't be known to be the first.
    """
    keys = spec.tags if by is None else by
    zoned = stream.withColumn(spec.time, F.col(spec.time).cast("timestamp")).withWatermark(spec.time, lag)
    slot = F.window(spec.time, f"{duration(width)} microseconds")
    out = zoned.groupBy(slot, *keys).agg(*[accumulate(zoned, f, name, spec).alias(f"{f}_{name}") for f in spec.fields])
    return out.select(*keys, moment(F.unix_micros("window.start")).alias(spec.time), *[f"{f}_{name}" for f in spec.fields])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what the source holds now to Parquet, and stops; a later run goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def maintain(stream: DataFrame, spec: SeriesSpec, hot: str, cold: str, checkpoint: str, hot_days: int, keep_days: int) -> StreamingQuery:
    """Appends what the source holds now to the hot tier, then moves and purges whole days; meant to run periodically.

    Days are counted back from the latest day stored. A later run goes on from the checkpoint; a batch
    that is repeated after a failure replaces its own rows.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if store.days(spark, hot):
            store.rewrite(spark, hot, spec, F.col("_batch") == number)
        store.insert(batch.withColumn("_batch", F.lit(number).cast("long")), hot, spec)

    query = stream.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if found := store.days(spark, hot):  # only now, as a batch that is repeated looks for its rows in the hot tier
        latest = dt.datetime.strptime(found[-1], "%Y%m%d")
        day = lambda back: (latest - dt.timedelta(days=back)).strftime("%Y%m%d")
        store.migrate(spark, hot, cold, day(hot_days - 1))
        store.purge(spark, cold, day(keep_days - 1))
    return query
