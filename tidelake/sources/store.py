"""Stored series: scans, inserts, daily partitions, retention, tiers and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.clock import micros, parse_time
from ..functions.filters import between
from ..spec import SeriesSpec, duration

DAY = "dt"


def scan(df: DataFrame, spec: SeriesSpec, start: str | None = None, end: str | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """Rows of a time range, both bounds included, and of given tag values.

    The comparisons reach the Parquet scan. A table partitioned by day is cut by its partitions too.
    """
    bound = lambda x: None if x is None else F.lit(x).cast("timestamp_ntz")
    out = df.where(between(spec.time, bound(start), bound(end)))
    if DAY in df.columns:
        day = lambda x: None if x is None else F.date_format(F.lit(x).cast("timestamp_ntz"), "yyyyMMdd")
        out = out.where(between(DAY, day(start), day(end)))
    for tag, value in (tags or {}).items():
        out = out.where(F.col(tag) == value)
    return out


def point(df: DataFrame, spec: SeriesSpec, at: str | Column) -> DataFrame:
    """All rows of one time."""
    return df.where(F.col(spec.time) == (F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at))


def documents(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Points as {timestamp, tags, fields...}; rows without tags have null tags."""
    tags = F.map_filter(F.create_map(*[x for t in spec.tags for x in (F.lit(t), F.col(t).cast("string"))]), lambda _, v: v.isNotNull())
    return df.select(F.col(spec.time).alias("timestamp"), F.when(F.size(tags) > 0, tags).alias("tags"), *spec.fields)


def dump(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Every point as a line of JSON; fields and tags that it lacks are left out."""
    return documents(df, spec).select(F.to_json(F.struct("timestamp", "tags", *spec.fields)).alias("value"))


def tag_key(spec: SeriesSpec) -> Column:
    """A stable text of all tags: name=value, sorted by name."""
    pairs = [F.concat(F.lit(f"{t}="), F.col(t).cast("string")) for t in sorted(spec.tags)]
    return F.array_join(F.array(*pairs), ",")


def from_documents(df: DataFrame, time: str = "timestamp", spec: SeriesSpec | None = None) -> DataFrame:
    """Documents as rows: a time in text becomes a time, and with ``spec`` each of its tags a column of text.

    Unreadable times give null. ``tags`` is a map or a struct; a tag that a document lacks is null.
    """
    out = df.withColumn(time, parse_time(F.col(time).cast("string")))
    if spec is None:
        return out
    held = df.schema["tags"].dataType if "tags" in df.columns else None
    known = held.fieldNames() if isinstance(held, StructType) else None
    tag = lambda t: F.lit(None) if held is None or known is not None and t not in known else F.col("tags")[t]
    return out.select(F.col(time).alias(spec.time), *[tag(t).cast("string").alias(t) for t in spec.tags], *[F.col(f) for f in spec.fields], *[F.col(c) for c in spec.tiebreak])


#: Writers that a day's rows are dealt over.
WRITERS = 4


def insert(df: DataFrame, path: str, spec: SeriesSpec, writers: int = WRITERS) -> None:
    """Appends rows, one folder for each day, dealt by day and a hash so that a hot day has several writers, and few files."""
    dated = df.withColumn(DAY, F.date_format(spec.time, "yyyyMMdd"))
    dealt = dated.repartition(DAY, F.pmod(F.xxhash64(*spec.order), F.lit(writers)))
    dealt.write.mode("append").partitionBy(DAY).parquet(path)


def insert_documents(df: DataFrame, path: str, spec: SeriesSpec, time: str = "timestamp") -> int:
    """Parses, flattens and appends documents; returns how many had no readable time and were left out."""
    rows = from_documents(df, time, spec)
    insert(rows.where(F.col(spec.time).isNotNull()), path, spec)
    return rows.where(F.col(spec.time).isNull()).count()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn(DAY, F.col(DAY).cast("string"))


def clear(spark: SparkSession, path: str) -> None:
    """Keeps the schema, drops the rows."""
    spark.read.parquet(path).limit(0).write.mode("overwrite").parquet(path + "-empty")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(as_path(path), True)
    fs.rename(as_path(path + "-empty"), as_path(path))


def retained(df: DataFrame, spec: SeriesSpec, keep: str | int, now: Column | None = None) -> DataFrame:
    """Rows not older than ``keep`` before ``now``, by default the latest time in the table."""
    if now is None:
        now = F.lit(df.agg(F.max(spec.time)).first()[0]).cast("timestamp_ntz")
    return df.where(F.col(spec.time) >= now - F.expr(f"make_dt_interval(0, 0, 0, {duration(keep)} / 1000000.0)"))


def days(spark: SparkSession, path: str) -> list[str]:
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    return sorted(s.getPath().getName().removeprefix(f"{DAY}=") for s in fs.listStatus(base) if s.getPath().getName().startswith(f"{DAY}="))


def _drop_days(spark: SparkSession, path: str, days: list[str]) -> None:
    for day in days:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY}={day}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def purge(spark: SparkSession, path: str, before_day: str) -> list[str]:
    """Drops whole days before ``before_day`` (yyyyMMdd); no file is read."""
    old = [d for d in days(spark, path) if d < before_day]
    _drop_days(spark, path, old)
    return old


_STAGED, _LEAVING = "_staged", "_leaving"


def _finish(spark: SparkSession, hot: str, cold: str) -> None:
    """Ends what an interrupted ``migrate`` began: days that left the hot tier are put into the cold one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = lambda path: hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in days(spark, f"{hot}/{_LEAVING}"):
        staged, there = f"{cold}/{_STAGED}/{DAY}={day}", f"{cold}/{DAY}={day}"
        if fs(cold).exists(hadoop(staged)):
            fs(cold).mkdirs(hadoop(there))
            for file in fs(cold).listStatus(hadoop(staged)):
                fs(cold).rename(file.getPath(), hadoop(f"{there}/{file.getPath().getName()}"))
            fs(cold).delete(hadoop(staged), True)
        fs(hot).delete(hadoop(f"{hot}/{_LEAVING}/{DAY}={day}"), True)


def migrate(spark: SparkSession, hot: str, cold: str, before_day: str, codec: str = "gzip") -> list[str]:
    """Moves days before ``before_day`` to another tier under another codec, and drops them from the first.

    Copies are staged out of readers' sight; then each day leaves the hot tier by one rename, and only
    then are its files renamed into place. A run that was interrupted is ended by the next one, so no
    row is lost or doubled.
    """
    _finish(spark, hot, cold)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(hot).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [d for d in days(spark, hot) if d < before_day]
    if old:
        read(spark, hot).where(F.col(DAY).isin(old)).write.mode("overwrite").option("compression", codec).partitionBy(DAY).parquet(f"{cold}/{_STAGED}")
        fs.mkdirs(hadoop(f"{hot}/{_LEAVING}"))
        for day in old:
            fs.rename(hadoop(f"{hot}/{DAY}={day}"), hadoop(f"{hot}/{_LEAVING}/{DAY}={day}"))
        _finish(spark, hot, cold)
    return old


def _settle(spark: SparkSession, path: str) -> None:
    """Ends what an interrupted ``rewrite`` began: days that were set aside are replaced, or else put back."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in days(spark, f"{path}/{_LEAVING}"):
        there, staged, old = (hadoop(f"{path}/{x}{DAY}={day}") for x in ("", f"{_STAGED}/", f"{_LEAVING}/"))
        if not fs.exists(there) and fs.exists(staged):
            fs.rename(staged, there)
        elif not fs.exists(there) and not fs.exists(hadoop(f"{path}/{_STAGED}/_SUCCESS")):
            fs.rename(old, there)
        fs.delete(old, True)
    fs.delete(hadoop(f"{path}/{_STAGED}"), True)


def rewrite(spark: SparkSession, path: str, spec: SeriesSpec, where: Column, values: dict[str, Column] | None = None) -> list[str]:
    """Updates the rows that match (``values`` by column), or deletes them (no ``values``); returns the days rewritten.

    Only days with a match are read in full and written anew, out of readers' sight; then the days'
    folders are set aside by renames and the new ones, of days with rows left, renamed into their place.
    """
    if values and spec.time in values:
        raise ValueError("a row's time can't be updated: delete it and insert another")
    _settle(spark, path)
    table = read(spark, path)
    found = sorted(r[0] for r in table.where(where).select(DAY).distinct().collect())
    if not found:
        return found
    hit = F.coalesce(where, F.lit(False))
    rows = table.where(F.col(DAY).isin(found))
    rows = rows.where(~hit) if values is None else rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
    rows.write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/{_STAGED}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(f"{path}/{_LEAVING}"))
    for day in found:
        fs.rename(hadoop(f"{path}/{DAY}={day}"), hadoop(f"{path}/{_LEAVING}/{DAY}={day}"))
    _settle(spark, path)
    return found


def ordered(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows by time, and by the tiebreak among equal times: the order in which scans of a store give them."""
    return df.orderBy(*spec.order)


def read_tiers(spark: SparkSession, *tiers: str) -> DataFrame:
    """All tiers as one table; predicates and partition cuts reach each."""
    tables = [read(spark, t) for t in tiers if days(spark, t)]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def compact(spark: SparkSession, path: str, to: str, spec: SeriesSpec, files_per_day: int = 1) -> None:
    """Rewrites small files as few for each day, sorted by time so that row groups can be skipped."""
    salt = F.pmod(F.xxhash64(*spec.order), F.lit(files_per_day))
    table = read(spark, path)
    table.repartition(DAY, salt).sortWithinPartitions(*spec.order).write.mode("overwrite").partitionBy(DAY).parquet(to)


def block_statistics(df: DataFrame, spec: SeriesSpec, field: str) -> DataFrame:
    """By day: rows, and smallest and largest value, as block headers would hold them."""
    return df.groupBy(F.date_format(spec.time, "yyyyMMdd").alias(DAY)).agg(F.count("*").alias("n"), F.min(field).alias("low"), F.max(field).alias("high"), F.min(micros(F.col(spec.time))).alias("first_us"))
