"""Databases and collections as Spark catalog objects."""

from __future__ import annotations

from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import downsample_policy
from ..sources.store import retained
from ..spec import SeriesSpec

_ONE = {"ok": 1}


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Catalog:
    """Commands on a session's catalog; each returns a plain document, or a DataFrame of rows."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def ping(self) -> dict[str, Any]:
        return dict(_ONE)

    def hello(self) -> dict[str, Any]:
        return {"ismaster": True, **_ONE}

    def build_info(self) -> dict[str, Any]:
        return {"version": pyspark.__version__, **_ONE}

    def server_status(self) -> dict[str, Any]:
        context = self.spark.sparkContext
        return {"host": context.master, "process": context.appName, "startTime": context.startTime, **_ONE}

    def list_databases(self) -> DataFrame:
        return self.spark.sql("SHOW DATABASES").withColumnRenamed("namespace", "name")

    def use(self, name: str) -> dict[str, Any]:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quote(name)}")
        self.spark.sql(f"USE {_quote(name)}")
        return dict(_ONE)

    def create(self, name: str, schema: str, spec: SeriesSpec, options: dict[str, str] | None = None, expire: str = "30d", granularity: str = "1h") -> dict[str, Any]:
        """A Parquet collection whose series description and options are table properties.

        ``expire`` is how long rows stay when ``expire_rows`` runs, ``granularity`` the window that
        ``downsample`` takes.
        """
        properties = {"series.time": spec.time, "series.tags": ",".join(spec.tags), "series.fields": ",".join(spec.fields), "retention": expire, "granularity": granularity, **(options or {})}
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {_quote(name)} ({schema}) USING parquet TBLPROPERTIES ({listed})")
        return dict(_ONE)

    def options(self, name: str) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {_quote(name)}").collect()}

    def expire_rows(self, name: str, now: str | None = None) -> dict[str, Any]:
        """Drops the rows that are older than the collection's retention before ``now``, by default its latest time."""
        table, spec = self.spark.table(name), self.describe(name)
        before = table.count()
        kept = retained(table, spec, self.options(name)["retention"], None if now is None else F.lit(now).cast("timestamp_ntz"))
        staged = f"{name}__kept"
        self.spark.sql(f"DROP TABLE IF EXISTS {_quote(staged)}")
        kept.write.saveAsTable(staged)
        self.spark.table(staged).write.mode("overwrite").insertInto(name)
        left = self.spark.table(staged).count()
        self.spark.sql(f"DROP TABLE {_quote(staged)}")
        return {"removed": before - left, **_ONE}

    def downsample(self, name: str, aggregate: str = "avg") -> DataFrame:
        """Every field by the collection's granularity and its tags."""
        return downsample_policy(self.spark.table(name), self.describe(name), self.options(name)["granularity"], aggregate)

    def describe(self, name: str) -> SeriesSpec:
        found = self.options(name)
        split = lambda x: tuple(c for c in found.get(x, "").split(",") if c)
        return SeriesSpec(found["series.time"], split("series.tags"), split("series.fields"))

    def insert(self, name: str, rows: DataFrame) -> dict[str, Any]:
        rows.select(*self.spark.table(name).columns).write.insertInto(name)
        return dict(_ONE)

    def list_collections(self, name: str | None = None) -> DataFrame:
        out = self.spark.sql("SHOW TABLES").where("not isTemporary").selectExpr("tableName as name", "namespace as db")
        return out if name is None else out.where(out.name == name)

    def _stats(self, quoted: str) -> tuple[int, int]:
        self.spark.sql(f"ANALYZE TABLE {quoted} COMPUTE STATISTICS")
        rows = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {quoted}").collect()}
        size, _, count = rows.get("Statistics", "0 bytes, 0 rows").partition(" bytes")
        return int(size or 0), int("".join(c for c in count if c.isdigit()) or 0)

    def stats(self, name: str) -> dict[str, Any]:
        size, count = self._stats(_quote(name))
        return {"collection": name, "size": size, "objects": count, **_ONE}

    def database_stats(self, name: str | None = None, scale: float = 1) -> dict[str, Any]:
        """Numbers of collections and rows, and bytes over ``scale``, of a database."""
        name = name or self.spark.catalog.currentDatabase()
        listed = [r.tableName for r in self.spark.sql(f"SHOW TABLES IN {_quote(name)}").collect() if not r.isTemporary]
        each = [self._stats(f"{_quote(name)}.{_quote(t)}") for t in listed]
        return {"db": name, "collections": len(each), "objects": sum(n for _, n in each), "dataSize": sum(size for size, _ in each) / scale, **_ONE}

    def clear(self, name: str) -> dict[str, Any]:
        self.spark.sql(f"TRUNCATE TABLE {_quote(name)}")
        return {"cleared": True, **_ONE}

    def drop(self, name: str) -> dict[str, Any]:
        self.spark.sql(f"DROP TABLE IF EXISTS {_quote(name)}")
        return dict(_ONE)

    def drop_database(self, name: str) -> dict[str, Any]:
        self.spark.sql(f"DROP DATABASE IF EXISTS {_quote(name)} CASCADE")
        return dict(_ONE)
