"""Publish the usage tables together."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.storage import children, delete, modified_ms
from ..schemas import checked

# Sort columns that make Parquet row groups prunable by the report's filters.
_SORT = {
    "usage_daily": ["local_date"],
    "usage_minute": ["local_date", "minute_start_ms", "window_id"],
    "usage_window": ["window_start_ms", "window_id"],
    "usage_session": ["local_date", "started_at_ms", "row_key"],
}
_PARTITION = {"usage_minute": ["local_date"], "usage_session": ["local_date"]}
#: A version that was never published is taken for a dead job's after a day.
_DEAD_AFTER_MS = 86_400_000
_POINTER_SCHEMA = "version string, published_ns bigint, schemas map<string,string>"


def replace_rollups(tables: dict[str, DataFrame], root: str, keep: int = 2) -> str:
    """Write all tables under a new version, then publish it with one small file.

    Readers take the last published version, so they see either all old or
    all new tables, and a job that dies halfway publishes nothing.  Once the
    pointer has moved, all but the last ``keep`` versions go: with two, a reader
    that began before the move can end.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    schemas = {name: table.schema.json() for name, table in tables.items()}
    for name, table in tables.items():
        keys = _PARTITION.get(name)
        rows = checked(table, name)
        if keys:
            rows = rows.repartition(*keys, *[c for c in _SORT[name] if c not in keys][:1])
        writer = rows.sortWithinPartitions(*_SORT[name]).write
        if keys:
            writer = writer.partitionBy(*keys)
        writer.parquet(f"{root}/versions/{version}/{name}")
    pointer = spark.createDataFrame([(version, time.time_ns(), schemas)], _POINTER_SCHEMA)
    pointer.coalesce(1).write.mode("append").json(f"{root}/published")
    retain(spark, root, keep)
    return version


def retain(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Remove published versions but the last ``keep``, and what dead jobs left; return what was removed."""
    published = spark.read.schema(_POINTER_SCHEMA).json(f"{root}/published")
    latest = published.groupBy("version").agg(F.max("published_ns").alias("at")).orderBy(F.desc("at"))
    known = [r.version for r in latest.collect()]  # one row per rebuild since the pointers were last rewritten
    now, removed = time.time_ns() // 1_000_000, []
    for name in children(spark, f"{root}/versions"):
        path = f"{root}/versions/{name}"
        dead = name not in known and now - modified_ms(spark, path) > _DEAD_AFTER_MS
        if dead or name in known[max(keep, 1) :]:
            delete(spark, path)
            removed.append(name)
    return removed


def read_rollups(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four tables of the published version."""
    published = spark.read.schema(_POINTER_SCHEMA).json(f"{root}/published")
    last = published.agg(
        F.max_by(F.struct("version", "schemas"), "published_ns").alias("p")
    ).first().p
    return {
        name: spark.read.schema(StructType.fromJson(json.loads(schema)))
        .parquet(f"{root}/versions/{last.version}/{name}")
        for name, schema in last.schemas.items()
    }


# Canonical orders, for reading a table in its published order.
TABLE_ORDER = {
    "source_jsonl": ["observed_at_ms", "source_key"],
    "source_app_server": ["last_seen_at_ms", "source_key"],
    "source_ccusage": ["run_at_ms", "source_key"],
    "usage_daily": ["local_date"],
    "usage_minute": ["minute_start_ms", "bucket_key"],
    "usage_window": ["window_start_ms", "window_id"],
    "usage_session": ["local_date", "started_at_ms", "row_key"],
    "capacities": ["profile_code"],
}


def in_table_order(df: DataFrame, table: str) -> DataFrame:
    return df.orderBy(*TABLE_ORDER[table])
