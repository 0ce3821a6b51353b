"""Readers of what other jobs land as JSON lines: feed messages, external runs, the title index.

Files are read by splits, blank lines and lines that are not JSON objects are
passed over, and a folder that does not exist is empty.  Where a line stands is
taken at the scan, before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_fields as j
from .session_logs import loaded

_PLACE = "path string, changed_ms bigint, block bigint, line bigint, value string"


def _lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("lineSep", "\n")
    found = loaded(lambda: reader.text(folder))
    if found is None:
        return spark.createDataFrame([], _PLACE)
    return found.select(
        F.col("_metadata.file_path").alias("path"),
        F.unix_millis("_metadata.file_modification_time").alias("changed_ms"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.trim(F.rtrim(F.col("value"), F.lit("\r"))).alias("value"),
    ).filter("value <> ''")


def _number(name: str) -> Column:
    return F.col(name).try_cast("bigint")


def read_polls(spark: SparkSession, folder: str, files: str = "*.jsonl") -> DataFrame:
    """poll_id, msg_no, polled_at_ms and the JSON text ``value``, as ``parse_messages`` takes them.

    A line is either a message as it came, or an envelope of ``message`` with
    ``polled_at_ms``, and ``poll_id`` and ``msg_no`` where they are known.  The
    bare messages of a file are one poll in the order of its lines, seen when
    the file was last changed.  Polls are named so that they sort by time, then
    by name.
    """
    cells = ["message", "polled_at_ms", "poll_id", "msg_no"]
    parts = _lines(spark, folder, files).select("*", F.json_tuple("value", *cells).alias(*cells))
    wrapped = F.col("message").isNotNull() & _number("polled_at_ms").isNotNull()
    at = F.when(wrapped, _number("polled_at_ms")).otherwise(F.col("changed_ms"))
    name = F.coalesce(F.when(wrapped, F.col("poll_id")), F.col("path"))
    place = F.struct(F.when(wrapped, _number("msg_no")).alias("msg_no"), "path", "block", "line")
    return parts.select(
        F.concat(F.lpad(at.cast("string"), 15, "0"), F.lit(":"), name).alias("poll_id"),
        place.alias("msg_no"),
        at.alias("polled_at_ms"),
        F.when(wrapped, F.col("message")).otherwise(F.col("value")).alias("value"),
    )


def read_runs(spark: SparkSession, folder: str, files: str = "*.jsonl") -> DataFrame:
    """Runs of the independent recomputation, as ``external_usage`` and ``run_status`` take them.

    A line holds one run with its result in ``data``, as an object or as text.
    A line without scope or start names no run; one without a status failed.
    """
    cells = ["scope", "pricing_scheme", "speed", "started_at_ms", "finished_at_ms", "version", "status", "data"]
    parts = _lines(spark, folder, files).select(F.json_tuple("value", *cells).alias(*cells))
    return parts.filter(F.col("scope").isNotNull() & _number("started_at_ms").isNotNull()).select(
        "scope",
        "pricing_scheme",
        "speed",
        _number("started_at_ms").alias("started_at_ms"),
        _number("finished_at_ms").alias("finished_at_ms"),
        "version",
        F.coalesce("status", F.lit("failed")).alias("status"),
        "data",
    )


def read_title_index(spark: SparkSession, folder: str, files: str = "session_index.jsonl") -> DataFrame:
    """id, thread_name and the order of lines, of every title index under ``folder``, file by file.

    An id or name that is not a string is null.
    """
    parsed = _lines(spark, folder, files).withColumn("v", F.try_parse_json("value"))
    return parsed.filter("schema_of_variant(v) like 'OBJECT%'").select(
        F.expr(j.string(j.path("v", "id"))).alias("id"),
        F.expr(j.string(j.path("v", "thread_name"))).alias("thread_name"),
        F.struct("path", "block", "line").alias("line_no"),
    )
