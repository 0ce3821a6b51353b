"""Cut lineage by writing a table to the shared checkpoint folder, and remove it when it is done with.

A frozen table survives executor loss, is computed once however many branches
read it, and carries its true size, so Catalyst broadcasts it only when it is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.

Inside a ``scratch`` block every frozen table belongs to the block and goes when the
block ends; tables that are handed out are kept by ``keep``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
#: Generated methods under what HotSpot compiles; a longer one runs interpreted, row by row.
_COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}
#: Rows go to Python by 10,000, which may be any number of bytes; a batch lies in the JVM, on its way and in the worker.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: What a write shuffled goes when it ends; else it stays on disk until the driver collects its garbage.
_CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_SMALL = {"spark.sql.parquet.compression.codec": "zstd"}
#: Folders written inside the open scratch blocks, innermost last.
_open: list[dict[str, None]] = []
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    named = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder that the driver and every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="run-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/meterline/{app}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1][path] = None
    return path


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def freeze(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written.

    ``wide`` is for rows of many expressions, whose generated code HotSpot would not compile.
    Python functions inside get batches of bounded bytes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _settings(spark, _BATCHES | _CLEANED | _SMALL | (_COMPILED if wide else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freeze_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``freeze``, and the number of rows, counted while they are written."""
    seen = Observation()
    frozen = freeze(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return frozen, seen.get["rows"]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, what was frozen inside, also after an error.

    A frame that reads a table of the block must be written or collected inside
    it, or be handed out by ``keep``.
    """
    _open.append({})
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders frozen inside, for a caller that removes them later with ``delete``."""
    _open.append({})
    paths: list[str] = []
    try:
        yield paths
    finally:
        paths.extend(_open.pop())


def keep(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """Freeze ``df`` for the block around the innermost one (or for good, without one)."""
    inner = _open.pop() if _open else None
    try:
        return freeze(df, label, wide)
    finally:
        if inner is not None:
            _open.append(inner)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    found, system = _path(spark, path)
    system.delete(found, True)


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it does not exist."""
    found, system = _path(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(found)) if system.exists(found) else []


def modified_ms(spark: SparkSession, path: str) -> int:
    found, system = _path(spark, path)
    return system.getFileStatus(found).getModificationTime()
