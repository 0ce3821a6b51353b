"""Incremental ingest of session logs with the file source.

The file source takes each file once, so a growing log lands as numbered
chunks ``<name>.<n>.jsonl``.  What a log had carried by its last line is kept
as one row per log in a keyed store and put in front of its next chunk, so a batch
reads only new lines and the rows of its own logs.  Facts go into a keyed store
as well: a key seen again is merged, and a batch writes only what it changes.
Everything a batch writes lies under its batch id: a batch that runs again after a
failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import freeze, scratch
from ..functions.tokens import TOKEN_COLUMNS
from ..operators.lineage import enrich, parent_edges
from ..operators.replay import strip_replay
from ..schemas import SOURCE_JSONL
from ..sources import session_logs as logs
from ..sources.keyed_store import Changes, KeyedStore, first_row, latest_row
from ..sources.upserts import upsert_logs

_PLACE = ["path", "block", "line_no", "record_no"]
#: Place of a split in its log: length of the chunk number, its digits, offset in the chunk.
_BLOCK = "struct<size:int,digits:string,offset:bigint>"
_COUNTER = "struct<" + ",".join(f"{n}:bigint" for n in TOKEN_COLUMNS) + ">"
_STATE = (
    "path string, session_id string, lineage struct<parent:string,relation:string>, "
    "provider string, model string, effort string, tier struct<tier:string>, turn_id string, "
    f"counter {_COUNTER}, plan string, started_at_ms bigint"
)
_HEADERS = "path string, session_id string, parent_session_id string, forked_at_ms bigint"
#: Buckets of the three stores; fixed for a folder.  A bucket should stay below some hundred megabytes.
BUCKETS = 64
METADATA = "session_id string, title string, parent_session_id string, reasoning_effort string"


def context_store(spark: SparkSession, folder: str) -> KeyedStore:
    """What each log carries after its last line."""
    return KeyedStore(spark, f"{folder}/context", _STATE, "path", latest_row("path"), BUCKETS)


def header_store(spark: SparkSession, folder: str) -> KeyedStore:
    """Header of each log, from its first session line."""
    return KeyedStore(spark, f"{folder}/headers", _HEADERS, "path", first_row("path"), BUCKETS)


def fact_store(spark: SparkSession, folder: str) -> KeyedStore:
    """The log fact table by ``source_key``."""
    return KeyedStore(spark, f"{folder}/log_facts", SOURCE_JSONL, "source_key", upsert_logs, BUCKETS)


def read_log_stream(spark: SparkSession, root: str) -> DataFrame:
    """Lines of new log chunks with the file and split they come from."""
    return (
        spark.readStream.format("text")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jsonl")
        .option("lineSep", "\n")
        .load(root)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("offset"),
            "value",
        )
    )


def batch_lines(batch: DataFrame) -> DataFrame:
    """Order the lines of a batch within their log: by chunk, split and line."""
    # A longer number is greater; numbers of one length compare as text.
    digits = F.ltrim(F.regexp_extract("file", r"\.(\d+)\.jsonl$", 1), F.lit("0"))
    block = F.struct(F.length(digits).alias("size"), digits.alias("digits"), F.col("offset").cast("bigint").alias("offset"))
    return batch.withColumn("line_no", F.monotonically_increasing_id()).select(
        F.regexp_replace("file", r"\.\d+\.jsonl$", ".jsonl").alias("path"),
        F.lit("active").alias("state"),
        block.cast(_BLOCK).alias("block"),
        "line_no",
        F.rtrim(F.col("value"), F.lit("\r")).alias("value"),
    )


def _seed_rows(state: DataFrame, fields: DataFrame) -> DataFrame:
    """Two rows in front of a log's new lines that set everything it carried.

    The session comes first: a session that differs from the one before clears
    turn and counter, which the second row then sets.
    """
    types = {f.name: f.dataType for f in fields.schema}

    def shaped(known: dict) -> DataFrame:
        cells = [
            known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in types.items()
        ]
        return state.select(*cells)

    common = {
        "path": F.col("path"),
        "block": F.struct(F.lit(-1), F.lit(""), F.lit(-1)),
        "observed_at_ms": F.lit(0),
        "inner_type": F.lit("seed"),
        "is_task": F.lit(False),
    }
    first = shaped(
        {
            **common,
            "line_no": F.lit(0),
            "sid": F.col("session_id"),
            "own_lineage": F.col("lineage"),
            "provider_set": F.col("provider"),
            "model_set": F.col("model"),
            "effort_set": F.col("effort"),
            "tier_set": F.col("tier"),
            "is_context": F.lit(False),
        },
    )
    second = shaped(
        {
            **common,
            "line_no": F.lit(1),
            "turn_value": F.col("turn_id"),
            "is_context": F.lit(True),
            "cumulative": F.col("counter"),
            "seed": F.struct(F.col("plan"), F.col("started_at_ms")),
        },
    )
    return first.unionByName(second)


def _state_after(context: DataFrame) -> DataFrame:
    """What each log of the batch carries after its last line."""
    pos = F.struct(*logs.LINE)

    def counter():
        # A counter from before the last change of session does not count.
        changed = F.max(F.when(F.col("changed"), pos))
        last = F.max_by(
            F.struct(pos.alias("pos"), F.col("cumulative").alias("value")),
            F.when(F.col("cumulative").isNotNull(), pos),
        )
        return F.struct(changed.alias("changed"), last.alias("last"))

    names = ["session_id", "lineage", "provider", "model", "effort", "tier", "turn_id", "plan"]
    kept = F.col("c.changed").isNull() | (F.col("c.last.pos") >= F.col("c.changed"))
    return (
        context.groupBy("path")
        .agg(
            F.max_by(F.struct(*names, F.col("started.at").alias("started_at_ms")), pos).alias("s"),
            counter().alias("c"),
        )
        .select(
            "path",
            *[F.col(f"s.{n}").alias(n) for n in names if n != "plan"],
            F.when(kept, F.col("c.last.value")).alias("counter"),
            F.col("s.plan").alias("plan"),
            F.col("s.started_at_ms").alias("started_at_ms"),
        )
    )


def _extract(batch: DataFrame, batch_id: int, folder: str) -> DataFrame:
    """Store facts (by place), headers and carried state of new lines; return the facts."""
    spark = batch.sparkSession
    envelopes = logs.parse_envelope(freeze(batch_lines(batch), "stream-lines"))
    fields = freeze(logs.line_fields(envelopes), "stream-fields", wide=True)
    states = context_store(spark, folder)
    before = states.lookup(fields, batch_id)
    context = freeze(logs.carry_context(fields.unionByName(_seed_rows(before, fields))), "stream-context", wide=True)
    lines = context.filter("inner_type <> 'seed'")
    facts = (
        logs.session_facts(lines)
        .unionByName(logs.turn_facts(lines))
        .unionByName(logs.quota_facts(lines))
        .unionByName(logs.usage_facts(lines))
    )
    target = f"{folder}/facts/batch={batch_id}"
    facts.write.mode("overwrite").parquet(target)
    header_store(spark, folder).merge(freeze(logs.file_header(envelopes), "stream-headers"), ["path"], batch_id)
    states.merge(freeze(_state_after(context), "stream-state"), [], batch_id)
    return spark.read.schema(facts.schema).parquet(target)


def _without_replay(facts: DataFrame, headers: DataFrame, batch_id: int, folder: str) -> DataFrame:
    """The batch's facts without usage that a log copied from its parent.

    Only logs with a parent need their earlier events and those of the parent;
    other logs pass through.  What counts is what has arrived: a parent that lands
    after its child is taken into account from then on, and for all rows by ``settle``.
    """
    here = facts.select("path").distinct()
    forked = freeze(
        headers.filter("parent_session_id is not null").join(here, "path", "left_semi").select("path", "parent_session_id"),
        "stream-forked",
    )
    if forked.isEmpty():
        return facts
    parents = headers.join(
        forked.select(F.col("parent_session_id").alias("session_id")).distinct(), "session_id", "left_semi"
    ).select("path")
    wanted = forked.select("path").unionByName(parents).distinct()
    stored = facts.sparkSession.read.schema(facts.schema.add("batch", "bigint")).parquet(f"{folder}/facts")
    seen = stored.filter(F.col("batch") <= batch_id).join(wanted, "path", "left_semi")
    # Headers of the logs compared only: with others a path without events would stand for the parent.
    kept = strip_replay(freeze(seen.withColumn("here", F.col("batch") == batch_id).drop("batch"), "stream-seen"), headers)
    own = kept.filter("here").drop("here").join(forked.select("path"), "path", "left_semi")
    return facts.join(forked.select("path"), "path", "left_anti").unionByName(own.select(*facts.columns))


def ingest_batch(batch: DataFrame, batch_id: int, folder: str, metadata: DataFrame | None = None) -> Changes:
    """Store a batch of new lines and merge its facts into the fact table; return what changed.

    The frames returned read scratch tables: use them inside the ``scratch`` block around the call.
    """
    spark = batch.sparkSession
    if metadata is None:
        metadata = spark.createDataFrame([], METADATA)
    facts = _extract(batch, batch_id, folder)
    headers = freeze(header_store(spark, folder).read(batch_id + 1), "stream-known")
    kept = freeze(_without_replay(facts, headers, batch_id, folder), "stream-kept")
    full = freeze(enrich(kept, metadata, _edges(metadata, headers)), "stream-full")
    return fact_store(spark, folder).merge(full, _PLACE, batch_id)


def _edges(metadata: DataFrame, headers: DataFrame) -> DataFrame:
    known = metadata.select("session_id", "parent_session_id").filter("parent_session_id is not null")
    return freeze(parent_edges(known, headers), "edges")


def start_ingest(
    spark: SparkSession,
    root: str,
    folder: str,
    on_batch: Callable[[int, Changes], None] | None = None,
    metadata: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Run the ingest.  ``trigger`` is as for ``writeStream.trigger``.

    The usual cadence is ``processingTime="5 minutes"``; ``availableNow=True``
    catches up and stops.  ``on_batch`` runs after a batch is stored, with what
    it changed: ``recompute`` brings the rollups up to date from it.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            changes = ingest_batch(batch, batch_id, folder, metadata)
            if on_batch is not None:
                on_batch(batch_id, changes)

    return (
        read_log_stream(spark, root)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All facts ingested so far by place, and the header of each log."""
    return spark.read.parquet(f"{folder}/facts").drop("batch"), header_store(spark, folder).read()


def settle(facts: DataFrame, headers: DataFrame, metadata: DataFrame) -> DataFrame:
    """The log fact table from all facts: replays removed, ancestry filled in, keys merged."""
    kept = strip_replay(facts, headers)
    return upsert_logs(None, enrich(kept, metadata, _edges(metadata, headers)), _PLACE)
