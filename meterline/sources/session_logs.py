"""Session logs: from JSON lines to session, turn, usage and quota facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import json_fields as j
from ..functions.accounts import normalize_tier
from ..functions.ordered import CHUNK, Running, ordered_scan
from ..functions.storage import freeze
from ..functions.timeline import day_start_ms, local_date, rfc3339_ms
from ..functions.tokens import (
    TOKEN_COLUMNS,
    counter_reset,
    normalized,
    observed,
    struct_fields,
    token_diff,
    token_struct,
)
from ..schemas import SOURCE_JSONL, column_names

# Line types that carry facts.
CONTEXT_TYPES = ["session_meta", "turn_context"]
NESTED_TYPES = [
    "token_count",
    "task_started",
    "task_complete",
    "task_aborted",
    "turn_aborted",
    "thread_settings_applied",
]
TASK_TYPES = ["task_started", "task_complete", "task_aborted", "turn_aborted"]
TASK_END_TYPES = ["task_complete", "task_aborted", "turn_aborted"]
ABORT_TYPES = ["task_aborted", "turn_aborted"]

LINE = ["block", "line_no"]
# Plan and turn start that a file had when its lines were last read.
SEED_TYPE = "struct<plan:string,started_at_ms:bigint>"
_LINE_SCHEMA = "path string, state string, block bigint, line_no bigint, value string"


def _roots(active: str, archived: str) -> tuple[tuple[str, str], ...]:
    return (active, "active"), (archived, "archived")


def _reader(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")


def loaded(load: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``load`` reads; None where its folder does not exist."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_logs(spark: SparkSession, active: str, archived: str, changed_after_ms: int | None = None) -> DataFrame:
    """Lines of every ``*.jsonl`` file under the two roots; a missing root is empty.

    ``block`` is the offset of the file split, at most
    ``spark.sql.files.maxPartitionBytes`` long, and ``line_no`` orders the
    lines of a split; both are taken at the scan, before any shuffle.
    Files not changed after ``changed_after_ms`` are left out before they are opened.
    """
    found = spark.createDataFrame([], _LINE_SCHEMA)
    for root, state in _roots(active, archived):
        reader = _reader(spark).option("lineSep", "\n")
        if changed_after_ms is not None:
            # The option counts whole seconds.
            after = dt.datetime.fromtimestamp(changed_after_ms // 1000 - 1, dt.timezone.utc)
            reader = reader.option("modifiedAfter", after.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
        lines = loaded(partial(reader.text, root))
        if lines is None:
            continue
        found = found.unionByName(
            lines.select(
                F.col("_metadata.file_path").alias("path"),
                F.lit(state).alias("state"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line_no"),
                F.rtrim(F.col("value"), F.lit("\r")).alias("value"),
            )
        )
    return found


def list_logs(spark: SparkSession, active: str, archived: str) -> DataFrame:
    """Path, state, modification time and size of every log file, without reading one.

    Spark's file sources pass over files without a byte; they count once they have a line.
    """
    found = spark.createDataFrame([], "path string, state string, modified_ms bigint, size bigint")
    for root, state in _roots(active, archived):
        files = loaded(partial(_reader(spark).format("binaryFile").load, root))
        if files is not None:
            found = found.unionByName(
                files.select(
                    "path", F.lit(state).alias("state"), F.unix_millis("modificationTime").alias("modified_ms"), F.col("length").alias("size")
                )
            )
    return found


@dataclass(frozen=True)
class Scan:
    """Log files, those that changed, and the lines of these; lines are counted as they are read."""

    files: DataFrame
    changed: DataFrame
    lines: DataFrame
    seen: Observation

    def report(self) -> dict[str, int]:
        """Figures of the scan; waits until the lines have been read."""
        return {
            "files_scanned": self.files.count(),
            "files_changed": self.changed.count(),
            # Spark reports nothing for a scan that it knows to be empty.
            "complete_lines": self.seen.get.get("lines", 0),
        }


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that ``known`` (path, modified_ms, size) does not hold as they are."""
    return files.join(known.select("path", "modified_ms", "size").distinct(), ["path", "modified_ms", "size"], "left_anti")


def scan_changed(spark: SparkSession, active: str, archived: str, known: DataFrame | None = None) -> Scan:
    """Lines of the files that are new or have another time or size than in ``known``.

    Store ``files`` with the facts and give it as ``known`` to the next scan.
    """
    files = freeze(list_logs(spark, active, archived), "log-files")
    changed = files if known is None else freeze(changed_files(files, known), "log-changed")
    oldest = changed.agg(F.min("modified_ms")).first()[0]
    lines = scan_logs(spark, active, archived, oldest)
    seen = Observation()
    read = lines.join(changed.select("path"), "path", "left_semi").select(*lines.columns)
    return Scan(files, changed, read.observe(seen, F.count(F.lit(1)).alias("lines")), seen)


def prefilter(lines: DataFrame) -> DataFrame:
    """Drop lines that cannot carry a fact, before any JSON is parsed."""
    def of_type(*names: str) -> Column:
        return reduce(or_, [F.col("value").contains(f'"type":"{name}"') for name in names])

    return lines.filter(of_type(*CONTEXT_TYPES) | (of_type("event_msg") & of_type(*NESTED_TYPES)))


def _parent(payload: str) -> str:
    found = j.first_of(
        payload,
        "forked_from_id",
        "parent_thread_id",
        "source.subagent.thread_spawn.parent_thread_id",
    )
    return f"nullif({j.string(found)}, '')"


def parse_envelope(lines: DataFrame) -> DataFrame:
    """Parse each kept line once; a line that is not JSON is dropped."""
    parsed = j.settled(prefilter(lines).select("path", *LINE, "value"), "v", F.try_parse_json("value")).filter("v is not null")
    fields = parsed.select(
        "path",
        *LINE,
        "v",
        F.expr(j.path("v", "payload")).alias("p"),
        F.expr(j.path("v", "type")).alias("_type"),
        F.expr(j.path("v", "timestamp")).alias("_time"),
    )
    typed = fields.select(
        "path",
        *LINE,
        "v",
        "p",
        F.expr(j.path("p", "type")).alias("_inner"),
        F.expr(f"coalesce({j.string('_type')}, '')").alias("event_type"),
        F.expr(j.string("_time")).alias("_time"),
    )
    timed = j.settled(typed, "observed_at_ms", rfc3339_ms(F.col("_time")))
    return timed.select(
        "path",
        *LINE,
        "v",
        "p",
        "event_type",
        "observed_at_ms",
        F.expr(f"if(event_type = 'event_msg', coalesce({j.string('_inner')}, ''), event_type)").alias("inner_type"),
    )


def file_header(envelopes: DataFrame) -> DataFrame:
    """Session, parent and fork time of the first session line of each file."""
    session = f"nullif({j.string(j.first_of('p', 'id', 'session_id'))}, '')"
    header = F.struct(
        F.expr(session).alias("session_id"),
        F.expr(_parent("p")).alias("parent_session_id"),
        F.col("observed_at_ms").alias("forked_at_ms"),
    )
    return (
        envelopes.filter("event_type = 'session_meta'")
        .groupBy("path")
        .agg(F.min_by(header, F.struct(*LINE)).alias("h"))
        .select("path", "h.*")
    )


def prune_files(
    files: DataFrame, headers: DataFrame, from_date: str, tracked: DataFrame | None = None
) -> DataFrame:
    """Files that may hold facts from a date on.

    ``files`` has path and modified_ms.  A file stays when it is tracked, when
    its session date (header, else first date in the path) or its modification
    time reaches the date, or when neither is known.
    """
    dates = F.regexp_extract_all("path", F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    valid = F.filter(dates, lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull())
    session_date = F.coalesce(
        local_date(F.col("forked_at_ms")), F.try_element_at(valid, F.lit(1))
    )
    kept = (
        F.coalesce(session_date >= from_date, F.lit(False))
        | F.when(F.col("modified_ms").isNull(), session_date.isNull()).otherwise(
            F.col("modified_ms") >= day_start_ms(F.lit(from_date))
        )
        | F.coalesce("_tracked", F.lit(False))
    )
    if tracked is None:
        marked = files.withColumn("_tracked", F.lit(False))
    else:
        flags = tracked.select("path").distinct().withColumn("_tracked", F.lit(True))
        marked = files.join(flags, "path", "left")
    return marked.join(headers, "path", "left").filter(kept).select(*files.columns)


def filter_from(records: DataFrame, from_date: str) -> DataFrame:
    """Records at or after the +08:00 midnight of a date."""
    return records.filter(F.col("observed_at_ms") >= day_start_ms(F.lit(from_date)))


def default_from_date(now_ms: int) -> str:
    """The local date 29 days before ``now_ms``."""
    local = dt.datetime.fromtimestamp(now_ms / 1000, dt.timezone(dt.timedelta(hours=8)))
    return (local.date() - dt.timedelta(days=29)).isoformat()


# --- fields of one line ----------------------------------------------------


def _with_tokens(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Per name the normalized token struct of a JSON object; null when every count is zero.

    Each step reads the columns of the one before, so that a key is looked up once.
    """
    found = rows.withColumns(
        {f"_{name}_{n}": F.expr(e) for name, value in values.items() for n, e in j.token_values(value).items()}
    )
    counts = {name: {n: f"_{name}_{n}" for n in TOKEN_COLUMNS} for name in values}
    cells = [c for of_name in counts.values() for c in of_name.values()]
    whole = found.withColumns({c: F.expr(j.integer(c)) for c in cells})
    normal = whole.withColumns(
        {c: value for of_name in counts.values()
         for c, value in zip(of_name.values(), normalized({n: F.col(c) for n, c in of_name.items()}).values())}
    )
    tokens = {name: {n: F.col(c) for n, c in of_name.items()} for name, of_name in counts.items()}
    return normal.withColumns(
        {name: F.when(F.col(value).isNotNull() & observed(tokens[name]), token_struct(tokens[name])) for name, value in values.items()}
    ).drop(*cells)


def line_fields(envelopes: DataFrame) -> DataFrame:
    """Pull every field the facts need out of the line, and nothing else."""
    inner = F.col("inner_type")
    is_session = F.col("event_type") == "session_meta"
    is_context = inner == "turn_context"
    is_settings = inner == "thread_settings_applied"
    is_task = inner.isin(*TASK_TYPES)
    is_count = inner == "token_count"
    settings = j.path("p", "thread_settings")
    tier_value = F.when(is_context, F.expr(j.first_of("p", "service_tier", "serviceTier"))).when(
        is_settings, F.expr(j.path(settings, "service_tier"))
    )
    fork = F.expr(j.string(j.path("p", "forked_from_id")))
    thread_parent = F.expr(
        f"coalesce({j.string(j.path('p', 'parent_thread_id'))}, "
        f"{j.string(j.path('p', 'source.subagent.thread_spawn.parent_thread_id'))})"
    )
    relation = (
        F.when(fork.isNotNull(), F.lit("fork"))
        .when(thread_parent.isNotNull(), F.lit("child"))
        .otherwise(F.lit("main"))
    )
    picked = envelopes.filter("observed_at_ms is not null").select(
        "path",
        *LINE,
        "observed_at_ms",
        "inner_type",
        F.when(is_session, F.expr(j.string(j.first_of("p", "id", "session_id")))).alias("sid"),
        F.when(is_session, F.struct(F.expr(_parent("p")).alias("parent"), relation.alias("relation")))
        .alias("own_lineage"),
        F.when(is_session, F.expr(j.string(j.path("p", "title")))).alias("title"),
        F.when(is_session, F.expr(j.string(j.path("p", "model_provider"))))
        .when(is_settings, F.expr(j.string(j.path(settings, "model_provider_id"))))
        .alias("provider_set"),
        F.when(is_context, F.expr(j.nested_string("p", "model")))
        .when(is_settings, F.expr(j.string(j.path(settings, "model"))))
        .alias("model_set"),
        F.when(is_context, F.expr(j.effort("p")))
        .when(is_settings, F.expr(j.effort(settings)))
        .alias("effort_set"),
        tier_value.alias("tier_value"),
        F.when(
            is_context | is_task, F.expr(j.string(j.first_of("p", "turn_id", "turnId")))
        ).alias("turn_value"),
        is_context.alias("is_context"),
        is_task.alias("is_task"),
        F.when(
            inner == "task_started", F.expr(j.epoch_ms(j.first_of("p", "started_at", "startedAt")))
        ).alias("task_started_at"),
        F.when(
            inner.isin(*TASK_END_TYPES),
            F.coalesce(
                F.expr(
                    j.epoch_ms(
                        j.first_of("p", "completed_at", "completedAt", "aborted_at", "abortedAt")
                    )
                ),
                F.col("observed_at_ms"),
            ),
        ).alias("task_ended_at"),
        F.when(is_count, F.expr(j.path("p", "info.last_token_usage"))).alias("last_value"),
        F.when(is_count, F.expr(j.path("p", "info.total_token_usage"))).alias("total_value"),
        F.when(
            is_count,
            F.expr(f"coalesce({j.path('v', 'rate_limits')}, {j.path('p', 'rate_limits')})"),
        ).alias("limits"),
    )

    windows = F.array(*[_limit_window(kind) for kind in ("primary", "secondary")])
    return _with_tokens(picked, {"last_usage": "last_value", "cumulative": "total_value"}).select(
        *[c for c in picked.columns if c not in ("tier_value", "last_value", "total_value", "limits")],
        F.when(
            F.col("tier_value").isNotNull(),
            F.struct(normalize_tier(F.expr(j.string("tier_value"))).alias("tier")),
        ).alias("tier_set"),
        "last_usage",
        "cumulative",
        F.expr(j.string(j.first_of("limits", "plan_type", "plan_type_raw"))).alias("limits_plan"),
        F.when(
            F.expr("schema_of_variant(limits) like 'OBJECT%'"),
            F.struct(
                F.expr(j.string(j.first_of("limits", "limit_id", "limitId"))).alias("limit_id"),
                F.filter(windows, lambda w: w.isNotNull()).alias("windows"),
            ),
        ).alias("quota"),
        F.lit(None).cast(SEED_TYPE).alias("seed"),
    )


def _limit_window(kind: str) -> Column:
    """One quota window of a line; null when it has neither percent nor reset."""
    value = j.path("limits", kind)
    used = j.double(j.first_of(value, "used_percent", "usedPercent"))
    reset = j.epoch_ms(j.first_of(value, "resets_at_ms", "resetsAt", "resets_at"))
    return F.expr(
        f"if(({used}) is null and ({reset}) is null, null, named_struct("
        f"'window_kind', '{kind}', 'used_percent', {used}, "
        f"'window_minutes', {j.integer(j.first_of(value, 'window_minutes', 'windowMinutes'))}, "
        f"'resets_at_ms', {reset}))"
    )


# --- carried state ---------------------------------------------------------


def usage_delta(last: Column, cumulative: Column, previous: Column) -> tuple[Column, Column]:
    """Token struct that a snapshot adds, and its quality.

    The last usage counts when the counter is absent or has moved; else the
    difference to the previous counter, or the counter itself after a reset.
    """
    moved = cumulative.isNull() | ~cumulative.eqNullSafe(previous)
    reset = F.coalesce(
        cumulative.isNotNull() & previous.isNotNull() & counter_reset(cumulative, previous),
        F.lit(False),
    )
    reported = last.isNotNull() & moved
    derived = F.when(previous.isNull() | reset, cumulative).otherwise(
        token_diff(cumulative, previous)
    )
    tokens = F.when(reported, last).when(cumulative.isNotNull(), derived)
    note = (
        F.when(reported, F.when(reset, F.lit("counter_reset")))
        .when(
            cumulative.isNotNull(),
            F.when(reset, F.lit("derived_from_cumulative,counter_reset")).otherwise(
                F.lit("derived_from_cumulative")
            ),
        )
    )
    return tokens, note


#: Fields of a line that nothing reads once they are carried.
_CARRIED = [
    "own_lineage", "provider_set", "model_set", "effort_set", "tier_set", "turn_value", "is_context", "task_started_at", "seed",
]


def _after(position: Column, change: Column) -> Column:
    return change.isNull() | (position > change)


def carry_context(fields: DataFrame) -> DataFrame:
    """Carry session, turn, model, tier, plan and counter along the lines of each file.

    Chunks are the file splits, so one huge file is scanned by many tasks.
    """
    pos = F.struct(*LINE)
    has_turn = F.col("is_context") | (F.col("is_task") & F.col("turn_value").isNotNull())
    own_turn = F.when(has_turn, F.struct(pos.alias("pos"), F.col("turn_value").alias("id")))
    own_counter = F.when(
        F.col("cumulative").isNotNull(), F.struct(pos.alias("pos"), F.col("cumulative").alias("value"))
    )
    has_session = F.col("sid").isNotNull()
    chunked = fields.withColumn(CHUNK, F.col("block"))
    first = ordered_scan(
        chunked,
        ["path"],
        LINE,
        [
            Running("session_before", "last", F.col("sid"), before=True),
            Running("lineage", "last", F.when(has_session, F.col("own_lineage"))),
            Running(
                "provider",
                "last",
                F.when(has_session | (F.col("inner_type") != "session_meta"), F.col("provider_set")),
            ),
            Running("model", "last", F.col("model_set")),
            Running("effort", "last", F.col("effort_set")),
            Running("tier", "last", F.col("tier_set")),
            Running("turn_before", "last", own_turn, before=True),
            Running("counter_before", "last", own_counter, before=True),
        ],
    )
    changed = has_session & ~F.col("sid").eqNullSafe(F.col("session_before"))
    second = ordered_scan(
        first.withColumn("changed", changed),
        ["path"],
        LINE,
        [Running("change_pos", "last", F.when(F.col("changed"), pos))],
    )
    turn_before = F.when(
        _after(F.col("turn_before.pos"), F.col("change_pos")), F.col("turn_before.id")
    )
    previous = F.when(
        _after(F.col("counter_before.pos"), F.col("change_pos")), F.col("counter_before.value")
    )
    tokens, note = usage_delta(F.col("last_usage"), F.col("cumulative"), previous)
    placed = (
        second.withColumns(
            {
                "session_id": F.coalesce("sid", "session_before"),
                "carried_turn": turn_before,
                "added": tokens,
                "note": note,
            }
        )
        .withColumns(
            {
                "turn_id": F.when(F.col("is_context"), F.col("turn_value")).otherwise(
                    F.coalesce(F.when(F.col("is_task"), F.col("turn_value")), F.col("carried_turn"))
                ),
                "normal": F.when(
                    F.col("added").isNotNull(),
                    token_struct(normalized(struct_fields(F.col("added")))),
                ),
            }
        )
        .withColumn("counts", F.coalesce(observed(struct_fields(F.col("normal"))), F.lit(False)))
    )
    task = F.col("is_task") & F.col("turn_id").isNotNull()
    other_turn = ~F.col("turn_id").eqNullSafe(F.col("carried_turn"))
    started_set = (
        F.when(F.col("seed").isNotNull(), F.struct(F.col("seed.started_at_ms").alias("at")))
        .when(
            task & (F.col("inner_type") == "task_started"),
            F.struct(F.coalesce("task_started_at", "observed_at_ms").alias("at")),
        )
        .when(
            F.col("changed") | (task & other_turn),
            F.struct(F.lit(None).cast("bigint").alias("at")),
        )
    )
    frozen = freeze(
        placed.withColumns(
            {
                "started_set": started_set,
                "plan_set": F.coalesce(
                    F.col("seed.plan"), F.when(F.col("counts"), F.col("limits_plan"))
                ),
            }
        ).drop(*_CARRIED, "session_before", "turn_before", "counter_before", "carried_turn", "change_pos", "added"),
        "log-context",
        wide=True,
    )
    carried = ordered_scan(
        frozen,
        ["path"],
        LINE,
        [
            Running("started", "last", F.col("started_set")),
            Running("plan", "last", F.col("plan_set")),
        ],
    )
    return carried.drop("started_set", "plan_set", CHUNK)


# --- facts -----------------------------------------------------------------


def digest(fields: dict[str, Column]) -> Column:
    """Hash of a state, null fields included."""
    state = F.struct(*[c.alias(n) for n, c in fields.items()])
    return F.sha2(F.to_json(state, {"ignoreNullFields": "false"}), 256)


_PLACE = ["path", "block", "line_no", "record_no"]


def _facts(df: DataFrame, record_no, kind: str, columns: dict[str, Column]) -> DataFrame:
    """Shape rows as the log fact table, with the place they come from."""
    filled = {"kind": F.lit(kind), "observed_at_ms": F.col("observed_at_ms"), **columns}
    cells = []
    for part in SOURCE_JSONL.split(", "):
        name, type_name = part.split()
        cells.append(filled.get(name, F.lit(None)).cast(type_name).alias(name))
    return df.select("path", *LINE, F.lit(record_no).alias("record_no"), *cells)


def _context_columns() -> dict[str, Column]:
    return {
        "session_id": F.col("session_id"),
        "parent_session_id": F.col("lineage.parent"),
        "root_session_id": F.col("lineage.parent"),
        "relation": F.col("lineage.relation"),
        "reasoning_effort": F.col("effort"),
        "provider": F.col("provider"),
        "plan_type": F.col("plan"),
    }


def session_facts(context: DataFrame) -> DataFrame:
    return _facts(
        context.filter("sid is not null"),
        0,
        "session",
        {
            **_context_columns(),
            "source_key": F.concat(F.lit("session:"), "sid"),
            "title": F.col("title"),
            "quality": F.lit("session_meta"),
        },
    )


def turn_facts(context: DataFrame) -> DataFrame:
    aborted = F.col("inner_type").isin(*ABORT_TYPES)
    return _facts(
        context.filter("is_task and turn_id is not null"),
        1,
        "turn",
        {
            **_context_columns(),
            "source_key": F.concat_ws(
                ":", F.lit("turn"), F.coalesce("session_id", F.lit("unknown")), "turn_id"
            ),
            "turn_id": F.col("turn_id"),
            "started_at_ms": F.coalesce("started.at", "observed_at_ms"),
            "ended_at_ms": F.col("task_ended_at"),
            "model": F.col("model"),
            "service_tier": F.col("tier.tier"),
            "quality": F.when(aborted, F.lit("aborted")),
        },
    )


def quota_facts(context: DataFrame) -> DataFrame:
    """Quota windows of the lines that add tokens."""
    rows = context.filter("counts and quota is not null").select(
        "*", F.posexplode("quota.windows").alias("window_no", "w")
    )
    plan = F.coalesce("limits_plan", "plan")
    state = {
        "limit_id": F.col("quota.limit_id"),
        "window_kind": F.col("w.window_kind"),
        "used_percent": F.col("w.used_percent"),
        "window_minutes": F.col("w.window_minutes"),
        "resets_at_ms": F.col("w.resets_at_ms"),
        "plan_type": plan,
    }
    return _facts(
        rows,
        2,
        "quota",
        {
            **state,
            "source_key": F.concat(F.lit("quota:"), digest(state)),
            "last_seen_at_ms": F.col("observed_at_ms"),
            "provider": F.col("provider"),
            "quality": F.lit("jsonl"),
        },
    ).withColumn(
        "record_no", F.when(F.col("window_kind") == "primary", F.lit(2)).otherwise(F.lit(3))
    )


def usage_facts(context: DataFrame) -> DataFrame:
    """Token increments; a snapshot with a total only is not an increment."""
    parts = [F.col(f"normal.{n}") for n in TOKEN_COLUMNS if n != "total_tokens"]
    some = parts[0] != 0
    for part in parts[1:]:
        some = some | (part != 0)
    state = {
        "session_id": F.col("session_id"),
        "turn_id": F.col("turn_id"),
        "model": F.col("model"),
        "tier": F.col("tier.tier"),
        "reasoning_effort": F.col("effort"),
        "plan": F.col("plan"),
        "last": F.col("last_usage"),
        "cumulative": F.col("cumulative"),
        "observed_at_ms": F.when(F.col("cumulative").isNull(), F.col("observed_at_ms")),
    }
    return _facts(
        context.filter("counts").filter(some),
        4,
        "usage",
        {
            **_context_columns(),
            "source_key": F.concat(F.lit("usage:"), digest(state)),
            "turn_id": F.col("turn_id"),
            "model": F.col("model"),
            "service_tier": F.col("tier.tier"),
            "quality": F.col("note"),
            **{n: F.col(f"normal.{n}") for n in TOKEN_COLUMNS},
        },
    )


def extract_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fact rows of all kinds with their place, and the file headers."""
    envelopes = parse_envelope(lines)
    headers = freeze(file_header(envelopes), "log-headers")
    context = freeze(
        carry_context(freeze(line_fields(envelopes), "log-fields", wide=True)), "log-carried", wide=True
    )
    facts = (
        session_facts(context)
        .unionByName(turn_facts(context))
        .unionByName(quota_facts(context))
        .unionByName(usage_facts(context))
    )
    return facts, headers


def without_place(records: DataFrame) -> DataFrame:
    return records.select(*column_names(SOURCE_JSONL))


def session_metadata(index: DataFrame, threads: DataFrame | None, edges: DataFrame | None):
    """Title, effort and parent per session from the local index and thread tables.

    The first non-empty title of the index wins, then the thread's title.
    """
    def filled(name: str) -> Column:
        return F.nullif(F.trim(name), F.lit(""))

    titles = (
        index.filter("id is not null")
        .groupBy(F.col("id").alias("session_id"))
        .agg(
            F.min_by(
                filled("thread_name"), F.when(filled("thread_name").isNotNull(), F.col("line_no"))
            ).alias("index_title")
        )
    )
    spark = index.sparkSession
    if threads is None:
        threads = spark.createDataFrame([], "id string, title string, reasoning_effort string")
    if edges is None:
        edges = spark.createDataFrame([], "parent_thread_id string, child_thread_id string")
    thread_rows = threads.filter("id is not null").select(
        F.col("id").alias("session_id"),
        filled("title").alias("thread_title"),
        filled("reasoning_effort").alias("reasoning_effort"),
    )
    parents = (
        edges.filter("parent_thread_id is not null and child_thread_id is not null")
        .groupBy(F.col("child_thread_id").alias("session_id"))
        .agg(F.max("parent_thread_id").alias("parent_session_id"))
    )
    return (
        titles.join(thread_rows, "session_id", "full")
        .join(parents, "session_id", "full")
        .select(
            "session_id",
            F.coalesce("index_title", "thread_title").alias("title"),
            "parent_session_id",
            "reasoning_effort",
        )
    )
