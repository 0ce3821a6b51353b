"""Reset windows in event order, with rows held until the watermark passes them.

Quota observations arrive in any order inside the watermark's delay.  A row waits
in the state of its group in the slot of its first sighting, with an event-time timer
at the slot's end.  When the watermark passes it no row of the slot can come, so the
group's walk takes its rows in order, and what it emits is what a batch over all rows gives.
A group has a timer and a few state values per slot, however many rows that holds.

A group's state is its open window (one row) and the rows of the last ``delay`` and slot.
A row older than the watermark is dropped by Spark; the touched windows are then
rebuilt from stored facts (``recompute``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..fixed_values import (
    INFERRED_DROP_PERCENT,
    INFERRED_MAX_NEW_PERCENT,
    INFERRED_MIN_GAP_MS,
    INFERRED_MIN_PREVIOUS_PERCENT,
    RESET_DROP_PERCENT,
    RESET_JITTER_MS,
)
from ..operators.windows import group_key

OUTPUT = (
    "window_id string, quota_group string, ordinal bigint, account_key string, limit_id string, window_kind string, "
    "window_start_ms bigint, resets_at_ms bigint, window_minutes bigint, plan_type string, "
    "inferred_after_gap boolean, closed boolean, version bigint"
)
_OPEN = (
    "ordinal bigint, account_key string, limit_id string, window_kind string, window_start_ms bigint, resets_at_ms bigint, "
    "window_minutes bigint, plan_type string, inferred_after_gap boolean, peak double, "
    "reset_so_far bigint, last_source string, last_seen bigint, version bigint"
)
_NAMES = [part.split()[0] for part in _OPEN.split(", ")]
_TAKEN = [
    "last_seen_at_ms", "priority", "source_key", "account_key", "limit_id", "window_kind",
    "used_percent", "window_minutes", "resets_at_ms", "plan_type", "source",
]
_WAITING = ["first_seen_at_ms", *_TAKEN]
#: Length of a slot: what a row waits at most beyond the watermark's delay.
SLOT_MS = 600_000
#: Rows of a batch that a task holds before it puts them into state.
HELD = 200_000


def _largest(left, right):
    return right if left is None else left if right is None else max(left, right)


def resets(state: dict, seen: int, row: dict) -> tuple[bool, bool]:
    """Whether this observation shows an explicit reset, and whether one is inferred after a gap."""
    percent, reset, peak = row["used_percent"], row["resets_at_ms"], state["peak"]
    if percent is None or peak is None:
        return False, False
    if state["reset_so_far"] is not None and reset is not None:
        fell = percent + RESET_DROP_PERCENT < peak
        return fell and reset - state["reset_so_far"] > RESET_JITTER_MS, False
    logged = state["last_source"] == row["source"] == "jsonl"
    quiet = seen - state["last_seen"] >= INFERRED_MIN_GAP_MS
    emptied = (
        peak >= INFERRED_MIN_PREVIOUS_PERCENT
        and percent <= INFERRED_MAX_NEW_PERCENT
        and peak - percent >= INFERRED_DROP_PERCENT
    )
    return False, logged and quiet and emptied


def advance(state: dict | None, seen: int, row: dict) -> tuple[dict, dict | None]:
    """The group's window after one more observation, and the window that it closes."""
    explicit, inferred = resets(state, seen, row) if state else (False, False)
    closed = None
    if state is None or explicit or inferred:
        if state is not None:
            end = seen if state["window_start_ms"] < seen else state["resets_at_ms"]
            after_gap = state["inferred_after_gap"] or inferred
            closed = {**state, "resets_at_ms": end, "inferred_after_gap": after_gap, "version": state["version"] + 1}
        now = {
            "ordinal": 0 if state is None else state["ordinal"] + 1,
            "limit_id": row["limit_id"],
            "window_kind": row["window_kind"],
            "window_start_ms": seen,
            "inferred_after_gap": inferred,
            **dict.fromkeys(["account_key", "resets_at_ms", "window_minutes", "plan_type", "peak"]),
            "reset_so_far": state["reset_so_far"] if state else None,
            "version": 0,
        }
    else:
        now = {**state, "version": state["version"] + 1}
    for name in ("account_key", "plan_type"):
        now[name] = row[name] if now[name] is None else now[name]
    now["window_minutes"] = now["window_minutes"] if row["window_minutes"] is None else row["window_minutes"]
    now["resets_at_ms"] = _largest(now["resets_at_ms"], row["resets_at_ms"])
    now["peak"] = _largest(now["peak"], row["used_percent"])
    now["reset_so_far"] = _largest(now["reset_so_far"], row["resets_at_ms"])
    now["last_source"], now["last_seen"] = row["source"], seen
    return now, closed


def distinct_rows(rows: list[dict]) -> list[dict]:
    """Rows of one instant in order; of rows that differ in their key only the least key stays."""
    least: dict[tuple, dict] = {}
    for row in rows:
        rest = tuple(row[n] for n in _TAKEN if n != "source_key")
        if rest not in least or row["source_key"] < least[rest]["source_key"]:
            least[rest] = row
    return sorted(least.values(), key=lambda r: (r["last_seen_at_ms"], r["priority"], r["source_key"]))


class ResetWindows(StatefulProcessor):
    """State of one group: rows that wait, by slot, and the open window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A slot's rows lie in numbered parts, so more rows of a slot rewrite none.
        self.waiting = handle.getMapState("waiting", "slot bigint, part int", "rows string")
        self.parts = handle.getMapState("parts", "slot bigint", "n int")
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        slots: dict[int, list[str]] = {}
        held, pick = 0, None
        for row in rows:
            pick = pick or itemgetter(*map(row.__fields__.index, _WAITING))
            taken = pick(tuple(row))
            if taken[0] is None:
                continue  # a row without a time has no place in the order
            slots.setdefault(taken[0] // SLOT_MS, []).append(json.dumps(taken, default=float))
            held += 1
            if held == HELD:
                self._put(slots)
                slots, held = {}, 0
        self._put(slots)
        return iter(())

    def _put(self, slots: dict[int, list[str]]) -> None:
        for slot, rows in slots.items():
            part = self.parts.getValue((slot,))[0] if self.parts.containsKey((slot,)) else 0
            if not part:
                self.handle.registerTimer((slot + 1) * SLOT_MS - 1)
            self.waiting.updateValue((slot, part), ("[" + ",".join(rows) + "]",))
            self.parts.updateValue((slot,), (part + 1,))

    def _take(self, slot: int) -> dict[int, list[dict]]:
        """The rows of a slot by their time, which leave the state."""
        found: dict[int, list[dict]] = {}
        for part in range(self.parts.getValue((slot,))[0]):
            for seen, *values in json.loads(self.waiting.getValue((slot, part))[0]):
                row = dict(zip(_TAKEN, values, strict=True))
                row["used_percent"] = None if row["used_percent"] is None else float(row["used_percent"])
                found.setdefault(seen, []).append(row)
            self.waiting.removeKey((slot, part))
        self.parts.removeKey((slot,))
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Timers of a group expire in the order of their times.
        slot = expiredTimerInfo.getExpiryTimeInMs() // SLOT_MS
        if not self.parts.containsKey((slot,)):
            return
        state = dict(zip(_NAMES, self.open.get(), strict=True)) if self.open.exists() else None
        for seen, rows in sorted(self._take(slot).items()):
            for row in distinct_rows(rows):
                state, closed = advance(state, seen, row)
                if closed is not None:
                    yield self._row(key[0], closed, True)
        self.open.update(tuple(state[n] for n in _NAMES))
        yield self._row(key[0], state, False)

    @staticmethod
    def _row(group: str, s: dict, closed: bool) -> Row:
        return Row(
            window_id=f"window:{group}:{s['ordinal']}",
            quota_group=group,
            **{n: s[n] for n in _NAMES[:9]},
            closed=closed,
            version=s["version"],
        )

    def close(self) -> None:
        pass


def reset_window_stream(quota: DataFrame, delay: str) -> DataFrame:
    """Reset windows as the watermark moves: a row for each slot that changes a window, and one when it closes.

    ``delay`` is how late a row may come.  The row of a window with the greatest
    ``version`` is its latest.  The stream needs the RocksDB state store.
    """
    keyed = quota.withColumns({"quota_group": group_key(), "event_time": F.timestamp_millis("first_seen_at_ms")})
    return (
        keyed.withWatermark("event_time", delay)
        .select("quota_group", "event_time", "first_seen_at_ms", *_TAKEN)
        .groupBy("quota_group")
        .transformWithState(ResetWindows(), OUTPUT, "Update", "EventTime")
    )


def latest_windows(changes: DataFrame) -> DataFrame:
    """The latest row of each window, from all rows that the stream has emitted."""
    names = [c for c in changes.columns if c != "window_id"]
    return changes.groupBy("window_id").agg(
        F.max_by(F.struct(*names), F.col("version")).alias("_last")
    ).select("window_id", "_last.*")
