"""Streams must settle to what the batch operators give on the same input."""

import random
import time

import pytest
from pyspark.sql import functions as F

from meterline import adapters
from meterline.operators.windows import group_key, reset_windows
from meterline.sources import session_logs as logs
from meterline.sources.upserts import upsert_logs
from meterline.streaming import ingest, live
from meterline.streaming import reset_windows as reset_windows_live


def run(df, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(
        availableNow=True
    ).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture
def usage_stream(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "usage")
    usage = adapters.usage_raw(spark, sf_dir)
    usage.repartition(3).write.parquet(folder)
    return spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_minute_totals_equal_batch(spark, sf_dir, usage_stream):
    live_rows = run(live.minute_totals(usage_stream, "40 days"), "complete", "minute_totals")
    batch = (
        adapters.usage_raw(spark, sf_dir)
        .groupBy((F.col("observed_at_ms") - F.col("observed_at_ms") % 60000).alias("m"))
        .agg(F.sum("total_tokens").alias("t"))
    )
    assert {(r.minute_start_ms, r.total_tokens) for r in live_rows.collect()} == {
        (r.m, r.t) for r in batch.collect()
    }


def test_dedupe_keeps_each_key_once(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "twice")
    usage = adapters.usage_raw(spark, sf_dir)
    usage.unionByName(usage).repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = run(live.dedupe_stream(stream, "40 days"), "append", "dedupe_stream")
    assert kept.count() == usage.count()
    assert kept.select("source_key").distinct().count() == usage.count()


def _windows(rows):
    names = [c for c in RESET_COLUMNS if c not in ("closed", "version")]
    return {tuple(r[c] for c in names) for r in rows}


def _stream_windows(spark, tmp_path, parts, delay):
    """Latest windows of a stream that reads the parts one after another, then two rows far ahead."""
    folder = str(tmp_path / "quota")
    schema = parts[0].schema
    # The rows far ahead belong to a group of their own and move the watermark past all others.
    ahead = parts[0].limit(1).withColumns({
        "account_key": F.lit("ahead"), "source_key": F.lit("ahead"), "first_seen_at_ms": F.lit(4_000_000_000_000), "last_seen_at_ms": F.lit(4_000_000_000_000),
    })
    for part in [*parts, ahead, ahead.withColumn("first_seen_at_ms", F.lit(4_000_000_000_001))]:
        part.select(*schema.names).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # the file source takes files by their time in seconds
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"reset_{abs(hash(str(tmp_path)))}"
    rows = run(reset_windows_live.reset_window_stream(stream, delay), "update", name)
    return reset_windows_live.latest_windows(rows).filter("quota_group not like 'ahead%'")


RESET_COLUMNS = ["window_id", "account_key", "limit_id", "window_kind", "window_start_ms", "resets_at_ms", "window_minutes",
                 "plan_type", "inferred_after_gap", "ordinal", "quota_group"]


def test_reset_windows_of_shuffled_parts_equal_batch(spark, sf_dir, tmp_path):
    quota = adapters.quota_raw(spark, sf_dir).persist()
    parts = quota.randomSplit([1.0, 1.0, 1.0], seed=5)
    live_rows = _stream_windows(spark, tmp_path, parts, "400 days").collect()
    batch = reset_windows(quota).collect()
    assert _windows(live_rows) == _windows(batch) and len(live_rows) == len(batch) > 5


def test_reset_windows_close_while_the_stream_runs(spark, sf_dir, tmp_path):
    """Parts in order with some rows an hour late: windows before the watermark are out before the end."""
    quota = adapters.quota_raw(spark, sf_dir).persist()
    late = F.crc32("source_key") % 5 == 0
    seen = F.col("first_seen_at_ms")
    bounds = quota.agg(F.min(seen).alias("a"), F.max(seen).alias("b")).first()
    step = (bounds.b - bounds.a) // 3 + 1
    part = F.floor((seen + F.when(late, 3_600_000).otherwise(0) - bounds.a) / step)
    parts = [quota.filter(part == k) for k in range(4) if not quota.filter(part == k).isEmpty()]
    live_rows = _stream_windows(spark, tmp_path, parts, "2 hours").collect()
    assert _windows(live_rows) == _windows(reset_windows(quota).collect())
    assert any(r.closed for r in live_rows)


def test_reset_windows_wait_by_slot(monkeypatch):
    """A group's state calls and timers follow its slots, not its rows, also when rows come in several parts."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    monkeypatch.setattr(reset_windows_live, "HELD", 300)
    calls, timers = [], []

    class Values(dict):
        def getValue(self, key):
            calls.append(key)
            return self[key]

        def updateValue(self, key, value):
            calls.append(key)
            self[key] = value

        containsKey = dict.__contains__
        removeKey = dict.__delitem__

    class One:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    handle = SimpleNamespace(getMapState=lambda *_: Values(), getValueState=lambda *_: One(), registerTimer=timers.append)
    walk = reset_windows_live.ResetWindows()
    walk.init(handle)
    names = ["quota_group", "first_seen_at_ms", *reset_windows_live._TAKEN]
    made, base = Row(*names), 1_784_044_800_000
    percent = [min(k // 20, 90) if k < 1900 else 5 for k in range(2000)]
    rows = [
        made("g", base + k * 1000, base + k * 1000, 1, f"k{k}", "a", "codex", "primary", float(percent[k]), 10_080, base + (1 if k < 1900 else 2) * 604_800_000, "plus", "jsonl")
        for k in range(2000)
    ]
    rows.append(made("g", None, *rows[0][2:]))
    random.Random(3).shuffle(rows)
    list(walk.handleInputRows(("g",), iter(rows[:900]), None))
    list(walk.handleInputRows(("g",), iter(rows[900:]), None))
    slots = {r.first_seen_at_ms // reset_windows_live.SLOT_MS for r in rows if r.first_seen_at_ms is not None}
    assert len(timers) == len(slots) == 4
    out = []
    for at in sorted(timers):
        out += walk.handleExpiredTimer(("g",), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
    assert len(calls) < 150 and not walk.waiting and not walk.parts
    last = {r.window_id: r for r in sorted(out, key=lambda r: r.version)}
    found = [(r.window_start_ms, r.resets_at_ms, r.closed, r.version) for _, r in sorted(last.items())]
    assert found == [
        (base, base + 1_900_000, True, 1900),
        (base + 1_900_000, base + 2 * 604_800_000, False, 99),
    ]


def test_reset_walk_as_batch_on_random_rows(spark):
    """The stream's step and the batch's fold agree on ties, nulls, gaps and equal rows."""
    draw = random.Random(11)
    rows, at = [], 1_780_000_000_000
    for k in range(400):
        at += draw.choice([0, 0, 1_000, 60_000, 1_900_000, 9_000_000])
        source = draw.choice(["jsonl", "jsonl", "app_server"])
        rows.append((f"k{k % 390}", at, at + draw.choice([0, 5]), draw.choice(["a", None]), draw.choice(["codex", None]), "primary",
                     draw.choice([None, 0.0, 10.0, 45.0, 60.0, 97.0]), draw.choice([None, 300, 10_080]), draw.choice([None, at + 500_000, at + 900_000]),
                     draw.choice([None, "plus"]), source, 2 if source == "app_server" else 1))
    schema = ("source_key string, first_seen_at_ms bigint, last_seen_at_ms bigint, account_key string, limit_id string, window_kind string, "
              "used_percent double, window_minutes bigint, resets_at_ms bigint, plan_type string, source string, priority int")
    quota = spark.createDataFrame(rows, schema)
    groups = {}
    for r in quota.withColumn("g", group_key()).collect():
        groups.setdefault(r.g, {}).setdefault(r.first_seen_at_ms, []).append(r.asDict())
    expected = set()
    for group, times in groups.items():
        state, done = None, []
        for seen in sorted(times):
            for row in reset_windows_live.distinct_rows(times[seen]):
                state, closed = reset_windows_live.advance(state, seen, row)
                done += [closed] if closed else []
        for s in [*done, state]:
            expected.add(tuple({**s, "window_id": f"window:{group}:{s['ordinal']}", "quota_group": group}[c] for c in RESET_COLUMNS))
    got = reset_windows(quota)
    assert _windows(got.collect()) == expected and len(expected) > 15
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()


def test_ingest_in_chunks_equals_one_batch(spark, sf_dir, tmp_path, monkeypatch):
    """Logs cut into chunks at odd places give the facts of the whole logs."""
    monkeypatch.setattr(ingest, "BUCKETS", 4)
    lines = adapters.log_lines(spark, sf_dir)
    texts = {}
    for r in lines.orderBy("path", "block", "line_no").collect():
        texts.setdefault(r.path, []).append(r.value)
    root, folder = tmp_path / "logs", tmp_path / "state"
    root.mkdir()
    for step in range(3):
        for path, values in texts.items():
            third = len(values) // 3 + 1
            part = values[step * third : (step + 1) * third]
            if part:
                name = path.replace(".jsonl", f".{step + 1}.jsonl")
                (root / name).write_text("\n".join(part) + "\n", encoding="utf-8")
        query = ingest.start_ingest(spark, str(root), str(folder))
        query.awaitTermination(300)
        assert query.exception() is None
    stored, headers = ingest.stored_facts(spark, str(folder))
    whole, whole_headers = logs.extract_events(lines)
    compared = [c for c in logs.without_place(whole).columns]
    left = sorted(map(str, stored.select(*compared).collect()))
    right = sorted(map(str, whole.select(*compared).collect()))
    assert left == right
    assert headers.count() == whole_headers.count()
    metadata = spark.createDataFrame(
        [], "session_id string, title string, parent_session_id string, reasoning_effort string"
    )
    settled = ingest.settle(stored, headers, metadata)
    keys = settled.agg(F.count_distinct("source_key"), F.count(F.lit(1))).first()
    assert keys[0] == keys[1] > 0
    # The table that the batches merged into is that of all facts at once.
    live_facts = ingest.fact_store(spark, str(folder)).read()
    assert sorted(map(str, live_facts.collect())) == sorted(map(str, settled.collect()))
    # A batch finds what its logs carry in few segments, however many batches there were.
    assert len(ingest.context_store(spark, str(folder)).segments()) <= 4 * 3
    again = upsert_logs(settled, stored.filter("kind = 'turn'"), ["path", "block", "line_no"])
    assert again.count() == settled.count()


def test_long_chunk_numbers_keep_their_order(spark):
    from meterline.streaming.ingest import batch_lines

    names = ["a.jsonl", "a.2.jsonl", "a.3000000.jsonl", "a.1785369600.jsonl", "a.20260101000000000000.jsonl", "a." + "9" * 80 + ".jsonl"]
    batch = spark.createDataFrame([(n, o, "x") for n in reversed(names) for o in (0, 5_000_000_000)], "file string, offset bigint, value string")
    rows = batch_lines(batch.withColumn("value", F.concat("file", F.lit("@"), "offset"))).orderBy("block").collect()
    assert {r["path"] for r in rows} == {"a.jsonl"}
    assert [r["value"] for r in rows] == [f"{n}@{o}" for n in names for o in (0, 5_000_000_000)]
