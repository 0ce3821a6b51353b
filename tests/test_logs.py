"""Log extraction on small literal logs."""

import pytest
from conftest import event_line, session_line, usage_line
from pyspark.sql import functions as F

from meterline.functions.storage import freeze
from meterline.operators import lineage, replay
from meterline.sources import session_logs as logs
from meterline.sources.upserts import batch_report, upsert_logs

PLACE = ["path", "block", "line_no", "record_no"]
T = "2026-08-04T06:4{}:0{}Z"
BASE = 1785825600000  # 2026-08-04T06:40:00Z


@pytest.fixture
def extract(spark, tmp_path):
    def run():
        lines = logs.scan_logs(spark, str(tmp_path / "sessions"), str(tmp_path / "archived"))
        facts, headers = logs.extract_events(lines)
        return freeze(facts, "facts"), headers

    return run


def rows(facts, kind):
    return facts.filter(F.col("kind") == kind).orderBy("path", "block", "line_no").collect()


def test_turn_and_usage(write_log, extract):
    write_log("a.jsonl", [
        session_line("2026-08-04T06:41:51.881Z", id="s1", title="hello"),
        {"timestamp": "2026-08-04T06:42:00Z", "type": "event_msg", "payload": {
            "type": "token_count", "info": {"last_token_usage": {
                "input_tokens": 10, "cached_input_tokens": 2, "output_tokens": 3,
                "total_tokens": 13}}}},
        {"timestamp": "bad", "type": "session_meta", "payload": {"id": "dropped"}},
        {"timestamp": "2026-08-04T06:42:00Z", "type": "response_item", "payload": {}},
    ])
    facts, _ = extract()
    assert [r.total_tokens for r in rows(facts, "usage")] == [13]
    (session,) = rows(facts, "session")
    assert (session.title, session.relation, session.observed_at_ms) == (
        "hello", "main", 1785825711881)


def test_resets_in_seconds_become_milliseconds(write_log, extract):
    write_log("a.jsonl", [usage_line(T.format(2, 0), last=10, percent=12, reset=1786351410)])
    (quota,) = rows(extract()[0], "quota")
    assert quota.resets_at_ms == 1_786_351_410_000


def test_cumulative_counter_and_reset(write_log, extract):
    write_log("a.jsonl", [
        usage_line(T.format(2, 0), total=100),
        usage_line(T.format(3, 0), total=140),
        usage_line(T.format(4, 0), total=10),
    ])
    usage = rows(extract()[0], "usage")
    assert [r.total_tokens for r in usage] == [100, 40, 10]
    assert usage[2].quality == "derived_from_cumulative,counter_reset"


def test_repeated_snapshot_adds_nothing(write_log, extract):
    write_log("a.jsonl", [
        usage_line(T.format(2, 0), last=100, total=100),
        usage_line(T.format(3, 0), last=40, total=140),
        usage_line(T.format(4, 0), last=40, total=140, percent=5),
    ])
    facts, _ = extract()
    assert [r.total_tokens for r in rows(facts, "usage")] == [100, 40]
    assert rows(facts, "quota") == []


def test_total_only_snapshot_keeps_quota_but_no_usage(write_log, extract):
    line = usage_line(T.format(2, 0), percent=7)
    line["payload"]["info"] = {"last_token_usage": {"total_tokens": 16096}}
    write_log("a.jsonl", [line])
    facts, _ = extract()
    assert rows(facts, "usage") == []
    assert [r.used_percent for r in rows(facts, "quota")] == [7.0]


def test_unknown_tier_clears_and_absent_tier_keeps(write_log, extract):
    def settings(ts, **values):
        return event_line(ts, "thread_settings_applied", thread_settings=values)

    write_log("a.jsonl", [
        settings(T.format(2, 0), service_tier="fast"),
        usage_line(T.format(2, 1), last=1),
        settings(T.format(2, 2), model="m"),
        usage_line(T.format(2, 3), last=2),
        settings(T.format(2, 4), service_tier="future-tier"),
        usage_line(T.format(2, 5), last=3),
    ])
    assert [r.service_tier for r in rows(extract()[0], "usage")] == ["fast", "fast", None]


def test_turn_context_without_id_replaces_the_turn(write_log, extract):
    context = {"timestamp": T.format(2, 1), "type": "turn_context", "payload": {"turn_id": None}}
    write_log("a.jsonl", [
        event_line(T.format(2, 0), "task_started", turn_id="t1"),
        context,
        usage_line(T.format(2, 2), last=1),
    ])
    assert [r.turn_id for r in rows(extract()[0], "usage")] == [None]


def test_turns_keep_effort_and_abort(write_log, extract):
    write_log("a.jsonl", [
        session_line("2026-08-04T06:41:51.881Z", id="child", session_id="root",
                     parent_thread_id="root"),
        event_line(T.format(2, 0), "thread_settings_applied", thread_settings={
            "model": "gpt-5.6-sol", "reasoning_effort": "high", "service_tier": "fast"}),
        event_line(T.format(2, 1), "task_started", turn_id="turn-1"),
        event_line(T.format(2, 2), "task_aborted", turn_id="turn-1"),
    ])
    facts, _ = extract()
    started, aborted = rows(facts, "turn")
    assert (started.parent_session_id, started.reasoning_effort, started.service_tier) == (
        "root", "high", "fast")
    assert started.ended_at_ms is None and started.relation == "child"
    assert aborted.ended_at_ms == BASE + 122_000 and aborted.quality == "aborted"
    assert aborted.started_at_ms == BASE + 121_000
    (merged,) = upsert_logs(None, facts.filter("kind = 'turn'"), PLACE).collect()
    assert (merged.started_at_ms, merged.ended_at_ms) == (BASE + 121_000, BASE + 122_000)


def test_replayed_counter_has_one_key(write_log, extract):
    write_log("a.jsonl", [usage_line(T.format(2, 0), last=12, total=24)])
    write_log("b.jsonl", [usage_line(T.format(2, 3), last=12, total=24)])
    usage = rows(extract()[0], "usage")
    assert len(usage) == 2 and len({r.source_key for r in usage}) == 1


def test_child_replay_prefix_is_removed(spark, write_log, extract):
    write_log("root.jsonl", [
        session_line(T.format(1, 0), id="root"),
        usage_line(T.format(2, 0), last=100, total=100, percent=10.0),
        usage_line(T.format(4, 0), last=50, total=150, percent=20.0),
    ])
    write_log("child.jsonl", [
        session_line(T.format(3, 0), id="child", parent_thread_id="root"),
        usage_line(T.format(3, 1), last=100, total=100, percent=10.0),
        usage_line(T.format(5, 0), last=30, total=130, percent=30.0),
    ])
    facts, headers = extract()
    metadata = logs.session_metadata(
        spark.createDataFrame([("child", " Title ", 1), ("child", "later", 2)],
                              "id string, thread_name string, line_no long"), None, None)
    edges = lineage.parent_edges(metadata.filter("parent_session_id is not null"), headers)
    kept = freeze(replay.strip_replay(facts, headers), "kept")
    stored = upsert_logs(None, lineage.enrich(kept, metadata, edges), PLACE)
    found = stored.collect()
    usage = [r for r in found if r.kind == "usage"]
    assert (len(usage), sum(r.total_tokens for r in usage)) == (3, 180)
    assert all(r.root_session_id == "root" for r in usage)
    quota = {r.used_percent: r for r in found if r.kind == "quota"}
    assert len(quota) == 3
    assert quota[10.0].observed_at_ms == quota[10.0].last_seen_at_ms == BASE + 120_000
    child = next(r for r in found if r.source_key == "session:child")
    assert (child.title, child.parent_session_id, child.relation) == ("Title", "root", "child")
    report = batch_report(stored, kept).first()
    assert report.inserted_events == 0 and report.duplicate_events == kept.count()


def test_burst_is_dropped_only_when_nothing_matches(write_log, extract):
    write_log("root.jsonl", [session_line(T.format(1, 0), id="root"),
                             usage_line(T.format(2, 0), last=7)])
    write_log("child.jsonl", [
        session_line(T.format(3, 0), id="child", forked_from_id="root"),
        usage_line("2026-08-04T06:43:00.100Z", last=1),
        usage_line("2026-08-04T06:43:00.900Z", last=2),
        usage_line("2026-08-04T06:43:05Z", last=3),
    ])
    facts, headers = extract()
    kept = replay.strip_replay(facts, headers).filter("kind = 'usage' and session_id = 'child'")
    assert [r.total_tokens for r in kept.collect()] == [3]


def test_parent_whose_times_go_back(spark):
    """The cut at the fork time is by time, wherever the events stand."""
    zero = [0, 0, 0]

    def event(path, line, ms, n):
        return (path, 0, line, ms, n, zero[0], zero[1], 0, zero[2], n)

    usage = spark.createDataFrame(
        [event("p", 1, 100, 1), event("p", 2, 900, 2), event("p", 3, 200, 3),
         event("c", 1, 500, 1), event("c", 2, 5_000, 3), event("c", 3, 10_000, 9)],
        "path string, block long, line_no long, observed_at_ms long, input_tokens long, "
        "cache_read_tokens long, cache_write_tokens long, output_tokens long, "
        "reasoning_tokens long, total_tokens long")
    headers = spark.createDataFrame(
        [("p", "P", None, 0), ("c", "C", "P", 500)],
        "path string, session_id string, parent_session_id string, forked_at_ms long")
    dropped = replay.replayed_usage(usage, headers).collect()
    assert sorted(r.line_no for r in dropped) == [1, 2]


def test_lines_keep_their_order_over_many_splits(spark, write_log, tmp_path):
    path = write_log("big.jsonl", [
        session_line(T.format(1, 0), id="s"),
        *[usage_line(T.format(2, 0), total=n) for n in range(1, 4001)],
    ])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 9))
    try:
        lines = logs.scan_logs(spark, str(tmp_path / "sessions"), str(tmp_path / "none"))
        assert lines.select("block").distinct().count() > 5
        facts, _ = logs.extract_events(lines)
        usage = facts.filter("kind = 'usage'")
        assert usage.agg(F.sum("total_tokens")).first()[0] == 4000
        assert usage.filter("quality like '%reset%'").isEmpty()
        assert usage.filter("session_id is null").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pruning_and_date_filter(spark):
    files = spark.createDataFrame(
        [("x/2026-08-02/a.jsonl", 0), ("x/2026-07-01/b.jsonl", 0), ("x/c.jsonl", 0),
         ("x/2026-07-01/d.jsonl", 1785600000000), ("x/e.jsonl", None), ("x/2026-07-01/f.jsonl", 0)],
        "path string, modified_ms long")
    headers = spark.createDataFrame(
        [("x/c.jsonl", "c", None, 1785600000000)],
        "path string, session_id string, parent_session_id string, forked_at_ms long")
    tracked = spark.createDataFrame([("x/2026-07-01/f.jsonl",)], "path string")
    kept = logs.prune_files(files, headers, "2026-08-01", tracked)
    assert {r.path[-7:] for r in kept.collect()} == {"a.jsonl", "c.jsonl", "d.jsonl", "e.jsonl",
                                                     "f.jsonl"}
    facts = spark.range(2).select((F.col("id") + 1785513599999).alias("observed_at_ms"))
    assert logs.filter_from(facts, "2026-08-01").count() == 1
    assert logs.default_from_date(1785825600000) == "2026-07-06"


def test_a_line_is_parsed_once(spark):
    """Filters on what the JSON holds must not move below the step that parses it."""
    text = '{"timestamp":"2026-08-04T06:40:00Z","type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":5}}}}'
    lines = spark.createDataFrame([("a", "active", 0, n, v) for n, v in enumerate([text, text[:-1], text])], logs._LINE_SCHEMA)
    fields = logs.line_fields(logs.parse_envelope(lines))
    assert fields._jdf.queryExecution().executedPlan().toString().lower().count("parsejson") == 1
    counts = (5, 0, 0, 0, 0, 5)
    assert [(r.line_no, tuple(r.last_usage), r.cumulative) for r in fields.orderBy("line_no").collect()] == [(0, counts, None), (2, counts, None)]


def test_carried_lines_hold_what_facts_read(spark, write_log, tmp_path):
    write_log("a.jsonl", [session_line(T.format(0, 1), id="s"), usage_line(T.format(0, 2), last=5)])
    lines = logs.scan_logs(spark, str(tmp_path / "sessions"), str(tmp_path / "archived"))
    carried = logs.carry_context(freeze(logs.line_fields(logs.parse_envelope(lines)), "fields"))
    assert not {"_chunk", "model_set", "started_set", "own_lineage", "seed"} & set(carried.columns)
    assert [(r.session_id, r.counts) for r in carried.orderBy("line_no").collect()] == [("s", False), ("s", True)]
