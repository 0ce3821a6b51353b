"""Readers of landed messages, runs and title indexes."""

import json
import os

from meterline.sources import account_feed, external_runs, landed
from meterline.sources import session_logs as logs


def lay(path, lines, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    if at:
        os.utime(path, (at, at))


def account(email):
    return {"result": {"account": {"type": "chatgpt", "email": email, "planType": "pro"}}}


QUOTA = {"result": {"rateLimits": {"limitId": "codex", "primary": {"usedPercent": 7.5, "resetsAt": 1_786_000_000}}}}


def test_bare_messages_of_a_file_are_one_poll(spark, tmp_path):
    lay(tmp_path / "b.jsonl", [account("a@x.y"), "", "{broken", QUOTA], at=1_785_000_000)
    lay(tmp_path / "a" / "c.jsonl", [QUOTA, account("b@x.y")], at=1_785_000_100)
    lay(tmp_path / "a" / "note.txt", [account("c@x.y")])
    rows = landed.read_polls(spark, str(tmp_path)).orderBy("poll_id", "msg_no").collect()
    assert [r.polled_at_ms for r in rows] == [1_785_000_000_000] * 3 + [1_785_000_100_000] * 2
    messages = account_feed.parse_messages(landed.read_polls(spark, str(tmp_path)))
    quota = account_feed.feed_quota_facts(messages).orderBy("last_seen_at_ms").collect()
    # The account of a poll is known from its message on, and not to other polls.
    assert [(r.used_percent, r.account_key is None) for r in quota] == [(7.5, False), (7.5, True)]
    assert account_feed.account_facts(messages).count() == 2


def test_envelopes_give_poll_time_and_order(spark, tmp_path):
    def wrap(poll, at, number, message):
        return {"poll_id": poll, "polled_at_ms": at, "msg_no": number, "message": message}

    lay(tmp_path / "one.jsonl", [wrap("p1", 5_000, 2, QUOTA), wrap("p2", 900, 1, json.dumps(account("b@x.y")))])
    lay(tmp_path / "two.jsonl", [wrap("p1", 5_000, 1, account("a@x.y")), wrap("p2", 900, 2, {"error": {"code": 1}}),
                                 {"message": "no time"}])
    polls = landed.read_polls(spark, str(tmp_path))
    assert sorted({r.poll_id.split(":", 1)[1] for r in polls.collect() if "p" in r.poll_id[-2:]}) == ["p1", "p2"]
    # Polls sort by time, whatever their names are.
    assert [r.poll_id[-2:] for r in polls.filter("poll_id like '%:p_'").orderBy("poll_id", "msg_no").collect()] == ["p2", "p2", "p1", "p1"]
    messages = account_feed.parse_messages(polls)
    assert account_feed.feed_quota_facts(messages).first().account_key == account_feed.account_facts(
        messages.filter("observed_at_ms = 5000")).first().account_key
    assert account_feed.feed_errors(messages).first().last_seen_at_ms == 900


def test_runs(spark, tmp_path):
    run = {"scope": "daily", "pricing_scheme": "api", "speed": "auto", "started_at_ms": 1, "finished_at_ms": 2, "version": "1", "status": "ok"}
    lay(tmp_path / "r.jsonl", [
        {**run, "data": {"daily": [{"date": "2026-07-01", "inputTokens": 5, "costUSD": 0.25}]}},
        {**run, "started_at_ms": 3, "data": json.dumps({"daily": []})},
        {**run, "started_at_ms": 4, "status": None},
        {"scope": "daily"}, "nothing",
    ])
    runs = landed.read_runs(spark, str(tmp_path))
    rows = external_runs.external_usage(runs).orderBy("range_start_ms").collect()
    assert [(r.scope_key, r.input_tokens, r.amount, r.status) for r in rows] == [
        ("2026-07-01", 5, 0.25, "ok"), ("__run__", None, None, "ok"), ("__run__", None, None, "failed")]
    assert external_runs.run_status(runs).first().status == "partial"


def test_title_index(spark, tmp_path):
    lay(tmp_path / "home" / "session_index.jsonl", [
        {"id": "s1", "thread_name": " "}, "{", {"id": 4, "thread_name": "number"}, "", {"id": "s1", "thread_name": " first "},
        {"id": "s1", "thread_name": "second"}, {"id": "s2", "thread_name": 9}, [1]])
    lay(tmp_path / "home" / "other.jsonl", [{"id": "s9", "thread_name": "not an index"}])
    threads = spark.createDataFrame([("s2", "from thread", " high "), ("s3", " ", None)], "id string, title string, reasoning_effort string")
    edges = spark.createDataFrame([("s1", "s2"), (None, "s3")], "parent_thread_id string, child_thread_id string")
    found = logs.session_metadata(landed.read_title_index(spark, str(tmp_path)), threads, edges)
    assert {tuple(r) for r in found.collect()} == {
        ("s1", "first", None, None), ("s2", "from thread", "s1", "high"), ("s3", None, None, None)}


def test_missing_folders_are_empty(spark, tmp_path):
    gone = str(tmp_path / "gone")
    for read in (landed.read_polls, landed.read_runs):
        assert read(spark, gone).count() == 0
    assert logs.session_metadata(landed.read_title_index(spark, gone), None, None).count() == 0
