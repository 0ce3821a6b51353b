"""Keyed writes, account feed, external runs, checks and publishing."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meterline import adapters
from meterline.functions import timeline
from meterline.plans import report
from meterline.schemas import SOURCE_APP_SERVER, SOURCE_CCUSAGE, SOURCE_JSONL, checked, column_names
from meterline.sources import account_feed, external_runs, sinks, upserts
from meterline.sources.catalogs import default_capacities


def typed(spark, schema, rows):
    full = [tuple(row.get(c) for c in column_names(schema)) + (row["seq"],) for row in rows]
    return spark.createDataFrame(full, schema + ", seq bigint")


def test_batch_upsert_equals_one_row_at_a_time(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(120):
        key = f"k{rng.randrange(9)}"
        rows.append({"seq": seq, "source_key": key, "kind": "quota" if key < "k4" else "usage",
                     "observed_at_ms": rng.randrange(1000),
                     "last_seen_at_ms": rng.choice([None, rng.randrange(1000)]),
                     "session_id": rng.choice([None, "a", "b"]),
                     "model": rng.choice([None, "m", "n"]), "title": rng.choice([None, "x", "y"]),
                     "total_tokens": rng.choice([None, 1, 2]), "quality": rng.choice([None, "q"])})
    stored = {}
    for r in rows:
        r = {c: r.get(c) for c in column_names(SOURCE_JSONL)}
        old = stored.get(r["source_key"])
        if old is None:
            stored[r["source_key"]] = dict(r)
            continue
        seen = r["observed_at_ms"] if r["last_seen_at_ms"] is None else r["last_seen_at_ms"]
        if old["kind"] == "quota":
            before = old["observed_at_ms"] if old["last_seen_at_ms"] is None else old["last_seen_at_ms"]
            old["last_seen_at_ms"] = max(before, seen)
            old["observed_at_ms"] = min(old["observed_at_ms"], r["observed_at_ms"])
        elif r["last_seen_at_ms"] is not None:
            old["last_seen_at_ms"] = r["last_seen_at_ms"]
        for c, v in r.items():
            if v is not None and c not in ("source_key", "kind", "observed_at_ms", "last_seen_at_ms",
                                           "session_id"):
                old[c] = v
    df = typed(spark, SOURCE_JSONL, rows)
    once = upserts.upsert_logs(None, df, ["seq"])
    twice = upserts.upsert_logs(upserts.upsert_logs(None, df.filter("seq < 50"), ["seq"]),
                                df.filter("seq >= 50"), ["seq"])
    for merged in (once, twice):
        assert {r.source_key: r.asDict() for r in merged.collect()} == stored
    again = upserts.upsert_logs(once, df.limit(0), ["seq"])
    assert {r.source_key: r.asDict() for r in again.collect()} == stored


def test_inverted_quota_times(spark):
    rows = [{"seq": 1, "source_key": "a", "kind": "quota", "observed_at_ms": 9, "last_seen_at_ms": 5},
            {"seq": 2, "source_key": "b", "kind": "usage", "observed_at_ms": 9, "last_seen_at_ms": 5}]
    fixed = upserts.repair_quota_times(typed(spark, SOURCE_JSONL, rows))
    assert {r.source_key: r.observed_at_ms for r in fixed.collect()} == {"a": 5, "b": 9}


def feed(spark, *messages):
    rows = [(1, i, 1000, json.dumps(m)) for i, m in enumerate(messages)]
    raw = spark.createDataFrame(rows, "poll_id long, msg_no long, polled_at_ms long, value string")
    return upserts.upsert_feed(None, account_feed.feed_facts(raw), account_feed.FEED_ORDER)


def test_feed_shapes(spark):
    window = {"usedPercent": 12.5, "windowMinutes": 10080, "resetsAt": "2026-08-04T06:42:00Z"}
    account = {"result": {"account": {"type": "chatgpt", "email": "A@b.c", "planType": "plus"}}}
    rows = feed(
        spark,
        account,
        {"result": {"rateLimits": {"limitId": "codex", "primary": window},
                    "rateLimitsByLimitId": {"codex": {"primary": window}, "x": {"secondary": window}}}},
        {"result": {"summary": {"dailyUsageBuckets": [{"startDate": "2026-08-03", "tokens": 7,
                                                       "Email": "a@b.c", "n": {"prompt": "p"}}]},
                    "lifetimeTokens": 9}},
    ).collect()
    quota = {(r.limit_id, r.window_kind): r for r in rows if r.kind == "quota"}
    assert set(quota) == {("codex", "primary"), ("x", "secondary")}
    one = quota["codex", "primary"]
    assert (one.used_percent, one.resets_at_ms, one.plan_type) == (12.5, 1785825720000, "plus")
    assert one.account_key.startswith("sha256:") and one.account_label == "account-" + one.account_key[-8:]
    (usage,) = [r for r in rows if r.kind == "usage"]
    assert json.loads(usage.daily_tokens_json) == [{"startDate": "2026-08-03", "tokens": 7, "n": {}}]
    assert usage.lifetime_tokens == 9
    assert "a@b.c" not in str(rows).lower()


def test_a_message_is_parsed_once(spark):
    quota = '{"result":{"rateLimits":{"limitId":"codex","primary":{"usedPercent":7,"resetsAt":1786839350},"secondary":{}}}}'
    raw = spark.createDataFrame([(1, 0, 5, quota), (1, 1, 5, "{")], "poll_id long, msg_no int, polled_at_ms long, value string")
    found = account_feed.feed_quota_facts(account_feed.parse_messages(raw))
    assert found._jdf.queryExecution().executedPlan().toString().lower().count("parsejson") == 1
    assert [(r.limit_id, r.window_kind, r.used_percent, r.resets_at_ms) for r in found.collect()] == [("codex", "primary", 7.0, 1786839350000)]
    # Four kinds of rows read the parsed messages, not the text.
    assert "parsejson" not in account_feed.feed_facts(raw)._jdf.queryExecution().executedPlan().toString().lower()


def test_unavailable_feed_blanks_the_account(spark):
    facts = feed(spark, {"result": {"account": {"id": "acc"}}}, {"error": {"code": 1}})
    assert facts.filter("status = 'unavailable'").count() == 1
    late = facts.withColumn("last_seen_at_ms", F.when(F.col("status") == "ok", 1).otherwise(2)
                            .cast("bigint"))
    assert account_feed.latest_account(late).first().account_key is None
    assert account_feed.latest_account(late, only_ok=True).first().account_key is not None


def test_external_rows_and_status(spark):
    rows = [("daily", "api", "auto", 1, 2, "v", "ok",
             '{"daily":[{"date":"2026-08-01","inputTokens":5.9,"costUSD":1.5,"models":{"m":{"prompt":1,"t":2}}}]}'),
            ("session", "api", "auto", 1, 2, "v", "failed", "not json")]
    results = spark.createDataFrame(rows, "scope string, pricing_scheme string, speed string, "
                                    "started_at_ms long, finished_at_ms long, version string, "
                                    "status string, data string")
    daily, session = sorted(external_runs.external_usage(results, "pv").collect(), key=lambda r: r.scope)
    assert (daily.source_key, daily.input_tokens, daily.amount) == (
        "ccusage:1:daily:2026-08-01:api:auto", 5, 1.5)
    assert json.loads(daily.model_breakdown_json) == {"m": {"t": 2}}
    assert (session.scope_key, session.total_tokens) == ("__run__", None)
    assert external_runs.run_status(results).first().status == "partial"


def test_time_functions(spark):
    def value(column):
        return spark.range(1).select(column).first()[0]

    assert value(timeline.minute_start(F.lit(-1))) == -60_000
    assert value(timeline.local_date(F.lit(1785513600000))) == "2026-08-01"
    assert value(timeline.local_date(F.lit(1785513599999))) == "2026-07-31"
    assert value(timeline.day_start_ms(F.lit("2026-08-01"))) == 1785513600000
    assert value(timeline.day_start_ms(F.lit("nope"))) == 0
    assert value(timeline.day_end_ms(F.lit("nope"))) == 2**63 - 1
    assert value(timeline.rfc3339_ms(F.lit("2026-08-04T14:42:00.5+08:00"))) == 1785825720500
    assert value(timeline.rfc3339_ms(F.lit("2026-08-04"))) is None


def test_checks_fail_on_unknown_values(spark):
    bad = spark.createDataFrame([("usd1",)], "profile_code string")
    with pytest.raises(PySparkException):
        checked(bad, "capacities").collect()
    assert checked(default_capacities(spark), "capacities").count() == 3


@pytest.fixture(scope="module")
def rollups(spark, sf_dir):
    from meterline.plans.rollup import Rollups

    return Rollups(adapters.rollup_inputs(spark, sf_dir))


def test_rollups_agree_and_publish_together(spark, rollups, tmp_path):
    root = str(tmp_path)
    sinks.replace_rollups(rollups.tables(), root)
    tables = sinks.read_rollups(spark, root)
    sums = [t.agg(F.sum("total_tokens")).first()[0] for t in tables.values()]
    assert len(set(sums)) == 1 and sums[0] > 0
    credits = [t.agg(F.sum(F.round(F.col("credit") * 1e6).cast("bigint"))).first()[0]
               for t in tables.values()]
    assert len(set(credits)) == 1
    sinks.replace_rollups({n: t.limit(0) for n, t in tables.items()}, root)
    assert sinks.read_rollups(spark, root)["usage_daily"].count() == 0
    primary = tables["usage_window"].filter("resets_at_ms < window_start_ms")
    assert primary.isEmpty()


def test_session_rows_are_computed_once(rollups):
    files = rollups.session.inputFiles()
    assert any("session-rows" in f for f in files) and not any("usage-facts" in f for f in files)


def test_report_sections(spark, rollups, sf_dir, tmp_path):
    from meterline.sources.catalogs import credit_catalog, usd_catalog

    feed_rows = upserts.upsert_feed(
        None, account_feed.feed_facts(adapters.feed_messages(spark, sf_dir)), account_feed.FEED_ORDER)
    logs = (adapters.quota_raw(spark, sf_dir).filter("source = 'jsonl'")
            .withColumn("observed_at_ms", F.col("first_seen_at_ms"))
            .withColumn("kind", F.lit("quota")))
    sections = report.report_sections(
        rollups.tables(), logs, feed_rows, adapters.external_raw(spark, sf_dir),
        default_capacities(spark), credit_catalog(spark), usd_catalog(spark), 1_786_665_600_000,
        "2026-07-20")
    report.write_report(sections, str(tmp_path / "report"))
    day = spark.read.json(str(tmp_path / "report" / "selected_day")).first()
    assert day.date == "2026-07-20"
    models = spark.read.json(str(tmp_path / "report" / "selected_models"))
    assert models.agg(F.sum("tokens")).first()[0] == day.usage.total
    report.write_document(sections, str(tmp_path / "document"))
    document = spark.read.text(str(tmp_path / "document"))
    assert {r.section for r in document.select("section").distinct().collect()} <= set(sections)
    kept = spark.read.json(document.filter("section = 'selected_models'").select("value").rdd.map(lambda r: r.value))
    assert kept.agg(F.sum("tokens")).first()[0] == day.usage.total
    method = json.loads(document.filter("section = 'methodology'").first().value)
    assert method["calculation_version"] == report.CALCULATION_VERSION and len(method["formulas"]) == 4
    current = json.loads(document.filter("section = 'current'").first().value)
    assert "provider" in current and current["provider"] is None


CURRENT_WINDOW = ("window_id string, window_kind string, window_start_ms long, resets_at_ms long, "
                  "total_tokens long, credit double, api_usd double")


@pytest.mark.parametrize(
    ("age_ms", "kind", "source", "flag"),
    [(1_000, "feed", "app_server", None), (1_000, "log", "jsonl", "official_fallback_jsonl"),
     (901_000, "feed", "none", "app_server_stale"), (901_000, "log", "none", "official_unavailable")],
)
def test_current_state(spark, age_ms, kind, source, flag):
    now = 1_786_000_000_000
    row = {"seq": 1, "source_key": "q", "kind": "quota", "observed_at_ms": now - age_ms,
           "first_seen_at_ms": now - age_ms, "last_seen_at_ms": now - age_ms, "limit_id": "codex",
           "window_kind": "primary", "used_percent": 7.0, "resets_at_ms": now + 5, "plan_type": "pro",
           "status": "ok"}
    feed_rows = typed(spark, SOURCE_APP_SERVER, [row] if kind == "feed" else [])
    logs = typed(spark, SOURCE_JSONL, [row] if kind == "log" else [])
    minute = spark.createDataFrame([], "bucket_key string, minute_start_ms long, "
                                   "official_used_percent double, official_source string, "
                                   "resets_at_ms long")
    found = spark.createDataFrame([("w", "primary", 1, now, 10, 32_000.0, 1.0)], CURRENT_WINDOW)
    got = report.current(feed_rows, logs, minute, found, default_capacities(spark), now).first()
    assert (got.source, got.plan, got.weekly_credit, got.local_percent) == (source, "pro", 64000.0, 50.0)
    assert got.used_percent == (7.0 if source != "none" else None)
    assert flag is None or flag in got.quality_flags


def test_current_account_falls_back_to_the_quota_row(spark):
    """Without an account row the quota row names the account; rows of accounts are not shown capacities."""
    now = 1_786_000_000_000
    row = {"seq": 1, "source_key": "q", "kind": "quota", "account_key": "acc", "first_seen_at_ms": now - 10,
           "last_seen_at_ms": now - 10, "limit_id": "codex", "window_kind": "primary", "used_percent": 7.0,
           "resets_at_ms": now + 5, "plan_type": "pro", "status": "ok"}
    minute = spark.createDataFrame([], "bucket_key string, minute_start_ms long, "
                                   "official_used_percent double, official_source string, resets_at_ms long")
    capacities = default_capacities(spark)
    own = capacities.filter("lower(profile_code) = 'usd200'").limit(1).withColumns(
        {"account_key": F.lit("acc"), "weekly_credit": F.lit(99.0), "effective_to_ms": F.lit(None).cast("long")})
    many = capacities.unionByName(own)
    others = own.crossJoin(spark.range(260)).withColumn("account_key", F.concat(F.lit("other"), F.col("id"))).drop("id")
    many = many.unionByName(others)
    windows = spark.createDataFrame([], CURRENT_WINDOW)
    got = report.current(typed(spark, SOURCE_APP_SERVER, [row]), typed(spark, SOURCE_JSONL, []), minute, windows, many, now).first()
    assert (got.account_key, got.weekly_credit, got.window_id, got.local_percent) == ("acc", 64000.0, None, None)


def test_external_table_has_every_column(spark, sf_dir):
    rows = external_runs.external_usage(adapters.external_results(spark, sf_dir))
    assert set(column_names(SOURCE_CCUSAGE)) <= set(rows.columns)
    stored = upserts.upsert_external(None, rows, ["run_at_ms", "item_no"])
    assert stored.count() == rows.select("source_key").distinct().count()
