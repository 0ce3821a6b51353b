"""Oracles of the report, reconciliation, capacity and scalar queries."""

from . import core
from . import views as v

ORACLES: dict[str, str] = {}


def over(select: str, **tables: str) -> str:
    """A query over the results of other oracles."""
    parts = [f"{name} AS (\n{core.ORACLES[source]}\n)" for name, source in tables.items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


_EXTERNAL = v.USAGE_RAW + """,
external_days AS (
  SELECT strftime(make_timestamp((observed_at_ms + 28800000) * 1000), '%Y-%m-%d') AS scope_key,
    sum(input_tokens - cache_read_tokens)::BIGINT AS input_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens,
    sum(cache_write_tokens)::BIGINT AS cache_write_tokens, sum(output_tokens)::BIGINT AS output_tokens,
    sum(reasoning_tokens)::BIGINT AS reasoning_tokens, sum(total_tokens)::BIGINT AS day_total
  FROM usage_base GROUP BY 1),
external_raw AS (
  SELECT 'daily' AS scope, d.*, pricing_scheme, speed, run_at_ms::BIGINT AS run_at_ms,
    day_total + CASE WHEN late THEN CAST(substr(scope_key, 9, 2) AS INTEGER) % 2 ELSE 7 END AS total_tokens,
    day_total / 1000.0::DOUBLE
      + CASE WHEN speed = 'auto' THEN 1.5::DOUBLE * (CAST(substr(scope_key, 9, 2) AS INTEGER) % 2) ELSE 0 END AS amount
  FROM external_days d,
    (VALUES ('subscription'), ('api')) AS a(pricing_scheme), (VALUES ('auto'), ('standard')) AS b(speed),
    (VALUES (1786000000000, false), (1786100000000, true)) AS c(run_at_ms, late))"""

ORACLES["latest_run"] = v.with_ctes(
    _EXTERNAL,
    select="""SELECT scope_key, pricing_scheme, speed, run_at_ms, total_tokens FROM external_raw
QUALIFY run_at_ms = max(run_at_ms) OVER (PARTITION BY scope, pricing_scheme, speed)""",
)
ORACLES["fast_surcharge"] = v.with_ctes(
    _EXTERNAL,
    select="""
SELECT scope, scope_key, pricing_scheme, max(amount) FILTER (speed = 'auto') AS auto_amount,
  max(amount) FILTER (speed = 'standard') AS standard_amount,
  greatest(max(amount) FILTER (speed = 'auto') - max(amount) FILTER (speed = 'standard'), 0) AS fast_surcharge
FROM external_raw WHERE run_at_ms = 1786100000000 GROUP BY ALL""",
)
ORACLES["external_usage"] = v.with_ctes(
    _EXTERNAL,
    select="""
SELECT 'ccusage:' || (run_at_ms - 1000) || ':daily:' || scope_key || ':' || pricing_scheme || ':' || speed AS source_key,
  scope, scope_key, input_tokens, cache_read_tokens, total_tokens, amount, 'ok' AS status FROM external_raw
UNION ALL
SELECT DISTINCT 'ccusage:' || (run_at_ms - 1000) || ':session:__run__:' || pricing_scheme || ':' || speed, 'session', '__run__',
  NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, 'failed' FROM external_raw WHERE speed = 'auto'""",
)
ORACLES["run_status"] = v.with_ctes(
    _EXTERNAL, select="SELECT 12 AS runs, 8 AS succeeded, 'partial' AS status WHERE (SELECT count(*) FROM external_raw) > 0"
)


def with_daily(select: str) -> str:
    return v.with_ctes(
        _EXTERNAL + ",\ndaily AS (\n" + core.ORACLES["usage_daily"] + "\n)", select=select
    )


ORACLES["validation"] = with_daily("""
SELECT e.scope_key AS date, 'total_tokens' AS metric, d.total_tokens AS local, e.total_tokens AS external,
  e.total_tokens - d.total_tokens AS diff, e.pricing_scheme AS pricing, e.speed,
  CASE WHEN e.total_tokens = d.total_tokens THEN 'match' ELSE 'diff' END AS status
FROM external_raw e JOIN daily d ON d.local_date = e.scope_key WHERE e.run_at_ms = 1786100000000""")
ORACLES["external_field_compare"] = with_daily("""
SELECT e.scope_key, e.pricing_scheme, e.speed,
  e.input_tokens - (d.input_tokens - d.cache_read_tokens) AS input_diff,
  e.cache_read_tokens - d.cache_read_tokens AS cache_read_diff,
  e.cache_write_tokens - d.cache_write_tokens AS cache_write_diff, e.output_tokens - d.output_tokens AS output_diff,
  e.reasoning_tokens - d.reasoning_tokens AS reasoning_diff, e.total_tokens - d.total_tokens AS total_diff,
  round(e.amount - CASE WHEN e.pricing_scheme = 'subscription' THEN d.credit ELSE d.api_usd END, 6) AS amount_diff
FROM external_raw e JOIN daily d ON d.local_date = e.scope_key WHERE e.run_at_ms = 1786100000000""")

ORACLES["selected_date"] = over(
    "SELECT max(local_date) AS date FROM daily", daily="usage_daily"
)
ORACLES["day_view"] = over(
    """SELECT local_date AS date, plan_type, capacity_profile, credit, api_usd, local_percent, account_tokens,
  input_tokens AS usage_input, total_tokens AS usage_total, quality FROM daily""",
    daily="usage_daily",
)
ORACLES["minute_view"] = over(
    """SELECT minute_start_ms, window_id, reset_marker, output_tokens AS usage_output, total_tokens AS usage_total,
  credit, official_used_percent, quality FROM minutes""",
    minutes="usage_minute",
)
ORACLES["minute_cumulative"] = over(
    """SELECT bucket_key, local_date, minute_start_ms, window_id,
  (sum(total_tokens) OVER day)::BIGINT AS cumulative_tokens,
  (sum(CAST(round(credit * 1000000) AS BIGINT)) OVER day)::BIGINT / 1000000.0::DOUBLE AS cumulative_credit,
  (sum(CAST(round(api_usd * 1000000) AS BIGINT)) OVER day)::BIGINT / 1000000.0::DOUBLE AS cumulative_api_usd,
  (sum(CAST(round(credit * 1000000) AS BIGINT)) OVER win)::BIGINT / 1000000.0::DOUBLE AS window_credit,
  official_used_percent, CASE WHEN official_used_percent IS NOT NULL
    THEN greatest(100.0::DOUBLE - official_used_percent, 0) END AS official_remaining_percent
FROM minutes
WINDOW day AS (PARTITION BY local_date ORDER BY minute_start_ms, coalesce(window_id, 'none') ROWS UNBOUNDED PRECEDING),
       win AS (PARTITION BY local_date, window_id ORDER BY minute_start_ms ROWS UNBOUNDED PRECEDING)""",
    minutes="usage_minute",
)
_CURVE = """,
spent AS (
  SELECT window_id, minute_start_ms, official_used_percent AS p,
    coalesce(sum(CAST(round(credit * 1000000) AS BIGINT))
      OVER (PARTITION BY window_id ORDER BY minute_start_ms ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS c
  FROM minutes WHERE window_id IS NOT NULL),
curve AS (SELECT * FROM spent WHERE p IS NOT NULL),
pairs AS (
  SELECT a.window_id, (b.c - a.c) / 1000000.0::DOUBLE / ((b.p - a.p) / 100.0::DOUBLE) AS candidate,
    a.minute_start_ms AS from_ms, b.minute_start_ms AS to_ms, a.p AS from_percent, b.p AS to_percent
  FROM curve a JOIN curve b ON a.window_id = b.window_id AND a.minute_start_ms < b.minute_start_ms AND b.p - a.p >= 5)"""


def with_curve(select: str) -> str:
    return "WITH minutes AS (\n" + core.ORACLES["usage_minute"] + "\n)" + _CURVE + "\n" + select


ORACLES["capacity_candidates"] = with_curve("""
SELECT window_id, max(candidate) AS candidate, arg_max(from_ms, (candidate, -from_ms, to_ms)) AS from_ms,
  arg_max(to_ms, (candidate, -from_ms, to_ms)) AS to_ms,
  arg_max(from_percent, (candidate, -from_ms, to_ms)) AS from_percent,
  arg_max(to_percent, (candidate, -from_ms, to_ms)) AS to_percent, count(*) AS intervals
FROM pairs GROUP BY window_id""")
ORACLES["candidate_spread"] = with_curve("""
SELECT a.window_id, count(*) AS checkpoint_intervals,
  median((b.c - a.c) / 1000000.0::DOUBLE / ((b.p - a.p) / 100.0::DOUBLE)) AS median_candidate,
  max((b.c - a.c) / 1000000.0::DOUBLE / ((b.p - a.p) / 100.0::DOUBLE))
    - min((b.c - a.c) / 1000000.0::DOUBLE / ((b.p - a.p) / 100.0::DOUBLE)) AS spread
FROM (SELECT window_id, p, min(minute_start_ms) AS ms, min(c) AS c FROM curve GROUP BY ALL) a
JOIN (SELECT window_id, p, min(minute_start_ms) AS ms, min(c) AS c FROM curve GROUP BY ALL) b
  ON a.window_id = b.window_id AND b.p - a.p >= 5 AND a.ms < b.ms
GROUP BY a.window_id""")
ORACLES["unobserved_percent"] = over(
    """SELECT window_id, official_percent_delta, local_percent,
  CASE WHEN official_percent_delta IS NOT NULL AND local_percent IS NOT NULL
       THEN greatest(official_percent_delta - local_percent, 0) END AS unobserved_percent FROM windows""",
    windows="usage_window",
)
ORACLES["window_detail"] = over(
    """SELECT w.window_id, w.total_tokens, coalesce(m.n, 0) AS minute_count, coalesce(s.n, 0) AS session_count,
  coalesce(s.roots, 0) AS root_count
FROM windows w LEFT JOIN (SELECT window_id, count(*) AS n FROM minutes GROUP BY 1) m USING (window_id)
LEFT JOIN (SELECT window_id, count(*) AS n, count(DISTINCT coalesce(root_session_id, session_id)) AS roots
           FROM sessions GROUP BY 1) s USING (window_id)""",
    windows="usage_window", minutes="usage_minute", sessions="usage_session",
)
ORACLES["nearest_window"] = over(
    """SELECT window_id, resets_at_ms FROM windows WHERE window_kind = 'primary'
ORDER BY abs(resets_at_ms - 1785300000000), window_start_ms, window_id LIMIT 1""",
    windows="disjoint_windows",
)
ORACLES["audit_counts"] = v.with_ctes(
    _EXTERNAL + ",\ndaily AS (" + core.ORACLES["usage_daily"] + "),\nsessions AS ("
    + core.ORACLES["usage_session"] + "),\nwindows_seen AS (" + core.ORACLES["usage_window"] + ")",
    select="""
SELECT 'lines' AS name, count(*) AS value FROM daily
UNION ALL SELECT 'events', count(*) FROM usage_raw
UNION ALL SELECT 'sessions', count(DISTINCT root_session_id) FROM sessions
UNION ALL SELECT 'source_rows', count(*) FROM usage_raw
UNION ALL SELECT 'window_rows', count(*) FROM windows_seen
UNION ALL SELECT 'ccusage_rows', count(*) FROM external_raw""",
)
ORACLES["sync_counts"] = v.with_ctes(
    v.USAGE_RAW,
    select="""SELECT 'days' AS name,
  count(DISTINCT strftime(make_timestamp((observed_at_ms + 28800000) * 1000), '%Y-%m-%d')) AS value FROM usage_raw
UNION ALL SELECT 'last_usage_ms', max(observed_at_ms) FROM usage_raw""",
)

_MODELS = core.PRICED_FACTS + core._SESSION_ALL + """,
items AS (
  SELECT m.*, s.started_at_ms, row_number() OVER (PARTITION BY m.row_key ORDER BY m.model, m.tier, m.reasoning_effort) AS place
  FROM model_rows m JOIN session_sum s USING (row_key))"""
ORACLES["report_models"] = v.with_ctes(
    _MODELS,
    select="""
SELECT local_date, model, tier, reasoning_effort, sum(tokens)::BIGINT AS tokens,
  CASE WHEN arg_max(credit IS NOT NULL, (started_at_ms, row_key, place))
       THEN sum(CAST(round(credit * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE END AS credit,
  CASE WHEN arg_max(api_usd IS NOT NULL, (started_at_ms, row_key, place))
       THEN sum(CAST(round(api_usd * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE END AS api_usd
FROM items GROUP BY ALL""",
)
ORACLES["report_sessions"] = over(
    """
SELECT local_date, coalesce(root_session_id, session_id) AS root_session_id,
  (arg_min({'t': title}, (started_at_ms, row_key))).t AS title,
  (arg_min({'t': primary_model}, (started_at_ms, row_key))).t AS primary_model,
  min(started_at_ms) AS started_at_ms, max(ended_at_ms) AS ended_at_ms, count(*) AS turn_count,
  coalesce(array_to_string(list_sort(list_distinct(list(primary_model) FILTER (primary_model IS NOT NULL))), ','), '') AS models,
  array_to_string(list_sort(list_distinct(list(fast_state))), ',') AS fast,
  sum(total_tokens)::BIGINT AS total_tokens,
  CASE WHEN count(credit) = count(*) THEN sum(CAST(round(credit * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE END AS credit,
  CASE WHEN count(api_usd) = count(*) THEN sum(CAST(round(api_usd * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE END AS api_usd
FROM sessions GROUP BY 1, 2""",
    sessions="usage_session",
)
ORACLES["report_turns"] = over(
    """SELECT row_key, turn_id, session_id, coalesce(root_session_id, session_id) AS root_session_id, primary_model AS model,
  fast_state AS fast, total_tokens AS usage_total, credit FROM sessions""",
    sessions="usage_session",
)

_CAPACITY_TABLE = """,
caps AS (SELECT * FROM (VALUES
  ('usd20', NULL, NULL, 3200.0::DOUBLE, 0, NULL), ('usd100', NULL, NULL, 16000.0, 0, NULL),
  ('usd200', NULL, NULL, 64000.0, 0, NULL), ('usd20', NULL, 'pro', 50000.0, 1785000000000, NULL),
  ('usd100', 's7', NULL, 17000.0, 1785500000000, 1786000000000))
  AS t(profile_code, account_key, plan_type, weekly_credit, from_ms, to_ms)),
asked AS (
  SELECT source_key, 's' || (CAST(substr(session_id, 2) AS BIGINT) % 10) AS account_key,
    CASE WHEN plan_type = 'team' AND input_tokens % 2 = 0 THEN 'business' ELSE plan_type END AS plan_type,
    observed_at_ms AS at_ms FROM usage_raw),
fitting AS (
  SELECT a.source_key, c.profile_code, c.weekly_credit,
    row_number() OVER (PARTITION BY a.source_key ORDER BY
      CASE WHEN c.plan_type IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN c.profile_code = CASE lower(a.plan_type) WHEN 'plus' THEN 'usd20' WHEN 'team' THEN 'usd100'
          WHEN 'pro' THEN 'usd200' END THEN 1 ELSE 0 END DESC, c.from_ms DESC, c.profile_code DESC) AS rn
  FROM asked a JOIN caps c ON c.from_ms <= a.at_ms AND (c.to_ms IS NULL OR a.at_ms < c.to_ms)
    AND (c.account_key IS NULL OR c.account_key = a.account_key) AND (c.plan_type IS NULL OR c.plan_type = a.plan_type)
  WHERE lower(a.plan_type) NOT IN ('api', 'unknown'))"""
ORACLES["capacity_for"] = v.with_ctes(
    v.USAGE_RAW + _CAPACITY_TABLE,
    select="""SELECT a.source_key, f.profile_code AS capacity_profile, f.weekly_credit
FROM asked a LEFT JOIN fitting f ON f.source_key = a.source_key AND f.rn = 1""",
)
ORACLES["capacity_for_join"] = ORACLES["capacity_for"]
ORACLES["capacity_for_plan"] = v.with_ctes(
    v.USAGE_RAW + _CAPACITY_TABLE + """,
by_profile AS (
  SELECT a.source_key, c.weekly_credit, c.profile_code,
    row_number() OVER (PARTITION BY a.source_key ORDER BY c.from_ms DESC) AS rn
  FROM asked a JOIN caps c ON c.profile_code = 'usd100' AND c.from_ms <= a.at_ms AND (c.to_ms IS NULL OR a.at_ms < c.to_ms)
    AND (c.account_key IS NULL OR c.account_key = a.account_key) WHERE a.account_key <> 's3')""",
    select="""SELECT a.source_key, coalesce(p.profile_code, f.profile_code) AS capacity_profile,
  coalesce(p.weekly_credit, f.weekly_credit) AS weekly_credit
FROM asked a LEFT JOIN by_profile p ON p.source_key = a.source_key AND p.rn = 1
LEFT JOIN fitting f ON f.source_key = a.source_key AND f.rn = 1""",
)
ORACLES["current_capacity"] = v.with_ctes(
    v.USAGE_RAW + _CAPACITY_TABLE,
    select="""
SELECT a.source_key, c.weekly_credit FROM asked a LEFT JOIN LATERAL (
  SELECT * FROM caps c WHERE c.from_ms <= a.at_ms AND (c.to_ms IS NULL OR a.at_ms < c.to_ms)
    AND (c.account_key IS NULL OR c.account_key = a.account_key)
    AND (c.plan_type IS NULL OR lower(c.plan_type) = lower(a.plan_type))
    AND c.profile_code = CASE lower(a.plan_type) WHEN 'plus' THEN 'usd20' WHEN 'team' THEN 'usd100' WHEN 'pro' THEN 'usd200' END
  ORDER BY CASE WHEN c.account_key IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN c.plan_type IS NOT NULL THEN 2 ELSE 0 END DESC,
    c.from_ms DESC LIMIT 1) c ON true""",
)
ORACLES["capacity_seeding"] = v.with_ctes(
    v.EVENTS
    + """,
dated AS (SELECT CASE event_type WHEN 'click' THEN 'usd20' ELSE 'usd100' END AS profile_code,
            max(event_id) AS seen, max(user_id)::DOUBLE AS credit
          FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1)""",
    select="""
SELECT profile_code, NULL::VARCHAR AS account_key, credit AS weekly_credit, 0::BIGINT AS effective_from_ms,
  seen AS confirmed_at_ms FROM dated
UNION ALL SELECT 'usd200', NULL, 55000, 0, 77
UNION ALL SELECT profile_code, 'old', credit, seen, seen FROM dated""",
)

ORACLES["scalar_functions"] = v.with_ctes(
    v.USAGE_RAW,
    select="""
SELECT source_key, observed_at_ms - observed_at_ms % 60000 AS minute_start_ms,
  strftime(make_timestamp((observed_at_ms + 28800000) * 1000), '%Y-%m-%d') AS local_date,
  (observed_at_ms + 28800000) // 86400000 * 86400000 - 28800000 AS day_start_ms,
  (observed_at_ms + 28800000) // 86400000 * 86400000 + 57600000 AS day_end_ms,
  coalesce(plan_type, CASE WHEN lower(provider) = 'pro' THEN 'api' END) AS effective_plan,
  CASE WHEN coalesce(plan_type, CASE WHEN lower(provider) = 'pro' THEN 'api' END) IS NULL THEN 'unknown'
       WHEN lower(coalesce(plan_type, 'api')) = 'api' THEN 'api' ELSE 'subscription' END AS context,
  CASE lower(plan_type) WHEN 'plus' THEN 'usd20' WHEN 'team' THEN 'usd100' WHEN 'pro' THEN 'usd200' END AS profile,
  CASE WHEN lower(model) = 'codex-auto-review' THEN 'gpt-5.5' ELSE lower(model) END AS dedupe_model,
  CASE WHEN input_tokens % 5 = 0 THEN 'standard' WHEN input_tokens % 5 = 1 THEN 'fast' END AS tier,
  CASE WHEN total_tokens < 100000 THEN total_tokens * 1000 ELSE (total_tokens + 100000000000) END AS epoch_ms,
  total_tokens / 1000000.0::DOUBLE AS amount, input_tokens / 1e12::DOUBLE AS per_token,
  greatest(100.0::DOUBLE - (input_tokens % 150)::DOUBLE, 0) AS remaining,
  1786000000000 - observed_at_ms <= 900000 AS fresh,
  plan_type IS NOT NULL AND lower(plan_type) NOT IN ('api', 'unknown') AS is_subscription
FROM usage_raw""",
)

# What is read back from files is what was landed.
ORACLES["external_files"] = ORACLES["external_usage"]


def _current(has_feed: bool, after_ms: int) -> str:
    """The report's current state; without a feed its clock follows the log quota."""
    from . import logs

    quota_logs = v.with_ctes(v.EVENTS + v.QUOTA_RAW, select="SELECT * FROM quota_raw WHERE source = 'jsonl'")
    clock = "accounts" if has_feed else "quota_logs"
    return f"""
WITH windows AS ({core.ORACLES["usage_window"]}),
minutes AS ({core.ORACLES["usage_minute"]}),
accounts AS ({logs.ORACLES["account_facts"]}),
feed_quota AS ({logs.ORACLES["feed_quota_facts"]}),
quota_logs AS ({quota_logs}),
clock AS (SELECT max(last_seen_at_ms) + {after_ms} AS now FROM {clock}),
a AS (SELECT * FROM accounts WHERE {has_feed} AND status = 'ok' ORDER BY last_seen_at_ms DESC LIMIT 1),
f AS (SELECT *, (SELECT now FROM clock) - last_seen_at_ms <= 900000 AS fresh FROM feed_quota WHERE {has_feed}
      ORDER BY CASE WHEN limit_id = 'codex' THEN 2 ELSE 1 END DESC, last_seen_at_ms DESC LIMIT 1),
l AS (SELECT *, (SELECT now FROM clock) - last_seen_at_ms <= 900000 AS fresh FROM quota_logs
      ORDER BY CASE WHEN window_kind <> 'primary' THEN 0 WHEN limit_id = 'codex' THEN 2 ELSE 1 END DESC,
        last_seen_at_ms DESC, source_key DESC LIMIT 1),
m AS (SELECT * FROM minutes, clock WHERE official_used_percent IS NOT NULL AND minute_start_ms > 0
        AND now - minute_start_ms <= 900000 ORDER BY minute_start_ms DESC, bucket_key DESC LIMIT 1),
state AS (
  SELECT coalesce(a.account_key, CASE WHEN f.fresh THEN f.account_key WHEN l.fresh THEN l.account_key END) AS account_key,
    a.account_label AS label, a.auth_kind, a.last_seen_at_ms AS observed_at_ms,
    coalesce(a.plan_type, f.plan_type, l.plan_type) AS plan,
    coalesce(CASE WHEN f.fresh THEN f.used_percent WHEN l.fresh THEN l.used_percent END, m.official_used_percent) AS used_percent,
    coalesce(CASE WHEN f.fresh THEN f.resets_at_ms WHEN l.fresh THEN l.resets_at_ms END, m.resets_at_ms) AS resets_at_ms,
    CASE WHEN f.fresh THEN f.window_minutes::BIGINT WHEN l.fresh THEN l.window_minutes END AS window_minutes,
    CASE WHEN f.fresh THEN 'app_server' WHEN l.fresh THEN 'jsonl' WHEN m.minute_start_ms IS NULL THEN 'none'
         WHEN m.official_source = 'app_server' THEN 'app_server' ELSE 'jsonl' END AS source,
    coalesce(f.fresh, false) AS feed_fresh, coalesce(l.fresh, false) AS log_fresh, f.last_seen_at_ms IS NOT NULL AS feed_any
  FROM clock LEFT JOIN a ON true LEFT JOIN f ON true LEFT JOIN l ON true LEFT JOIN m ON true),
shown AS (
  SELECT s.*, s.used_percent IS NOT NULL OR s.resets_at_ms IS NOT NULL AS available, c.weekly_credit,
    w.window_id AS near_id, w.window_start_ms, w.resets_at_ms AS near_reset, w.total_tokens, w.credit, w.api_usd
  FROM state s
  LEFT JOIN (VALUES ('plus', 3200.0::DOUBLE), ('team', 16000.0::DOUBLE), ('pro', 64000.0::DOUBLE)) AS c(plan, weekly_credit)
    ON c.plan = lower(s.plan)
  LEFT JOIN windows w ON true
  ORDER BY w.window_kind = 'primary' DESC,
    CASE WHEN s.resets_at_ms IS NOT NULL THEN abs(w.resets_at_ms - s.resets_at_ms) END NULLS LAST,
    CASE WHEN s.resets_at_ms IS NOT NULL AND w.window_kind = 'primary' THEN w.window_start_ms ELSE -w.window_start_ms END
  LIMIT 1)
SELECT coalesce(label, plan) AS display, account_key, auth_kind, plan, NULL::VARCHAR AS provider, weekly_credit, observed_at_ms,
  used_percent, greatest(100.0::DOUBLE - used_percent, CASE WHEN used_percent IS NOT NULL THEN 0.0::DOUBLE END) AS remaining_percent,
  resets_at_ms, window_minutes, CASE WHEN available THEN source ELSE 'none' END AS source,
  CASE WHEN available THEN near_id END AS window_id, near_id AS local_window_id, window_start_ms AS local_start_at_ms,
  CASE WHEN resets_at_ms IS NOT NULL THEN near_reset END AS local_reset_at_ms, total_tokens AS local_tokens, credit AS local_credit,
  api_usd AS local_api_usd, CASE WHEN weekly_credit > 0 THEN credit / weekly_credit * 100.0::DOUBLE END AS local_percent,
  CASE WHEN NOT available THEN true END AS official_stale,
  concat_ws(',', CASE WHEN NOT feed_fresh THEN CASE WHEN feed_any THEN 'app_server_stale' ELSE 'app_server_unavailable' END END,
    CASE WHEN log_fresh AND NOT feed_fresh THEN 'official_fallback_jsonl' END,
    CASE WHEN NOT available THEN 'official_unavailable' END,
    CASE WHEN weekly_credit IS NULL THEN 'capacity_unconfirmed' END) AS quality_flags
FROM shown"""


ORACLES["current_state"] = _current(True, 60_000)
ORACLES["current_state_logs"] = _current(False, 60_000)
ORACLES["current_state_stale"] = _current(True, 86_400_000)


def _document() -> str:
    """Items and tokens of each section of the report of the last day."""
    from . import logs

    whole = {
        "daily": core.ORACLES["usage_daily"], "minutes": core.ORACLES["usage_minute"],
        "sessions": core.ORACLES["usage_session"], "windows": core.ORACLES["usage_window"],
        "models": ORACLES["report_models"], "runs": ORACLES["latest_run"], "checks": ORACLES["validation"],
        "card": core.ORACLES["price_card"], "feed_usage": logs.ORACLES["feed_usage_facts"],
    }
    tables = ",\n".join(f"{name} AS ({sql})" for name, sql in whole.items())
    today = "local_date = (SELECT max(local_date) FROM daily)"
    root = "coalesce(root_session_id, session_id)"
    counted = {
        "days": "daily", "selected_day": f"daily WHERE {today}", "selected_minutes": f"minutes WHERE {today}",
        "selected_turns": f"sessions WHERE {today}", "window_minutes": "minutes WHERE window_id IS NOT NULL",
        "window_turns": "sessions WHERE window_id IS NOT NULL",
    }
    plain = {
        "selected_models": f"(SELECT count(*) FROM models WHERE {today})",
        "selected_sessions": f"(SELECT count(DISTINCT {root}) FROM sessions WHERE {today})",
        "window_sessions": f"(SELECT count(*) FROM (SELECT DISTINCT window_id, {root} FROM sessions WHERE window_id IS NOT NULL))",
        "quota_windows": "(SELECT count(*) FROM windows)", "validation_latest": "(SELECT count(*) FROM runs)",
        "validation": "(SELECT count(*) FROM checks)", "price_card": "(SELECT count(*) FROM card)",
        "account_daily_tokens": "(SELECT least(count(*), 1) FROM feed_usage)",
        "current": "1", "capacities": "3", "methodology": "1", "audit": "6",
    }
    rows = [
        f"SELECT '{name}' AS section, count(*) AS items, sum(total_tokens)::BIGINT AS tokens FROM {source}"
        for name, source in counted.items()
    ]
    rows += [f"SELECT '{name}', {value}, NULL" for name, value in plain.items()]
    return f"WITH {tables}\n" + "\nUNION ALL ".join(rows)


ORACLES["report_document"] = _document()
