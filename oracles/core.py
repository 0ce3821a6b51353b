"""Oracles of the pricing, window, turn and rollup queries."""

from . import views as v

DAY = "strftime(make_timestamp((observed_at_ms + 28800000) * 1000), '%Y-%m-%d')"
TOKENS = (
    "input_tokens, cache_read_tokens, cache_write_tokens, output_tokens, "
    "reasoning_tokens, total_tokens"
)
SUMS = ", ".join(f"sum({t.strip()})::BIGINT AS {t.strip()}" for t in TOKENS.split(","))
MONEY = "credit_micros / 1000000.0::DOUBLE AS credit, api_usd_micros / 1000000.0::DOUBLE AS api_usd"

PRICED_FACTS = (
    v.USAGE_DEDUP
    + v.WINDOWS
    + v.usage_windowed("usage_dedup")
    + ",\n"
    + v.priced("usage_windowed")
    + v.TURN_RAW
    + v.usage_turned("priced")
    + v.FACTS
)

ORACLES: dict[str, str] = {}

ORACLES["usage_normalized"] = v.with_ctes(
    v.USAGE_RAW,
    select="""
SELECT source_key,
  greatest(i, 0) AS input_tokens, least(greatest(c, 0), greatest(i, 0)) AS cache_read_tokens,
  greatest(w, 0) AS cache_write_tokens, greatest(o, 0) AS output_tokens,
  least(greatest(r, 0), greatest(o, 0)) AS reasoning_tokens,
  CASE WHEN t <= 0 THEN greatest(i, 0) + greatest(o, 0) ELSE t END AS total_tokens
FROM (SELECT source_key, input_tokens - 5000 AS i, cache_read_tokens * 2 AS c, cache_write_tokens - 3 AS w,
             output_tokens AS o, reasoning_tokens * 3 AS r,
             CASE WHEN service_tier = 'fast' THEN 0 ELSE total_tokens END AS t FROM usage_raw)""",
)

ORACLES["usage_dedup"] = v.with_ctes(v.USAGE_DEDUP, select="SELECT * FROM usage_dedup")

ORACLES["price_version_at"] = v.with_ctes(
    v.USAGE_RAW + ",\n" + v.priced("usage_raw"),
    select="SELECT source_key, credit_version, usd_version FROM with_version",
)

ORACLES["match_rate"] = v.with_ctes(
    v.EVENTS.strip()
    + """,
odd_names AS (
  SELECT DISTINCT CASE event_type WHEN 'click' THEN 'GPT-5.6-Sol' WHEN 'view' THEN 'gpt-5.5-cyber'
    WHEN 'purchase' THEN 'gpt-5.4-mini' WHEN 'signup' THEN 'codex-auto-review' ELSE 'gpt-5' END
    || CASE WHEN k % 3 = 0 THEN '' ELSE '-' || k END AS model FROM ev),
"""
    + v.priced("(SELECT model, 0 AS observed_at_ms, 0 AS input_tokens, 0 AS cache_read_tokens, "
               "0 AS cache_write_tokens, 0 AS output_tokens, 'standard' AS service_tier FROM odd_names)"),
    select="""SELECT model_key, CASE scheme WHEN 'credit' THEN 'subscription_credit' ELSE 'api_usd' END AS scheme,
  version, model AS matched_model, r_in AS input_rate FROM best""",
)

ORACLES["price_events"] = v.with_ctes(
    v.USAGE_NORMAL + ",\n" + v.priced("usage_normal"),
    select=f"SELECT source_key, credit_micros, api_usd_micros, {v.flag_text('price_flags')} AS quality FROM priced",
)

ORACLES["price_card"] = v.with_ctes(
    v.USAGE_NORMAL + ",\n" + v.priced("usage_normal") + """,
used AS (SELECT credit_version, usd_version, credit_model, count(*) AS events FROM priced
         WHERE credit_model IS NOT NULL GROUP BY ALL),
periods AS (SELECT from_ms, to_ms, version AS cv FROM versions WHERE scheme = 'credit')""",
    select="""
SELECT p.cv || ' + ' || d.version AS version, p.from_ms AS effective_from_ms, p.to_ms AS effective_to_ms,
  c.model, c.r_in AS credit_input, c.r_out AS credit_output, c.mult AS credit_fast_multiplier,
  m.r_in AS usd_input, m.r_out AS usd_output, m.mult AS usd_fast_multiplier, m.l_in AS usd_long_input,
  coalesce(u.events, 0) AS events
FROM periods p
JOIN versions d ON d.scheme = 'usd' AND d.from_ms = p.from_ms
JOIN rates c ON c.scheme = 'credit' AND c.version = p.cv AND c.name = c.model
LEFT JOIN (SELECT r.*, n.model AS credit_name,
             row_number() OVER (PARTITION BY n.model, r.version ORDER BY
               CASE WHEN n.model = r.name THEN 1000000 ELSE 0 END + length(r.name) DESC, r.rate_no DESC) AS rn
           FROM (SELECT DISTINCT model FROM rates WHERE scheme = 'credit') n
           JOIN rates r ON r.scheme = 'usd' AND (n.model = r.name OR starts_with(n.model, r.name || '-'))) m
  ON m.version = d.version AND m.credit_name = c.model AND m.rn = 1
LEFT JOIN used u ON u.credit_version = p.cv AND u.usd_version = d.version AND u.credit_model = c.model""",
)

ORACLES["rate_overrides"] = v.with_ctes(
    v.USAGE_NORMAL + ",\n" + v.RATES,
    select="""
SELECT u.model, count(*) AS events,
  sum(u.input_tokens - u.cache_read_tokens)::BIGINT * (any_value(r.r_in) / 1e12::DOUBLE) AS input_cost,
  sum(u.cache_read_tokens)::BIGINT * (any_value(r.r_cached) / 1e12::DOUBLE) AS cache_read_cost,
  sum(u.cache_write_tokens)::BIGINT * (any_value(r.r_write) / 1e12::DOUBLE) AS cache_write_cost,
  sum(u.output_tokens)::BIGINT * (any_value(r.r_out) / 1e12::DOUBLE) AS output_cost,
  any_value(r.mult) AS fast_multiplier
FROM usage_normal u
JOIN rates r ON r.scheme = 'usd' AND r.version = 'api-usd-2026-07-30' AND r.name = u.model
GROUP BY u.model""",
)

ORACLES["pricing_version"] = v.with_ctes(
    v.USAGE_RAW,
    select=f"""SELECT {DAY} AS local_date, count(*) AS events,
  'subscription-credit-2026-07-30+api-usd-2026-07-30' AS pricing_version FROM usage_raw GROUP BY 1""",
)

ORACLES["price_boundaries"] = v.with_ctes(
    v.USAGE_RAW + ",\n" + v.RATES + """,
points AS (SELECT from_ms AS at_ms FROM rates UNION SELECT to_ms FROM rates WHERE to_ms IS NOT NULL)""",
    select="""SELECT at_ms, count(u.source_key) AS events_before FROM points
  LEFT JOIN usage_raw u ON u.observed_at_ms < at_ms GROUP BY at_ms""",
)

ORACLES["quality_union"] = v.with_ctes(
    v.USAGE_NORMAL + ",\n" + v.priced("usage_normal"),
    select=f"""SELECT session_id, {v.flag_text('flatten(list(price_flags))')} AS quality FROM priced GROUP BY session_id""",
)

_WINDOW_COLUMNS = (
    "window_id, account_key, limit_id, window_kind, window_start_ms, resets_at_ms, "
    "window_minutes, plan_type, inferred_after_gap, ordinal"
)
ORACLES["canonical_limit"] = v.with_ctes(
    v.EVENTS + v.QUOTA_CANONICAL, select="SELECT * FROM quota_kept"
)
ORACLES["reset_windows"] = v.with_ctes(
    v.EVENTS + v.WINDOWS, select=f"SELECT {_WINDOW_COLUMNS} FROM open_windows"
)
ORACLES["disjoint_windows"] = v.with_ctes(
    v.EVENTS + v.WINDOWS, select=f"SELECT {_WINDOW_COLUMNS} FROM windows"
)
ORACLES["usage_window_asof"] = v.with_ctes(
    v.USAGE_DEDUP + v.WINDOWS + v.usage_windowed("usage_dedup"),
    select="SELECT source_key, window_id FROM usage_windowed",
)
ORACLES["asof_by_account"] = """
WITH seen AS (SELECT event_id, user_id, epoch_ms(ts) AS at_ms, event_type FROM events),
w AS (SELECT 'w' || event_id AS window_id, user_id, at_ms, user_id::VARCHAR AS quota_group, event_id AS ordinal
      FROM seen WHERE event_type = 'error'),
own AS (SELECT user_id, at_ms, arg_max(window_id, ordinal) AS window_id FROM w GROUP BY ALL),
own_head AS (SELECT user_id, arg_min(window_id, (at_ms, ordinal)) AS window_id FROM w GROUP BY ALL),
line AS (SELECT at_ms, arg_max(window_id, (quota_group, ordinal)) AS window_id FROM w GROUP BY ALL),
head AS (SELECT arg_min(window_id, (at_ms, quota_group, ordinal)) AS window_id FROM w)
SELECT event_id, coalesce(own.window_id, own_head.window_id) AS own_window_id,
       coalesce(line.window_id, (SELECT window_id FROM head)) AS window_id
FROM seen s
ASOF LEFT JOIN own ON own.user_id = s.user_id AND own.at_ms <= s.at_ms
ASOF LEFT JOIN line ON line.at_ms <= s.at_ms
LEFT JOIN own_head ON own_head.user_id = s.user_id
"""
ORACLES["quota_window"] = v.with_ctes(
    v.EVENTS + v.WINDOWS + v.POINTS, select="SELECT source_key, window_id FROM quota_windowed"
)
ORACLES["official_point"] = v.with_ctes(
    v.EVENTS + v.WINDOWS + v.POINTS,
    select="SELECT minute_start_ms, window_id, official_used_percent, official_source FROM points",
)
_OFFICIAL_WINDOW = """,
window_rises AS (
  SELECT window_id, minute_start_ms, official_used_percent,
    official_used_percent - lag(official_used_percent) OVER (PARTITION BY window_id ORDER BY minute_start_ms) AS rise
  FROM points WHERE official_used_percent IS NOT NULL AND window_id IS NOT NULL),
official_window AS (
  SELECT window_id, arg_min(official_used_percent, minute_start_ms) AS official_percent_start,
    arg_max(official_used_percent, minute_start_ms) AS official_percent_end,
    nullif(sum(CASE WHEN rise >= 0 THEN rise END), 0) AS official_percent_delta
  FROM window_rises GROUP BY window_id)"""
ORACLES["official_delta"] = v.with_ctes(
    v.EVENTS + v.WINDOWS + v.POINTS + _OFFICIAL_WINDOW, select="SELECT * FROM official_window"
)
_OFFICIAL_DAY = """,
day_seen AS (
  SELECT p.*, strftime(make_timestamp((p.minute_start_ms + 28800000) * 1000), '%Y-%m-%d') AS local_date,
    w.ordinal > 0 AND w.window_start_ms - w.window_start_ms % 60000 = p.minute_start_ms AS marked,
    w.inferred_after_gap
  FROM points p JOIN windows w USING (window_id)
  WHERE w.window_kind = 'primary' AND p.official_used_percent IS NOT NULL),
day_rises AS (
  SELECT *, official_used_percent - lag(official_used_percent)
    OVER (PARTITION BY local_date, window_id ORDER BY minute_start_ms) AS rise FROM day_seen),
official_day AS (
  SELECT local_date, arg_min(official_used_percent, (minute_start_ms, window_id)) AS official_percent_start,
    arg_max(official_used_percent, (minute_start_ms, window_id)) AS official_percent_end,
    nullif(sum(CASE WHEN rise >= 0 THEN rise END), 0) AS official_percent_delta,
    count(DISTINCT CASE WHEN marked THEN window_id END) AS reset_count,
    CASE WHEN bool_or(inferred_after_gap) THEN ['inferred_after_gap'] ELSE [] END AS official_flags
  FROM day_rises GROUP BY local_date)"""
ORACLES["reset_count"] = v.with_ctes(
    v.EVENTS + v.WINDOWS + v.POINTS + _OFFICIAL_DAY,
    select="SELECT local_date, reset_count FROM official_day",
)

ORACLES["usage_turn"] = v.with_ctes(
    v.USAGE_DEDUP + v.TURN_RAW + v.usage_turned("usage_dedup"),
    select="SELECT source_key, turn_id, turn_started_ms, turn_ended_ms FROM usage_turned",
)

ORACLES["usage_daily"] = v.with_ctes(
    PRICED_FACTS + v.POINTS + _OFFICIAL_DAY + v.ACCOUNT_DAYS + v.plan_split("local_date")
    + ",\n" + v.CAPACITIES,
    select=f"""
SELECT coalesce(t.grain, o.local_date) AS local_date, 'acct' AS account_key, 'chatgpt' AS auth_kind,
  t.plan_type, t.capacity_profile, {TOKENS}, {MONEY},
  local_credit_micros / 1000000.0::DOUBLE / c.weekly_credit * 100.0::DOUBLE AS local_percent,
  a.tokens AS account_tokens, a.tokens - total_tokens AS unobserved_tokens,
  CASE WHEN a.tokens > 0 THEN total_tokens::DOUBLE / a.tokens::DOUBLE END AS coverage_ratio,
  CASE WHEN a.tokens IS NOT NULL THEN 'settled' ELSE 'unavailable' END AS account_token_freshness,
  official_percent_start, official_percent_end, official_percent_delta, coalesce(reset_count, 0) AS reset_count,
  {v.flag_text('''list_concat(coalesce(t.flags, []), coalesce(o.official_flags, []), list_filter([
    CASE WHEN t.grain IS NOT NULL AND credit_micros IS NULL THEN 'missing_pricing' END,
    CASE WHEN official_percent_start IS NULL THEN 'official_unavailable' END,
    CASE WHEN a.tokens IS NULL THEN 'account_tokens_unavailable' END], lambda x: x IS NOT NULL))''')} AS quality
FROM totals t FULL JOIN official_day o ON o.local_date = t.grain
LEFT JOIN account_days a ON a.date = coalesce(t.grain, o.local_date)
LEFT JOIN capacities c ON c.profile_code = t.capacity_profile""",
)

ORACLES["dominant_plan"] = v.with_ctes(
    PRICED_FACTS + v.plan_split("local_date"),
    select=f"""SELECT grain AS local_date, plan_type, capacity_profile AS local_profile, local_credit_micros,
  total_tokens, credit_micros FROM totals""",
)

_WINDOW_TOKENS = """,
window_tokens AS (
  SELECT w.window_id, sum(a.tokens)::BIGINT AS account_tokens FROM windows w JOIN account_days a
    ON a.date >= strftime(make_timestamp((w.window_start_ms + 28800000) * 1000), '%Y-%m-%d')
   AND a.date <= coalesce(strftime(make_timestamp((w.resets_at_ms + 28800000) * 1000), '%Y-%m-%d'), '9999-12-31')
  GROUP BY w.window_id)"""
ORACLES["window_account_tokens"] = v.with_ctes(
    v.USAGE_RAW + v.WINDOWS + v.ACCOUNT_DAYS + _WINDOW_TOKENS, select="SELECT * FROM window_tokens"
)

ORACLES["usage_window"] = v.with_ctes(
    PRICED_FACTS + v.POINTS + _OFFICIAL_WINDOW + v.ACCOUNT_DAYS + _WINDOW_TOKENS
    + v.plan_split("window_id") + ",\n" + v.CAPACITIES,
    select=f"""
SELECT w.window_id, w.account_key, w.limit_id, w.window_kind, w.window_start_ms, w.resets_at_ms,
  w.window_minutes, 'chatgpt' AS auth_kind, t.plan_type, CAST(NULL AS VARCHAR) AS provider, t.capacity_profile,
  {TOKENS}, {MONEY},
  local_credit_micros / 1000000.0::DOUBLE / c.weekly_credit * 100.0::DOUBLE AS local_percent,
  a.account_tokens, a.account_tokens - total_tokens AS unobserved_tokens,
  CASE WHEN a.account_tokens > 0 THEN total_tokens::DOUBLE / a.account_tokens::DOUBLE END AS coverage_ratio,
  official_percent_start, official_percent_end, official_percent_delta,
  {v.flag_text('''list_concat(coalesce(t.flags, []), list_filter([
    CASE WHEN w.inferred_after_gap THEN 'inferred_after_gap' END,
    CASE WHEN a.account_tokens IS NULL THEN 'account_tokens_unavailable' END], lambda x: x IS NOT NULL))''')} AS quality
FROM windows w LEFT JOIN totals t ON t.grain = w.window_id
LEFT JOIN official_window o ON o.window_id = w.window_id
LEFT JOIN window_tokens a ON a.window_id = w.window_id
LEFT JOIN capacities c ON c.profile_code = t.capacity_profile""",
)

_MINUTE = """,
minute_usage AS (
  SELECT minute_start_ms, window_id AS window_key, """ + SUMS + """,
    sum(credit_micros)::BIGINT AS credit_micros, sum(api_usd_micros)::BIGINT AS api_usd_micros,
    flatten(list(flags)) AS flags,
    last(plan_type ORDER BY observed_at_ms, source_key) FILTER (plan_type IS NOT NULL) AS last_plan,
    list_distinct(list(plan_type) FILTER (plan_type IS NOT NULL)) AS plans,
    first(provider ORDER BY observed_at_ms, source_key) FILTER (provider IS NOT NULL) AS first_provider,
    min((observed_at_ms, source_key)) FILTER (provider IS NOT NULL) AS provider_order
  FROM facts GROUP BY 1, 2),
minute_both AS (
  SELECT coalesce(u.minute_start_ms, p.minute_start_ms) AS minute_start_ms,
    coalesce(u.window_key, p.window_id) AS window_key, u.* EXCLUDE (minute_start_ms, window_key),
    p.official_used_percent, p.official_source, p.quota_account_key, p.quota_plan_type,
    p.window_id IS NOT NULL AS has_quota
  FROM minute_usage u FULL JOIN points p ON p.minute_start_ms = u.minute_start_ms AND p.window_id = u.window_key),
minute_all AS (
  SELECT m.*, w.window_id, w.window_kind, w.window_start_ms, w.resets_at_ms, w.ordinal, w.inferred_after_gap,
    coalesce(w.plan_type, m.quota_plan_type) AS start_plan, w.account_key
  FROM minute_both m LEFT JOIN windows w ON w.window_id = m.window_key)"""
_MINUTE_PLAN = "coalesce(last_plan, start_plan)"
ORACLES["usage_minute"] = v.with_ctes(
    PRICED_FACTS + v.POINTS + _MINUTE,
    select=f"""
SELECT minute_start_ms || ':' || window_key AS bucket_key, minute_start_ms,
  strftime(make_timestamp((minute_start_ms + 28800000) * 1000), '%Y-%m-%d') AS local_date,
  account_key, 'chatgpt' AS auth_kind, {_MINUTE_PLAN} AS plan_type, first_provider AS provider,
  CASE WHEN {_MINUTE_PLAN} IS NULL OR lower({_MINUTE_PLAN}) IN ('api', 'unknown') THEN NULL
       ELSE CASE lower({_MINUTE_PLAN}) WHEN 'plus' THEN 'usd20' WHEN 'team' THEN 'usd100' ELSE 'usd200' END
  END AS capacity_profile,
  window_id, window_kind, window_start_ms, resets_at_ms,
  ordinal > 0 AND (window_start_ms = minute_start_ms
    OR (has_quota AND window_start_ms - window_start_ms % 60000 = minute_start_ms)) AS reset_marker,
  {TOKENS}, {MONEY}, official_used_percent, official_source,
  {v.flag_text('''list_concat(coalesce(flags, []), list_filter([
    CASE WHEN len(list_distinct(list_append(coalesce(plans, []), start_plan))) > 1 THEN 'mixed_plan' END,
    CASE WHEN inferred_after_gap THEN 'inferred_after_gap' END], lambda x: x IS NOT NULL))''')} AS quality
FROM minute_all""",
)

_SESSION = v.SESSION_RAW + """,
keyed AS (
  SELECT f.*, coalesce(f.root_session_id, f.session_id) AS root_key, w.resets_at_ms,
    greatest(epoch_ms(CAST(f.local_date AS TIMESTAMP)) - 28800000, w.window_start_ms) AS low,
    least(epoch_ms(CAST(f.local_date AS TIMESTAMP)) + 57600000, coalesce(w.resets_at_ms, 9223372036854775807)) AS high
  FROM facts f LEFT JOIN windows w USING (window_id)),
session_rows AS (
  SELECT *, root_key || ':' || coalesce(turn_id, 'unknown') || ':' || local_date || ':' || coalesce(window_id, 'none') AS row_key,
    greatest(coalesce(turn_started_ms, observed_at_ms), low) AS started,
    CASE WHEN turn_ended_ms IS NOT NULL THEN least(turn_ended_ms, high) END AS ended,
    list_concat(flags, list_filter([
      CASE WHEN root_session_id IS NULL THEN 'root_unresolved' END,
      CASE WHEN turn_started_ms < low OR turn_ended_ms > high THEN 'split_boundary' END], lambda x: x IS NOT NULL)) AS row_flags
  FROM keyed),
model_rows AS (
  SELECT row_key, local_date, model, coalesce(service_tier, 'unknown') AS tier,
    coalesce(reasoning_effort, 'unknown') AS reasoning_effort, sum(total_tokens)::BIGINT AS tokens,
    sum(credit_micros)::BIGINT / 1000000.0::DOUBLE AS credit, sum(api_usd_micros)::BIGINT / 1000000.0::DOUBLE AS api_usd
  FROM session_rows GROUP BY ALL)"""
ORACLES["model_breakdown"] = v.with_ctes(
    PRICED_FACTS + _SESSION, select="SELECT * FROM model_rows"
)

_SESSION_ALL = _SESSION + ",\n" + """session_sum AS (
  SELECT row_key, any_value(local_date) AS local_date, """ + SUMS + """,
    sum(credit_micros)::BIGINT AS credit_micros, sum(api_usd_micros)::BIGINT AS api_usd_micros,
    flatten(list(row_flags)) AS flags, min(started) AS started_at_ms, max(ended) AS ended_at_ms,
    min(observed_at_ms) AS first_ms, max(observed_at_ms) AS last_ms,
    min((observed_at_ms, source_key)) AS first_order,
    first(root_session_id ORDER BY observed_at_ms, source_key) AS root_session_id,
    first(root_key ORDER BY observed_at_ms, source_key) AS root_key,
    first(session_id ORDER BY observed_at_ms, source_key) AS session_id,
    first(turn_id ORDER BY observed_at_ms, source_key) AS turn_id,
    first(relation ORDER BY observed_at_ms, source_key) AS relation,
    first(window_id ORDER BY observed_at_ms, source_key) AS window_id,
    first(plan_type ORDER BY observed_at_ms, source_key) AS plan_type,
    first(minute_start_ms ORDER BY observed_at_ms, source_key) AS minute_start_ms,
    count(DISTINCT (model, coalesce(service_tier, 'unknown'), coalesce(reasoning_effort, 'unknown'))) AS triples,
    min(model) AS only_model, list_sort(list_distinct(list(coalesce(service_tier, 'unknown')))) AS tiers
  FROM session_rows GROUP BY row_key),
session_points AS (
  SELECT s.row_key, arg_min(p.official_used_percent, p.minute_start_ms) AS official_percent_start,
    arg_max(p.official_used_percent, p.minute_start_ms) AS official_percent_end
  FROM session_sum s JOIN points p ON p.window_id = s.window_id AND p.official_used_percent IS NOT NULL
   AND p.minute_start_ms BETWEEN s.first_ms - s.first_ms % 60000 AND s.last_ms - s.last_ms % 60000
  GROUP BY s.row_key)"""
ORACLES["session_official"] = v.with_ctes(
    PRICED_FACTS + v.POINTS + _SESSION_ALL,
    select="""SELECT s.row_key, official_percent_start, official_percent_end
FROM session_sum s LEFT JOIN session_points p USING (row_key)""",
)
ORACLES["usage_session"] = v.with_ctes(
    PRICED_FACTS + v.POINTS + _MINUTE + _SESSION_ALL,
    select=f"""
SELECT s.row_key, s.local_date, s.root_session_id, s.session_id, s.turn_id,
  coalesce(r.title, o.title) AS title,
  coalesce(s.relation, o.relation, CASE WHEN s.session_id <> s.root_key THEN 'child' ELSE 'main' END) AS relation,
  s.started_at_ms, s.ended_at_ms, s.window_id, m.account_key, 'chatgpt' AS auth_kind, s.plan_type,
  CASE WHEN m.provider_order <= s.first_order THEN m.first_provider END AS provider,
  CASE WHEN s.plan_type IS NULL OR lower(s.plan_type) IN ('api', 'unknown') THEN NULL
       ELSE CASE lower(s.plan_type) WHEN 'plus' THEN 'usd20' WHEN 'team' THEN 'usd100' ELSE 'usd200' END
  END AS capacity_profile,
  CASE WHEN triples = 1 THEN only_model END AS primary_model,
  CASE WHEN len(tiers) > 1 THEN 'mixed' WHEN tiers = ['fast'] THEN 'fast' ELSE 'standard' END AS fast_state,
  {", ".join("s." + t.strip() for t in TOKENS.split(","))},
  s.credit_micros / 1000000.0::DOUBLE AS credit, s.api_usd_micros / 1000000.0::DOUBLE AS api_usd,
  p.official_percent_start, p.official_percent_end,
  {v.flag_text('''list_concat(s.flags, CASE WHEN p.official_percent_start IS NULL
    THEN ['official_unavailable'] ELSE [] END)''')} AS quality
FROM session_sum s
LEFT JOIN session_raw r ON r.session_id = s.root_key
LEFT JOIN session_raw o ON o.session_id = s.session_id
LEFT JOIN minute_all m ON m.minute_start_ms = s.minute_start_ms AND m.window_key = s.window_id
LEFT JOIN session_points p ON p.row_key = s.row_key""",
)

ORACLES["usage_session_meta"] = v.with_ctes(
    v.USAGE_DEDUP + v.SESSION_RAW,
    select="""
SELECT u.source_key, coalesce(r.title, o.title) AS title,
  coalesce(u.relation, o.relation, CASE WHEN u.session_id <> coalesce(u.root_session_id, u.session_id)
    THEN 'child' ELSE 'main' END) AS relation
FROM usage_dedup u
LEFT JOIN session_raw r ON r.session_id = coalesce(u.root_session_id, u.session_id)
LEFT JOIN session_raw o ON o.session_id = u.session_id""",
)

ORACLES["day_account_tokens"] = v.with_ctes(
    v.USAGE_RAW + v.ACCOUNT_DAYS,
    select=f"""
SELECT d.local_date, d.total_tokens, a.tokens AS account_tokens, a.tokens - d.total_tokens AS unobserved_tokens,
  CASE WHEN a.tokens > 0 THEN d.total_tokens::DOUBLE / a.tokens::DOUBLE END AS coverage_ratio,
  CASE WHEN a.tokens IS NOT NULL THEN 'settled' ELSE 'unavailable' END AS account_token_freshness
FROM (SELECT {DAY} AS local_date, sum(total_tokens)::BIGINT AS total_tokens FROM usage_raw GROUP BY 1) d
LEFT JOIN account_days a ON a.date = d.local_date""",
)

ORACLES["quota_union"] = v.with_ctes(
    v.EVENTS + v.QUOTA_RAW,
    select="""
SELECT source_key, first_seen_at_ms, last_seen_at_ms, account_key, limit_id,
  CASE WHEN source = 'app_server' THEN 'primary' ELSE window_kind END AS window_kind, used_percent, resets_at_ms,
  CASE WHEN source = 'app_server' THEN coalesce(plan_type, 'pro') ELSE plan_type END AS plan_type, source, priority
FROM quota_raw""",
)

# What is equal to another operator's result by definition has its oracle.
ORACLES["daily_from_facts"] = ORACLES["daily_refreshed"] = ORACLES["usage_daily"]
ORACLES["reset_windows_live"] = ORACLES["reset_windows"]
