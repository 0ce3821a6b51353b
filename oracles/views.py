"""Common table expressions: the metering views over the given tables."""

from meterline.fixed_values import (
    CAPACITY_DEFAULTS,
    CREDIT_RATES,
    CREDIT_VERSIONS,
    USD_RATES,
    USD_VERSIONS,
)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return f"'{value}'"
    return str(value)


def _catalog_rows(scheme: str, versions, rates) -> list[str]:
    rows = []
    for version_no, (version, start, end, threshold) in enumerate(versions):
        for rate_no, rate in enumerate(rates[version]):
            model, aliases, *numbers = rate
            long_card = numbers[5] if len(numbers) > 5 and numbers[5] else (None,) * 4
            for name in [model, *aliases]:
                values = [scheme, version, version_no, start, end, threshold, rate_no, model, name,
                          *numbers[:5], *long_card]
                rows.append("(" + ", ".join(_sql(v) for v in values) + ")")
    return rows


_NAMES = (
    "scheme, version, version_no, from_ms, to_ms, threshold, rate_no, model, name, "
    "r_in, r_cached, r_write, r_out, mult, l_in, l_cached, l_write, l_out"
)
RATES = (
    "rates_text AS (SELECT * FROM (VALUES\n"
    + ",\n".join(
        _catalog_rows("credit", CREDIT_VERSIONS, CREDIT_RATES)
        + _catalog_rows("usd", USD_VERSIONS, USD_RATES)
    )
    + f") AS t({_NAMES})),\n"
    "rates AS (SELECT scheme, version, version_no, from_ms::BIGINT AS from_ms, "
    "to_ms::BIGINT AS to_ms, threshold::BIGINT AS threshold, rate_no, model, name, "
    "r_in::BIGINT AS r_in, r_cached::BIGINT AS r_cached, r_write::BIGINT AS r_write, "
    "r_out::BIGINT AS r_out, mult::DOUBLE AS mult, l_in::BIGINT AS l_in, "
    "l_cached::BIGINT AS l_cached, l_write::BIGINT AS l_write, l_out::BIGINT AS l_out "
    "FROM rates_text)"
)

CAPACITIES = (
    "capacities AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', {v}::DOUBLE)" for c, v in sorted(CAPACITY_DEFAULTS.items()))
    + ") AS t(profile_code, weekly_credit))"
)

EVENTS = """
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         epoch_us(ts) // 1000 + 80006400000 AS observed_at_ms
  FROM events)"""

USAGE_RAW = EVENTS + """,
usage_base AS (
  SELECT 'usage:' || event_id AS source_key, event_id, observed_at_ms,
         's' || user_id AS session_id,
         CASE WHEN user_id >= 50 THEN 's' || (user_id - 50) END AS parent_session_id,
         CASE WHEN user_id % 13 <> 0 THEN 's' || (user_id % 50) END AS root_session_id,
         CASE event_id % 5 WHEN 0 THEN 's' || user_id || ':' || ((observed_at_ms + 28800000) // 3600000)
              WHEN 1 THEN 'x' || event_id END AS turn_id,
         CASE WHEN user_id < 50 THEN 'main' WHEN user_id % 2 = 0 THEN 'child' ELSE 'fork' END AS relation,
         CASE event_type WHEN 'click' THEN 'gpt-5.6-sol' WHEN 'view' THEN 'gpt-5.6-terra'
              WHEN 'purchase' THEN 'gpt-5.4-mini-2026' WHEN 'signup' THEN 'codex-auto-review'
              ELSE 'not-a-model' END AS model,
         CASE event_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' END AS service_tier,
         CASE WHEN event_id % 2 = 0 THEN 'high' END AS reasoning_effort,
         CASE WHEN user_id % 10 = 4 THEN 'pro' END AS provider,
         CASE user_id % 5 WHEN 0 THEN 'plus' WHEN 1 THEN 'team' WHEN 2 THEN 'pro' WHEN 3 THEN 'api' END AS plan_type,
         CAST(round(value * 1000) AS BIGINT) AS input_tokens,
         CAST(round(value * 1000) AS BIGINT) * k // 100 AS cache_read_tokens,
         CASE WHEN event_id % 7 = 0 THEN k ELSE 0 END AS cache_write_tokens,
         k * 10 AS output_tokens, k * 4 AS reasoning_tokens,
         CAST(round(value * 1000) AS BIGINT) + k * 10 AS total_tokens
  FROM ev),
usage_raw AS (
  SELECT * EXCLUDE (event_id) FROM usage_base
  UNION ALL BY NAME
  SELECT * EXCLUDE (event_id) REPLACE ('dup:' || event_id AS source_key, 'child' AS relation,
         'standard' AS service_tier, 'low' AS reasoning_effort, CAST(NULL AS VARCHAR) AS provider)
  FROM usage_base WHERE event_id % 11 = 0)"""

USAGE_NORMAL = USAGE_RAW + """,
usage_normal AS (
  SELECT * REPLACE (
      greatest(input_tokens, 0) AS input_tokens,
      least(greatest(cache_read_tokens, 0), greatest(input_tokens, 0)) AS cache_read_tokens,
      greatest(cache_write_tokens, 0) AS cache_write_tokens,
      greatest(output_tokens, 0) AS output_tokens,
      least(greatest(reasoning_tokens, 0), greatest(output_tokens, 0)) AS reasoning_tokens,
      CASE WHEN total_tokens <= 0 THEN greatest(input_tokens, 0) + greatest(output_tokens, 0)
           ELSE total_tokens END AS total_tokens)
  FROM usage_raw)"""

USAGE_DEDUP = USAGE_NORMAL + """,
ranked AS (
  SELECT *, coalesce(root_session_id, session_id) AS owner,
         CASE WHEN lower(model) = 'codex-auto-review' THEN 'gpt-5.5' ELSE lower(model) END AS card,
         CASE WHEN relation IN ('child', 'fork') THEN 1 ELSE 0 END AS copied
  FROM usage_normal
  WHERE input_tokens <> 0 OR cache_read_tokens <> 0 OR cache_write_tokens <> 0
     OR output_tokens <> 0 OR reasoning_tokens <> 0 OR total_tokens <> 0),
usage_dedup AS (
  SELECT first(source_key ORDER BY copied, source_key) AS source_key,
         observed_at_ms,
         first(session_id ORDER BY copied, source_key) AS session_id,
         first(root_session_id ORDER BY copied, source_key) FILTER (root_session_id IS NOT NULL) AS root_session_id,
         first(turn_id ORDER BY copied, source_key) FILTER (turn_id IS NOT NULL) AS turn_id,
         first(relation ORDER BY copied, source_key) AS relation,
         first(model ORDER BY copied, source_key) FILTER (model IS NOT NULL) AS model,
         CASE WHEN bool_or(service_tier = 'standard') THEN 'standard'
              WHEN bool_or(service_tier = 'fast') THEN 'fast'
              ELSE first(service_tier ORDER BY copied, source_key) FILTER (service_tier IS NOT NULL) END AS service_tier,
         first(reasoning_effort ORDER BY copied, source_key) FILTER (reasoning_effort IS NOT NULL) AS reasoning_effort,
         first(provider ORDER BY copied, source_key) FILTER (provider IS NOT NULL) AS provider,
         first(plan_type ORDER BY copied, source_key) FILTER (plan_type IS NOT NULL) AS plan_type,
         input_tokens, cache_read_tokens, cache_write_tokens, output_tokens, reasoning_tokens, total_tokens
  FROM ranked
  GROUP BY owner, observed_at_ms, card, input_tokens, cache_read_tokens, cache_write_tokens,
           output_tokens, reasoning_tokens, total_tokens)"""


def priced(source: str) -> str:
    """Versions, rates and amounts of a usage relation, as CTEs ending in ``priced``."""
    return RATES + f""",
versions AS (SELECT DISTINCT scheme, version, version_no, from_ms, to_ms FROM rates),
with_version AS (
  SELECT u.*,
    (SELECT arg_max(version, from_ms) FROM versions v WHERE v.scheme = 'credit'
       AND v.from_ms <= u.observed_at_ms AND (v.to_ms IS NULL OR u.observed_at_ms < v.to_ms)) AS credit_version,
    (SELECT arg_max(version, from_ms) FROM versions v WHERE v.scheme = 'usd'
       AND v.from_ms <= u.observed_at_ms AND (v.to_ms IS NULL OR u.observed_at_ms < v.to_ms)) AS usd_version
  FROM {source} u),
names AS (SELECT DISTINCT lower(model) AS model_key FROM {source} WHERE model IS NOT NULL),
matched AS (
  SELECT n.model_key, r.*,
         row_number() OVER (PARTITION BY n.model_key, r.scheme, r.version ORDER BY
           CASE WHEN n.model_key = lower(r.name) THEN 1000000 + length(r.name) ELSE length(r.name) END DESC,
           r.rate_no DESC) AS place
  FROM names n JOIN rates r ON n.model_key = lower(r.name) OR starts_with(n.model_key, lower(r.name) || '-')),
best AS (SELECT * FROM matched WHERE place = 1),
amounts AS (
  SELECT w.*, c.model AS credit_model, d.model AS usd_model, c.mult AS credit_mult, d.mult AS usd_mult,
    (greatest(input_tokens - cache_read_tokens, 0)::HUGEINT * c.r_in + cache_read_tokens::HUGEINT * c.r_cached
      + cache_write_tokens::HUGEINT * c.r_write + output_tokens::HUGEINT * c.r_out + 500000) // 1000000 AS credit_base,
    CASE WHEN d.threshold IS NOT NULL AND d.l_in IS NOT NULL AND input_tokens > d.threshold THEN
      (greatest(input_tokens - cache_read_tokens, 0)::HUGEINT * d.l_in + cache_read_tokens::HUGEINT * d.l_cached
        + cache_write_tokens::HUGEINT * d.l_write + output_tokens::HUGEINT * d.l_out + 500000) // 1000000
    ELSE
      (greatest(input_tokens - cache_read_tokens, 0)::HUGEINT * d.r_in + cache_read_tokens::HUGEINT * d.r_cached
        + cache_write_tokens::HUGEINT * d.r_write + output_tokens::HUGEINT * d.r_out + 500000) // 1000000
    END AS usd_base
  FROM with_version w
  LEFT JOIN best c ON c.scheme = 'credit' AND c.version = w.credit_version AND c.model_key = lower(w.model)
  LEFT JOIN best d ON d.scheme = 'usd' AND d.version = w.usd_version AND d.model_key = lower(w.model)),
priced AS (
  SELECT *,
    CASE WHEN credit_model IS NULL OR usd_model IS NULL THEN NULL
         WHEN service_tier = 'fast' AND credit_mult IS NOT NULL AND usd_mult IS NOT NULL
           THEN CAST(round(credit_base::DOUBLE * credit_mult) AS BIGINT)
         ELSE credit_base::BIGINT END AS credit_micros,
    CASE WHEN credit_model IS NULL OR usd_model IS NULL THEN NULL
         WHEN service_tier = 'fast' AND credit_mult IS NOT NULL AND usd_mult IS NOT NULL
           THEN CAST(round(usd_base::DOUBLE * usd_mult) AS BIGINT)
         ELSE usd_base::BIGINT END AS api_usd_micros,
    CASE WHEN credit_model IS NULL OR usd_model IS NULL THEN ['missing_pricing']
         ELSE list_filter([
           CASE WHEN service_tier IS NULL OR service_tier NOT IN ('fast', 'standard')
                THEN 'service_tier_unclassified' END,
           CASE WHEN service_tier = 'fast' AND (credit_mult IS NULL OR usd_mult IS NULL)
                THEN 'fast_unsupported_fallback_standard' END], lambda x: x IS NOT NULL) END AS price_flags
  FROM amounts)"""


QUOTA_RAW = """,
quota_ev AS (
  SELECT event_id, observed_at_ms, observed_at_ms - 1784044800000 AS o,
         (observed_at_ms - 1784044800000) // 604800000 AS week
  FROM ev),
quota_class AS (
  SELECT *, CASE WHEN event_id % 20 BETWEEN 14 AND 16 THEN 'rolling' WHEN event_id % 20 >= 17 THEN 'secondary'
            ELSE 'weekly' END AS class FROM quota_ev),
quota_raw AS (
  SELECT CASE WHEN class = 'rolling' THEN 'rolling' ELSE 'codex' END || ':'
      || CASE WHEN class = 'secondary' THEN 'secondary' ELSE 'primary' END || ':' || event_id AS source_key,
    observed_at_ms AS first_seen_at_ms, observed_at_ms AS last_seen_at_ms, 'acct' AS account_key,
    CASE WHEN class = 'rolling' THEN 'rolling' ELSE 'codex' END AS limit_id,
    CASE WHEN class = 'secondary' THEN 'secondary' ELSE 'primary' END AS window_kind,
    CASE class WHEN 'rolling' THEN 0 WHEN 'secondary' THEN CASE WHEN (o // 86400000) % 5 < 3 THEN 97 ELSE 5 END
      ELSE (o % 604800000) * 100 // 604800000 END::DOUBLE AS used_percent,
    10080::BIGINT AS window_minutes,
    CASE class WHEN 'rolling' THEN observed_at_ms + 604800000
      WHEN 'weekly' THEN 1784044800000 + (week + 1) * 604800000 END AS resets_at_ms,
    CASE WHEN week % 2 = 0 THEN 'plus' END AS plan_type,
    CASE WHEN class <> 'secondary' AND event_id % 2 = 0 THEN 'app_server' ELSE 'jsonl' END AS source,
    CASE WHEN class <> 'secondary' AND event_id % 2 = 0 THEN 2 ELSE 1 END AS priority
  FROM quota_class)"""

QUOTA_CANONICAL = QUOTA_RAW + """,
quota_kept AS (
  SELECT * FROM quota_raw q
  WHERE window_kind <> 'primary' OR limit_id = 'codex'
     OR account_key NOT IN (SELECT account_key FROM quota_raw
                            WHERE window_kind = 'primary' AND limit_id = 'codex'))"""

# The fold: one reduction over the ordered observations of a group.
WINDOWS = QUOTA_CANONICAL + """,
quota_line AS (
  SELECT *, account_key || ':' || limit_id || ':' || window_kind AS quota_group,
         row_number() OVER (PARTITION BY account_key, limit_id, window_kind
           ORDER BY first_seen_at_ms, last_seen_at_ms, priority, source_key) AS place
  FROM quota_kept),
folded AS (
  SELECT quota_group, list_reduce(
      list({'p': used_percent, 'r': resets_at_ms, 'src': source, 't': first_seen_at_ms, 'place': place,
            'starts': CASE WHEN place = 1 THEN [{'place': place, 'inferred': false}] ELSE [] END}
           ORDER BY place),
      lambda a, x: {
        'p': CASE WHEN coalesce(x.p + 5 < a.p AND x.r - a.r > 300000, false)
                    OR coalesce(a.src = 'jsonl' AND x.src = 'jsonl' AND x.t - a.t >= 1800000 AND a.p >= 50
                        AND x.p <= 50 AND a.p - x.p >= 40 AND NOT (a.r IS NOT NULL AND x.r IS NOT NULL), false)
                  THEN x.p ELSE greatest(coalesce(a.p, x.p), coalesce(x.p, a.p)) END,
        'r': greatest(coalesce(a.r, x.r), coalesce(x.r, a.r)),
        'src': x.src, 't': x.t, 'place': x.place,
        'starts': CASE WHEN coalesce(x.p + 5 < a.p AND x.r - a.r > 300000, false)
            THEN list_append(a.starts, {'place': x.place, 'inferred': false})
          WHEN coalesce(a.src = 'jsonl' AND x.src = 'jsonl' AND x.t - a.t >= 1800000 AND a.p >= 50
            AND x.p <= 50 AND a.p - x.p >= 40 AND NOT (a.r IS NOT NULL AND x.r IS NOT NULL), false)
            THEN list_append(a.starts, {'place': x.place, 'inferred': true})
          ELSE a.starts END}).starts AS starts
  FROM quota_line GROUP BY quota_group),
segment_starts AS (
  SELECT quota_group, s.place AS place, s.inferred AS inferred,
    row_number() OVER (PARTITION BY quota_group ORDER BY s.place) - 1 AS ordinal,
    lead(s.place) OVER (PARTITION BY quota_group ORDER BY s.place) AS next_place
  FROM (SELECT quota_group, unnest(starts) AS s FROM folded)),
segment_rows AS (
  SELECT q.*, s.ordinal, s.inferred AND q.place = s.place AS inferred
  FROM quota_line q JOIN segment_starts s ON s.quota_group = q.quota_group AND q.place >= s.place
    AND (s.next_place IS NULL OR q.place < s.next_place)),
segments AS (
  SELECT quota_group, ordinal,
         first(account_key ORDER BY place) AS account_key, first(limit_id ORDER BY place) AS limit_id,
         first(window_kind ORDER BY place) AS window_kind, min(first_seen_at_ms) AS window_start_ms,
         max(resets_at_ms) AS max_reset,
         last(window_minutes ORDER BY place) FILTER (window_minutes IS NOT NULL) AS window_minutes,
         first(plan_type ORDER BY place) FILTER (plan_type IS NOT NULL) AS plan_type,
         bool_or(inferred) AS inferred
  FROM segment_rows GROUP BY quota_group, ordinal),
open_windows AS (
  SELECT 'window:' || quota_group || ':' || ordinal AS window_id, account_key, limit_id, window_kind,
         window_start_ms,
         CASE WHEN window_start_ms < lead(window_start_ms) OVER w THEN lead(window_start_ms) OVER w
              ELSE max_reset END AS resets_at_ms,
         window_minutes, plan_type,
         inferred OR coalesce(lead(inferred) OVER w, false) AS inferred_after_gap,
         ordinal::BIGINT AS ordinal, quota_group
  FROM segments WINDOW w AS (PARTITION BY quota_group ORDER BY ordinal)),
windows AS (
  SELECT * REPLACE (
    CASE WHEN resets_at_ms > lead(window_start_ms) OVER (PARTITION BY quota_group ORDER BY window_start_ms, ordinal)
         THEN lead(window_start_ms) OVER (PARTITION BY quota_group ORDER BY window_start_ms, ordinal)
         ELSE resets_at_ms END AS resets_at_ms)
  FROM open_windows)"""

POINTS = """,
quota_windowed AS (
  SELECT q.*, coalesce(
      (SELECT arg_max(window_id, (window_start_ms, ordinal)) FROM windows w WHERE w.window_kind = q.window_kind
         AND w.limit_id = q.limit_id AND w.account_key = q.account_key AND w.window_start_ms <= q.first_seen_at_ms),
      (SELECT arg_min(window_id, (window_start_ms, ordinal)) FROM windows w WHERE w.window_kind = q.window_kind
         AND w.limit_id = q.limit_id AND w.account_key = q.account_key)) AS window_id
  FROM quota_kept q),
points AS (
  SELECT first_seen_at_ms - first_seen_at_ms % 60000 AS minute_start_ms, window_id,
         last(used_percent ORDER BY priority, first_seen_at_ms, last_seen_at_ms, source_key)
           FILTER (used_percent IS NOT NULL) AS official_used_percent,
         last(source ORDER BY priority, first_seen_at_ms, last_seen_at_ms, source_key)
           FILTER (used_percent IS NOT NULL) AS official_source,
         first(account_key ORDER BY first_seen_at_ms, last_seen_at_ms, priority, source_key)
           FILTER (account_key IS NOT NULL) AS quota_account_key,
         first(plan_type ORDER BY first_seen_at_ms, last_seen_at_ms, priority, source_key)
           FILTER (plan_type IS NOT NULL) AS quota_plan_type
  FROM quota_windowed GROUP BY ALL)"""


def usage_windowed(source: str) -> str:
    return f""",
usage_windowed AS (
  SELECT u.*, coalesce(
      (SELECT arg_max(window_id, (window_start_ms, quota_group, ordinal)) FROM windows w
        WHERE w.window_kind = 'primary' AND w.window_start_ms <= u.observed_at_ms),
      (SELECT arg_min(window_id, (window_start_ms, quota_group, ordinal)) FROM windows w
        WHERE w.window_kind = 'primary')) AS window_id
  FROM {source} u)"""


TURN_RAW = """,
turn_raw AS (
  SELECT 's' || user_id AS session_id,
         's' || user_id || ':' || ((observed_at_ms + 28800000) // 3600000) AS turn_id,
         min(observed_at_ms) AS started_at_ms,
         CASE WHEN ((observed_at_ms + 28800000) // 3600000) % 4 <> 0
              THEN min(observed_at_ms) + max(event_id) % 5 * 2400000 END AS ended_at_ms
  FROM ev GROUP BY user_id, (observed_at_ms + 28800000) // 3600000)"""


def usage_turned(source: str) -> str:
    return f""",
usage_turned AS (
  SELECT u.* EXCLUDE (turn_id), coalesce(u.turn_id, t.turn_id) AS turn_id,
         t.started_at_ms AS turn_started_ms, t.ended_at_ms AS turn_ended_ms
  FROM {source} u
  LEFT JOIN LATERAL (
    SELECT * FROM turn_raw t
    WHERE t.session_id = u.session_id AND (t.turn_id = u.turn_id OR t.started_at_ms <= u.observed_at_ms)
    ORDER BY (t.turn_id = u.turn_id) DESC NULLS LAST,
             (t.ended_at_ms IS NULL OR u.observed_at_ms <= t.ended_at_ms) DESC,
             t.started_at_ms DESC, t.turn_id DESC
    LIMIT 1) t ON true)"""


ACCOUNT_DAYS = """,
account_days AS (
  SELECT strftime(make_timestamp((observed_at_ms + 28800000) * 1000), '%Y-%m-%d') AS date,
         CAST(round(sum(total_tokens)::BIGINT * 1.1::DOUBLE) AS BIGINT) AS tokens
  FROM usage_base GROUP BY 1
  HAVING CAST(substr(date, 9, 2) AS INTEGER) % 6 <> 0)"""

SESSION_RAW = """,
session_raw AS (
  SELECT 's' || u.user_id AS session_id,
         CASE WHEN u.user_id >= 50 THEN 's' || (u.user_id - 50) END AS parent_session_id,
         c.text AS title,
         CASE WHEN u.user_id % 3 <> 0 THEN CASE WHEN u.user_id < 50 THEN 'main' ELSE 'child' END END AS relation
  FROM (SELECT DISTINCT user_id FROM events) u
  LEFT JOIN conversations c ON c.conv_id = u.user_id AND c.turn = 0)"""

FACTS = """,
with_plan AS (
  SELECT * REPLACE (coalesce(plan_type, CASE WHEN lower(provider) = 'pro' THEN 'api' END) AS plan_type),
         observed_at_ms - observed_at_ms % 60000 AS minute_start_ms,
         strftime(make_timestamp((observed_at_ms + 28800000) * 1000), '%Y-%m-%d') AS local_date
  FROM usage_turned),
facts AS (
  SELECT * REPLACE (CASE WHEN context = 'subscription' THEN credit_micros END AS credit_micros),
    list_concat(price_flags, list_filter([
      CASE WHEN (context = 'subscription' AND credit_micros IS NULL) OR api_usd_micros IS NULL
             OR context = 'unknown' THEN 'pricing_partial' END,
      CASE WHEN context = 'unknown' THEN 'account_context_unavailable' END], lambda x: x IS NOT NULL)) AS flags,
    CASE WHEN context = 'subscription' AND lower(plan_type) <> 'unknown' THEN
      CASE lower(plan_type) WHEN 'plus' THEN 'usd20' WHEN 'team' THEN 'usd100' ELSE 'usd200' END END AS capacity_profile
  FROM (SELECT *, CASE WHEN plan_type IS NULL THEN 'unknown' WHEN lower(plan_type) = 'api' THEN 'api'
               ELSE 'subscription' END AS context FROM with_plan))"""


def plan_split(grain: str) -> str:
    """Plan entries and the dominant choice per grain: CTEs ``split`` and ``totals``."""
    return f""",
split AS (
  SELECT {grain} AS grain, plan_type, capacity_profile,
         coalesce(plan_type, 'unknown') || ':' || coalesce(capacity_profile, 'unknown') AS plan_key,
         sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens,
         sum(cache_write_tokens)::BIGINT AS cache_write_tokens, sum(output_tokens)::BIGINT AS output_tokens,
         sum(reasoning_tokens)::BIGINT AS reasoning_tokens, sum(total_tokens)::BIGINT AS total_tokens,
         sum(credit_micros)::BIGINT AS credit_micros, sum(api_usd_micros)::BIGINT AS api_usd_micros,
         flatten(list(flags)) AS flags
  FROM facts WHERE {grain} IS NOT NULL GROUP BY ALL),
scored AS (
  SELECT *, coalesce(credit_micros / 1000000.0::DOUBLE, total_tokens::DOUBLE) AS score,
         plan_type IS NOT NULL AND lower(plan_type) NOT IN ('api', 'unknown') AS is_sub
  FROM split),
totals AS (
  SELECT grain, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens,
         sum(cache_write_tokens)::BIGINT AS cache_write_tokens, sum(output_tokens)::BIGINT AS output_tokens,
         sum(reasoning_tokens)::BIGINT AS reasoning_tokens, sum(total_tokens)::BIGINT AS total_tokens,
         sum(credit_micros)::BIGINT AS credit_micros, sum(api_usd_micros)::BIGINT AS api_usd_micros,
         list_concat(flatten(list(flags)), list_filter([
           CASE WHEN count(*) > 1 THEN 'mixed_plan' END,
           CASE WHEN bool_or(lower(plan_type) = 'api') AND bool_or(is_sub) THEN 'mixed_account' END],
           lambda x: x IS NOT NULL)) AS flags,
         CASE WHEN bool_or(is_sub) THEN last(plan_type ORDER BY score, plan_key) FILTER (is_sub)
              ELSE last(plan_type ORDER BY score, plan_key) END AS plan_type,
         CASE WHEN count(*) FILTER (is_sub) = 1 THEN max(capacity_profile) FILTER (is_sub) END AS capacity_profile,
         CASE WHEN count(*) FILTER (is_sub) = 1 THEN max(credit_micros) FILTER (is_sub) END AS local_credit_micros
  FROM scored GROUP BY grain)"""


def flag_text(expr: str) -> str:
    return f"nullif(array_to_string(list_sort(list_distinct({expr})), ','), '')"


def with_ctes(*parts: str, select: str, recursive: bool = True) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + "".join(parts).strip() + "\n" + select
