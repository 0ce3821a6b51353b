"""Oracles of the log, feed, upsert and lineage queries."""

from . import views as v

LINES = v.EVENTS + """,
base AS (
  SELECT *, CAST(round(value * 1000) AS BIGINT) AS inp, event_id // 1000 AS block,
    min(event_id) OVER (PARTITION BY user_id) AS start_id FROM ev),
counted AS (
  SELECT *, (sum(inp) OVER w)::BIGINT AS cum_in, (sum(k * 10) OVER w)::BIGINT AS cum_out FROM base
  WINDOW w AS (PARTITION BY user_id, block ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
line_rows AS (
  SELECT user_id, event_id * 8 AS ord, event_id, observed_at_ms, k, 'session' AS kind,
    's' || user_id || CASE WHEN event_id % 997 = 0 THEN 'b' ELSE '' END AS sid,
    NULL::VARCHAR AS turn_value, false AS sets_turn, NULL::VARCHAR AS model_set, NULL::VARCHAR AS effort_set,
    false AS sets_tier, NULL::VARCHAR AS tier, NULL::BIGINT AS l_in, NULL::BIGINT AS l_cached, NULL::BIGINT AS l_out,
    NULL::BIGINT AS c_in, NULL::BIGINT AS c_out, false AS has_limits
  FROM counted WHERE event_id = start_id OR event_id % 401 = 0 OR event_id % 997 = 0
  UNION ALL
  SELECT user_id, event_id * 8 + 1, event_id, observed_at_ms, k, 'context', NULL,
    CASE WHEN event_id % 10 = 0 THEN 't' || event_id END, true,
    CASE event_type WHEN 'click' THEN 'gpt-5.6-sol' WHEN 'view' THEN 'gpt-5.6-terra' ELSE 'codex-auto-review' END,
    CASE WHEN k % 4 = 0 THEN 'high' END, event_id % 15 <> 0,
    CASE k % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' END, NULL, NULL, NULL, NULL, NULL, false
  FROM counted WHERE event_id % 5 = 0
  UNION ALL
  SELECT user_id, event_id * 8 + 2, event_id, observed_at_ms, k,
    CASE event_id % 7 WHEN 0 THEN 'started' WHEN 3 THEN 'complete' ELSE 'aborted' END, NULL,
    CASE event_id % 7 WHEN 0 THEN 'k' || event_id WHEN 5 THEN 'z' || event_id END, event_id % 7 <> 3,
    NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, false
  FROM counted WHERE event_id % 7 IN (0, 3, 5)
  UNION ALL
  SELECT user_id, event_id * 8 + 3, event_id, observed_at_ms, k, 'count', NULL, NULL, false, NULL, NULL, false, NULL,
    CASE WHEN event_id % 2 = 0 THEN inp END, CASE WHEN event_id % 2 = 0 THEN inp * k // 100 END,
    CASE WHEN event_id % 2 = 0 THEN k * 10 END,
    CASE WHEN event_id % 3 <> 2 THEN cum_in END, CASE WHEN event_id % 3 <> 2 THEN cum_out END, event_id % 20 = 0
  FROM counted),
sessions_seen AS (
  SELECT *, last_value(sid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS session_id,
    last_value(sid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS session_before
  FROM line_rows),
epochs AS (
  SELECT *, sid IS NOT NULL AND sid IS DISTINCT FROM session_before AS changed,
    sum(CASE WHEN sid IS NOT NULL AND sid IS DISTINCT FROM session_before THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS epoch
  FROM sessions_seen),
carried AS (
  SELECT *,
    (last_value(CASE WHEN sets_turn THEN {'id': turn_value} END IGNORE NULLS) OVER before_here).id AS turn_before,
    (last_value(CASE WHEN sets_turn THEN {'id': turn_value} END IGNORE NULLS) OVER upto_here).id AS turn_here,
    (last_value(CASE WHEN sets_tier THEN {'t': tier} END IGNORE NULLS) OVER file_here).t AS service_tier,
    last_value(model_set IGNORE NULLS) OVER file_here AS model,
    last_value(effort_set IGNORE NULLS) OVER file_here AS reasoning_effort,
    last_value(CASE WHEN c_in IS NOT NULL AND (c_in <> 0 OR c_out <> 0) THEN {'i': c_in, 'o': c_out} END IGNORE NULLS)
      OVER before_here AS previous
  FROM epochs
  WINDOW before_here AS (PARTITION BY user_id, epoch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto_here AS (PARTITION BY user_id, epoch ORDER BY ord ROWS UNBOUNDED PRECEDING),
         file_here AS (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
judged AS (
  SELECT *, l_in IS NOT NULL AND (l_in <> 0 OR l_out <> 0)
      AND (c_in IS NULL OR previous IS NULL OR c_in <> previous.i OR c_out <> previous.o) AS reported,
    c_in IS NOT NULL AND previous IS NOT NULL AND (c_in < previous.i OR c_out < previous.o) AS reset
  FROM carried),
deltas AS (
  SELECT *,
    CASE WHEN reported THEN l_in WHEN c_in IS NULL THEN NULL WHEN previous IS NULL OR reset THEN c_in
         ELSE greatest(c_in - previous.i, 0) END AS d_in,
    CASE WHEN reported THEN least(l_cached, l_in) WHEN c_in IS NOT NULL THEN 0 END AS d_cached,
    CASE WHEN reported THEN l_out WHEN c_in IS NULL THEN NULL WHEN previous IS NULL OR reset THEN c_out
         ELSE greatest(c_out - previous.o, 0) END AS d_out,
    CASE WHEN reported THEN CASE WHEN reset THEN 'counter_reset' END
         WHEN c_in IS NOT NULL THEN CASE WHEN reset THEN 'derived_from_cumulative,counter_reset'
           ELSE 'derived_from_cumulative' END END AS quality
  FROM judged),
passed AS (
  SELECT *, kind = 'count' AND coalesce(d_in <> 0 OR d_cached <> 0 OR d_out <> 0, false) AS counts,
    kind IN ('started', 'complete', 'aborted') AND turn_here IS NOT NULL AS is_turn
  FROM deltas),
context AS (
  SELECT *,
    last_value(CASE WHEN counts AND has_limits THEN CASE WHEN k % 2 = 0 THEN 'plus' ELSE 'pro' END END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS plan_type,
    (last_value(CASE
       WHEN is_turn AND kind = 'started' THEN {'at': CASE WHEN event_id % 2 = 0
         THEN (observed_at_ms // 1000 - 60) * 1000 ELSE observed_at_ms END}
       WHEN changed OR (is_turn AND turn_here IS DISTINCT FROM turn_before) THEN {'at': NULL::BIGINT}
     END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING)).at AS started,
    CASE WHEN user_id >= 50 THEN 's' || (user_id - 50) END AS parent_session_id,
    CASE WHEN user_id >= 50 THEN 'fork' ELSE 'main' END AS relation
  FROM passed)"""

ORACLES: dict[str, str] = {}

ORACLES["file_header"] = v.with_ctes(
    LINES,
    select="""
SELECT 's' || user_id || '.jsonl' AS path, arg_min(sid, ord) AS session_id,
  CASE WHEN user_id >= 50 THEN 's' || (user_id - 50) END AS parent_session_id, min(observed_at_ms) AS forked_at_ms
FROM line_rows WHERE kind = 'session' GROUP BY user_id""",
)
ORACLES["session_facts"] = v.with_ctes(
    LINES,
    select="""SELECT 'session:' || sid AS source_key, observed_at_ms, sid AS session_id, parent_session_id, relation,
  reasoning_effort, 'openai' AS provider, plan_type, 'session_meta' AS quality FROM context WHERE kind = 'session'""",
)
ORACLES["turn_facts"] = v.with_ctes(
    LINES,
    select="""SELECT 'turn:' || session_id || ':' || turn_here AS source_key, observed_at_ms, session_id,
  turn_here AS turn_id, coalesce(started, observed_at_ms) AS started_at_ms,
  CASE WHEN kind <> 'started' THEN observed_at_ms END AS ended_at_ms, model, service_tier, reasoning_effort,
  plan_type, CASE WHEN kind = 'aborted' THEN 'aborted' END AS quality FROM context WHERE is_turn""",
)
ORACLES["usage_facts"] = v.with_ctes(
    LINES,
    select="""SELECT observed_at_ms, session_id, turn_here AS turn_id, relation, model, service_tier, reasoning_effort,
  plan_type, d_in AS input_tokens, d_cached AS cache_read_tokens, d_out AS output_tokens,
  d_in + d_out AS total_tokens, quality FROM context WHERE counts""",
)
ORACLES["quota_facts"] = v.with_ctes(
    LINES,
    select="""SELECT observed_at_ms, plan_type, 'codex' AS limit_id, 'primary' AS window_kind,
  k::DOUBLE AS used_percent, 10080 AS window_minutes, (observed_at_ms // 604800000 * 604800 + 604800) * 1000 AS resets_at_ms
FROM context WHERE counts AND has_limits""",
)
ORACLES["carry_context"] = v.with_ctes(
    LINES,
    select="""SELECT ord AS line_no, session_id, turn_here AS turn_id, service_tier, model, reasoning_effort, plan_type
FROM context""",
)
ORACLES["usage_digest"] = v.with_ctes(
    LINES,
    select="""
SELECT count(DISTINCT (session_id, turn_here, model, service_tier, reasoning_effort, plan_type,
    CASE WHEN l_in IS NOT NULL AND (l_in <> 0 OR l_out <> 0) THEN (l_in, least(l_cached, l_in), l_out) END,
    CASE WHEN c_in IS NOT NULL THEN (c_in, c_out) END,
    CASE WHEN c_in IS NULL THEN observed_at_ms END)) AS keys, count(*) AS events
FROM context WHERE counts""",
)

ORACLES["usage_delta"] = v.with_ctes(
    v.EVENTS + """,
snap AS (
  SELECT user_id, event_id, 0 AS repeat, observed_at_ms,
    (sum(CAST(round(value * 1000) AS BIGINT)) OVER w)::BIGINT AS ci, (sum(k * 10) OVER w)::BIGINT AS co,
    CASE WHEN event_id % 2 = 0 THEN CAST(round(value * 1000) AS BIGINT) END AS li,
    CASE WHEN event_id % 2 = 0 THEN k * 10 END AS lo
  FROM ev WINDOW w AS (PARTITION BY user_id, event_id // 1000 ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
both_rows AS (
  SELECT * FROM snap UNION ALL
  SELECT user_id, event_id, 1, observed_at_ms + 1, ci, co, li, lo FROM snap WHERE event_id % 97 = 0),
prev AS (
  SELECT *, lag(ci) OVER w AS pi, lag(co) OVER w AS po FROM both_rows
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id, repeat)),
judged AS (
  SELECT *, (li IS NOT NULL AND (li <> 0 OR lo <> 0)) AND (pi IS NULL OR ci <> pi OR co <> po) AS reported,
    pi IS NOT NULL AND (ci < pi OR co < po) AS reset FROM prev)""",
    select="""
SELECT user_id, event_id, repeat,
  CASE WHEN reported THEN li WHEN pi IS NULL OR reset THEN ci ELSE greatest(ci - pi, 0) END AS input_tokens,
  CASE WHEN reported THEN lo WHEN pi IS NULL OR reset THEN co ELSE greatest(co - po, 0) END AS output_tokens,
  CASE WHEN reported THEN CASE WHEN reset THEN 'counter_reset' END
       WHEN reset THEN 'derived_from_cumulative,counter_reset' ELSE 'derived_from_cumulative' END AS quality
FROM judged""",
)

_ROOTS = v.EVENTS + """,
nodes AS (SELECT DISTINCT user_id FROM events WHERE user_id >= 50),
walk AS (
  SELECT user_id, user_id - 50 AS node FROM nodes
  UNION ALL SELECT w.user_id, w.node - 50 FROM walk w WHERE w.node IN (SELECT user_id FROM nodes)),
looped AS (SELECT DISTINCT 'c' || (user_id % 7) AS session_id FROM events)"""
ORACLES["resolve_root"] = v.with_ctes(
    _ROOTS,
    select="""
SELECT 's' || user_id AS session_id, 's' || min(node) AS root_session_id FROM walk GROUP BY user_id
UNION ALL SELECT session_id, NULL FROM looped""",
)
ORACLES["parent_edges"] = v.with_ctes(
    v.EVENTS,
    select="""
SELECT 's' || user_id AS session_id,
  CASE WHEN user_id % 3 = 0 AND user_id >= 50 THEN 's' || (user_id - 50) ELSE 'meta' || (user_id % 5) END AS parent_session_id
FROM (SELECT DISTINCT user_id FROM events)""",
)
ORACLES["enrich_records"] = v.with_ctes(
    v.USAGE_RAW,
    select="""
SELECT source_key, 's' || (CAST(substr(session_id, 2) AS BIGINT) % 50) AS root_session_id,
  parent_session_id, CASE WHEN reasoning_effort IS NULL THEN 'low' ELSE reasoning_effort END AS reasoning_effort,
  CASE WHEN parent_session_id IS NOT NULL THEN 'child' ELSE 'main' END AS relation
FROM usage_raw""",
)

_BATCH = v.EVENTS + """,
batch AS (
  SELECT event_id AS seq, 'k' || (event_id % 997) AS source_key,
    CASE WHEN event_id % 997 % 4 = 0 THEN 'quota' ELSE 'usage' END AS kind, observed_at_ms,
    CASE WHEN event_id % 3 = 0 THEN observed_at_ms + k * 1000 END AS last_seen_at_ms,
    CASE WHEN event_id % 5 <> 0 THEN 's' || user_id END AS session_id,
    CASE WHEN event_id % 7 = 0 THEN event_type END AS model,
    CASE k % 3 WHEN 0 THEN 'plus' WHEN 1 THEN 'pro' END AS plan_type,
    CASE WHEN event_id % 2 = 0 THEN k END AS total_tokens,
    CASE WHEN event_id % 4 = 0 THEN k::DOUBLE END AS used_percent,
    CASE WHEN event_id % 11 = 0 THEN 't' || event_id END AS title
  FROM ev)"""


def _last(name: str) -> str:
    return f"arg_max({name}, seq) FILTER ({name} IS NOT NULL) AS {name}"


ORACLES["log_upsert"] = v.with_ctes(
    _BATCH,
    select=f"""
SELECT source_key, any_value(kind) AS kind,
  CASE WHEN any_value(kind) = 'quota' THEN min(observed_at_ms) ELSE arg_min(observed_at_ms, seq) END AS observed_at_ms,
  CASE WHEN any_value(kind) = 'quota' AND count(*) > 1 THEN max(coalesce(last_seen_at_ms, observed_at_ms))
       ELSE arg_max(last_seen_at_ms, seq) FILTER (last_seen_at_ms IS NOT NULL) END AS last_seen_at_ms,
  (arg_min({{'s': session_id}}, seq)).s AS session_id,
  {_last('model')}, {_last('plan_type')}, {_last('total_tokens')}, {_last('used_percent')}, {_last('title')}
FROM batch GROUP BY source_key""",
)
ORACLES["scan_report"] = v.with_ctes(
    _BATCH,
    select="""
SELECT count(*) AS recognized_events,
  count(DISTINCT CASE WHEN source_key NOT IN (SELECT source_key FROM batch WHERE seq * 2 < (SELECT max(seq) FROM batch)) THEN source_key END) AS inserted_events,
  count(*) - count(DISTINCT CASE WHEN source_key NOT IN (SELECT source_key FROM batch WHERE seq * 2 < (SELECT max(seq) FROM batch)) THEN source_key END) AS duplicate_events,
  count(DISTINCT CASE WHEN kind = 'quota' AND source_key NOT IN (SELECT source_key FROM batch WHERE seq * 2 < (SELECT max(seq) FROM batch))
        THEN source_key END) AS inserted_quota_samples
FROM batch WHERE seq * 2 >= (SELECT max(seq) FROM batch)""",
)
ORACLES["repair_quota_times"] = v.with_ctes(
    _BATCH,
    select="""
SELECT seq, CASE WHEN kind = 'quota' AND observed_at_ms + 60000 > last_seen_at_ms THEN last_seen_at_ms
  ELSE observed_at_ms + 60000 END AS observed_at_ms FROM batch""",
)
ORACLES["external_upsert"] = v.with_ctes(
    v.EVENTS,
    select="""
SELECT 'x' || (event_id % 311) AS source_key, max(observed_at_ms) AS run_at_ms, arg_max(k, event_id) AS total_tokens,
  arg_max(value, event_id) AS amount FROM ev GROUP BY 1""",
)
ORACLES["feed_upsert"] = v.with_ctes(
    v.EVENTS,
    select="""
SELECT 'f' || (event_id % 211) AS source_key, arg_min(observed_at_ms, event_id) AS first_seen_at_ms,
  arg_max(observed_at_ms, event_id) AS last_seen_at_ms,
  arg_max(CASE WHEN k % 5 = 0 THEN 'unavailable' ELSE 'ok' END, event_id) AS status,
  arg_max(event_type, event_id) FILTER (k % 2 = 0) AS plan_type
FROM ev GROUP BY 1""",
)

_REPLAY = v.EVENTS + """,
plain AS (
  SELECT user_id, event_id, observed_at_ms, CAST(round(value * 1000) AS BIGINT) AS i, k * 10 AS o,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM ev),
firsts AS (SELECT user_id, min(observed_at_ms) AS start_ms, max(observed_at_ms) AS last_ms FROM plain GROUP BY user_id),
usage_events AS (
  SELECT user_id, event_id, observed_at_ms, i, o FROM plain
  UNION ALL
  SELECT f.user_id, p.nth - 10, f.start_ms - 100000 + p.nth * 5000, p.i, p.o
  FROM plain p JOIN firsts f ON f.user_id = p.user_id + 50 WHERE p.nth <= 3 AND f.user_id % 7 <> 0
  UNION ALL
  SELECT user_id, n - 10, start_ms - 100000 + n * 500, 900000 + n, 1
  FROM firsts, (VALUES (1), (2), (3)) AS t(n) WHERE user_id % 7 = 0 AND user_id >= 50),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx,
    observed_at_ms - lag(observed_at_ms) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM usage_events),
parent_list AS (
  SELECT f.user_id AS child, p.i, p.o, row_number() OVER (PARTITION BY f.user_id ORDER BY p.event_id) AS idx
  FROM firsts f JOIN usage_events p ON p.user_id = f.user_id - 50
  WHERE f.user_id % 2 <> 0 OR p.observed_at_ms <= f.last_ms),
missed AS (
  SELECT c.user_id, min(CASE WHEN p.i IS NULL OR p.i <> c.i OR p.o <> c.o THEN c.idx END) AS first_miss
  FROM placed c LEFT JOIN parent_list p ON p.child = c.user_id AND p.idx = c.idx
  WHERE c.user_id >= 50 GROUP BY c.user_id),
burst AS (
  SELECT user_id, coalesce(min(CASE WHEN gap > 1000 THEN idx END) - 1, max(idx)) AS burst FROM placed GROUP BY user_id),
dropped AS (
  SELECT c.* FROM placed c JOIN missed m USING (user_id) JOIN burst b USING (user_id)
  WHERE m.first_miss IS NULL OR c.idx < m.first_miss OR (m.first_miss = 1 AND b.burst >= 2 AND c.idx <= b.burst))"""
ORACLES["replay_prefix"] = v.with_ctes(
    _REPLAY,
    select="SELECT 's' || user_id || '.jsonl' AS path, event_id AS line_no, observed_at_ms FROM dropped",
)
ORACLES["leading_burst"] = v.with_ctes(
    _REPLAY,
    select="""SELECT 's' || user_id || '.jsonl' AS path, CASE WHEN burst >= 2 THEN burst END AS burst FROM burst""",
)
ORACLES["replayed_quota_drop"] = v.with_ctes(
    _REPLAY,
    select="""
SELECT 's' || user_id || '.jsonl' AS path, 'quota' AS kind, event_id AS line_no FROM placed p
WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM dropped d WHERE d.user_id = p.user_id AND d.observed_at_ms = p.observed_at_ms)
UNION ALL
SELECT 's' || user_id || '.jsonl', 'usage', event_id FROM placed p
WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.user_id = p.user_id AND d.event_id = p.event_id)""",
)

_FEED = v.EVENTS + """,
polls AS (
  SELECT event_id, user_id, k, observed_at_ms,
    'sha256:' || sha256('user' || (user_id % 3) || '@example.com') AS account_key,
    CASE WHEN user_id % 2 = 0 THEN 'plus' ELSE 'pro' END AS plan,
    strftime(make_timestamp((observed_at_ms + 28800000) * 1000), '%Y-%m-%d') AS day
  FROM ev)"""
ORACLES["account_facts"] = v.with_ctes(
    _FEED,
    select="""
SELECT 'account' AS kind, observed_at_ms AS last_seen_at_ms, account_key, 'account-' || right(account_key, 8) AS account_label,
  'chatgpt' AS auth_kind, plan AS plan_type, 'settled' AS freshness, 'ok' AS status FROM polls
UNION ALL
SELECT 'account', observed_at_ms, NULL, NULL, NULL, NULL, 'unavailable', 'unavailable' FROM polls WHERE event_id % 350 = 0""",
)
ORACLES["feed_quota_facts"] = v.with_ctes(
    _FEED,
    select="""
SELECT observed_at_ms AS last_seen_at_ms, account_key, limit_id, plan_type, 'primary' AS window_kind,
  k::DOUBLE AS used_percent, 10080 AS window_minutes, (observed_at_ms // 1000 + 3600) * 1000 AS resets_at_ms
FROM (
  SELECT *, unnest(['codex', 'spark']) AS limit_id, plan AS plan_type FROM polls WHERE k % 4 = 0
  UNION ALL SELECT *, 'codex', 'team' FROM polls WHERE k % 4 IN (1, 2)
  UNION ALL SELECT *, 'weekly', plan FROM polls WHERE k % 4 = 3)""",
)
ORACLES["feed_usage_facts"] = v.with_ctes(
    _FEED,
    select="""
SELECT account_key, plan AS plan_type, event_id AS lifetime_tokens,
  '[{"startDate":"' || day || '","tokens":' || (event_id * 100 + k) || '},{"date":"2026-07-01","totalTokens":' || event_id || '}]' AS daily_tokens_json
FROM polls""",
)
ORACLES["account_daily_tokens"] = v.with_ctes(
    _FEED,
    select="""
SELECT day AS date, arg_max(event_id * 100 + k, observed_at_ms) AS tokens FROM polls GROUP BY day
UNION ALL SELECT '2026-07-01', arg_max(event_id, observed_at_ms) FROM polls""",
)
ORACLES["latest_account"] = v.with_ctes(
    _FEED,
    select="""
SELECT 'any' AS scope, CASE WHEN event_id % 350 = 0 THEN NULL ELSE account_key END AS account_key, observed_at_ms AS last_seen_at_ms
FROM polls WHERE observed_at_ms = (SELECT max(observed_at_ms) FROM polls)
UNION ALL
SELECT 'ok', account_key, observed_at_ms FROM polls WHERE observed_at_ms = (SELECT max(observed_at_ms) FROM polls)""",
)
ORACLES["preferred_quota"] = v.with_ctes(
    v.EVENTS + v.QUOTA_RAW + """,
daily_quota AS (
  SELECT *, strftime(make_timestamp((first_seen_at_ms + 28800000) * 1000), '%Y-%m-%d') AS local_date,
    CASE WHEN window_kind = 'primary' AND limit_id = 'codex' AND source = 'app_server' THEN 2
         WHEN window_kind = 'primary' THEN 1 ELSE 0 END AS tier
  FROM (SELECT * REPLACE (CASE WHEN limit_id = 'codex' AND source = 'jsonl' THEN 'other' ELSE limit_id END AS limit_id) FROM quota_raw))""",
    select="""
SELECT local_date, arg_max(source_key, (tier, last_seen_at_ms, source_key)) AS source_key,
  arg_max(used_percent, (tier, last_seen_at_ms, source_key)) AS used_percent
FROM daily_quota GROUP BY local_date""",
)

# What is equal to another operator's result by definition has its oracle.
ORACLES["log_upsert_batches"] = ORACLES["log_upsert"]
ORACLES["feed_files"] = ORACLES["account_facts"]
_LAST_DATE = "strftime(make_timestamp((max(observed_at_ms) + 28800000) * 1000) - INTERVAL 29 DAY, '%Y-%m-%d')"
_FILES = v.EVENTS + f""",
since AS (SELECT {_LAST_DATE} AS day FROM ev),
per_user AS (SELECT user_id, min(observed_at_ms) AS first_ms, count(*) AS lines FROM ev GROUP BY 1),
files AS (
  SELECT 'logs/' || CASE WHEN user_id % 3 = 0 THEN strftime(make_timestamp((first_ms + 28800000) * 1000), '%Y-%m-%d') || '/' ELSE '' END
           || 's' || user_id || '.jsonl' AS path, user_id, first_ms, lines,
         CASE WHEN user_id % 5 <> 0 THEN first_ms + user_id * 3600000 END AS modified_ms FROM per_user),
dated AS (
  SELECT *, CASE WHEN user_id % 2 = 0 OR user_id % 3 = 0
                 THEN strftime(make_timestamp((first_ms + 28800000) * 1000), '%Y-%m-%d') END AS session_date,
         strftime(make_timestamp((modified_ms + 28800000) * 1000), '%Y-%m-%d') AS modified_date FROM files)"""
ORACLES["prune_files"] = v.with_ctes(
    _FILES,
    select="""SELECT path, modified_ms FROM dated, since
WHERE user_id % 17 = 0 OR coalesce(session_date >= day, false)
   OR CASE WHEN modified_ms IS NULL THEN session_date IS NULL ELSE modified_date >= day END""",
)
ORACLES["filter_from"] = v.with_ctes(
    v.USAGE_RAW + f""",
since AS (SELECT {_LAST_DATE} AS day FROM usage_raw)""",
    select="""SELECT source_key, observed_at_ms FROM usage_raw, since
WHERE strftime(make_timestamp((observed_at_ms + 28800000) * 1000), '%Y-%m-%d') >= day""",
)
ORACLES["file_report"] = v.with_ctes(
    _FILES,
    select="""SELECT count(*) AS files_scanned, count(*) FILTER (NOT (user_id % 3 = 0 AND user_id % 2 = 0)) AS files_changed,
  coalesce(sum(lines) FILTER (NOT (user_id % 3 = 0 AND user_id % 2 = 0)), 0)::BIGINT AS complete_lines
FROM files WHERE modified_ms IS NOT NULL""",
)
ORACLES["session_metadata"] = v.with_ctes(
    v.EVENTS + """,
named AS (
  SELECT 's' || (conv_id % 400) AS session_id, conv_id * 1000 + turn AS line_no,
         CASE WHEN turn % 2 = 1 THEN nullif(trim(substr(text, 1, 40), ' '), '') END AS title
  FROM conversations WHERE conv_id % 11 <> 0),
titles AS (SELECT session_id, arg_min(title, line_no) FILTER (title IS NOT NULL) AS index_title FROM named GROUP BY 1),
threads AS (SELECT DISTINCT 's' || user_id AS session_id, 't' || user_id AS thread_title, user_id FROM events)""",
    select="""SELECT session_id, coalesce(index_title, thread_title) AS title,
  CASE WHEN user_id >= 50 THEN 's' || (user_id - 50) END AS parent_session_id, CASE WHEN user_id % 2 = 0 THEN 'high' END AS reasoning_effort
FROM titles FULL JOIN threads USING (session_id)""",
)
ORACLES["title_index_files"] = ORACLES["session_metadata"]
