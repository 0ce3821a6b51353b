"""Values that must equal the published ones for results to be right.

Everything in this module is a fixed value: thresholds, enumerations, quality
flags, capacity defaults and the two price catalogs.  No logic lives here.
"""

# Fixed values: +08:00 day boundary and time units, in milliseconds.
LOCAL_OFFSET_MS = 28_800_000
MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# Reset-window segmentation thresholds.
RESET_DROP_PERCENT = 5.0
RESET_JITTER_MS = 300_000
INFERRED_DROP_PERCENT = 40.0
INFERRED_MIN_PREVIOUS_PERCENT = 50.0
INFERRED_MAX_NEW_PERCENT = 50.0
INFERRED_MIN_GAP_MS = 1_800_000

# Other thresholds.
REPLAY_BURST_GAP_MS = 1_000
FRESH_MAX_AGE_MS = 900_000
SECONDS_CUTOFF = 100_000_000_000
EXACT_MODEL_SCORE = 1_000_000
CANDIDATE_MIN_PERCENT = 5.0

# Capacity defaults (weekly credit) and plan to profile mapping.
CAPACITY_DEFAULTS = {"usd20": 3200.0, "usd100": 16000.0, "usd200": 64000.0}
PLAN_PROFILE = {"plus": "usd20", "team": "usd100", "pro": "usd200"}

# The review alias is de-duplicated as the card it falls back to.
REVIEW_ALIAS = "codex-auto-review"
REVIEW_CARD = "gpt-5.5"
CANONICAL_LIMIT = "codex"

# Quality flags, alphabetical.  A flag's position is its bit.
QUALITY_FLAGS = [
    "account_context_unavailable",
    "account_tokens_unavailable",
    "fast_unsupported_fallback_standard",
    "inferred_after_gap",
    "missing_api_version",
    "missing_model",
    "missing_pricing",
    "missing_subscription_version",
    "mixed_account",
    "mixed_plan",
    "official_unavailable",
    "pricing_multiplier_invalid",
    "pricing_partial",
    "root_unresolved",
    "service_tier_unclassified",
    "split_boundary",
]

# Keys that are never kept, compared in lower case.
PRIVATE_KEYS = [
    "directory",
    "sessionfile",
    "session_file",
    "access_token",
    "accesstoken",
    "refresh_token",
    "refreshtoken",
    "api_key",
    "apikey",
    "authorization",
    "prompt",
    "message",
    "content",
    "email",
]

# Price change instant, 2026-07-30T00:00:00Z.
PRICE_CHANGE_MS = 1_785_369_600_000
LONG_CONTEXT_TOKENS = 272_000

# Price versions as (version, effective_from_ms,
# effective_to_ms, long_context_threshold_tokens).
CREDIT_VERSIONS = [
    ("subscription-credit-before-2026-07-30", 0, PRICE_CHANGE_MS, None),
    ("subscription-credit-2026-07-30", PRICE_CHANGE_MS, None, None),
]
USD_VERSIONS = [
    ("api-usd-before-2026-07-30", 0, PRICE_CHANGE_MS, LONG_CONTEXT_TOKENS),
    ("api-usd-2026-07-30", PRICE_CHANGE_MS, None, LONG_CONTEXT_TOKENS),
]

# Rates in micro-units per million tokens, in catalog order.
# model, aliases, input, cache_read, cache_write, output, fast_multiplier
CREDIT_RATES = {
    "subscription-credit-before-2026-07-30": [
        ("gpt-5.6-sol", [], 125000000, 12500000, 0, 750000000, 2.5),
        ("gpt-5.6-terra", [], 62500000, 6250000, 0, 375000000, 2.5),
        ("gpt-5.6-luna", [], 25000000, 2500000, 0, 150000000, 2.5),
        ("gpt-5.5", ["codex-auto-review"], 125000000, 12500000, 0, 750000000, 2.5),
        ("gpt-5.5-cyber", [], 500000000, 50000000, 0, 3000000000, None),
        ("gpt-5.4", [], 62500000, 6250000, 0, 375000000, 2.0),
        ("gpt-5.4-mini", [], 18750000, 1875000, 0, 113000000, None),
        ("gpt-5.3-codex", [], 43750000, 4375000, 0, 350000000, None),
        ("gpt-5.2", [], 43750000, 4375000, 0, 350000000, None),
    ],
    "subscription-credit-2026-07-30": [
        ("gpt-5.6-sol", [], 125000000, 12500000, 0, 750000000, 2.5),
        ("gpt-5.6-terra", [], 50000000, 5000000, 0, 300000000, 2.5),
        ("gpt-5.6-luna", [], 5000000, 500000, 0, 30000000, 2.5),
        ("gpt-5.5", ["codex-auto-review"], 125000000, 12500000, 0, 750000000, 2.5),
        ("gpt-5.5-cyber", [], 312500000, 31250000, 0, 1875000000, None),
        ("gpt-5.4", [], 62500000, 6250000, 0, 375000000, 2.0),
        ("gpt-5.4-mini", [], 18750000, 1875000, 0, 113000000, None),
        ("gpt-5.3-codex", [], 43750000, 4375000, 0, 350000000, None),
        ("gpt-5.2", [], 43750000, 4375000, 0, 350000000, None),
    ],
}

# model, aliases, input, cache_read, cache_write, output, fast_multiplier,
# long context (input, cache_read, cache_write, output) or None
USD_RATES = {
    "api-usd-before-2026-07-30": [
        ("gpt-5.6-sol", [], 5000000, 500000, 6250000, 30000000, None,
         (10000000, 1000000, 12500000, 45000000)),
        ("gpt-5.6-terra", [], 2500000, 250000, 3125000, 15000000, None,
         (5000000, 500000, 6250000, 22500000)),
        ("gpt-5.6-luna", [], 1000000, 100000, 1250000, 6000000, None,
         (2000000, 200000, 2500000, 9000000)),
        ("gpt-5.5", ["codex-auto-review"], 5000000, 500000, 0, 30000000, None,
         (10000000, 1000000, 0, 45000000)),
        ("gpt-5.4", [], 2500000, 250000, 0, 15000000, None,
         (5000000, 500000, 0, 22500000)),
        ("gpt-5.4-mini", [], 750000, 75000, 0, 4500000, None, None),
        ("gpt-5.3-codex", [], 1750000, 175000, 0, 14000000, None, None),
    ],
    "api-usd-2026-07-30": [
        ("gpt-5.6-sol", [], 5000000, 500000, 6250000, 30000000, 2.0,
         (10000000, 1000000, 12500000, 45000000)),
        ("gpt-5.6-terra", [], 2000000, 200000, 2500000, 12000000, 2.0,
         (4000000, 400000, 5000000, 18000000)),
        ("gpt-5.6-luna", [], 200000, 20000, 250000, 1200000, 2.0,
         (400000, 40000, 500000, 1800000)),
        ("gpt-5.5", ["codex-auto-review"], 5000000, 500000, 0, 30000000, 2.5,
         (10000000, 1000000, 0, 45000000)),
        ("gpt-5.4", [], 2500000, 250000, 0, 15000000, 2.0,
         (5000000, 500000, 0, 22500000)),
        ("gpt-5.4-mini", [], 750000, 75000, 0, 4500000, 2.0, None),
        ("gpt-5.3-codex", [], 1750000, 175000, 0, 14000000, 2.0, None),
    ],
}
