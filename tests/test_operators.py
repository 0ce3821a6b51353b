"""Operators on small literal inputs, and properties that must always hold."""

import random

import pytest
from pyspark.sql import functions as F

from meterline.functions import quality
from meterline.functions.ordered import Running, ordered_scan, range_chunks
from meterline.operators import capacity, dedupe, lineage, pricing, turns, windows
from meterline.plans import rollup
from meterline.sources.catalogs import (
    CAPACITY_SCHEMA,
    credit_catalog,
    default_capacities,
    ensure_capacities,
    price_catalog,
    set_capacity,
    small_table,
    usd_catalog,
)

CHANGE = 1_785_369_600_000
USAGE = (
    "source_key string, observed_at_ms long, model string, service_tier string, "
    "input_tokens long, cache_read_tokens long, cache_write_tokens long, output_tokens long, "
    "reasoning_tokens long, total_tokens long"
)


def price(spark, *events, default_tier="standard"):
    data = [(str(i), at, model, tier, n, 0, 0, 0, 0, n)
            for i, (n, model, tier, at) in enumerate(events)]
    priced = pricing.price_events(
        spark.createDataFrame(data, USAGE), credit_catalog(spark), usd_catalog(spark), default_tier
    )
    found = priced.select("source_key", "credit_micros", "api_usd_micros",
                          quality.text("price_flags").alias("quality"))
    return [(r.credit_micros, r.api_usd_micros, r.quality)
            for r in sorted(found.collect(), key=lambda r: int(r.source_key))]


def test_prices(spark):
    fallback = "fast_unsupported_fallback_standard"
    assert price(
        spark,
        (200_000, "gpt-5.6-terra", "standard", CHANGE - 1),
        (200_000, "gpt-5.6-terra", "standard", CHANGE),
        (300_000, "gpt-5.6-sol", "standard", CHANGE),
        (200_000, "gpt-5.6-sol", "fast", CHANGE - 1),
        (200_000, "gpt-5.6-sol", "fast", CHANGE),
        (200_000, "gpt-5.4-mini", "standard", CHANGE),
        (200_000, "CODEX-auto-review", "standard", CHANGE),
        (200_000, "gpt-5.6-sol", None, CHANGE),
        (200_000, "not-a-model", "standard", CHANGE),
        (200_000, None, None, CHANGE),
        (200_000, "gpt-5.2", "standard", CHANGE),
        (200_000, "gpt-5.6-sol", "standard", -1),
        (272_000, "gpt-5.6-sol", "standard", CHANGE),
        (4_000_000_000, "gpt-5.5-cyber", "standard", CHANGE),
    ) == [
        (12_500_000, 500_000, None),
        (10_000_000, 400_000, None),
        (37_500_000, 3_000_000, None),
        (25_000_000, 1_000_000, fallback),
        (62_500_000, 2_000_000, None),
        (3_750_000, 150_000, None),
        (25_000_000, 1_000_000, None),
        (25_000_000, 1_000_000, "service_tier_unclassified"),
        (None, None, "missing_pricing"),
        (None, None, "missing_pricing"),
        (None, None, "missing_pricing"),
        (None, None, "missing_subscription_version"),
        (34_000_000, 1_360_000, None),
        (1_250_000_000_000, 40_000_000_000, None),
    ]


def test_default_tier_can_be_fast(spark):
    assert price(spark, (200_000, "gpt-5.6-sol", None, CHANGE), default_tier="fast") == [
        (62_500_000, 2_000_000, "service_tier_unclassified")
    ]


def test_catalog_file_with_overlap_and_bad_multiplier(spark, tmp_path):
    def document(scheme, multiplier):
        rate = ('{"model":"m","aliases":[],"input_microusd_per_million":1000000,'
                '"cache_read_microusd_per_million":0,"cache_write_microusd_per_million":0,'
                f'"output_microusd_per_million":0,"fast_multiplier":{multiplier}}}')
        versions = ",".join(
            f'{{"version":"{name}","effective_from_ms":{start},"effective_to_ms":null,'
            f'"long_context_threshold_tokens":null,"rates":[{rate}]}}'
            for name, start in (("old", 0), ("new", 50)))
        path = tmp_path / f"{scheme}.json"
        path.write_text(f'{{"scheme":"{scheme}",\n"versions":[{versions}]}}')
        return price_catalog(spark, str(path))

    credit, usd = document("subscription_credit", -1.0), document("api_usd", 2.0)
    data = [("a", 60, "m", "fast", 10, 0, 0, 0, 0, 10), ("b", 60, "m", "standard", 10, 0, 0, 0, 0, 10)]
    events = spark.createDataFrame(data, USAGE)
    bad, good = sorted(pricing.price_events(events, credit, usd).collect(),
                       key=lambda r: r.source_key)
    assert (bad.credit_micros, good.credit_micros, good.credit_version) == (None, 10, "new")
    assert bad.price_flags == quality.BITS["pricing_multiplier_invalid"]
    by_join = events.join(pricing.price_segments(credit, usd),
                          (F.col("observed_at_ms") >= F.col("segment_from_ms"))
                          & (F.col("observed_at_ms") < F.col("segment_to_ms")))
    assert {r.credit_version for r in by_join.collect()} == {"new"}


QUOTA = (
    "source_key string, first_seen_at_ms long, last_seen_at_ms long, account_key string, "
    "limit_id string, window_kind string, used_percent double, window_minutes long, "
    "resets_at_ms long, plan_type string, source string, priority int"
)


def quota(spark, *points, source="jsonl"):
    rows = [(f"q{i}", t, t, "acct", "weekly", "primary", p, 10080, r, None, source, 1)
            for i, (t, p, r) in enumerate(points)]
    return spark.createDataFrame(rows, QUOTA)


@pytest.mark.parametrize(
    ("points", "expected"),
    [
        ([(1_000_000, 10.0, 2_000_000), (1_060_000, 11.0, 2_001_000), (1_120_000, 2.0, 2_600_000)],
         [(1_000_000, 1_120_000, False), (1_120_000, 2_600_000, False)]),
        ([(1_000_000, 97.0, None), (2_800_001, 5.0, None)],
         [(1_000_000, 2_800_001, True), (2_800_001, None, True)]),
        ([(1_000_000, 80.0, 2_000_000), (1_060_000, 20.0, 2_000_000), (1_120_000, 30.0, 2_000_000)],
         [(1_000_000, 2_000_000, False)]),
        ([(1_000_000, 0.0, 2_000_000), (1_060_000, 0.0, 2_600_000), (1_120_000, 0.0, 3_200_000)],
         [(1_000_000, 3_200_000, False)]),
    ],
)
def test_reset_window_cases(spark, points, expected):
    found = windows.disjoint_windows(windows.reset_windows(quota(spark, *points)))
    assert [(r.window_start_ms, r.resets_at_ms, r.inferred_after_gap)
            for r in found.orderBy("ordinal").collect()] == expected


def brute_windows(points):
    """The two rules, one observation after another."""
    starts, peak, reset_so_far, last = [], None, None, None
    for t, p, r, source in points:
        explicit = (peak is not None and p is not None and p + 5 < peak
                    and reset_so_far is not None and r is not None and r - reset_so_far > 300_000)
        inferred = (last is not None and last[1] == source == "jsonl" and t - last[0] >= 1_800_000
                    and peak is not None and p is not None and peak >= 50 and p <= 50
                    and peak - p >= 40 and not (reset_so_far is not None and r is not None))
        if last is None or explicit or inferred:
            starts.append(t)
            peak = p
        elif p is not None:
            peak = p if peak is None else max(peak, p)
        if r is not None:
            reset_so_far = r if reset_so_far is None else max(reset_so_far, r)
        last = (t, source)
    return starts


def test_reset_windows_against_brute_force(spark):
    """Many random groups, and one that holds most of the rows."""
    rng = random.Random(7)
    rows, expected = [], {}
    for g in range(12):
        t, points = 0, []
        for _ in range(900 if g == 0 else 60):
            t += rng.choice([60_000, 400_000, 2_000_000])
            points.append((t, rng.choice([None, 0.0, 3.0, 40.0, 55.0, 90.0, 99.0]),
                           rng.choice([None, t + 600_000, 5_000_000, t + 9_000_000]),
                           rng.choice(["jsonl", "jsonl", "app_server"])))
        expected[f"a{g}"] = brute_windows(points)
        rows += [(f"{g}:{i:05d}", t, t, f"a{g}", "l", "primary", p, None, r, None, s, 1)
                 for i, (t, p, r, s) in enumerate(points)]
    found = {}
    for r in windows.reset_windows(spark.createDataFrame(rows, QUOTA)).orderBy("ordinal").collect():
        found.setdefault(r.account_key, []).append(r.window_start_ms)
    assert found == expected


def test_canonical_limit(spark):
    rows = [("1", 1, 1, "a", "codex", "primary", 1.0, 1, 1, None, "jsonl", 1),
            ("2", 1, 1, "a", "spark", "primary", 0.0, 1, 1, None, "jsonl", 1),
            ("3", 1, 1, "a", "spark", "secondary", 0.0, 1, 1, None, "jsonl", 1),
            ("4", 1, 1, None, "spark", "primary", 0.0, 1, 1, None, "jsonl", 1)]
    kept = windows.canonical_limit(spark.createDataFrame(rows, QUOTA))
    assert sorted(r.source_key for r in kept.collect()) == ["1", "3", "4"]
    null_account = [("1", 1, 1, None, "codex", "primary", 1.0, 1, 1, None, "jsonl", 1), rows[3]]
    kept = windows.canonical_limit(spark.createDataFrame(null_account, QUOTA))
    assert [r.source_key for r in kept.collect()] == ["1"]


def test_asof_assignment_without_keys(spark):
    """Windows of one start, and facts before the first and after the last."""
    day = 86_400_000
    found = spark.createDataFrame(
        [("w0", 5 * day, "g", 0), ("w1", 5 * day, "h", 0), ("w2", 9 * day, "g", 1),
         ("w3", 9 * day + 5, "g", 2)],
        "window_id string, window_start_ms long, quota_group string, ordinal long")
    facts = spark.createDataFrame(
        [(t,) for t in (0, 5 * day - 1, 5 * day, 8 * day, 9 * day, 9 * day + 4, 9 * day + 5, 90 * day)],
        "t long")
    got = windows.assign_asof(facts, "t", found, []).orderBy("t").collect()
    assert [r.window_id for r in got] == ["w0", "w0", "w1", "w1", "w2", "w2", "w3", "w3"]


@pytest.mark.parametrize("keyed", [True, False])
def test_asof_assignment_against_brute_force(spark, keyed):
    """A thousand accounts, a hot one, shared starts, null keys and times, accounts without windows."""
    rng = random.Random(11)
    accounts = [None, *[f"a{i}" for i in range(1_000)]]
    begun = [(f"w{i}", a, rng.randrange(0, 400_000), f"g{i % 7}", i)
             for i, a in enumerate([*accounts[:-5], *["a3"] * 400, *["a3"] * 30])]
    begun += [(f"same{i}", "a3", 60_000, "g", i) for i in range(3)]
    seen = [(i, rng.choice([*accounts, *["a3"] * 500]), rng.choice([None, *[rng.randrange(0, 500_000)] * 9]))
            for i in range(4_000)]
    found = spark.createDataFrame(
        begun, "window_id string, account_key string, window_start_ms long, quota_group string, ordinal long")
    facts = spark.createDataFrame(seen, "n long, account_key string, t long")
    got = windows.assign_asof(facts, "t", found, ["account_key"] if keyed else []).collect()

    def brute(account, t):
        mine = sorted((w[2], w[3], w[4], w[0]) for w in begun if not keyed or w[1] == account)
        if t is None or not mine:
            return None
        earlier = [w for w in mine if w[0] <= t]
        return (earlier[-1] if earlier else mine[0])[3]

    assert {r.n: r.window_id for r in got} == {n: brute(a, t) for n, a, t in seen}
    assert len(got) == len(seen)


def test_asof_assignment_without_windows(spark):
    none = spark.createDataFrame([], "window_id string, window_start_ms long, quota_group string, ordinal long")
    facts = spark.createDataFrame([(1,), (2,)], "t long")
    assert [r.window_id for r in windows.assign_asof(facts, "t", none, []).collect()] == [None, None]


def test_turns_against_brute_force(spark):
    """Nested, overlapping, open and finished turns, with one busy session."""
    rng = random.Random(3)
    turn_rows, usage_rows = [], []
    for s in range(6):
        for i in range(200 if s == 0 else 12):
            start = rng.randrange(0, 5_000)
            end = rng.choice([None, start + rng.randrange(0, 50), start + rng.randrange(0, 3_000)])
            turn_rows.append((f"s{s}", f"t{i:03d}", start, end))
        for i in range(400 if s == 0 else 30):
            own = rng.choice([None, None, f"t{rng.randrange(0, 300):03d}"])
            usage_rows.append((f"u{s}:{i}", f"s{s}", own, rng.randrange(0, 6_000)))

    def brute(session, own, t):
        mine = [r for r in turn_rows if r[0] == session]
        for r in mine:
            if own is not None and r[1] == own:
                return own, r[2], r[3]
        before = [r for r in mine if r[2] <= t]
        covering = [r for r in before if r[3] is None or t <= r[3]]
        pick = max(covering or before, key=lambda r: (r[2], r[1]), default=None)
        return (own or (pick and pick[1]), pick and pick[2], pick and pick[3])

    usage = spark.createDataFrame(
        usage_rows, "source_key string, session_id string, turn_id string, observed_at_ms long")
    known = spark.createDataFrame(
        turn_rows, "session_id string, turn_id string, started_at_ms long, ended_at_ms long")
    got = {r.source_key: (r.turn_id, r.turn_started_ms, r.turn_ended_ms)
           for r in turns.assign_turn(usage, known).collect()}
    assert got == {k: brute(s, own, t) for k, s, own, t in usage_rows}


def test_range_chunks_compute_their_rows_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def row(n):
        computed.add(1)
        return ("g", n)

    data = spark.createDataFrame(spark.sparkContext.parallelize(range(300), 3).map(row), "g string, i long")
    assert range_chunks(data, ["g"], ["i"], "once").count() == 300
    assert computed.value == 300


def test_ordered_scan_over_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.randrange(5)}", i,
             rng.choice([None, rng.randrange(100)])) for i in range(2_000)]
    # Small partitions are joined again by default; keep them to see many chunks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = spark.createDataFrame(rows, "g string, i long, v long").repartition(4)
        chunks = range_chunks(data, ["g"], ["i"], "hot")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert chunks.filter("g = 'hot'").select("_chunk").distinct().count() > 3
    got = ordered_scan(chunks, ["g"], ["i"], [
        Running("last", "last", F.col("v"), before=True),
        Running("first", "first", F.col("v")),
        Running("top", "max", F.col("v")),
        Running("low", "min", F.col("v"), before=True),
        Running("n", "sum", F.lit(1).cast("bigint")),
    ])
    state, expected = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        last, first, top, low, n = state.get(g, (None, None, None, None, 0))
        known = [x for x in (top, v) if x is not None]
        expected[i] = (last, first if first is not None else v, max(known, default=None), low, n + 1)
        state[g] = (v if v is not None else last, first if first is not None else v,
                    max(known, default=None),
                    min([x for x in (low, v) if x is not None], default=None), n + 1)
    assert {r.i: (r["last"], r["first"], r.top, r.low, r.n) for r in got.collect()} == expected


RECORD = (
    "source_key string, observed_at_ms long, session_id string, root_session_id string, "
    "turn_id string, model string, service_tier string, reasoning_effort string, relation string, "
    "provider string, plan_type string, input_tokens long, cache_read_tokens long, "
    "cache_write_tokens long, output_tokens long, reasoning_tokens long, total_tokens long"
)


def record(key, relation, root="r", **other):
    base = dict(source_key=key, observed_at_ms=100, session_id="s", root_session_id=root,
                turn_id="t", model="gpt-5.6-sol", service_tier=None, reasoning_effort=None,
                relation=relation, provider=None, plan_type=None, input_tokens=10,
                cache_read_tokens=0, cache_write_tokens=0, output_tokens=0, reasoning_tokens=0,
                total_tokens=10)
    return {**base, **other}


def test_dedupe(spark):
    def run(*rows):
        return dedupe.dedupe_usage(spark.createDataFrame(list(rows), RECORD)).collect()

    (kept,) = run(record("child:1", "child", service_tier="standard", plan_type="plus"),
                  record("parent:1", "main", service_tier="fast"))
    assert (kept.source_key, kept.service_tier, kept.plan_type) == ("parent:1", "standard", "plus")
    assert len(run(record("a", "main", "x"), record("b", "main", "y"))) == 2
    (card,) = run(record("a", "main", model="codex-auto-review"), record("b", "main", model="GPT-5.5"))
    assert card.model == "codex-auto-review"
    copies = [record(f"c{i:04d}", "child") for i in range(500)]
    (one,) = run(*copies, record("zz", "main"))
    assert one.source_key == "zz"


def test_roots(spark):
    edges = spark.createDataFrame(
        [("child", "parent"), ("parent", "root"), ("a", "b"), ("b", "a"), ("c", "a"), ("e", "")]
        + [(f"n{i}", f"n{i + 1}") for i in range(37)],
        "session_id string, parent_session_id string")
    got = {r.session_id: r.root_session_id for r in lineage.resolve_roots(edges).collect()}
    assert got == {"child": "root", "parent": "root", "a": None, "b": None, "c": None,
                   **{f"n{i}": "n37" for i in range(37)}}
    pairs = spark.createDataFrame(
        [("child", "parent"), ("child", None), ("root", "child"), ("x", "parent"), ("y", "y"),
         ("z", None), ("q", "a"), ("n3", "n30"), ("n30", "n3")],
        "session_id string, parent_session_id string")
    roots = {(r.session_id, r.parent_session_id): r.root_session_id
             for r in lineage.roots_of_pairs(pairs, edges).collect()}
    assert roots == {("child", "parent"): "root", ("child", None): "child", ("root", "child"): None,
                     ("x", "parent"): "root", ("y", "y"): None, ("z", None): "z", ("q", "a"): None,
                     ("n3", "n30"): "n37", ("n30", "n3"): None}


def test_capacities(spark):
    rows = capacity.capacity_rows(default_capacities(spark))
    plans = ("plus", "team", "PRO", "api", "unknown", None, "business")
    asked = spark.createDataFrame(list(enumerate(plans)), "n int, plan string").coalesce(1)
    nobody, plan, at = F.lit(None).cast("string"), F.col("plan"), F.lit(1)

    def joined(**how):
        made = capacity.with_capacity(asked, default_capacities(spark), nobody, plan, at, **how)
        return [r[0] for r in made.orderBy("n").select("capacity.profile_code").collect()]

    wanted = ["usd20", "usd100", "usd200", None, None, None, "usd200"]
    choice = capacity.capacity_for(rows, nobody, plan, at).getField("profile_code")
    assert [r[0] for r in asked.orderBy("n").select(choice).collect()] == joined() == wanted
    assert joined(rule="current") == ["usd20", "usd100", "usd200", None, None, None, None]
    changed = set_capacity(default_capacities(spark), "usd200", 55_000.0, 9)
    assert {r.profile_code: r.weekly_credit for r in changed.collect()} == {
        "usd20": 3200.0, "usd100": 16000.0, "usd200": 55_000.0}
    for bad in (("usd1", 1.0), ("usd20", -1.0), ("usd20", float("nan")), ("usd20", float("inf"))):
        with pytest.raises(ValueError):
            set_capacity(changed, *bad, 9)
    dated = {"account_key": "a", "effective_from_ms": 5, "confirmed_at_ms": 7}
    old = small_table(spark, [{"profile_code": "usd20", "weekly_credit": 1.0, **dated},
                              {"profile_code": "usd20", "weekly_credit": 2.0,
                               "effective_from_ms": 0, "confirmed_at_ms": 3}], CAPACITY_SCHEMA)
    seeded = ensure_capacities(old).filter("account_key is null")
    assert {r.profile_code: r.weekly_credit for r in seeded.collect()} == {
        "usd20": 2.0, "usd100": 16000.0, "usd200": 64000.0}


def test_capacities_of_many_accounts(spark):
    """Dated capacities of 400 accounts against a plain scan over all rows."""
    rng = random.Random(5)
    accounts, plans, codes = [f"a{i}" for i in range(400)], ["plus", "pro", "Team", "other"], ["usd20", "usd100", "usd200"]
    rows = []
    for i in range(900):
        start = rng.randrange(100)
        rows.append({"profile_code": rng.choice(codes), "account_key": rng.choice([None, *accounts]) if i > 20 else None,
                     "plan_type": rng.choice([None, *plans]), "weekly_credit": float(i), "effective_from_ms": start,
                     "effective_to_ms": rng.choice([None, start + rng.randrange(1, 60)]), "confirmed_at_ms": 0})
    facts = [(n, rng.choice([None, "nobody", *accounts]), rng.choice([None, "api", "PRO", *plans]),
              rng.randrange(-5, 130), rng.choice([None, *codes])) for n in range(1500)]
    own = {"plus": "usd20", "team": "usd100", "pro": "usd200"}

    def plain(account, plan, at, profile, rule):
        best = None
        for r in rows:
            if not (r["effective_from_ms"] <= at and (r["effective_to_ms"] is None or at < r["effective_to_ms"])):
                continue
            if r["account_key"] not in (None, account):
                continue
            mine, score = own.get((plan or "").lower()) == r["profile_code"], None
            if rule == "current":
                if mine and (r["plan_type"] is None or r["plan_type"].lower() == plan.lower()):
                    score = 4 * (r["account_key"] is not None) + 2 * (r["plan_type"] is not None)
            elif profile == r["profile_code"]:
                score = 4
            elif plan and plan.lower() not in ("api", "unknown") and r["plan_type"] in (None, plan):
                score = 2 * (r["plan_type"] is not None) + mine
            if score is not None:
                rank = (score, r["effective_from_ms"], r["profile_code"], r["account_key"] is not None, r["weekly_credit"])
                best = max(best or rank, rank)
        return best and best[4]

    table = small_table(spark, rows, CAPACITY_SCHEMA)
    asked = spark.createDataFrame(facts, "n int, account string, plan string, at bigint, profile string")
    for rule in ("plan", "profile", "current"):
        how = {"profile": F.col("profile")} if rule == "profile" else {"rule": rule}
        made = capacity.with_capacity(asked, table, F.col("account"), F.col("plan"), F.col("at"), **how)
        got = {r.n: r.capacity and r.capacity.weekly_credit for r in made.collect()}
        assert got == {n: plain(a, p, at, c if rule == "profile" else None, rule) for n, a, p, at, c in facts}, rule


def test_large_counts_saturate_and_stay_exact(spark):
    names = ["_fresh_input", "cache_read_tokens", "cache_write_tokens", "output_tokens"]
    rates = [f"credit_{n}" for n in ("input", "cache_read", "cache_write", "output")]
    rows = [(2 * 10**18, 0, 0, 0, 1_000_000, 0, 0, 0), (2 * 10**18, 0, 0, 0, 3, 0, 0, 0), (9 * 10**18,) * 4 + (9 * 10**18,) * 4, (5, 0, 0, 0, 100_000, 0, 0, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names + rates))
    got = [r[0] for r in df.select(pricing._base_amount("credit")).collect()]
    want = [min(2**63 - 1, (sum(a * b for a, b in zip(r[:4], r[4:])) + 500_000) // 1_000_000) for r in rows]
    assert got == want


def test_many_price_versions_take_the_same_way(spark):
    schema = "version string, version_no int, effective_from_ms bigint, effective_to_ms bigint"
    many = spark.createDataFrame([(f"v{i}", i, i * 40_000_000, None) for i in range(80)], schema)
    events = spark.createDataFrame([(t,) for t in range(-5, 3_400_000_000, 90_000_007)] + [(40_000_000,), (None,)], "observed_at_ms bigint")
    got = {r[0]: (r[1], r[2]) for r in pricing.price_version_at(events, many, many).collect()}
    for at, found in got.items():
        want = None if at is None or at < 0 else f"v{min(79, at // 40_000_000)}"
        assert found == (want, want)


def test_last_row_of_a_session_counts(spark):
    sessions = spark.createDataFrame(
        [("a", "old", None, 1, "k1"), ("a", "new", "fork", 2, "k0"), ("b", "only", None, 5, "k2")],
        "session_id string, title string, relation string, observed_at_ms bigint, source_key string",
    )
    rows = spark.createDataFrame(
        [(1, "a", None, None), (2, "b", "a", None), (3, "c", None, "own")],
        "n int, session_id string, root_session_id string, relation string",
    )
    got = {r.n: (r.title, r.relation) for r in rollup.session_meta(rows, sessions).collect()}
    assert got == {1: ("new", "fork"), 2: ("new", "child"), 3: (None, "own")}


def test_rates_of_names_against_brute_force(spark):
    """Exact names, prefixes before a dash, double and trailing dashes, names with many parts, none at all."""
    credit = credit_catalog(spark)
    known = [(r.version, r.rate_no, n.lower()) for r in credit.collect() for n in [r.model, *r.aliases]]
    names = sorted({n for *_, n in known})
    keys = ["", "-", "none", "-".join("x" * 400), *names]
    keys += [n + tail for n in names for tail in ("-", "--", "-2026", "-mini-x", "x", "-mini", "-" + "a-" * 50)]
    asked = spark.createDataFrame([(k,) for k in sorted(set(keys))], "model_key string")
    got = {(r.model_key, r.version): r.rate.rate_no for r in pricing.match_rate(asked, credit).collect()}
    expected = {}
    for key in set(keys):
        for version in {v for v, *_ in known}:
            fits = [(1_000_000 * (key == n) + len(n), no) for v, no, n in known if v == version and (key == n or key.startswith(n + "-"))]
            if fits:
                expected[key, version] = max(fits)[1]
    assert got == expected
