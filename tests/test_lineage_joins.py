"""Ancestor tables, covering turns and running sums against brute force."""

import random

from pyspark.sql import functions as F

from meterline.functions.storage import children, freeze, scratch, scratch_path
from meterline.operators.lineage import ancestor_tables, roots_of_pairs, with_depth
from meterline.operators.turns import _covering, _power_bins
from meterline.plans.rollup import window_account_tokens


def walk(parent, start):
    """Nodes from ``start`` upwards, or None if they repeat."""
    seen = [start]
    while parent.get(seen[-1]):
        if parent[seen[-1]] in seen:
            return None
        seen.append(parent[seen[-1]])
    return seen


def expected_root(parent, session, own):
    """Own parent first, then the graph; None where the session comes back to itself or the ancestry has no end."""
    if not own:
        return session
    above = walk(parent, own)
    return None if own == session or above is None or session in above else above[-1]


def test_roots_of_pairs_as_a_walk(spark):
    draw = random.Random(8)
    names = [f"n{k}" for k in range(60)]
    parent = {n: draw.choice(names) for n in draw.sample(names, 45)}
    pairs = {(n, draw.choice([None, "", *names])) for n in names for _ in range(3)} | set(parent.items())
    edges = spark.createDataFrame(list(parent.items()), "session_id string, parent_session_id string")
    frame = spark.createDataFrame(sorted(pairs, key=str), "session_id string, parent_session_id string")
    got = {(r.session_id, r.parent_session_id): r.root_session_id for r in roots_of_pairs(frame, edges).collect()}
    assert got == {(s, p): expected_root(parent, s, p) for s, p in pairs}


def test_a_deep_chain_takes_few_rounds(spark):
    depth = 5_000
    edges = spark.range(1, depth).select(
        F.concat(F.lit("s"), "id").alias("session_id"), F.concat(F.lit("s"), F.col("id") - 1).alias("parent_session_id")
    )
    # The first session claims a parent far below itself; another one claims a parent beside its own.
    pairs = spark.createDataFrame([("s3", "s4990"), ("s4000", "s17"), ("s4000", "s3999")], "session_id string, parent_session_id string")
    folder = scratch_path(spark, "x").rsplit("/", 1)[0]
    with scratch(spark):
        before = set(children(spark, folder))
        got = {(r.session_id, r.parent_session_id): r.root_session_id for r in roots_of_pairs(pairs, edges).collect()}
        written = set(children(spark, folder)) - before
        assert len([n for n in written if n.startswith("ancestors-")]) == 14 and len(written) < 40
    assert got == {("s3", "s4990"): None, ("s4000", "s17"): "s0", ("s4000", "s3999"): "s0"}


def test_depths(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "a")], "node string, above string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxz"], "node string")
    found = {r.node: r.depth for r in with_depth(nodes, ancestor_tables(edges)).collect()}
    assert found == {"a": 0, "b": 1, "c": 2, "d": 3, "x": 1, "z": 0}


def test_bins_tile_a_span(spark):
    spans = [(0, 0), (5, 5), (1, 1000), (7, 4096), (1_786_000_000_000, 1_786_000_000_000 + 31_536_000_000)]
    rows = spark.createDataFrame(spans, "a bigint, z bigint").select("a", "z", _power_bins(F.col("a"), F.col("z")).alias("bins")).collect()
    for r in rows:
        tiles = sorted((b.bin << b.level, (b.bin + 1) << b.level) for b in r.bins)
        assert tiles[0][0] == r.a and tiles[-1][1] == r.z + 1
        assert all(x[1] == y[0] for x, y in zip(tiles, tiles[1:]))


def test_one_long_turn_leaves_other_sessions_probes_alone(spark):
    year = 31_536_000_000
    turns = [("long", "y", 0, year)] + [(f"s{k}", "t", 100 * i, 100 * i + 63) for k in range(20) for i in range(5)]
    facts = [("long", "f", year // 2)] + [(f"s{k}", f"f{k}", 130) for k in range(20)]
    started = spark.createDataFrame(turns, "_session string, turn_id string, started_at_ms bigint, ended_at_ms bigint")
    probes = spark.createDataFrame(facts, "_session string, source_key string, _at bigint")
    found = {r.source_key: r._found.started_at_ms for r in _covering(probes, started).collect()}
    assert found == {"f": 0, **{f"f{k}": 100 for k in range(20)}}
    levels = freeze(started.select("_session", F.explode(_power_bins(F.col("started_at_ms"), F.col("ended_at_ms"))).alias("b")), "t")
    assert levels.filter("_session <> 'long'").select("b.level").distinct().count() <= 7


def test_account_tokens_of_windows(spark):
    day = 86_400_000
    base = 1_785_513_600_000  # 2026-08-01 at +08:00
    days = [("2026-08-01", 5), ("2026-08-02", 7), ("2026-08-05", 11), ("2026-02-30", 100), ("2026-8-2", 100)]
    windows = [("a", base, base + day), ("b", base + day, None), ("c", base + 2 * day, base + 3 * day), ("d", base + 4 * day, base + day),
               ("e", base - 9 * day, base + 90 * day), ("f", base + 4 * day, base + 4 * day)]
    frame = spark.createDataFrame(windows, "window_id string, window_start_ms bigint, resets_at_ms bigint")
    plan = window_account_tokens(frame, spark.createDataFrame(days, "date string, tokens bigint"))
    assert {r.window_id: r.account_tokens for r in plan.collect()} == {"a": 12, "b": 18, "e": 23, "f": 11}
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    none = window_account_tokens(frame, spark.createDataFrame([], "date string, tokens bigint"))
    assert none.count() == 0
