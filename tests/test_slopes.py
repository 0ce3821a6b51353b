"""Best slopes, counts and medians against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterline.functions.slopes import count_intervals, slope_spread, steepest

POINTS = st.lists(
    st.tuples(st.sampled_from([0.0, 3.3, 4.999, 5.0, 8.3, 10.1, 10.6, 33.3, 38.3, 50.0, 99.9]), st.sampled_from([0, 0, 7, 1_000_000, 2_500_000])), max_size=40
)


def arrays(points):
    percent = np.array([p for p, _ in points], float)
    return np.arange(len(points)) * 60_000, percent, np.cumsum([c for _, c in points], dtype=np.int64)


def pairs(ms, percent, spent, least):
    for i in range(len(ms)):
        for j in range(len(ms)):
            if ms[i] < ms[j] and percent[j] - percent[i] >= least:
                value = (spent[j] - spent[i]) / 1_000_000.0 / ((percent[j] - percent[i]) / 100.0)
                yield float(value), -int(ms[i]), int(ms[j]), float(percent[i]), float(percent[j])


@settings(max_examples=300, deadline=None)
@given(POINTS)
def test_steepest_as_all_pairs(points):
    ms, percent, spent = arrays(points)
    every = list(pairs(ms, percent, spent, 5.0))
    assert count_intervals(percent, 5.0) == len(every)
    best = max(every, default=None)
    expected = best and (best[0], -best[1], best[2], best[3], best[4], len(every))
    assert steepest(ms, percent, spent, 5.0) == expected


def checkpoints(ms, percent, spent):
    levels, first = np.unique(percent, return_index=True)
    return ms[first], levels, spent[first]


@settings(max_examples=200, deadline=None)
@given(POINTS)
def test_spread_as_all_pairs(points):
    ms, percent, spent = checkpoints(*arrays(points))
    every = [v for v, *_ in pairs(ms, percent, spent, 5.0)]
    found = slope_spread(ms, percent, spent, 5.0)
    if not every:
        assert found is None
    else:
        assert found[0] == len(every) and found[2] == max(every) - min(every)
        assert found[1] == pytest.approx(float(np.median(every)), rel=1e-14)


def test_a_week_of_fractional_percents():
    draw = np.random.default_rng(3)
    n = 10_080
    percent = np.round(np.sort(draw.random(n)) * 100, 6) + draw.integers(0, 2, n) * 0.01
    spent = np.cumsum(draw.integers(0, 900_000, n))
    ms = np.arange(n) * 60_000
    found = steepest(ms, percent, spent, 5.0)
    best, total = None, 0
    for j in range(n):
        along = np.flatnonzero(percent[j] - percent[:j] >= 5.0)
        total += len(along)
        if len(along):
            values = (spent[j] - spent[along]) / 1_000_000.0 / ((percent[j] - percent[along]) / 100.0)
            k = int(np.argmax(values))
            best = max(best or (-1.0,), (float(values[k]), -int(ms[along[k]]), int(ms[j])))
    assert (found[0], -found[1], found[2]) == best and found[5] == total
    few = slice(0, n, 4)
    cms, cp, cs = checkpoints(ms[few], percent[few], spent[few])
    every = np.concatenate([(cs[b] - cs[:b]) / 1_000_000.0 / ((cp[b] - cp[:b]) / 100.0) if b else [] for b in range(len(cp))])
    keep = np.concatenate([(cp[b] - cp[:b] >= 5.0) & (cms[:b] < cms[b]) if b else np.zeros(0, bool) for b in range(len(cp))])
    got = slope_spread(cms, cp, cs, 5.0)
    assert got[0] == keep.sum() and got[1] == pytest.approx(float(np.median(every[keep])), rel=1e-14)
