"""Slopes between points of one curve of spent credit over percent, without forming all pairs.

Arrays hold one window's points.  A candidate is the credit of an interval over its share of
a hundred percent; credit is in millionths and never falls with time.
"""

from __future__ import annotations

import numpy as np

#: Slopes this close count as equal until they are compared as the numbers that are reported.
_NEAR = 1e-12


def _candidate(spent: np.ndarray | int, rise: np.ndarray | float) -> np.ndarray | float:
    return spent / 1_000_000.0 / (rise / 100.0)


def _reach(levels: np.ndarray, percent: np.ndarray, least: float) -> np.ndarray:
    """How many of the sorted levels lie at least ``least`` below each percent, as its own subtraction rounds."""
    count = np.searchsorted(levels, percent - least, side="right")
    while True:
        more = count < len(levels)
        more[more] = percent[more] - levels[count[more]] >= least
        less = count > 0
        less[less] = percent[less] - levels[count[less] - 1] < least
        if not (more.any() or less.any()):
            return count
        count = count + more - less


def count_intervals(percent: np.ndarray, least: float) -> int:
    """Pairs of points in time order of which the later is at least ``least`` higher: ranks in a binary indexed tree."""
    levels, rank = np.unique(percent, return_inverse=True)
    reach = _reach(levels, percent, least)
    tree, total = [0] * (len(levels) + 1), 0
    for place, upto in zip(rank.tolist(), reach.tolist(), strict=True):
        while upto > 0:
            total += tree[upto]
            upto &= upto - 1
        at = place + 1
        while at < len(tree):
            tree[at] += 1
            at += at & -at
    return total


def steepest(ms: np.ndarray, percent: np.ndarray, spent: np.ndarray, least: float):
    """(candidate, from_ms, to_ms, from_percent, to_percent, intervals) of the best interval; None without any.

    ``ms`` rises.  Of equal candidates that from the earliest point counts, then that to the latest.
    Credit never falls, so the best start on a level is its first point and the best
    end its last one, and an interval against time is never better than one along it.
    """
    intervals = count_intervals(percent, least)
    if not intervals:
        return None
    levels, first = np.unique(percent, return_index=True)
    last = len(percent) - 1 - np.unique(percent[::-1], return_index=True)[1]
    reach = _reach(levels, levels, least)
    low, high = spent[first], spent[last]
    hull: list[int] = []

    def slope(a: int, b: int) -> float:
        return (high[b] - low[a]) / (levels[b] - levels[a])

    best, added = None, 0
    for b in range(len(levels)):
        while added < reach[b]:
            while len(hull) > 1:
                p, q = hull[-2], hull[-1]
                through = (low[q] - low[p]) * (levels[added] - levels[q])
                beyond = (low[added] - low[q]) * (levels[q] - levels[p])
                # A point on the line stays: its candidate may be the one to report.
                if through <= beyond + _NEAR * max(abs(through), abs(beyond)):
                    break
                hull.pop()
            hull.append(added)
            added += 1
        if not hull:
            continue
        # Slopes to the end rise along the hull up to the tangent, then fall.
        left, right = 0, len(hull) - 1
        while left < right:
            middle = (left + right) // 2
            here, there = slope(hull[middle], b), slope(hull[middle + 1], b)
            if there > here:
                left = middle + 1
            else:
                right = middle
        peak = slope(hull[left], b)
        near = peak - _NEAR * abs(peak)
        start = end = left
        while start > 0 and slope(hull[start - 1], b) >= near:
            start -= 1
        while end + 1 < len(hull) and slope(hull[end + 1], b) >= near:
            end += 1
        for a in hull[start : end + 1]:
            if first[a] < last[b]:
                value = float(_candidate(high[b] - low[a], levels[b] - levels[a]))
                found = (value, -int(ms[first[a]]), int(ms[last[b]]), float(levels[a]), float(levels[b]))
                best = found if best is None or found[:3] > best[:3] else best
    if best is None or best[0] <= 0:
        best = _flat(ms, levels, first, last, reach)
    return best[0], -best[1], best[2], best[3], best[4], intervals


def _flat(ms, levels, first, last, reach):
    """Where no credit was spent in any interval: the earliest start, then the latest end."""
    for a in np.argsort(first, kind="stable").tolist():
        ends = np.flatnonzero((reach > a) & (last > first[a]))
        if len(ends):
            b = ends[np.argmax(last[ends])]
            return 0.0, -int(ms[first[a]]), int(ms[last[b]]), float(levels[a]), float(levels[b])
    raise AssertionError("there is an interval")


def slope_spread(ms: np.ndarray, percent: np.ndarray, spent: np.ndarray, least: float):
    """(intervals, median, greatest less least) of the candidates of all pairs; None without any.

    Points come by rising percent.  Candidates are made for one end at a time and never kept:
    a histogram of their numbers narrows down to the values around the middle, which are then
    selected exactly.
    """
    reach = _reach(percent, percent, least)

    def each():
        for b in np.flatnonzero(reach).tolist():
            starts = slice(0, reach[b])
            along = ms[starts] < ms[b]
            if along.any():
                yield _candidate(spent[b] - spent[starts][along], percent[b] - percent[starts][along])

    count, low, high = 0, np.inf, -np.inf
    for values in each():
        count, low, high = count + len(values), min(low, values.min()), max(high, values.max())
    if not count:
        return None
    spread = float(high - low)
    wanted = [(count - 1) // 2, count // 2]
    # Bounds of a bracket that holds the wanted places, and how many lie below it.
    below, inside = 0, count
    left, right = low, high
    while inside > max(4 * len(percent), 1024) and left < right:
        edges = np.linspace(left, right, 257)
        edges[0], edges[-1] = left, right
        if not (np.diff(edges) > 0).all():
            break
        sums = np.zeros(256, np.int64)
        for values in each():
            sums += np.histogram(values[(values >= left) & (values <= right)], edges)[0]
        upto = below + np.cumsum(sums)
        one, two = np.searchsorted(upto, [wanted[0] + 1, wanted[1] + 1])
        if one == 0 and two == 255:
            break
        below = int(upto[one - 1]) if one else below
        inside = int(upto[two]) - below
        # The last bin is closed on the right, the others are not.
        left, right = edges[one], edges[two + 1] if two == 255 else np.nextafter(edges[two + 1], -np.inf)
    kept = np.sort(np.concatenate([v[(v >= left) & (v <= right)] for v in each()]))
    first, second = (float(kept[place - below]) for place in wanted)
    # The mean of two numbers as a linear interpolation at a half, like SQL's.
    return count, first + (second - first) * 0.5, spread
