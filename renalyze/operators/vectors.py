"""Array kernels for histories that change over time (numpy only).

A batch holds the rows of many patients, each patient's rows contiguous
(a segment) and in arrival order; positions 0 .. n-1 are moments in time.
Every function works on whole arrays in O(n log n).
"""

from __future__ import annotations

import numpy as np


def kth_in_prefix(rank: np.ndarray, sign: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query, the ``k``-th smallest (from 0) rank of the multiset that
    the events ``lo .. hi-1`` leave: an event adds (+1) or removes (-1) its rank.

    A descent over the bits of the ranks, all queries at once: the events are
    split stably by the bit, and the signed count of those without it says which side holds the k-th.
    """
    lo, hi, k = lo.astype(np.int64), hi.astype(np.int64), k.astype(np.int64)
    found = np.zeros(len(k), np.int64)
    if not len(rank) or not len(k):
        return found
    for bit in reversed(range(max(1, int(rank.max()).bit_length()))):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.r_[0, np.cumsum(~one)]
        weight = np.r_[0, np.cumsum(np.where(one, 0, sign))]
        below = weight[hi] - weight[lo]
        right = k >= below
        n_zeros = zeros[-1]
        lo = np.where(right, n_zeros + lo - zeros[lo], zeros[lo])
        hi = np.where(right, n_zeros + hi - zeros[hi], zeros[hi])
        k = np.where(right, k - below, k)
        found |= right.astype(np.int64) << bit
        order = np.argsort(one, kind="stable")
        rank, sign = rank[order], sign[order]
    return found


def covering_max(n: int, start: np.ndarray, end: np.ndarray, value: np.ndarray, empty) -> np.ndarray:
    """At each of ``n`` moments, the largest value of the intervals [start, end) that cover it."""
    out = np.full(n, empty, value.dtype if len(value) else np.asarray(empty).dtype)
    some = end > start
    start, end, value = start[some], end[some], value[some]
    if not len(start):
        return out
    # each interval is two overlapping runs of a power of two; runs are handed down level by level
    level = np.floor(np.log2(end - start)).astype(int)
    level -= (1 << level) > (end - start)
    level += (2 << level) <= (end - start)
    table = np.full(n, empty, out.dtype)
    for k in range(int(level.max()), -1, -1):
        here = level == k
        np.maximum.at(table, start[here], value[here])
        np.maximum.at(table, end[here] - (1 << k), value[here])
        if k:
            half = 1 << (k - 1)
            down = table.copy()
            down[half:] = np.maximum(down[half:], table[:-half] if half < n else table[:0])
            table = down
    return table


def nearest_smaller(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place, the nearest place before it, not before ``first``, with a
    smaller ``f`` (distinct numbers); -1 if there is none."""
    n = len(f)
    tables, width = [f], 1
    while 2 * width <= n:
        t = tables[-1]
        tables.append(np.minimum(t[:-width], t[width:]))        # minimum of f[p : p + 2 * width]
        width *= 2
    at = np.arange(n)                                            # f[at : place] is known to be larger
    for k in range(len(tables) - 1, -1, -1):
        w = 1 << k
        fits = at - w >= first
        low = np.where(fits, tables[k][np.where(fits, at - w, 0)], np.iinfo(np.int64).min)
        at = np.where(fits & (low > f), at - w, at)
    return np.where(at > first, at - 1, -1)


def last_at_most(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of the last of the sorted ``keys`` that is at most each wanted one; -1 if none."""
    return np.searchsorted(keys, wanted, "right") - 1


def segment_sums(first: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Running sums within segments (``first``: each row's first row), in extended precision."""
    total = np.cumsum(add, dtype=np.longdouble)
    return total - (total[first] - add[first])


def step_intervals(date: np.ndarray, first: np.ndarray, end_of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, step): how long each difference between neighbouring
    readings stands.  ``date`` numbers the rows' dates in date order, patient by
    patient; ``first`` / ``end_of``: first and one-past-last row of the row's patient.

    A new date stands between the nearest older dates on both sides: two
    neighbourhoods begin, and the one between those two ends.  Within a
    neighbourhood the difference changes when either reading is overwritten.
    """
    n, n_dates = len(date), int(date.max()) + 1 if len(date) else 0
    rows = np.lexsort((np.arange(n), date))                      # versions by (date, arrival)
    by_date = date[rows]
    opens = np.r_[True, by_date[1:] != by_date[:-1]] if n else np.zeros(0, bool)
    born = rows[opens]                                           # each date's first row
    seg_first = first[born]
    lowest = np.searchsorted(seg_first, seg_first, "left")       # the patient's first date
    left = nearest_smaller(born, lowest)
    flipped = n_dates - 1 - (np.searchsorted(seg_first, seg_first, "right") - 1)[::-1]
    right = nearest_smaller(born[::-1], flipped)[::-1]
    right = np.where(right < 0, -1, n_dates - 1 - right)
    dates = np.arange(n_dates)
    has_l, has_r = left >= 0, right >= 0
    a = np.r_[left[has_l], dates[has_r]]                         # neighbourhoods (a, b), from ``since``
    b = np.r_[dates[has_l], right[has_r]]
    since = np.r_[born[has_l], born[has_r]]
    until = end_of[born][np.r_[dates[has_l], dates[has_r]]]
    both = has_l & has_r
    split = left[both] * n_dates + right[both]
    order = np.argsort(split)
    hit = np.searchsorted(split[order], a * n_dates + b)
    hit_ok = (hit < len(split)) & (split[order][np.minimum(hit, len(split) - 1)] == a * n_dates + b) if len(split) else np.zeros(len(a), bool)
    until = np.where(hit_ok, born[both][order][np.minimum(hit, len(split) - 1)] if len(split) else 0, until)
    # moments of change: the begin, and every overwrite of either side while it stands
    pair, at = [np.arange(len(a))], [since]
    over, over_date = rows[~opens], by_date[~opens]
    for side in (a, b):
        o = np.lexsort((since, side))
        k = last_at_most(side[o] * (n + 1) + since[o], over_date * (n + 1) + over)
        p = o[np.maximum(k, 0)] if len(o) else np.zeros(len(over), int)
        ok = (k >= 0) & (side[p] == over_date) & (until[p] > over) if len(o) else np.zeros(len(over), bool)
        pair.append(p[ok])
        at.append(over[ok])
    pair, at = np.concatenate(pair), np.concatenate(at)
    o = np.lexsort((at, pair))
    pair, at = pair[o], at[o]
    ends = np.where(np.r_[pair[1:] == pair[:-1], False], np.r_[at[1:], 0], until[pair]) if len(pair) else at
    versions = by_date * (n + 1) + rows
    step = (value[rows][last_at_most(versions, b[pair] * (n + 1) + at)]
            - value[rows][last_at_most(versions, a[pair] * (n + 1) + at)])
    ok = ~np.isnan(step)
    return at[ok], ends[ok], step[ok]
