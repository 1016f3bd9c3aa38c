"""Suffix array by linear grouping, without recursion or renaming.

First part: suffixes are grouped by their longest Lyndon prefix. Groups start as first symbols and are taken from the
greatest down. When a group is taken, each member s looks for its parent: the nearest suffix before it in a smaller
group, found along the parents of the suffixes between (previous-smaller pointers). The parent's prefix grows by the
member's, so within its own group a parent moves behind those that got nothing, the further the more members it got.

Second part: suffixes are emitted in ascending order. When suffix i is emitted, i - 1, its parent, that one's parent
and so on are the ones whose Lyndon prefix ends at i; each that isn't placed yet takes the next place of its group."""

from __future__ import annotations

import numpy as np


def lyndon_groups(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """For each suffix its group's first place in suffix order, and its parent (-1 for none). The last symbol must be
    the only least one."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    start = np.searchsorted(ranked, symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    size = np.bincount(start, minlength=n).tolist()
    sa, group, at = order.tolist(), start.tolist(), place.tolist()
    parent = [-1] * n
    last = n - 1
    while last > 0:
        first = group[sa[last]]
        got: dict[int, int] = {}
        members = sa[first : last + 1]
        if last > first:
            members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = parent[p]
            if p >= 0:
                parent[s] = p
                got[p] = got.get(p, 0) + 1
        if len(got) == 1:
            (p,) = got
            old = group[p]
            if size[old] > 1:
                end = old + size[old] - 1
                other, mine = sa[end], at[p]
                sa[mine], sa[end], at[other], at[p] = other, p, mine, end
                group[p], size[end] = end, 1
                size[old] -= 1
        elif got:
            moved: dict[int, dict[int, list[int]]] = {}
            for p, times in got.items():
                moved.setdefault(group[p], {}).setdefault(times, []).append(p)
            for old, runs in moved.items():
                end = old + size[old]
                for times in sorted(runs, reverse=True):
                    run = runs[times]
                    begin = end - len(run)
                    for p in run:
                        end -= 1
                        other, mine = sa[end], at[p]
                        sa[mine], sa[end], at[other], at[p] = other, p, mine, end
                        group[p] = begin
                    size[begin] = len(run)
                if end > old:
                    size[old] = end - old
        last = first - 1
    return group, parent


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a sequence of non-negative integers, in lexicographic order."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    group, parent = lyndon_groups(text)
    out, free = [0] * (n + 1), list(range(n + 1))
    placed = bytearray(n + 1)
    out[0] = n
    placed[n] = 1
    for i in range(n + 1):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = parent[s]
    return np.array(out[1:], np.int64)


def repeats(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in suffix order whether the next suffix agrees with it in its first `length` symbols (Kasai)."""
    n = len(order)
    t, sa = symbols.tolist(), order.tolist()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rank = rank.tolist()
    out = np.zeros(n, bool)
    h = 0
    for i in range(n):
        r = rank[i]
        if r + 1 < n:
            j = sa[r + 1]
            stop = n - max(i, j)
            while h < stop and t[i + h] == t[j + h]:
                h += 1
            out[r] = h >= length
            if h:
                h -= 1
        else:
            h = 0
    return out
