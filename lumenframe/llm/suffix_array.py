"""Suffix array by linear grouping.

Suffixes are grouped by a prefix that ends up as their longest Lyndon prefix.
Groups are taken in descending order; each member points at the nearest
position before it whose suffix lies in a smaller group, and that position's
prefix grows by the member's (once for each of several members in a row), which
moves it to a new group just above its old one. Then suffixes are emitted in
ascending order: a suffix hands its place on to the suffixes whose Lyndon
prefix ends where it begins, each taking the next free place of its group, so
nothing is ever renamed or sorted again (after Baier, CPM 2016).
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each position, previous-smaller pointers, groups in ascending order)."""
    n = len(codes)
    members: list[list[int]] = []
    group, size, below = [0] * n, [], []
    by_code: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        by_code.setdefault(c, []).append(i)
    above_of: dict[int, int] = {}
    last = -1
    for c in sorted(by_code):
        g = len(members)
        members.append(by_code[c])
        size.append(len(by_code[c]))
        below.append(last)
        if last >= 0:
            above_of[last] = g
        for i in by_code[c]:
            group[i] = g
        last = g
    smaller, done = [-1] * (n + 1), [False] * (n + 1)  # position -1 reads the spare last entry
    descending = []
    now = last
    while now >= 0:
        descending.append(now)
        parents, repeats = [], []
        for i in members[now]:
            if group[i] != now:
                continue
            j = i - 1
            while done[j]:
                j = smaller[j]
            smaller[i] = j
            done[i] = True
            if j >= 0:
                if parents and parents[-1] == j:
                    repeats[-1] += 1
                else:
                    parents.append(j)
                    repeats.append(1)
        members[now] = ()
        if len(parents) == 1:
            g = group[parents[0]]
            if size[g] > 1:
                _raise(parents, g, group, size, members, below, above_of)
        elif parents:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in zip(parents, repeats):
                moved.setdefault((-k, group[p]), []).append(p)
            for (_, g), some in sorted(moved.items()) if len(moved) > 1 else moved.items():
                if size[g] > len(some):
                    _raise(some, g, group, size, members, below, above_of)
        now = below[now]
    descending.reverse()
    return group, smaller, descending


def _raise(some, g, group, size, members, below, above_of) -> None:
    """Moves positions out of a group into a new one just above it."""
    new = len(members)
    members.append(some)
    size.append(len(some))
    size[g] -= len(some)
    for p in some:
        group[p] = new
    up = above_of.get(g, -1)
    below.append(g)
    above_of[g] = new
    if up >= 0:
        below[up] = new
        above_of[new] = up


def suffix_array(codes: list[int]) -> np.ndarray:
    """Suffix order of a sequence whose last element is smaller than all others."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    group, smaller, ascending = lyndon_groups(codes)
    sizes = np.bincount(group)
    place = np.zeros(len(sizes), np.int64)
    order = np.array(ascending)
    place[order] = np.concatenate(([0], np.cumsum(sizes[order])[:-1]))
    free = place.tolist()
    out, placed = [0] * n, [False] * (n + 1)
    out[0] = n - 1
    placed[n - 1] = placed[n] = True  # the spare last entry stands for "before the text"
    for k in range(n):
        j = out[k] - 1
        while not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
    return np.array(out)
