"""Suffix array by linear grouping: Lyndon-prefix groups in descending order, then each group's order by induction.

First part: suffixes start in groups by their first symbol.  Groups are taken
from the largest down.  Each suffix of the group taken gets a pointer to the
nearest suffix in front of it that lies in a smaller group; the suffixes pointed
at have their Lyndon prefix extended by the group's and move behind the rest of
their own group, those pointed at more often further behind.  In the end a group
holds the suffixes with one Lyndon prefix, and the groups are in order.

Second part: from the smallest suffix up, the suffixes whose next smaller suffix
is the one at hand take the next free places of their groups; they are found by
following the pointers from the position in front of it.  No part of the text is
renamed and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """(group, smaller): the first place of each suffix's group, and its previous smaller suffix or -1."""
    symbols = np.asarray(text)
    n = len(symbols)
    by_symbol = np.argsort(symbols, kind="stable")
    heads = np.concatenate(([True], symbols[by_symbol][1:] != symbols[by_symbol][:-1]))
    starts = np.flatnonzero(heads)
    first = np.empty(n, np.int64)
    first[by_symbol] = starts[np.cumsum(heads) - 1]
    group, order = first.tolist(), by_symbol.tolist()
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    place = place.tolist()
    end = dict(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True))
    smaller = [-2] * n                   # -2: not taken yet, so in a group below the ones taken
    top = n
    while top:
        start = group[order[top - 1]]
        taken = order[start:top]
        top = start
        if len(taken) > 1:
            taken.sort()
        pointed: dict[int, int] = {}
        for x in taken:
            j = x - 1
            while j >= 0 and smaller[j] != -2:
                j = smaller[j]
            smaller[x] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        most = max(pointed.values())
        levels = [pointed] if most == 1 else [[j for j, c in pointed.items() if c == k] for k in sorted(set(pointed.values()), reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for j in level:
                g = group[j]
                m = moved.get(g, 0) + 1
                moved[g] = m
                to, at = end[g] - m, place[j]
                if to != at:
                    other = order[to]
                    order[to], order[at] = j, other
                    place[j], place[other] = to, at
            for g, m in moved.items():
                e = end[g]
                if e - m > g:
                    end[g] = end[e - m] = e - m
                    end[e - m] = e
                    for j in order[e - m:e]:
                        group[j] = e - m
    return group, smaller


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return []
    group, smaller = lyndon_groups(text)
    free = list(range(n))                # by a group's first place: its next free place
    out = [-1] * n
    placed = bytearray(n)
    j = n - 1                            # suffixes that are smaller than all behind them end the text
    while j >= 0:
        g = group[j]
        out[free[g]] = j
        free[g] += 1
        placed[j] = 1
        j = smaller[j]
    for k in out:
        j = k - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out
