"""Suffix sorting by groups of Lyndon prefixes, in linear time and without recursion on renamed texts.

First the suffixes are refined into groups: a group is taken in descending order, every member points to its
previous smaller suffix, and the suffixes pointed to leave their group for a higher one, those pointed to more often
for a still higher one. What is left is one group for each Lyndon prefix, in their order. Then a single pass over the
growing suffix array puts, for each placed suffix, the suffix to its left and the chain of its previous smaller
suffixes at the front of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer sequence in lexicographic order (a proper prefix comes first)."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    text = np.asarray(symbols)
    first = np.argsort(text, kind="stable")
    ordered = text[first]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    owner = np.repeat(heads, np.diff(np.append(heads, n)))
    inverse = np.empty(n, np.int64)
    inverse[first] = np.arange(n)
    of = np.empty(n, np.int64)
    of[first] = owner

    slots: list[int] = first.tolist()  # suffixes by group; a group is slots[g : g + size[g]], and g is its name
    place: list[int] = inverse.tolist()  # where in slots a suffix is
    group: list[int] = of.tolist()
    size = [0] * n
    for h, c in zip(heads.tolist(), np.diff(np.append(heads, n)).tolist()):
        size[h] = c
    previous = [-1] * n
    done = bytearray(n)

    top = n
    while top > 0:
        g = group[slots[top - 1]]
        if top - g == 1:
            # the usual case, a single suffix
            i = slots[g]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                h = group[p]
                last = h + size[h] - 1
                if last != h:
                    at, other = place[p], slots[last]
                    slots[at], slots[last] = other, p
                    place[other], place[p] = at, last
                    size[h] -= 1
                    size[last] = 1
                    group[p] = last
            top = g
            continue
        members = slots[g:top]
        for i in members:
            done[i] = 1
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        top = g
        if not pointed:
            continue
        # those pointed to most often go highest; within one count, those of one group stay together
        levels: dict[int, list[int]] = {}
        for p, c in pointed.items():
            if c in levels:
                levels[c].append(p)
            else:
                levels[c] = [p]
        for c in sorted(levels, reverse=True):
            parts: dict[int, list[int]] = {}
            for p in levels[c]:
                h = group[p]
                if h in parts:
                    parts[h].append(p)
                else:
                    parts[h] = [p]
            for h, moved in parts.items():
                if len(moved) == size[h]:
                    continue
                last = h + size[h]
                for p in moved:
                    last -= 1
                    at, other = place[p], slots[last]
                    slots[at], slots[last] = other, p
                    place[other], place[p] = at, last
                size[h] -= len(moved)
                size[last] = len(moved)
                for p in moved:
                    group[p] = last

    out = [-1] * n
    front = list(range(n))  # of a group: the next slot to fill
    used = bytearray(n)
    i = n - 1  # the empty suffix comes before all others, so the last one and its chain are placed first
    at = 0
    while True:
        while i >= 0 and not used[i]:
            used[i] = 1
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            i = previous[i]
        if at == n:
            break
        i = out[at] - 1
        at += 1
    return np.array(out, np.int64)
