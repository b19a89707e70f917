"""Suffix sorting by Lyndon-prefix groups (Baier's linear grouping construction).

Phase 1 refines suffix groups until all suffixes of a group share their longest Lyndon prefix, taking groups in descending
order; phase 2 walks the order from its low end and files each suffix, and those that point to it through their
previous-smaller pointers, into its group. No suffix is ever renamed recursively.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

#: Longer texts keep their tables in packed arrays, which are a little slower and far smaller than lists.
PACK = 1 << 18


def suffix_array(text: Sequence[int]) -> list[int]:
    """Order of the suffixes of text; a shorter suffix precedes a longer one that begins with it."""
    n = len(text) + 1  # an end mark smaller than all symbols
    if n == 1:
        return []
    symbols = sorted(set(text))
    start = {}
    members: dict[int, list[int]] = {0: [n - 1]}
    for c in symbols:
        start[c] = -1
    counts: dict[int, int] = dict.fromkeys(symbols, 0)
    for c in text:
        counts[c] += 1
    at = 1
    table = (lambda x: array("q", x)) if n > PACK else list
    size = table([0]) * n  # by a group's first place in the order, which is also its name
    size[0] = 1
    top = table([0]) * n  # a group's name by its last place
    for c in symbols:
        start[c] = at
        members[at] = []
        size[at] = counts[c]
        at += counts[c]
        top[at - 1] = start[c]
    group = table([start[c] for c in text])
    group.append(0)
    for i in range(n - 1):
        members[group[i]].append(i)
    prev = table([-1]) * n
    end = n
    while end > 0:
        g = top[end - 1]
        # phase 1, one group: prev[s] is the nearest place before s whose suffix lies in a lower group
        fans: dict[int, int] = {}
        for s in members.pop(g):
            if group[s] != g:
                continue  # it moved up when a higher group was taken
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                fans[p] = fans.get(p, 0) + 1
        end = g
        if not fans:
            continue
        # places that more of the group point to are larger; each class moves to the top of its own group
        if len(fans) == 1:
            ((p, _),) = fans.items()
            h = group[p]
            if size[h] > 1:
                size[h] -= 1
                new = h + size[h]
                top[new] = new
                top[new - 1] = h
                size[new] = 1
                members[new] = [p]
                group[p] = new
            continue
        most = max(fans.values())
        if most == 1:
            classes = [fans]
        else:
            by: list[list[int]] = [[] for _ in range(most + 1)]
            for p, k in fans.items():
                by[k].append(p)
            classes = [by[k] for k in range(most, 0, -1) if by[k]]
        for places in classes:
            moved: dict[int, list[int]] = {}
            for p in places:
                h = group[p]
                if h in moved:
                    moved[h].append(p)
                else:
                    moved[h] = [p]
            for h, own in moved.items():
                k = len(own)
                rest = size[h] - k
                if rest == 0:
                    continue
                new = h + rest
                size[h] = rest
                size[new] = k
                top[new + k - 1] = new
                top[new - 1] = h
                own.sort()
                members[new] = own
                for p in own:
                    group[p] = new
    # phase 2
    order = table([0]) * n
    order[0] = n - 1
    free = table(range(n))
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = prev[s]
    return list(order[1:])
