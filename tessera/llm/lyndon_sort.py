"""Suffix arrays by grouping Lyndon prefixes.

Phase 1 groups suffixes by their longest Lyndon prefix. Groups are taken from the largest down; for a suffix
of the current group, the nearest suffix to its left that lies in a smaller group (its previous-smaller
pointer) has its prefix extended by the group's, so it moves to a new group just above its old one. Pointers
jump over finished suffixes, and each is jumped over once, so all jumps are linear in number. Phase 2 emits
the order: when a suffix is emitted, the suffixes whose Lyndon prefix ends where it begins follow in their
groups; they are found by the same pointers. No names are assigned and nothing recurses. Members of a group are gone
through in text order, which Python's sort gives; apart from these sorts all work is linear in the text.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Order of the suffixes of ``text``; its last symbol must be smaller than all others."""
    n = len(text)
    symbols = sorted(set(text))
    place = {c: g for g, c in enumerate(symbols)}
    group = [place[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    above = list(range(1, len(symbols) + 1))  # a list linked in group order; -1 is its lower end
    below = list(range(-1, len(symbols) - 1))
    above[-1] = -1
    done, before, copies = bytearray(n), [-1] * n, [0] * n
    order: list[int] = []
    sizes: list[int] = []
    current = len(symbols) - 1
    while current >= 0:
        mine = [i for i in members[current] if group[i] == current]
        members[current] = mine
        if len(mine) > 1:
            mine.sort()
        order.append(current)
        sizes.append(len(mine))
        for i in mine:
            done[i] = 1
        touched = []
        for i in mine:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                if not copies[j]:
                    touched.append(j)
                copies[j] += 1
        if len(touched) == 1:
            p = touched[0]
            copies[p] = 0
            old = group[p]
            if len(members[old]) > 1:
                fresh = len(members)
                members.append([p])
                group[p] = fresh
                top = above[old]
                above.append(top)
                below.append(old)
                above[old] = fresh
                if top >= 0:
                    below[top] = fresh
        elif touched:
            parts: dict[int, list[int]] = {}
            for p in touched:
                key = group[p] * n + copies[p]
                copies[p] = 0
                if key in parts:
                    parts[key].append(p)
                else:
                    parts[key] = [p]
            for key in sorted(parts, reverse=True):  # fewer copies lie lower, so they go in last, just above the old group
                old, fresh = key // n, len(members)
                moved = parts[key]
                members.append(moved)
                for p in moved:
                    group[p] = fresh
                top = above[old]
                above.append(top)
                below.append(old)
                above[old] = fresh
                if top >= 0:
                    below[top] = fresh
        current = below[current]

    start = [0] * len(members)
    at = 0
    for g, size in zip(reversed(order), reversed(sizes), strict=True):
        start[g] = at
        at += size
    out = [0] * n
    out[0] = n - 1
    start[group[n - 1]] += 1
    for k in range(n):
        x = out[k]
        stop, j = before[x], x - 1
        while j != stop:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            j = before[j]
    return out
