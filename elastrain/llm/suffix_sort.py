"""Suffix arrays by linear grouping, and the common prefixes of neighbours.

Suffixes start out grouped by their first symbol. Groups are taken from the largest down: each member
points to the nearest position before it that lies in a smaller group, and the positions pointed at are
moved, by the number of pointers they get, into new groups just above their old one. At the end a group
holds the suffixes with one and the same longest Lyndon prefix. A single pass then emits the order
within groups along the same pointers; nothing is renamed or sorted recursively.
"""

from __future__ import annotations

from itertools import groupby


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes in ascending order; the last symbol must be the unique smallest."""
    n = len(symbols)
    members: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    label, above = [0] * n, [0] * (n + 1)  # group of a position: where it begins in the order; above: group that ends there
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    at = 0
    for c in sorted(by_symbol):
        members[at], size[at] = by_symbol[c], len(by_symbol[c])
        for i in by_symbol[c]:
            label[i] = at
        above[at + size[at]] = at
        at += size[at]
    before = [-1] * n

    while at:
        group = above[at]
        for i in (own := [i for i in members.pop(group) if label[i] == group]):
            j = i - 1
            while j >= 0 and label[j] >= group:
                j = before[j]
            before[i] = j
        # Members come in ascending order, and so do their pointers: equal ones are adjacent.
        pointed: dict[int, list[int]] = {}
        for j, who in groupby(own, before.__getitem__):
            if j >= 0:
                pointed.setdefault(sum(1 for _ in who), []).append(j)
        for times in sorted(pointed, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in pointed[times]:
                moved.setdefault(label[j], []).append(j)
            for old, js in moved.items():
                if (left := size[old] - len(js)) == 0:
                    continue
                new = old + left
                size[old], size[new], members[new] = left, len(js), js
                above[new + len(js)], above[new] = new, old
                for j in js:
                    label[j] = new
        at = group

    order, free, placed = [-1] * n, {}, [False] * n
    order[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            spot = free.get(label[j], label[j])
            order[spot], placed[j] = j, True
            free[label[j]] = spot + 1
            j = before[j]
    return order


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """For each place in the order: symbols that its suffix shares with the one before it (0 for the first)."""
    n = len(symbols)
    rank, shared, k = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        if rank[i] == 0:
            k = 0
            continue
        j = order[rank[i] - 1]
        while i + k < n and j + k < n and symbols[i + k] == symbols[j + k]:
            k += 1
        shared[rank[i]] = k
        k = max(0, k - 1)
    return shared


def repeated_starts(texts: list[bytes], length: int) -> list[list[int]]:
    """For each text the positions whose next ``length`` bytes also stand elsewhere in the texts."""
    symbols: list[int] = []
    for i, text in enumerate(texts):
        symbols += [b + len(texts) + 1 for b in text]
        symbols.append(i + 1)  # separators differ, so nothing is shared across them
    symbols.append(0)
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order) + [0]
    found = sorted(order[r] for r in range(len(order)) if max(shared[r], shared[r + 1]) >= length)
    out, at, base = [], 0, 0
    for text in texts:
        mine = []
        while at < len(found) and found[at] < base + len(text):
            mine.append(found[at] - base)
            at += 1
        out.append(mine)
        base += len(text) + 1
    return out
