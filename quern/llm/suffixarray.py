"""Suffix arrays by linear grouping: Lyndon prefixes first, then the order inside each group.

Phase one keeps suffixes in groups ordered by the prefix that their members share, and takes the groups from the highest
down. The previous-smaller pointers of a group's suffixes are the positions whose prefix this group extends: they move
up inside their own groups, the more of this group they are followed by, the higher. When all groups are taken, a
group holds the suffixes of one Lyndon prefix. Phase two emits suffixes in ascending order and puts, along the
pointers, each preceding suffix at the next free place of its group. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """The places of ``s`` in the order of its suffixes; a suffix that is a prefix of another comes first."""
    n = len(s)
    if not n:
        return []
    # Groups are spans of `order`; `head` is a suffix's span by its first place, which also orders the groups.
    low = [n, *sorted(range(n), key=s.__getitem__)]  # place n is the empty suffix, lowest of all
    order, where, head, size = low, [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    at = 0
    while at <= n:
        end = at + 1
        while end <= n and at and s[order[end]] == s[order[at]]:
            end += 1
        for k in range(at, end):
            where[order[k]], head[order[k]] = k, at
        size[at] = end - at
        at = end
    prev = [-1] * (n + 1)
    last = n
    while last >= 0:
        g = head[order[last]]
        members = sorted(order[g : last + 1])
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and head[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        by_group: dict[int, dict[int, list[int]]] = {}
        for j, c in counts.items():
            by_group.setdefault(head[j], {}).setdefault(c, []).append(j)
        for h, by_count in by_group.items():
            end = h + size[h]
            for c in sorted(by_count, reverse=True):
                movers = by_count[c]
                start = end - len(movers)
                if start == h:
                    break  # the whole rest has this count: it keeps its span
                for k, j in zip(range(end - 1, start - 1, -1), movers):
                    other = order[k]
                    p = where[j]
                    order[p], order[k], where[other], where[j] = other, j, p, k
                for j in movers:
                    head[j] = start
                size[start] = len(movers)
                size[h] = start - h
                end = start
        last = g - 1
    # Phase two.
    free = list(range(n + 1))
    out, placed = [-1] * (n + 1), bytearray(n + 1)
    out[0] = n
    placed[n] = 1
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            h = head[j]
            out[free[h]] = j
            free[h] += 1
            placed[j] = 1
            j = prev[j]
    return out[1:]
