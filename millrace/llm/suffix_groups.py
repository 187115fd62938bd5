"""Suffix arrays by linear grouping of suffixes on their longest Lyndon prefixes."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes in ascending order; a suffix comes before those that it begins.

    First, suffixes are grouped by their first symbol and groups are taken from the highest
    to the lowest. Each suffix of a group points to the nearest suffix to its left of a
    lower group (the previous smaller one); those pointed at are moved, by how many
    pointers they got, into new groups right above their old one, whose prefix grows by
    that many copies of the group's. In the end a group holds the suffixes of one longest
    Lyndon prefix, and groups are in order. Second, suffixes are taken in ascending order,
    and whichever suffix's prefix ends where one starts gets the next place of its group.
    Nothing is renamed, and no smaller problem is solved first. Every suffix points once,
    so there are no more moves than suffixes.
    """
    n = len(symbols)
    if n == 0:
        return []
    alphabet = sorted(set(symbols))
    number = {symbol: i for i, symbol in enumerate(alphabet)}
    group = [number[symbol] for symbol in symbols]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(alphabet) - 1))  # the next lower group
    length = [1] * len(alphabet)  # of a group's prefix
    above: list[int] = list(range(1, len(alphabet))) + [-1]
    left = list(range(n))  # leads to the nearest suffix whose group is still to come
    at = len(alphabet) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        for i in own:
            left[i] = i - 1
        pointers: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and left[j] != j:
                j = left[j]
            k = i
            while k != j and k >= 0:
                left[k], k = j, left[k]
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointers.items():
            moved.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moved, key=lambda m: -m[0]) if len(moved) > 1 else moved:
            new, high = len(members), above[old]
            members.append(moved[times, old])
            length.append(length[old] + times * length[at])
            below.append(old)
            above.append(high)
            above[old] = new
            if high >= 0:
                below[high] = new
            for j in members[new]:
                group[j] = new
        at = below[at]
    # Where each group's places begin, from the lowest on.
    place, start = [0] * len(members), 0
    at = 0
    while at >= 0:
        place[at] = start
        start += len(members[at])
        at = above[at]
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        ending[i + length[group[i]]].append(i)
    out = [0] * n
    for j in ending[n]:
        out[place[group[j]]] = j
        place[group[j]] += 1
    for rank in range(n):
        for j in ending[out[rank]]:
            out[place[group[j]]] = j
            place[group[j]] += 1
    return out
