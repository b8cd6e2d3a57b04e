"""Linear suffix sorting by groups of equal Lyndon prefixes.

Every suffix belongs to the group of its longest Lyndon prefix. Groups are finished in descending
order: a suffix hands its group's word to the nearest earlier suffix that is smaller, which so
grows its own prefix and moves to a new group just above its old one (the further up, the more
copies of the word it took). When no group is left, groups ascend as their suffixes do. Within a
group the order is that of the suffixes after the common word; these are smaller, so one ascending
pass over the result emits every suffix into the next place of its group. No names are assigned
and nothing recurs.
"""

from __future__ import annotations


def lyndon_groups(text) -> tuple[list[list[int]], list[int]]:
    """The groups in ascending order, and for each suffix the nearest earlier smaller one (-1: none)."""
    n = len(text)
    first: dict = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    order = sorted(first)
    members = [first[c] for c in order]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    lower = list(range(-1, len(members) - 1))
    higher = list(range(1, len(members) + 1))
    if higher:
        higher[-1] = -1
    back = list(range(-1, n - 1))  # for a finished suffix, where to look on for one that isn't
    done = bytearray(n)
    before = [-1] * n
    finished = []
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        own = [i for i in own if group[i] == g]
        finished.append(own)
        for i in own:
            done[i] = 1
        took: dict[int, int] = {}
        for i in own:
            j = back[i]
            if j >= 0 and done[j]:
                way = [i]
                while j >= 0 and done[j]:
                    way.append(j)
                    j = back[j]
                for k in way:
                    back[k] = j
            before[i] = j
            if j >= 0:
                took[j] = took.get(j, 0) + 1
        moves: dict[int, dict] = {}
        for j, times in took.items():
            moves.setdefault(group[j], {}).setdefault(times, []).append(j)
        for old, by_times in moves.items():
            below = old
            for times in sorted(by_times):
                new, above = len(members), higher[below]
                members.append(by_times[times])
                lower.append(below)
                higher.append(above)
                higher[below] = new
                lower[above] = new  # there is always one above: the group being finished
                for j in by_times[times]:
                    group[j] = new
                below = new
        g = lower[g]
    finished.reverse()
    return finished, before


def suffix_array(text) -> list[int]:
    """Positions of the sorted suffixes of a sequence of comparable, hashable symbols."""
    n = len(text)
    groups, before = lyndon_groups(text)
    group, place, at = [0] * n, [], 0
    for g, own in enumerate(groups):
        place.append(at)
        at += len(own)
        for i in own:
            group[i] = g
    out, sorted_yet = [0] * n, bytearray(n)

    def emit(i: int) -> None:
        """The suffixes whose next smaller one starts at ``i + 1``."""
        while i >= 0 and not sorted_yet[i]:
            g = group[i]
            out[place[g]] = i
            place[g] += 1
            sorted_yet[i] = 1
            i = before[i]

    emit(n - 1)  # those that end with the text
    for r in range(n):
        i = out[r] - 1
        if i >= 0 and not sorted_yet[i]:
            emit(i)
    return out
