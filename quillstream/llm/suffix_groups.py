"""Suffix arrays by linear grouping, for many short texts at once.

A suffix belongs to the group of its longest Lyndon prefix. Groups start as first symbols and
are processed in descending order: of each member, the nearest earlier position of a smaller
group (its previous-smaller pointer, found over the pointers of larger groups) has its own
prefix extended by the group's word, as often as members follow each other; it moves behind
the rest of its old group, further the more words it takes. When the smallest group is
done, a group holds the suffixes of one Lyndon word, and its order is that of what follows the
word: going up the array, each suffix hands the next free place of their groups to those whose
word ends where it starts. No text is renamed, nothing recurses.

Texts are independent, so one step processes the largest open group of every text, as numpy
operations over all of them: a batch takes as many steps as its longest text has groups.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def lyndon_groups(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions by group, the first place of each position's group, and the length of its word.

    ``bounds``: where texts start, and the end of the last; each text ends with a symbol
    smaller than all its others. Places count through all texts, as positions do."""
    n = len(symbols)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    array = np.lexsort((symbols, text))
    place = np.empty(n + 1, np.int64)
    place[array] = np.arange(n)
    ordered = symbols[array]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (text[array][1:] != text[array][:-1])
    first = np.flatnonzero(new)
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n + 1, np.int64)
    group[array] = np.repeat(first, size[first])
    group[n] = -1  # before all texts: smaller than any group
    length = np.ones(n, np.int64)
    before = np.full(n + 1, n)
    moved = np.zeros(n, bool)
    low, top = bounds[:-1].copy(), bounds[1:].copy()
    begin = np.append(bounds[:-1][text], 0)
    open_ = np.flatnonzero(top > low)
    while len(open_):
        own = group[array[top[open_] - 1]]
        top[open_] = own
        members = array[_ranges(own, size[own])]
        mine = group[members]
        p = np.where(members > begin[members], members - 1, n)
        # over larger groups by their pointers, then over this group's own members
        far = np.flatnonzero(group[p] > mine)
        while len(far):
            p[far] = before[p[far]]
            far = far[group[p[far]] > mine[far]]
        before[members] = p
        same = np.flatnonzero(group[p] == mine)
        while len(same):
            p[same] = before[p[same]]
            before[members[same]] = p[same]
            same = same[group[p[same]] == mine[same]]
        real = p < n
        p, members = p[real], members[real]
        if len(p):
            order = np.argsort(p, kind="stable")
            sorted_p = p[order]
            edge = np.flatnonzero(np.append(True, sorted_p[1:] != sorted_p[:-1]))
            parents, times = sorted_p[edge], np.diff(np.append(edge, len(p)))
            length[parents] += times * length[members[order[edge]]]
            old = group[parents]
            order = np.lexsort((times, old))
            parents, times, old = parents[order], times[order], old[order]
            # they take the last places of their old groups, those with more words further back
            edge = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            count = np.diff(np.append(edge, len(old)))
            shrunk = size[old[edge]] - count
            slots = _ranges(old[edge] + shrunk, count)
            moved[parents] = True
            there = array[slots]
            displaced = there[~moved[there]]
            at = place[parents]
            vacated = at[at < np.repeat(old[edge] + shrunk, count)]
            moved[parents] = False
            array[vacated], place[displaced] = displaced, vacated
            array[slots], place[parents] = parents, slots
            size[old[edge]] = shrunk
            fresh = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
            many = np.diff(np.append(fresh, len(old)))
            size[slots[fresh]] = many
            group[parents] = np.repeat(slots[fresh], many)
        open_ = open_[top[open_] > low[open_]]
    return array, group[:n], length


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array of each text, one after the other, as positions in ``symbols``."""
    n = len(symbols)
    array, group, length = lyndon_groups(symbols, bounds)
    after = np.arange(n) + length  # where a suffix's word ends
    ends = np.repeat(bounds[1:], np.diff(bounds))
    inner = np.flatnonzero(after < ends)
    inner = inner[np.argsort(after[inner], kind="stable")]
    handed = np.bincount(after[inner], minlength=n)
    offset = np.cumsum(handed) - handed
    free = np.arange(n)  # next free place, by the first of a group
    out = np.full(n, -1)
    last = np.flatnonzero(after >= ends)
    out[group[last]] = last
    at, stop = bounds[:-1].copy(), bounds[1:]
    live = np.flatnonzero(at < stop)
    while len(live):
        s = out[at[live]]
        got = inner[_ranges(offset[s], handed[s])]
        slot = group[got]
        out[free[slot]] = got
        free[slot] += 1
        at[live] += 1
        live = live[at[live] < stop[live]]
    return out
