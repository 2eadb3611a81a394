"""Suffix arrays of many texts at once by linear grouping.

The construction has two phases and renames nothing. Phase one keeps the suffixes in
groups that share a prefix, at first the first symbol, and takes the groups in descending
order. For each suffix of the group it follows the pointers to the nearest suffix on the
left in a smaller group (the previous smaller one). Suffixes that such pointers meet have
this group's prefix right after their own, so they leave their group for new ones just
above it, one per number of meetings. At the end each group's common prefix is the
longest Lyndon word its suffixes start with, and each suffix has been a member of a
processed group once.

Phase two emits: it walks the final order from the smallest suffix up; the suffix before
the current one, and the chain of previous-smaller pointers from there, up to the first
that already has its place, come next in their groups.

Both phases handle one group, or one step, of every text per round, so that a round is a
few numpy calls over all texts. The texts of a call should be of similar size.
"""

from __future__ import annotations

import numpy as np


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def lyndon_groups(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group (its first place in the order) and previous smaller suffix of every suffix.

    ``symbols`` holds the texts one after the other, text t at ``starts[t]`` up to
    ``starts[t + 1]``; each ends with a symbol smaller than any other of it.
    """
    n = len(symbols)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((symbols, text)).astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    new = np.ones(n, bool)
    new[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    first = np.flatnonzero(new).astype(np.int32)
    size = np.zeros(n, np.int32)
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n, np.int32)
    group[order] = np.repeat(first, size[first])
    smaller = np.full(n, -1, np.int32)
    moved = np.zeros(n, bool)
    live, end = np.arange(len(starts) - 1), starts[1:].astype(np.int32)
    starts = starts.astype(np.int32)
    while len(live):
        low = group[order[end - 1]]
        count = end - low
        member = order[_runs(count) + np.repeat(low, count)]
        floor, base = np.repeat(low, count), np.repeat(starts[live], count)
        smaller[member] = member - 1
        at = member - 1
        todo = np.flatnonzero((at >= base) & (group[at] >= floor))
        while len(todo):
            at = smaller[smaller[member[todo]]]
            smaller[member[todo]] = at
            todo = todo[(at >= base[todo]) & (group[at] >= floor[todo])]
        met = smaller[member]
        met = np.sort(met[met >= base])
        if len(met):
            head = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
            times = np.diff(np.append(head, len(met)))
            met = met[head]
            old = group[met]
            by = np.lexsort((times, old))
            met, times, old = met[by], times[by], old[by]
            new_old = np.append(True, old[1:] != old[:-1])
            head = np.flatnonzero(new_old)
            leaving = np.diff(np.append(head, len(met)))
            zone = old[head] + size[old[head]] - leaving.astype(np.int32)
            zones = np.repeat(zone, leaving)
            slots = zones + _runs(leaving).astype(np.int32)
            was = place[met]
            moved[met] = True
            pushed = slots[~moved[order[slots]]]
            free = np.sort(was[was < zones])
            other = order[pushed]
            order[free] = other
            place[other] = free
            order[slots] = met
            place[met] = slots
            moved[met] = False
            size[old[head]] -= leaving.astype(np.int32)
            head = np.flatnonzero(new_old | np.append(True, times[1:] != times[:-1]))
            parts = np.diff(np.append(head, len(met)))
            group[met] = np.repeat(slots[head], parts)
            size[slots[head]] = parts
        rest = low > starts[live]
        live, end = live[rest], low[rest]
    return group, smaller


def emit(group: np.ndarray, smaller: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix array of every text, one after the other, from its groups."""
    n = len(group)
    out = np.full(n, -1, np.int32)
    free = np.arange(n, dtype=np.int32)
    placed = np.zeros(n, bool)
    first, last = starts[:-1].astype(np.int32), starts[1:].astype(np.int32)
    out[first] = last - 1
    placed[last - 1] = True
    free[first] += 1
    at, base, end = first.copy(), first.copy(), last.copy()
    here = out[at] - 1
    while len(at):
        can = here >= base
        can &= ~placed[here]
        go = here[can]
        slot = free[group[go]]
        out[slot] = go
        free[group[go]] = slot + 1
        placed[go] = True
        here[can] = smaller[go]
        stay = ~can
        at[stay] += 1
        done = at >= end
        if done.any():
            keep = ~done
            at, base, end, here, stay = at[keep], base[keep], end[keep], here[keep], stay[keep]
        here[stay] = out[at[stay]] - 1
    return out


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return emit(*lyndon_groups(symbols, starts), starts)
