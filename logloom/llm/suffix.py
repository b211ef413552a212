"""Suffix arrays by linear grouping over Lyndon prefixes, for many small texts at once.

First phase: the suffixes of a text are grouped by first symbol and the groups are processed from the highest down. Each
member i of the group gets a previous-smaller pointer: the nearest position to its left whose group is lower. The
positions pointed at have a Lyndon prefix that the group's word extends, once for each pointer they get, so they leave
their group for new groups right above its rest, ordered by that number. At the end suffixes share a group exactly if
they share their longest Lyndon prefix, and groups are in order.

Second phase: suffixes are emitted in order. Below the suffix just emitted, at i, stand those whose Lyndon prefix ends
where i begins: i - 1 and what its previous-smaller pointers lead to, up to the first one emitted before. Each takes the
next free place of its group. No ranks are renamed and nothing recurs.

Both phases run in lockstep over all texts of a call, one group or one place per text and step, so each numpy call
serves thousands of texts. All positions are global: text t owns the slots offset[t] + 1 .. offset[t] + len(t), and slot
offset[t] is a stop that no group holds.
"""

from __future__ import annotations

import numpy as np

_INT = np.int32


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _grouped(symbols: np.ndarray, offset: np.ndarray, length: np.ndarray):
    """First phase: order (members by group), group (its first slot) and pointer of every position."""
    size = len(symbols)
    own = _ranges(offset + 1, length)
    key = np.repeat(np.arange(len(length), dtype=np.int64), length) * (int(symbols.max(initial=0)) + 1) + symbols[own]
    by = np.argsort(key, kind="stable")
    order, place = np.full(size, -1, _INT), np.full(size, -1, _INT)
    order[own] = own[by]
    place[own[by]] = own
    first = np.flatnonzero(np.diff(key[by], prepend=-1))
    many = np.diff(np.append(first, len(by)))
    group, held = np.full(size, -1, _INT), np.zeros(size, _INT)
    group[own[by]] = np.repeat(own[first], many)
    held[own[first]] = many
    pointer, marked = np.full(size, -1, _INT), np.zeros(size, bool)
    low, top = offset + 1, offset + 1 + length
    live = np.flatnonzero(top > low)
    while len(live):
        s = group[order[top[live] - 1]]
        count = top[live] - s
        top[live] = s
        live = live[s > low[live]]
        at = order[_ranges(s, count)]
        floor = np.repeat(s, count)
        to = at - 1
        pointer[at] = to
        open_ = np.flatnonzero(group[to] >= floor)
        while len(open_):
            to[open_] = pointer[to[open_]]
            pointer[at[open_]] = to[open_]
            open_ = open_[group[to[open_]] >= floor[open_]]
        to = np.sort(to[group[to] >= 0])
        if not len(to):
            continue
        new = np.flatnonzero(np.diff(to, prepend=-1))
        times = np.diff(np.append(new, len(to)))
        to = to[new]
        by = np.lexsort((times, group[to]))
        to, times = to[by], times[by]
        old = group[to]
        cut = np.flatnonzero(np.diff(old, prepend=-1))
        moved = np.diff(np.append(cut, len(old)))
        old_of = old[cut]
        tail = old_of + held[old_of] - moved  # the movers' places: the end of their group
        slot = _ranges(tail, moved)
        marked[to] = True
        there = order[slot]
        staying = there[~marked[there]]
        was = place[to]
        holes = was[was < np.repeat(tail, moved)]
        order[holes], place[staying] = staying, holes
        order[slot], place[to] = to, slot
        marked[to] = False
        held[old_of] -= moved.astype(_INT)
        change = np.diff(times, prepend=-1) != 0
        change[cut] = True
        sub = np.flatnonzero(change)
        many = np.diff(np.append(sub, len(to)))
        group[to] = np.repeat(slot[sub], many)
        held[slot[sub]] = many
    return group, pointer


def suffix_arrays(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """texts: symbols of 1 and up, none empty. Gives all positions in suffix order, text by text, as indices into the
    concatenated texts, and where each text begins there. The end of a text is below every symbol."""
    length = np.array([len(t) + 1 for t in texts], np.int64)
    offset = np.concatenate(([0], np.cumsum(length + 1)[:-1])).astype(np.int64)
    symbols = np.zeros(int((length + 1).sum()), np.int64)
    begin = np.concatenate(([0], np.cumsum(length - 1)))
    inner = _ranges(offset + 1, length - 1)
    symbols[inner] = np.concatenate(texts)
    group, pointer = _grouped(symbols, offset, length)
    # Second phase.
    free = np.arange(len(symbols), dtype=_INT)  # next free slot of the group that begins here
    out = np.full(len(symbols) + 1, -1, _INT)
    done = np.zeros(len(symbols), bool)
    done[offset] = True  # the stops end every chain
    now, end = (offset + 1).copy(), offset + 1 + length
    out[now] = offset + length
    done[offset + length] = True
    j = offset + length - 1
    while len(now):
        stop = done[j]
        going = j[~stop]
        slot = free[group[going]]
        free[group[going]] += 1
        out[slot] = going
        done[going] = True
        j[~stop] = pointer[going]
        k = np.flatnonzero(stop)
        now[k] += 1
        over = now[k] >= end[k]
        j[k] = out[now[k]] - 1
        if over.any():
            keep = np.ones(len(now), bool)
            keep[k[over]] = False
            now, end, j = now[keep], end[keep], j[keep]
    plain = np.zeros(len(symbols), np.int64)
    plain[inner] = np.arange(len(inner))
    return plain[out[inner + 1]], begin  # the first slot of each text has its end
