"""Suffix order by Lyndon grouping, for one text or for many small ones at once.

Phase one sorts suffixes into groups by their Lyndon prefix. Groups are taken in descending order; each member's
previous-smaller pointer is found by following the pointers of larger suffixes; the suffixes pointed to move to a new
group directly above the rest of theirs, one for each number of members that point to them. Phase two takes the groups
in ascending order: a member's rank is decided by how often the group's word repeats and then by the rank of the
suffix that follows, which a lower group has fixed. No text is renamed and nothing is recursive.

Both phases run in step over many independent texts: the next group of every text is handled by one set of array
operations, so the cost per symbol is that of a few vectorised gathers.
"""

from __future__ import annotations

import numpy as np

from weftlink.llm.shared import ranges


def suffix_order(t: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """Positions of all suffixes, text after text, each text's in ascending order.

    ``t``: symbols from 0 to 256; 0 ends a string and is smaller than all else; each text starts with a 0 and the last
    symbol is a 0. ``text``: the number, from 0 to ``count`` - 1, of the text each position belongs to, ascending. Suffixes
    that are equal up to their ends, and the ends themselves, stand in any order.
    """
    n = len(t)
    key = text.astype(np.int64) * 257 + t
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, n))
    size = np.zeros(n, np.int64)
    size[starts] = sizes
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(starts, sizes)
    total = np.bincount(text, minlength=count)
    top = np.cumsum(total)
    floor = top - total + np.bincount(text[t == 0], minlength=count)
    prev = np.arange(-1, n - 1)
    end = np.arange(1, n + 1)
    moved = np.zeros(n, bool)
    top = top.copy()
    act = np.flatnonzero(top > floor)
    while len(act):
        g = group[sa[top[act] - 1]]
        mem = sa[ranges(g, top[act] - g)]
        mine = group[mem]
        at = mem - 1
        prev[mem] = at
        todo = np.flatnonzero(group[at] >= mine)
        while len(todo):
            nxt = prev[at[todo]]
            at[todo] = nxt
            prev[mem[todo]] = nxt
            todo = todo[group[nxt] >= mine[todo]]
        real = t[at] != 0
        if real.any():
            up, ends = at[real], end[mem[real]]
            order = np.argsort(up, kind="stable")
            up, ends = up[order], ends[order]
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            u, k = up[first], np.diff(np.append(first, len(up)))
            end[u] = np.maximum.reduceat(ends, first)
            h = group[u]
            order = np.lexsort((k, h))
            u, k, h = u[order], k[order], h[order]
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            hs = np.flatnonzero(new_h)
            c = np.diff(np.append(hs, len(h)))
            old, length = h[hs], size[h[hs]]
            slot0 = old + length - c
            slots = ranges(slot0, c)
            moved[u] = True
            there = sa[slots]
            there = there[~moved[there]]
            place = isa[u]
            place = place[place < np.repeat(slot0, c)]
            sa[place] = there
            isa[there] = place
            sa[slots] = u
            isa[u] = slots
            moved[u] = False
            sub = np.flatnonzero(new_h | np.concatenate([[True], k[1:] != k[:-1]]))
            many = np.diff(np.append(sub, len(u)))
            group[u] = np.repeat(slots[sub], many)
            size[old] = length - c
            size[slots[sub]] = many
        top[act] = g
        act = act[g > floor[act]]
    # phase two: groups of one are in place
    member_of = np.unique(group)
    multi = member_of[(size[member_of] > 1) & (t[sa[member_of]] != 0)]
    if not len(multi):
        return sa
    owner = text[sa[multi]]
    turn = np.arange(len(multi)) - np.repeat(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), np.bincount(owner)[np.unique(owner)])
    order = np.argsort(turn, kind="stable")
    reps = np.ones(n, np.int64)
    for part in np.split(multi[order], np.flatnonzero(np.diff(turn[order])) + 1):
        st, many = part, size[part]
        mem = sa[ranges(st, many)]
        mine = group[mem]
        todo = np.flatnonzero(group[end[mem]] == mine)
        while len(todo):
            i = mem[todo]
            j = end[i]
            hops, far = reps[j], end[j]
            reps[i] += hops
            end[i] = far
            todo = todo[group[far] == mine[todo]]
        new = mem[np.lexsort((isa[end[mem]], reps[mem], mine))]
        slots = ranges(st, many)
        sa[slots] = new
        isa[new] = slots
    return sa


def suffix_array(data: bytes) -> np.ndarray:
    """The suffix array of one byte string."""
    t = np.zeros(len(data) + 2, np.int64)
    t[1:-1] = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    sa = suffix_order(t, np.zeros(len(t), np.int64), 1)
    return sa[t[sa] != 0] - 1
