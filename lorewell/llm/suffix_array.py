"""A suffix array by induced sorting, and its permuted common prefixes, on arrays.

The suffixes of a text are smaller than their successor (S) or larger (L). The leftmost S of each run begins a leftmost-smaller (LMS) substring. Those
are sorted by one induction from their first symbols; equal ones get equal names, and the string of the names, if any repeats, is sorted by the same
procedure, down to short strings. From the sorted LMS suffixes a second induction gives all.

An induction passes the buckets of the first symbols once upwards for L and once downwards for S. Buckets that don't induce into each other are passed
together: a pass ends a stretch only where a suffix and its successor would both lie in it. In a bucket with repeats of its own symbol, what
a suffix induces there is its whole run, so no step is taken for each repeat. All work of a stretch is on arrays, and its total is linear but for the
stable sort by symbol within a stretch.
"""

from __future__ import annotations

import numpy as np

#: Up to this length a string of names, whose many symbols make an induction's steps outweigh its work, ends the recursion: it is sorted by doubling.
SHORT = 1 << 18


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S. The text must end with a unique smallest symbol."""
    n = len(t)
    change = np.r_[np.flatnonzero(t[1:] != t[:-1]), n - 1]  # the last position of each run of equal symbols
    rising = np.r_[t[change[:-1]] < t[change[:-1] + 1], True]
    return np.repeat(rising, np.diff(np.r_[-1, change]))


def _append(sa: np.ndarray, at: np.ndarray, symbols: np.ndarray, items: np.ndarray, sign: int) -> None:
    """Place items, in order, at the open end of their symbols' buckets; ``sign`` -1 fills downwards."""
    order = symbols.argsort(kind="stable")
    s = symbols[order]
    first = np.empty(len(s), bool)
    first[0] = True
    np.not_equal(s[1:], s[:-1], out=first[1:])
    new, group = first.nonzero()[0], first.cumsum() - 1
    sa[at[s] + sign * (np.arange(len(s)) - new[group])] = items[order]
    at[s[new]] += sign * np.bincount(group)


def _runs_before(items: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """The positions before each item in its run of equal symbols: those next to the items first, in the items' order, then those before them, and so on."""
    size = items - run_start[items]
    steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
    return (np.repeat(items, size) - steps)[np.argsort(steps, kind="stable")]


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All suffixes from the LMS suffixes in the order given, which must be one of their first symbols."""
    n, k = len(t), len(count)
    sa = np.full(n, -1, np.int32)
    end = np.cumsum(count)
    begin = end - count
    edges = np.r_[begin, n]
    change = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]).astype(np.int32)
    run_start = np.repeat(change, np.diff(np.r_[change, n]))
    seeds = np.bincount(t[lms], minlength=k)
    spot = np.arange(len(lms)) + np.repeat(end - np.cumsum(seeds), seeds)  # at the ends of their buckets
    sa[spot] = lms

    larger = np.flatnonzero(~is_s[:-1])
    reach = np.full(k, k, np.int64)  # the first bucket that is induced into from this one or a later one
    np.minimum.at(reach, t[larger + 1].astype(np.int64), t[larger].astype(np.int64))
    reach = np.minimum.accumulate(reach[::-1])[::-1]
    head, c = begin.copy(), 0
    while c < k and reach[c] < k:
        stop = max(c + 1, int(reach[c]))
        a, b = edges[c], edges[stop]
        if reach[c] == c:  # repeats of this symbol
            first = sa[a : head[c]]
            own = _runs_before(first, run_start)
            sa[head[c] : head[c] + len(own)] = own
            head[c] += len(own)
            before = sa[a:b]
            before = before[before > 0] - 1
            before = before[~is_s[before] & (t[before] != c)]
        else:
            before = sa[a:b]
            before = before[before > 0] - 1
            before = before[~is_s[before]]
        if len(before):
            _append(sa, head, t[before], before, 1)
        c = stop

    sa[spot] = -1
    sa[0] = n - 1  # the end symbol's own suffix is induced by none
    smaller = np.flatnonzero(is_s[:-1])
    reach = np.full(k, -1, np.int64)  # the last bucket that is induced into from this one or an earlier one
    np.maximum.at(reach, t[smaller + 1].astype(np.int64), t[smaller].astype(np.int64))
    reach = np.maximum.accumulate(reach)
    tail, c = end - 1, k - 1
    while c >= 0 and reach[c] >= 0:
        start = min(c, int(reach[c]) + 1)
        a, b = edges[start], edges[c + 1]
        if reach[c] == c:
            first = sa[tail[c] + 1 : b][::-1]
            own = _runs_before(first, run_start)
            sa[tail[c] + 1 - len(own) : tail[c] + 1] = own[::-1]
            tail[c] -= len(own)
            before = sa[a:b][::-1]
            before = before[before > 0] - 1
            before = before[is_s[before] & (t[before] != c)]
        else:
            before = sa[a:b][::-1]
            before = before[before > 0] - 1
            before = before[is_s[before]]
        if len(before):
            _append(sa, tail, t[before], before, -1)
        c = start - 1
    return sa


def _names(t: np.ndarray, lms_sorted: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ranks of LMS substrings in sorted order: neighbours with the same symbols and length share one."""
    a, b = lms_sorted[:-1], lms_sorted[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        live = live[length[a[live]] > step]
        if not len(live):
            break
        differ = t[a[live] + step] != t[b[live] + step]
        same[live[differ]] = False
        live = live[~differ]
        step += 1
    return np.r_[0, np.cumsum(~same)]


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """The sorted suffixes of a short text: ranks by the first symbol, then by twice as many, and so on."""
    n, span = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].reshape(-1)
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-span] = rank[span:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].reshape(-1)
        span *= 2
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n)
    return sa


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """The sorted suffixes of symbols below ``alphabet``, of which the last is a unique 0."""
    n = len(t)
    count = np.bincount(t, minlength=alphabet)
    if count.max() == 1:
        return np.argsort(t).astype(np.int32)
    is_s = suffix_types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    sa = induce(t, is_s, lms[np.argsort(t[lms], kind="stable")], count)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    length = np.zeros(n, np.int32)
    length[lms] = np.diff(np.r_[lms, n - 1]) + 1  # an LMS substring reaches to the next LMS position
    rank = _names(t, ordered, length)
    if rank[-1] + 1 < len(rank):  # equal names: the order of their suffixes is that of the string of names
        where = np.empty(n, np.int32)
        where[lms] = np.arange(len(lms))
        names = np.empty(len(lms), np.int32)
        names[where[ordered]] = rank
        ordered = lms[_by_doubling(names) if len(names) <= SHORT else suffix_array(names, int(rank[-1]) + 1)]
    return induce(t, is_s, ordered, count)


def _shared(t: np.ndarray, a: int, b: int, width: int = 1 << 12) -> int:
    """How many symbols two different suffixes share."""
    done = 0
    while True:
        n = min(width, len(t) - max(a, b) - done)
        apart = np.flatnonzero(t[a + done : a + done + n] != t[b + done : b + done + n])
        if len(apart):
            return done + int(apart[0])
        done += n


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By position in the text (permuted): how many symbols the suffix shares with the one before it in ``sa``, all of them; 0 for the first.

    phi names each suffix's predecessor. Where the symbols before both are equal, the prefix is one shorter than that of the position before, so only
    the other positions are compared, eight bytes at a time, and their lengths are carried on.
    """
    n = len(t)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = 0
    at = np.arange(n, dtype=np.int32)
    fresh = (at == 0) | (phi == 0)
    fresh[1:] |= t[:-1] != t[phi[1:] - 1]
    fresh[sa[0]] = True
    here = np.flatnonzero(fresh).astype(np.int32)
    there = phi[here]
    per = 8 // t.itemsize
    padded = np.r_[t, np.zeros(per, t.dtype)]
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, per), (t.itemsize, t.itemsize))
    length = np.zeros(len(here), np.int32)
    live, step = np.flatnonzero(here != sa[0]), 0
    while len(live):
        if len(live) < 16 and step >= 64:  # a few long ones
            length[live] = [step + _shared(t, int(here[i]) + step, int(there[i]) + step) for i in live]
            break
        x = np.ascontiguousarray(words[here[live] + step]).view(np.uint64)[:, 0] ^ np.ascontiguousarray(words[there[live] + step]).view(np.uint64)[:, 0]
        apart = x != 0
        low = x[apart]
        length[live[apart]] = step + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int32) // (8 * t.itemsize)  # bits below the first that differs
        live = live[~apart]
        step += per
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    carried = np.zeros(n, np.int32)
    carried[here] = length
    return carried[last] - (at - last)
