"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Positions are typed smaller (S) or larger (L) than their successor. The
substrings between leftmost S positions (LMS) are sorted by inducing from their
unsorted order, named, and the string of names is sorted in turn (recursively, by
pairs of ranks, until all differ). From the sorted LMS suffixes the whole array
is induced in two linear sweeps over the buckets. A bucket is handled in waves,
one per repetition of its byte, so every step works on arrays.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S positions; the last position, the sentinel, is S."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    if n > 1:
        d = t[:-1] != t[1:]
        # The next position, from each one, where the text changes.
        at = np.where(d, np.arange(n - 1), n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        last = at == n - 1
        at[last] = n - 2
        s[:-1] = t[at] < t[at + 1]
        s[:-1][last] = True
    return s


def _deal(out: dict, where: np.ndarray, chars: np.ndarray) -> None:
    """Append positions to the lists of their characters, in order."""
    order = np.argsort(chars, kind="stable")
    where, chars = where[order], chars[order]
    cut = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    starts = [0, *cut.tolist()]
    ends = [*cut.tolist(), len(chars)]
    for a, b in zip(starts, ends):
        out.setdefault(int(chars[a]), []).append(where[a:b])


def _sweep(t, kind, first, second, up: bool):
    """One inducing sweep. ``first``: per character, positions known before the
    waves; ``second``: positions after them, whose predecessors are induced as
    well. Returns, per character, what the waves brought, in order."""
    pending: dict[int, list] = {c: [v] for c, v in first.items()}
    done: dict[int, np.ndarray] = {}
    for c in range(257) if up else range(256, -1, -1):
        wave = pending.pop(c, None)
        got = []
        while wave:
            w = np.concatenate(wave) if len(wave) > 1 else wave[0]
            wave = None
            if not len(w):
                break
            got.append(w)
            p = w[w > 0] - 1
            p = p[kind[p]]
            ch = t[p]
            same = ch == c
            if same.any():
                wave = [p[same]]
                p, ch = p[~same], ch[~same]
            if len(p):
                _deal(pending, p, ch)
        if got:
            done[c] = np.concatenate(got)
        rest = second.get(c)
        if rest is not None and len(rest):
            p = rest[rest > 0] - 1
            p = p[kind[p]]
            if len(p):
                _deal(pending, p, t[p])
    return done


def _induce(t, s, lms) -> np.ndarray:
    """All positions sorted, given LMS positions in the order to induce from."""
    n = len(t)
    stars: dict[int, list] = {}
    _deal(stars, lms, t[lms])
    stars = {c: np.concatenate(v) for c, v in stars.items()}
    larger = _sweep(t, ~s, {}, stars, True)
    smaller = _sweep(t, s, {}, {c: v[::-1] for c, v in larger.items()}, False)
    out = []
    for c in range(257):
        if c in larger:
            out.append(larger[c])
        if c in smaller:
            out.append(smaller[c][::-1])
    sa = np.concatenate(out)
    return sa if len(sa) == n else np.concatenate([[n - 1], sa])


def _names(t, lms, order) -> tuple[np.ndarray, int]:
    """A name for each LMS substring: equal for equal substrings, rising with
    their order. ``order``: LMS positions sorted by their substrings."""
    n = len(t)
    rank = np.full(n, -1, np.int64)
    rank[lms] = np.arange(len(lms))
    end = np.append(lms[1:], n - 1)
    a, b = order[:-1], order[1:]
    la, lb = end[rank[a]] - a, end[rank[b]] - b
    equal = la == lb
    live = np.flatnonzero(equal)
    off = 0
    while len(live):
        ok = t[a[live] + off] == t[b[live] + off]
        equal[live[~ok]] = False
        live = live[ok]
        off += 1
        live = live[la[live] >= off]
    name = np.concatenate([[0], np.cumsum(~equal)])
    out = np.empty(len(lms), np.int64)
    out[rank[order]] = name
    return out, int(name[-1]) + 1


def _sort_names(names: np.ndarray, distinct: int) -> np.ndarray:
    """The order of the suffixes of a string of names: sorted by their first
    2, 4, 8, ... names until all differ."""
    rank, n, h = names.copy(), len(names), 1
    while distinct < n:
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank[order] = new
        distinct = int(new[-1]) + 1
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffix array of a uint8 array."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    t = np.zeros(n + 1, np.int16)
    t[:-1] = data
    t[:-1] += 1
    s = _types(t)
    star = s.copy()
    star[1:] &= ~s[:-1]
    star[0] = False
    lms = np.flatnonzero(star)
    sa = _induce(t, s, lms)
    order = sa[star[sa]]
    names, distinct = _names(t, lms, order)
    lms = lms[_sort_names(names, distinct)]
    return _induce(t, s, lms)[1:]


def permuted_lcp(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """plcp[i]: the common prefix of suffix i with the suffix before it in order.

    plcp[i] = plcp[i - 1] - 1 wherever both suffixes are preceded by the same
    byte; only the other (irreducible) values are compared, eight bytes a step.
    """
    n = len(data)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (phi > 0)
    reducible &= data[i - 1] == data[np.maximum(phi - 1, 0)]
    at = np.flatnonzero(~reducible & (phi >= 0))
    plcp = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    a, b = at.copy(), phi[at]
    while len(at):
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        room = n - np.maximum(a, b)
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.searchsorted(_EDGES, low, "right") - 1)
        step = np.minimum(same, room)
        plcp[at] += step
        on = (step == 8) & (room > 8)
        at, a, b = at[on], a[on] + 8, b[on] + 8
    base = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.where(reducible, np.maximum(plcp[base] - (i - base), 0), plcp)


#: The lowest bit of the k-th byte.
_EDGES = np.array([1 << (8 * k) for k in range(8)], np.uint64)
