"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard of strings.

A shard is a list of byte strings, each ended by a separator of its own that is smaller than any byte. Suffixes are
classified as smaller or larger than their successor; the substrings between leftmost-smaller positions are named in sorted
order, and the string of names is ranked by recursion: its own leftmost-smaller substrings are sorted by inducing, named, and
so on until all names differ. From the sorted leftmost-smaller suffixes, two linear passes induce the array. Over bytes they go
bucket by bucket, each bucket being one vector step for every run length in it; over names, of which there are many, entry by
entry.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; s ends with its smallest symbol, which counts as smaller."""
    step = np.concatenate([np.sign(np.diff(s.astype(np.int32))), [1]])
    n = len(s)
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _dense(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(differs)])
    return out


def name_substrings(s: np.ndarray, smaller: np.ndarray, marks: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Names, in sorted order, of the substrings s[marks[j]..marks[j + 1]]. s has at most 7 bits a symbol, 0 for any
    separator; tie[j] tells separators apart: that of the substring's first symbol, or else of its last."""
    n = len(s)
    coded = np.concatenate([s.astype(np.uint64) * np.uint64(2) + smaller, np.zeros(8, np.uint64)])
    size = np.where(s[marks] == 0, 1, np.diff(np.concatenate([marks, [n - 1]])) + 1)  # a separator alone decides
    names, base = None, 0
    while names is None or base < size.max():
        key = np.zeros(len(marks), np.uint64)
        for o in range(8):
            at = np.minimum(marks + base + o, n)
            key = key << np.uint64(8) | np.where(base + o < size, coded[at], np.uint64(0))
        if names is None:
            order = np.argsort(key, kind="stable")
            names = _dense(order, key[order][1:] != key[order][:-1])
        else:
            order = np.lexsort((key, names))
            names = _dense(order, (key[order][1:] != key[order][:-1]) | (names[order][1:] != names[order][:-1]))
        base += 8
    order = np.lexsort((tie, names))
    return _dense(order, (tie[order][1:] != tie[order][:-1]) | (names[order][1:] != names[order][:-1]))


def _induced(s: np.ndarray, smaller: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The order of all suffixes of s, a string of whole numbers that ends with its only 0, from that of its leftmost-smaller
    ones: a pass to the right places the larger suffixes at the heads of their buckets, one to the left the smaller at the tails."""
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    by = marks[np.argsort(s[marks], kind="stable")]
    here = np.bincount(s[by], minlength=len(counts))
    placed = np.full(len(s), -1)
    placed[np.arange(len(by)) + (ends - np.cumsum(here))[s[by]]] = by
    array, text, small, heads, tails = placed.tolist(), s.tolist(), smaller.tolist(), (ends - counts).tolist(), ends.tolist()
    for i in array:  # sees what it places further on
        if i > 0 and not small[i - 1]:
            c = text[i - 1]
            array[heads[c]] = i - 1
            heads[c] += 1
    for i in reversed(array):
        if i > 0 and small[i - 1]:
            c = text[i - 1]
            tails[c] -= 1
            array[tails[c]] = i - 1
    return np.array(array)


def rank_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of dense names (its end sorts first): inducing sorts its leftmost-smaller
    substrings, whose names form a string of at most half the length, ranked in the same way."""
    n = len(names)
    if not n or names.max() == n - 1:
        return np.argsort(names)
    s = np.concatenate([names.astype(np.int64) + 1, [0]])
    smaller = classify(s)
    marks = np.flatnonzero(np.concatenate([[False], smaller[1:] & ~smaller[:-1]]))
    number = np.full(n + 1, -1)
    number[marks] = np.arange(len(marks))
    order = number[_induced(s, smaller, marks)]
    order = order[order >= 0]
    size = np.diff(np.concatenate([marks, [n]])) + 1
    differs = size[order[1:]] != size[order[:-1]]
    same = np.flatnonzero(~differs)
    if len(same):
        width = size[order[same]]
        first = np.cumsum(width) - width
        step = np.arange(width.sum()) - np.repeat(first, width)
        equal = s[np.repeat(marks[order[same]], width) + step] == s[np.repeat(marks[order[same + 1]], width) + step]
        differs[same] = ~np.logical_and.reduceat(equal, first)
    return _induced(s, smaller, marks[rank_names(_dense(order, differs))])[1:]


def suffix_array(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(array, text, ends): the suffix array of the strings joined with separators, that text, and the separators' places.

    A separator sorts by the place of its string; text holds 0 there and byte classes from 1 elsewhere, so strings that have
    more than 126 different bytes are sorted over two symbols a byte, of which only the first ones' suffixes are kept.
    """
    joined = np.concatenate([x for v in strings for x in (v, np.zeros(1, np.uint8))])
    ends = np.cumsum([len(v) + 1 for v in strings]) - 1
    sep = np.zeros(len(joined), bool)
    sep[ends] = True
    used = np.unique(joined[~sep])
    if len(used) > 126:  # halves of bytes
        wide = np.empty((len(joined), 2), np.uint8)
        wide[:, 0], wide[:, 1] = (joined >> 4) + 1, (joined & 15) + 17
        keep = np.ones((len(joined), 2), bool)
        keep[sep, 1] = False
        s, lead = wide[keep], np.concatenate([[0], np.cumsum(2 - sep)[:-1]])
        s[lead[sep]] = 0
        array = _induce(s, lead[ends])
        back = np.full(len(s), -1)
        back[lead] = np.arange(len(joined))
        array = back[array]
        return array[array >= 0], joined, ends
    table = np.zeros(256, np.uint8)
    table[used] = np.arange(1, len(used) + 1)
    s = table[joined]
    s[sep] = 0
    return _induce(s, ends), joined, ends


def _induce(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(s)
    smaller = classify(s)
    smaller[ends] = True
    follow = np.zeros(n, bool)
    follow[1:] = smaller[1:] & ~smaller[:-1]
    follow[ends] = True
    marks = np.flatnonzero(follow)
    number = np.full(n, 0)
    number[ends] = np.arange(1, len(ends) + 1)
    after = np.concatenate([marks[1:], [n - 1]])
    tie = np.where(s[marks] == 0, number[marks], number[after])
    marks = marks[rank_names(name_substrings(s, smaller, marks, tie))]
    symbols = int(s.max()) + 1
    by = np.argsort(s[marks], kind="stable")
    cut = np.searchsorted(s[marks][by], np.arange(symbols + 1))
    starts = [marks[by[cut[c] : cut[c + 1]]] for c in range(symbols)]

    def push(source: np.ndarray, want: bool, same: int, lists: list[list[np.ndarray]]) -> np.ndarray:
        """Deals the predecessors of the wanted type to their buckets, in order; those of bucket `same` are returned."""
        before = source[source > 0] - 1
        before = before[smaller[before] == want]
        c = s[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, int)
        own = np.zeros(0, np.int64)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(c)], strict=False):
            if c[lo] == same:
                own = before[lo:hi]
            else:
                lists[c[lo]].append(before[lo:hi])
        return own

    none = np.zeros(0, np.int64)

    def sweep(order: range, want: bool, rest: list[np.ndarray]) -> list[np.ndarray]:
        """One induction pass: in each bucket, entries dealt to it and runs of its own symbol, then the rest of the bucket."""
        lists: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        out = [none] * symbols
        for c in order:
            parts = lists[c]
            wave = np.concatenate(parts) if parts else none
            done = []
            while len(wave):
                done.append(wave)
                wave = push(wave, want, c, lists)
            out[c] = np.concatenate(done) if done else none
            push(rest[c], want, c, lists)
        return out

    larger = sweep(range(symbols), False, starts)
    fewer = sweep(range(symbols - 1, 0, -1), True, [v[::-1] for v in larger])
    return np.concatenate([ends, *[x for c in range(1, symbols) for x in (larger[c], fewer[c][::-1])]])


def common_prefixes(array: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, plcp) in text order: the suffix before each in the array (-1: none), and the length of their common prefix.

    A position whose left neighbours agree (as its predecessor's do) has one less than the position to its left; the others,
    which are few, are compared eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]
    number = np.searchsorted(ends, np.arange(n))
    room = ends[number] - np.arange(n)
    prev = np.maximum(before, 0)
    most = np.where(before >= 0, np.minimum(room, room[prev]), 0)
    left = np.concatenate([[-1], np.where(room[:-1] == 0, -1, text[:-1].astype(np.int64))])
    reducible = (before >= 0) & (left >= 0) & (left == left[prev]) & (prev > 0)
    reducible[1:] &= before[1:] - 1 == np.where(reducible[1:], before[:-1], -2)
    at = np.flatnonzero(~reducible & (most > 0))
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for o in range(8):
        words |= padded[o : o + n] << np.uint64(8 * o)
    plcp, got, live = np.zeros(n, np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        a, b = at[live] + got[live], before[at[live]] + got[live]
        x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        low = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        got[live] += low
        live = live[(low == 8) & (got[live] < most[at[live]])]
    plcp[at] = np.minimum(got, most[at])
    head = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    return before, np.maximum(plcp[head] - (np.arange(n) - head), 0)


def repeated_starts(strings: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each string, whether the substring of `length` bytes at each place occurs at another place of any string too."""
    array, text, ends = suffix_array(strings)
    before, plcp = common_prefixes(array, text, ends)
    long = np.flatnonzero(plcp >= length)
    flags = np.zeros(len(text), bool)
    flags[long] = True
    flags[before[long]] = True
    return [flags[e - len(v) : e] for e, v in zip(ends.tolist(), strings, strict=True)]
