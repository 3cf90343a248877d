"""An n-gram trie of Elias-Fano levels over one shard's contexts, kept as flat arrays that a memory map serves.

Levels: the contexts (monotone keys), pointers to where each context's words begin (monotone), and the words. A context's words are
stored on top of the last value of the context before it, so the whole level is monotone; a word is found by a successor
search relative to its context's base. Beside the words lie their probabilities, beside the contexts their weights, both as
16-bit codes of the logarithm.
"""

from __future__ import annotations

import mmap

import numpy as np

#: For each byte: its number of ones, and the place of its k-th one.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.uint8)
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)

#: Codes are thousandths of -log10, counted from one; zero says that there is none.
STEP = 1000.0


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of numbers in (0, 1]: within 0.12 percent of the number."""
    return (np.minimum(np.rint(-np.log10(p) * STEP), 65534) + 1).astype(np.uint16)


def value(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((1.0 - code.astype(np.float64)) / STEP), 0.0)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The values' low `width` bits, one after another, in 64-bit words, with a word to spare."""
    bits = np.zeros((len(values), width), np.uint8)
    for b in range(width):
        bits[:, b] = (values >> b) & 1
    return _words(bits.ravel())


def _words(bits: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(bits) // 64 + 2) * 8, np.uint8)
    some = np.packbits(bits, bitorder="little")
    whole[: len(some)] = some
    return whole.view(np.uint64)


class EliasFano:
    """A monotone sequence of n numbers: low bits as they are, high bits in unary (a one for each number, a zero for each step)."""

    def __init__(self, arrays: list[np.ndarray]):
        head, self.low, self.high, self.rank = arrays
        self.n, self.width = int(head[0]), int(head[1])
        self.mask = np.uint64((1 << self.width) - 1)
        self.bytes = self.high.view(np.uint8).reshape(-1, 8)
        self.zeros = np.arange(len(self.rank), dtype=np.int64) * 64 - self.rank

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        most = int(values[-1]) if n else 0
        width = min(56, max(0, (most // max(n, 1)).bit_length() - 1))
        steps = values >> width
        bits = np.zeros(n + (most >> width) + 2, np.uint8)
        bits[steps + np.arange(n)] = 1
        high = _words(bits)
        ones = _ONES[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return [np.array([n, width], np.int64), _packed(values, width), high, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64)]

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Where the k-th one (flip 0) or zero (flip 255) is, counted from nought."""
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(np.uint8)
        row = self.bytes[word] ^ np.uint8(flip)
        upto = np.cumsum(_ONES[row], axis=1, dtype=np.uint8)
        byte = (upto <= rest[:, None]).sum(axis=1)
        at = np.arange(len(k)) * 8 + byte
        rest -= np.where(byte > 0, upto.ravel()[at - 1], 0).astype(np.uint8)
        return word * 64 + byte * 8 + _PLACE[row.ravel()[at], rest]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        over = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (((self.low[word] >> shift) | over) & self.mask).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.rank, 0) - i) << self.width) | self.lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the place of the first number that is x or more (n, if none is), whether it is x).

        Numbers that share x's high bits lie between two zeros; their low bits are searched. Each zero is selected once.
        """
        most = int(self.zeros[-1]) - 1
        high = x >> self.width
        step = np.minimum(high, most)
        zeros, at = np.unique(step, return_inverse=True)
        ends = np.minimum(self._select(zeros, self.zeros, 255) - zeros, self.n)
        apart = np.flatnonzero(np.diff(zeros, prepend=-1) > 1)  # others begin where the zero before them ends
        firsts = np.concatenate([[0], ends[:-1]])
        firsts[apart] = np.minimum(self._select(zeros[apart] - 1, self.zeros, 255) - (zeros[apart] - 1), self.n)
        end, lower = ends[at], np.where(high > most, self.n, firsts[at])
        upper, low, left = end.copy(), x & ((1 << self.width) - 1), np.flatnonzero(lower < end)
        while len(left):
            mid = (lower[left] + upper[left]) >> 1
            less = self.lows(mid) < low[left]
            lower[left[less]], upper[left[~less]] = mid[less] + 1, mid[~less]
            left = left[lower[left] < upper[left]]
        same, inside = np.zeros(len(x), bool), np.flatnonzero(lower < end)
        same[inside] = self.lows(lower[inside]) == low[inside]
        return lower, same


def flat(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, each from a multiple of eight bytes on, behind a table of their kinds and sizes."""
    table = np.array([[8 * (a.dtype == np.int64) + 9 * (a.dtype == np.uint64) + 2 * (a.dtype == np.uint16), len(a)] for a in arrays], np.int64)
    body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)
    return np.array([len(arrays)], np.int64).tobytes() + table.tobytes() + body


def unflat(data) -> list[np.ndarray]:
    count = int(np.frombuffer(data, np.int64, 1)[0])
    table = np.frombuffer(data, np.int64, 2 * count, 8).reshape(-1, 2)
    at, out = 8 + 16 * count, []
    for kind, size in table.tolist():
        dtype = {8: np.int64, 9: np.uint64, 2: np.uint16}[kind]
        out.append(np.frombuffer(data, dtype, size, at))
        at += -(-size * np.dtype(dtype).itemsize // 8) * 8
    return out


def build(context: np.ndarray, word: np.ndarray, count: np.ndarray, split: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(levels, context keys, count of each context, distinct words of each), from distinct (context, word), sorted, with counts.

    Witten-Bell smoothing: after a context met N times, with T different words, a word met n times has n / (N + T) of its own, and
    T / (N + T) goes to the shorter context. split tells, for each row, whether other shards hold words of its context: N and
    T are not known here then, and the word's code is that of n / 10^15.
    """
    keys, at = np.unique(context, return_index=True)
    total = np.add.reduceat(count, at) if len(at) else count[:0]
    kinds = np.diff(np.append(at, len(context)))
    own = np.repeat(np.arange(len(keys)), kinds)
    last = word[np.append(at[1:], len(word)) - 1] + 1 if len(at) else word[:0]
    base = np.cumsum(last) - last
    alone = count / (total + kinds)[own]
    levels = [*EliasFano.arrays(keys), *EliasFano.arrays(np.append(at, len(context))), *EliasFano.arrays(base[own] + word + 1)]
    levels += [quantised(np.where(split, count * 1e-15, alone)), quantised(kinds / (total + kinds))]
    return flat(levels), keys, total, kinds


class Trie:
    """The levels of build(), served from a memory map without a file, so that nothing is left on the executor's disk."""

    def __init__(self, levels: bytes):
        pages = mmap.mmap(-1, len(levels))
        pages.write(levels)
        arrays = unflat(memoryview(pages))
        self.contexts, self.pointers, self.words = (EliasFano(arrays[k : k + 4]) for k in (0, 4, 8))
        self.codes, self.weights = arrays[12], arrays[13]

    def find(self, contexts: np.ndarray, own: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the words, weights of the contexts): the i-th word is asked for after contexts[own[i]].

        A word that its context doesn't have gets code 0; a context that is not there gives all to the shorter one.
        """
        code, weight = np.zeros(len(word), np.uint16), np.ones(len(contexts), np.uint16)
        if not self.contexts.n:
            return code, weight
        at, same = self.contexts.successor(contexts)
        there = np.flatnonzero(same)
        weight[there] = self.weights[at[there]]
        first, end, base = (np.zeros(len(contexts), np.int64) for _ in range(3))
        places, back = np.unique(np.concatenate([at[there], at[there] + 1]), return_inverse=True)
        pointers = self.pointers.access(places)[back]
        first[there], end[there] = pointers[: len(there)], pointers[len(there) :]
        above = there[first[there] > 0]
        base[above] = self.words.access(first[above] - 1)
        asked = np.flatnonzero(end[own] > 0)
        mine = own[asked]
        place, same = self.words.successor(base[mine] + word[asked] + 1)
        hit = same & (place < end[mine])
        code[asked[hit]] = self.codes[place[hit]]
        return code, weight
