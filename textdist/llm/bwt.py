"""Burrows-Wheeler transform of a collection of strings, column by column, with common prefixes.

Round j puts the j-th symbol from the right of every string in front of its last suffix, and so inserts one suffix per string into
the sorted list of all suffixes so far. The list is kept as three arrays that a round reads and rewrites from
front to back, like the files of an external construction: for each suffix its first symbol with the place of its tail (the
LF mapping of the transform), the symbol before it (the transform), and the number of symbols it shares
with the suffix before it, up to a cap. Rounds are as many as the longest string has symbols, so callers pass
collections of short strings and bounded size.

A symbol is a few bytes, most significant first, so its order is that of the bytes. Windows of bytes at any offset
are met by giving each text as several strings, one for each phase of its end.
"""

import numpy as np

SHIFT, TAIL = np.uint64(31), np.uint64((1 << 31) - 1)
BLOCK = 64
#: row i covers what lies more than i places behind the first of a block
BEYOND = np.where(np.arange(BLOCK) > np.arange(BLOCK)[:, None], 255, 0).astype(np.uint8)


class Minima:
    """Least value of any range of an array of bytes."""

    def __init__(self, values):
        n = len(values)
        blocks = n // BLOCK + 2
        self.values = np.full(blocks * BLOCK + BLOCK, 255, np.uint8)
        self.values[:n] = values
        self.rows = np.lib.stride_tricks.sliding_window_view(self.values, BLOCK)
        self.levels = [self.values[: blocks * BLOCK].reshape(blocks, BLOCK).min(1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def _edge(self, lo, hi):
        """Ranges within BLOCK values."""
        out = np.empty(len(lo), np.uint8)
        near = hi == lo
        out[near] = self.values[lo[near]]
        far = np.flatnonzero(~near)
        rows = self.rows[lo[far]]
        rows |= BEYOND[(hi - lo)[far]]
        half = BLOCK // 2
        while half >= 8:  # whole rows at once; the last few by numpy's reduction
            rows = np.minimum(rows[:, :half], rows[:, half:])
            half //= 2
        out[far] = rows.min(1)
        return out

    def of(self, lo, hi):
        """Least of values[lo..hi], both ends included, lo <= hi."""
        short = hi - lo < BLOCK
        if short.all():
            return self._edge(lo, hi)
        out = np.empty(len(lo), np.uint8)
        out[short] = self._edge(lo[short], hi[short])
        a, b = lo[~short], hi[~short]
        left, right = a // BLOCK + 1, b // BLOCK - 1
        best = np.minimum(self._edge(a, left * BLOCK - 1), self._edge((right + 1) * BLOCK, b))
        width = right - left + 1
        level = np.where(width > 0, np.log2(np.maximum(width, 1)).astype(np.int64), -1)
        for k in np.unique(level[level >= 0]):
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            best[at] = np.minimum(best[at], np.minimum(table[left[at]], table[right[at] + 1 - (1 << int(k))]))
        out[~short] = best
        return out


def build(symbols, ends, lengths, cap, width=1):
    """(keys, common, before, place): per suffix in order, first symbol + 1 and place of its tail packed in one number, symbols
    shared with the suffix before (at most ``cap`` <= 250), symbol before it (0 for none), and the place of each whole string.

    String i has ``lengths[i]`` symbols, the last at ``ends[i] - width`` in ``symbols``, each ``width`` before the next. Empty
    suffixes come first, in the order of the strings."""
    m = len(ends)
    keys, common = np.arange(m, dtype=np.uint64), np.zeros(m, np.uint8)
    before = np.zeros(m, np.uint32)
    place = np.arange(m, dtype=np.int64)
    turn = np.arange(m)  # strings in the order of their last suffix
    for j in range(int(lengths.max()) if m else 0):
        turn = turn[lengths[turn] > j]
        symbol = symbols[ends[turn] - (j + 1) * width]
        before[place[turn]] = symbol
        by_symbol = np.argsort(symbol, kind="stable")
        turn, symbol = turn[by_symbol], symbol[by_symbol]
        first = symbol.astype(np.uint64) + np.uint64(1)
        tail = place[turn]
        key = first << SHIFT | tail.astype(np.uint64)
        at = np.searchsorted(keys, key)  # old suffixes before each new one
        n, k = len(keys), len(key)
        least = Minima(common)
        # common prefix with the suffix before: 1 + that of the tails
        fresh = np.zeros(k, bool)
        fresh[1:] = at[1:] == at[:-1]
        above = np.where(fresh, np.r_[key[:1], key[:-1]], keys[np.maximum(at - 1, 0)])
        i = np.flatnonzero((above >> SHIFT == first) & (fresh | (at > 0)))
        new_common = np.zeros(k, np.uint8)
        new_common[i] = np.minimum(least.of((above[i] & TAIL).astype(np.int64) + 1, tail[i]), cap - 1) + 1
        # and of the old suffix after it
        i = np.flatnonzero(np.r_[at[1:] != at[:-1], True] & (at < n))
        i = i[keys[at[i]] >> SHIFT == first[i]]
        common[at[i]] = np.minimum(least.of(tail[i] + 1, (keys[at[i]] & TAIL).astype(np.int64)), cap - 1) + 1
        # rewrite the list
        shift = np.cumsum(np.bincount(at, minlength=n + 1)[:n], dtype=np.uint32)
        key += shift[tail]
        keys += shift[(keys & TAIL).view(np.int64)]
        place += shift[place]
        new_place = at + np.arange(k)
        place[turn] = new_place
        stays = np.ones(n + k, bool)
        stays[new_place] = False
        grown = []
        for old, new in ((keys, key), (common, new_common), (before, np.zeros(k, np.uint32))):
            out = np.empty(n + k, old.dtype)
            out[stays] = old
            out[new_place] = new
            grown.append(out)
        keys, common, before = grown
    return keys, common, before, place


def phases(data, offs, width):
    """Symbols at every byte, and for each text the strings of its phases: (symbols, text, ends, lengths)."""
    padded = np.r_[data, np.zeros(width, np.uint8)].astype(np.uint32)
    symbols = np.zeros(len(data), np.uint32)
    for j in range(width):
        symbols = symbols << np.uint32(8) | padded[j : j + len(data)]
    texts = len(offs) - 1
    text = np.repeat(np.arange(texts), width)
    ends = offs[1:][text] - np.tile(np.arange(width), texts)
    lengths = np.maximum(ends - offs[:-1][text], 0) // width
    return symbols, text, ends, lengths


def repeated_windows(data, offs, window, width=4):
    """(text, offset, group) of every window of ``window`` bytes; windows of one group are equal, and no others."""
    if window % width:
        raise ValueError("a window is a whole number of symbols")
    symbols, text, ends, lengths = phases(data, offs, width)
    cap = window // width
    keys, common, _, place = build(symbols, ends, lengths, cap, width)
    group = np.cumsum(common < cap)
    string = np.flatnonzero(lengths >= cap)
    at, found, gone = place[string], [], 0
    while len(string):
        found.append((text[string], ends[string] - offs[text[string]] - (lengths[string] - gone) * width, group[at]))
        at = (keys[at] & TAIL).astype(np.int64)
        gone += 1
        more = lengths[string] >= cap + gone
        string, at = string[more], at[more]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))
