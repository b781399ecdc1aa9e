"""Sets of hashed word shingles of whole texts."""

import numpy as np

from textdist.llm.bytesbatch import SPACE, mix, spans

_rng = np.random.default_rng(20)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(data):
    """A-Z in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def span_hashes(data, starts, ends):
    """64-bit hash of each span of bytes; spans are in order and do not overlap."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lengths.max()), STEP))
        terms = BYTE[data[place + np.repeat(starts, lengths)]] * power[place]
        return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def gram_hashes(words, size):
    """Hash of every run of ``size`` words, by its first word."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size):
        out += words[j : n + j] * PLACE[j] if n > 0 else 0
    return mix(out)


def shingle_sets(data, offs, size=5):
    """Sorted distinct shingle hashes of each text. A text of fewer words has its whole sequence as one."""
    data = lowered(data)
    starts, ends = spans(data, offs, SPACE)
    words = span_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offs).tolist()
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            fresh = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        elif b > a:
            out.append(mix(gram_hashes(words[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
