"""Whole texts of an Arrow batch as one byte array with offsets, and the words in it.

Operators work on slices of a batch of bounded size: a slice ends when its texts pass
``limit`` bytes, so only a single text can make it larger.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x):
    """splitmix64 of every element."""
    x = x.astype(U64) + _GOLD
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def flat(texts):
    """Bytes and int64 offsets of a string or binary array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(batch, column, limit=SLICE_BYTES):
    """Slices of a record batch whose texts hold about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def give_back():
    """Free memory of this process returned to the system, where the C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A task on Arrow batches that gives back its memory when it ends: its worker serves later tasks and stages too,
    and what it holds in reserve adds to theirs."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def spans(data, offs, gap):
    """Starts and ends of the runs of bytes outside ``gap`` (a table of 256), cut at text ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offs[1:-1]
    edges = edges[edges < len(data)]
    starts = inside & ~before
    starts[edges] = inside[edges]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = inside & ~after
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def packed(data, starts, ends):
    """Arrow binary array of the given spans."""
    lengths = ends - starts
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    mask = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    body = data[mask]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(body)])


def sums(values, bounds):
    """Sum of values[bounds[i]:bounds[i + 1]] for every i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
