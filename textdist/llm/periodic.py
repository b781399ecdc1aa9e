"""Periodic runs of words, found with a dictionary of basic factors, and texts with runs collapsed to one period.

The basic factors of a text are its stretches of 1, 2, 4, … words. Equal factors of one length have one name; a name of the
next length is made of the names of its two halves. A run with smallest period q is judged at the length L, the power of two with
L / 2 < q <= L: inside the run the next place of a factor is exactly q further, so its places form an arithmetic
progression, and three places in a row with one difference of at most L propose that difference as a period. Proposals at
neighbouring places with one period are the same run; together they extend as far as the run does, and so are merged to its first word and its length.
A factor that occurs once in its text is dropped, with all longer ones that hold it, so common texts end after a few lengths.

A run is at least ``max(least_words, least_repeats * q)`` words long, and ``least_repeats`` is at least 4 (three places of a
factor need that many). Texts are worked in slices of bounded size, all texts of a slice at once; arrays are of the
size of a slice (a longer text is a slice of its own).

Edges: null and empty texts have no words and no runs, nulls for the longest run, and digests of nothing. Every row gives one
row, repeated rows and null keys too. Ties for the longest run go to the least start, then the least period. Other
columns are left alone.
"""

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import functions as F

from textdist.llm.bytesbatch import SPACE, flat, packed, slices, spans

RUN = "array<struct<start: long, length: long, period: long>>"


def names_of(first, second, places, most):
    """Names of pairs that occur twice or more: the places, ordered by pair and then by place, and the name at each."""
    if not len(places):
        return places, places
    bits = max(int(most), 1).bit_length()
    if 3 * bits <= 63:
        key = np.sort((first << 2 * bits) | (second << bits) | places)
        places, pair = key & ((1 << bits) - 1), key >> bits
        new = pair[1:] != pair[:-1]
    else:
        order = np.lexsort((places, second, first))
        places, first, second = places[order], first[order], second[order]
        new = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    edge = np.r_[True, new, True]
    again = ~(edge[:-1] & edge[1:])
    name = np.cumsum(edge[:-1]) - 1
    return places[again], name[again]


def runs_of(words, bounds, least_words=6, least_repeats=4):
    """Starts (in all words), lengths and periods of the runs of texts given as word numbers and bounds, ordered by start and period."""
    n = len(words)
    found = [np.zeros((3, 0), np.int64)]
    if n:
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end = bounds[1:][text]
        most = max(n, int(words.max()) + 1, len(bounds))
        places, name = names_of(text, words.astype(np.int64), np.arange(n), most)
        size, longest = 1, int(np.diff(bounds).max())
        step, named = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        while len(places) and size * least_repeats <= 2 * longest:
            # distance to the next place of the same factor, 0 if it is further than the factor is long
            step[:] = 0
            gap = np.diff(places)
            near = (name[1:] == name[:-1]) & (2 * gap > size) & (gap <= size)
            step[places[:-1][near]] = gap[near]
            heads = np.flatnonzero(step)
            period = step[heads]
            twice = heads + period < n
            heads, period = heads[twice], period[twice]
            third = step[heads + period] == period
            heads, period = heads[third], period[third]
            if len(heads):
                # neighbours with one period are one run
                edge = np.flatnonzero(np.r_[True, (np.diff(heads) != 1) | (np.diff(period) != 0) | (np.diff(text[heads]) != 0)])
                last = np.r_[edge[1:], len(heads)] - 1
                start, q = heads[edge], period[edge]
                length = heads[last] + 2 * q + size - start
                long_enough = length >= np.maximum(least_words, least_repeats * q)
                found.append(np.stack([start, length, q])[:, long_enough])
            named[:] = -1
            named[places] = name
            whole = places[places + 2 * size <= end[places]]
            whole = whole[named[whole + size] >= 0]
            places, name = names_of(named[whole], named[whole + size], whole, most)
            size *= 2
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def kept_words(n, start, length, period):
    """Which words stay if each run keeps its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


def words_of(texts):
    """Distinct words, the number of each word in them, and the bounds of each text."""
    data, offs = flat(texts)
    starts, ends = spans(data, offs, SPACE)
    words = packed(data, starts, ends).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offs).astype(np.int64)


def joined(known, words, bounds):
    """Bytes of each text's words, joined by one space."""
    body = pc.binary_join_element_wise(known, pa.scalar(b"", known.type), pa.scalar(b" ", known.type)).take(pa.array(words))
    data, offs = flat(body)
    data, offs = data.tobytes(), offs[bounds].tolist()
    return [data[a : max(a, b - 1)] for a, b in zip(offs, offs[1:])]


def with_repeated_tails(words, bounds, starts, periods):
    """Words of each text from word ``start`` on replaced by repeats of the ``period`` words there; period 0 leaves a text as it is."""
    n = np.diff(bounds)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
    a, p = np.repeat(starts, n), np.repeat(periods, n)
    source = np.where((p > 0) & (place >= a), a + (place - a) % np.maximum(p, 1), place)
    return words[source + np.repeat(bounds[:-1], n)]


def _scan(df, fields, schema, key, text, tails, options):
    rows = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                known, words, bounds = words_of(part.column("_t"))
                if tails is not None:
                    words = with_repeated_tails(words, bounds, *tails(part.column("_k").to_pylist(), np.diff(bounds).tolist()))
                start, length, period = runs_of(words, bounds, **options)
                of = np.searchsorted(start, bounds)
                keep = kept_words(len(words), start, length, period)
                start = start - np.repeat(bounds[:-1], np.diff(of))
                columns = fields(of, start, length, period, joined(known, words[keep], np.r_[0, np.cumsum(keep)][bounds]))
                yield pa.RecordBatch.from_arrays([part.column("_k"), *columns], names=["_k", *(f"_{i}" for i in range(len(columns)))])

    made = [f.split(" ", 1) for f in schema]
    out = rows.mapInArrow(run, ", ".join([f"_k {dict(rows.dtypes)['_k']}", *(f"_{i} {kind}" for i, (_, kind) in enumerate(made))]))
    return out.select(F.col("_k").alias(key), *[F.col(f"_{i}").alias(name) for i, (name, _) in enumerate(made)])


def collapse(df, key="doc_id", text="text", tails=None, **options):
    """Rows (key, runs, collapsed): the runs of each text by start and period, and its words without the repeats, joined by one space.
    ``tails`` takes keys and word counts and gives starts and periods of tails to plant first."""

    def fields(of, start, length, period, texts):
        struct = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
        return pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), struct), pa.array(texts, pa.binary()).view(pa.string())

    return _scan(df, fields, [f"runs {RUN}", "collapsed string"], key, text, tails, options)


def digests(df, key="doc_id", text="text", tails=None, **options):
    """Rows (key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run, and digests of what ``collapse`` gives."""

    def fields(of, start, length, period, texts):
        lines = [f"{s},{l},{p}\n" for s, l, p in zip(start.tolist(), length.tolist(), period.tolist())]
        at = of.tolist()
        own = [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(at, at[1:])]
        text_of = np.repeat(np.arange(len(of) - 1), np.diff(of))
        order = np.lexsort((period, start, -length, text_of))
        has = np.diff(of) > 0
        best = order[of[:-1][has]]
        longest = []
        for values in (start, length, period, 1000 * length // np.maximum(period, 1)):
            column = np.zeros(len(has), np.int64)
            column[has] = values[best]
            longest.append(pa.array(column, mask=~has))
        rest = [hashlib.sha256(x).hexdigest() for x in texts]
        return [pa.array(np.diff(of).astype(np.int64)), *longest, pa.array(own), pa.array(rest)]

    schema = ["n_runs long", "start long", "length long", "period long", "exponent_milli long", "runs_sha256 string", "collapsed_sha256 string"]
    return _scan(df, fields, schema, key, text, tails, options)


def planted_tails(keys, counts):
    """Starts and periods of the tails that every tenth key, by CRC, gets; none for a null key or no words."""
    starts, periods = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for i, (k, n) in enumerate(zip(keys, counts)):
        h = crc32(str(k).encode())
        if k is not None and n and h % 10 == 0:
            g = h // 10
            starts[i] = g % n
            periods[i] = 1 + (n - starts[i]) // (3 + g % 8)
    return starts, periods
