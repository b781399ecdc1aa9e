"""n-gram counts in packed form.

Tasks work on slices of texts. Equal n-grams of a slice are merged in place, and what moves on is one binary row per slice and
bucket of n-grams, so an n-gram costs a few bytes and a frequent one an entry per slice. Buckets are ranges of the
n-gram's hash and their number follows the size of the texts, so no task's memory grows with the table. Large tables are worked in
turns, each with the n-grams of its own first words and its shuffle files dropped when it ends, so disk holds a part of the n-grams at a time. An n-gram is told apart by
an 80-bit hash: among 10^10 different ones a clash has probability about 4 x 10^-5. The numpy helpers
run in Python workers on one slice or one bucket.

What a slice must know of the others (``shared_codes``) comes back as a number per n-gram, in the order of the slice's hashes, so neither
the text of an n-gram nor that of its holder moves.
"""

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textdist.session import cut_lineage, shuffles_dropped

SLICE_BYTES = 8 << 20
BUCKET_GRAMS = 6 << 20
#: turns of a large table, and the size of texts that is worth one
TURNS, TURN_BYTES = 4, 32 << 20
#: bytes of a word and the space after it, low so that buckets rather come out small
WORD_BYTES = 4
GATHER_ROWS = 1 << 16
LANES = (np.uint64(0x9E3779B97F4A7C13), np.uint64(0xC2B2AE3D27D4EB4F))
KEYS = ("textdist-ngram-1", "textdist-ngram-2")
HASHED = [("f", "<u8"), ("e", "<u2")]
COUNTED = np.dtype([*HASHED, ("total", "<u4")])
#: a number of a slice's n-gram that the other slices must see: a count of one text, or one times copies of texts
SHARED, SHARED_WIDE = (np.dtype([*HASHED, ("v", x)]) for x in ("<u4", "<u8"))
ENTRIES = "_slice int, _bucket int, n int, _data binary"


def text_bytes(df, tokens):
    """Size of a token column; an array element counts as a short word."""
    kind = df.schema[tokens].dataType
    size = F.octet_length(tokens) if isinstance(kind, T.StringType) else F.size(tokens) * F.lit(2 * WORD_BYTES)
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def bucket_count(spark, size, orders):
    grams = size // WORD_BYTES * len(set(orders))
    return max(spark.sparkContext.defaultParallelism, -(-grams // BUCKET_GRAMS))


def turn_count(size):
    return max(1, min(TURNS, size // TURN_BYTES))


def plain_tokens(df, tokens):
    """Texts as they are, other tokens as arrays of strings."""
    return F.col(tokens) if isinstance(df.schema[tokens].dataType, T.StringType) else F.col(tokens).cast("array<string>").alias(tokens)


def packed_rows(values):
    """A structured array by byte planes: planes of zeros nearly vanish when rows are compressed."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked_rows(blobs, kind):
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel() for b in blobs]
    return np.concatenate(parts)


def packed_grams(values):
    """N-grams in the order of ``f``, kept as steps, whose high bytes are zero."""
    out = values.copy()
    out["f"][1:] = np.diff(values["f"])
    return packed_rows(out)


def unpacked_grams(blobs, kind):
    parts = [unpacked_rows([b], kind) for b in blobs]
    for p in parts:
        p["f"] = np.cumsum(p["f"])
    return np.concatenate(parts)


def stable_order(numbers, most):
    """Order of small numbers; 16-bit ones are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if most < 1 << 16 else numbers, kind="stable")


def scrambled(x):
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def range_of(f, ranges):
    """Number of the equal range of hashes that holds each one."""
    return ((f >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def free_memory():
    """Give the memory of a slice back, as workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def word_hashes(words):
    """Two 64-bit hashes of each word of an Arrow string array, one look-up per different word."""
    coded = words.dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    known = pc.fill_null(coded.dictionary, "\x00null").to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy(zero_copy_only=False)
    return [pd.util.hash_array(known, hash_key=k, categorize=False)[at] if len(known) else np.empty(0, np.uint64) for k in KEYS]


def coded_rows(table, names):
    """Number of each row's combination of values, and a row of each combination."""
    code = np.zeros(len(table), dtype=np.int64)
    for name in names:
        column = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = np.unique(code * max(1, len(column.dictionary)) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    return code, first


def run_starts(*columns):
    """Where sorted rows begin to differ from the row before."""
    differs = np.zeros(len(columns[0]), dtype=bool)
    differs[:1] = True
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(differs)


def hash_order(f):
    """Order of hashes, equal ones as they come."""
    order = np.argsort(f)
    same = f[order[1:]] == f[order[:-1]]
    if same.any():
        run = np.cumsum(np.append(True, ~same))
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))
        tied = (run[at].astype(np.uint64) << np.uint64(32)) | order[at].astype(np.uint64)
        tied.sort()
        order[at] = (tied & np.uint64(0xFFFFFFFF)).astype(order.dtype)
    return order


def sorted_grams(f, e, group=None, groups=1):
    """Order of n-grams by group and hash, equal ones as they come; the second part of the hash rarely decides."""
    order = hash_order(f)
    more = ()
    if groups > 1:
        order = order[stable_order(group[order], groups)]
        more = (group[order],)
    if len(run_starts(f[order], *more)) != len(run_starts(f[order], *more, e[order])):
        order = np.lexsort((e, f, group) if groups > 1 else (e, f))
    return order


def slices_of(batches, tokens, limit=SLICE_BYTES):
    """Arrow batches put together to slices of bounded size, rows without tokens left out."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = pa.Table.from_batches([batch.slice(at, 256)])
            part = part.filter(pc.is_valid(part.column(tokens)))
            held.append(part)
            size += part.column(tokens).nbytes
            if size >= limit:
                yield pa.concat_tables(held)
                held, size = [], 0
    if size or any(len(h) for h in held):
        yield pa.concat_tables(held)


class Slice:
    """Word places of a slice of texts, in the order of rows."""

    def __init__(self, table, tokens, by, mixed=None):
        """``by`` numbers the groups of rows; a hash of the group in column ``mixed`` goes into the hashes of n-grams."""
        column = table.column(tokens).combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        is_text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
        words = pc.split_pattern(column, " ") if is_text else column
        length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(length), dtype=np.int32), length)
        ends = np.cumsum(length)
        self.left = (np.repeat(ends, length) - np.arange(len(self.row))).astype(np.int32)
        flat = words.flatten()
        self.hash = word_hashes(flat)
        self.code, self.first = coded_rows(table, by)
        mixed = None if mixed is None else table.column(mixed).to_numpy().astype(np.int64).view(np.uint64)
        self.mixed = None if mixed is None else [scrambled(mixed + m) for m in LANES]
        if is_text:
            size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.empty(0, np.int64)
            self.start = np.cumsum(size) - size + np.arange(len(size)) - self.row
            self.stop = self.start + size
            wide = column.cast(pa.large_binary())
            offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
            self.bytes = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]

    def grams(self, orders, turn=0, turns=1):
        """Per order (n, places, f, e) of its n-grams of a turn, which their first two words choose."""
        (h, k), (p, q) = self.hash, LANES
        for n in range(1, max(orders) + 1):
            if n < 3:
                first = h if n == 1 else h[:-1] * p + h[1:]
                at = np.flatnonzero((self.left[: len(first)] >= n) & ((range_of(scrambled(first), turns) == np.uint64(turn)) if turns > 1 else True))
                a, b = first[at], k[at] if n == 1 else k[at] * q + k[at + 1]
            else:
                more = self.left[at] >= n
                at = at[more]
                a, b = a[more] * p + h[at + (n - 1)], b[more] * q + k[at + (n - 1)]
            if n in orders:
                group = None if self.mixed is None else self.row[at]
                f, e = (scrambled(x if group is None else x + m[group]) for x, m in zip((a, b), self.mixed or (None, None)))
                yield n, at, f, e.astype(np.uint16)


def gathered(data, start, stop):
    """Bytes of many stretches, one after the other."""
    out = []
    for s in range(0, len(start), GATHER_ROWS):
        lo, size = start[s : s + GATHER_ROWS], stop[s : s + GATHER_ROWS] - start[s : s + GATHER_ROWS]
        out.append(data[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))])
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def _hashed(kind, f, e, **more):
    values = np.empty(len(f), kind)
    values["f"], values["e"] = f, e
    for name, x in more.items():
        values[name] = x
    return values


def _cuts(bucket, *group):
    starts = run_starts(bucket, *group)
    return starts, np.append(starts, len(bucket))


def counted_slices(tokens, orders, by, buckets, turn=0, turns=1):
    """Task: (by…, _bucket, n, _data) with the counts of a slice's n-grams of a turn."""

    def run(batches):
        for table in slices_of(batches, tokens):
            part = Slice(table, tokens, by)
            groups = len(part.first)
            for n, at, f, e in part.grams(orders, turn, turns):
                if not len(at):
                    continue
                g = part.code[part.row[at]] if groups > 1 else np.zeros(len(at), np.uint8)
                order = sorted_grams(f, e, g, groups)
                f, e, g = f[order], e[order], g[order]
                starts = run_starts(f, e, g)
                values = _hashed(COUNTED, f[starts], e[starts], total=np.diff(np.append(starts, len(f))))
                bucket, g = range_of(values["f"], buckets).astype(np.int32) + turn * buckets, g[starts]
                at, cuts = _cuts(bucket, g)
                rows = table.select(by).take(pa.array(part.first[g[at]])) if by else None
                columns = [rows.column(c).combine_chunks() for c in by] if by else []
                yield from pa.table([*columns, pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), n, np.int32)),
                                     pa.array([packed_grams(values[s:e]) for s, e in zip(cuts[:-1], cuts[1:])], pa.binary())], names=[*by, "_bucket", "n", "_data"]).to_batches()
            del part
            free_memory()

    return run


def _of_orders(table):
    """Per order of a bucket, the rows of its blobs."""
    n = table.column("n").to_numpy()
    return [(int(x), np.flatnonzero(n == x)) for x in np.unique(n)]


def bucket_totals(by):
    def run(table):
        data, rows = table.column("_data"), []
        for n, at in _of_orders(table):
            v = unpacked_grams([data[i].as_buffer() for i in at], COUNTED)
            order = sorted_grams(v["f"], v["e"])
            rows.append((n, len(run_starts(v["f"][order], v["e"][order])), int(v["total"].sum(dtype=np.int64))))
        n, uniq, total = zip(*rows)
        group = [pa.chunked_array([table.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(rows), np.int64)))]) for c in by]
        free_memory()
        return pa.table([*group, pa.array(n, pa.int32()), pa.array(uniq, pa.int64()), pa.array(total, pa.int64())], names=[*by, "n", "uniq", "total"])

    return run


def by_bucket(rows, by, buckets, kernel, schema):
    """Blobs of each bucket and group to the rows of ``kernel``."""
    return rows.repartition(buckets, *by, "_bucket").groupBy(*by, "_bucket").applyInArrow(kernel, schema)


def in_turns(spark, turns, rows_of):
    """Rows of all turns, each worked and written before the next begins."""
    out = None
    for turn in range(turns):
        with shuffles_dropped(spark):
            done = cut_lineage(rows_of(turn))
        out = done if out is None else out.unionByName(done)
    return out


def other_tops(first, gram, v):
    """Twice the largest number of the same n-gram in another slice, and one more in the n-gram's first slice."""
    starts = np.flatnonzero(first)
    top = np.maximum.reduceat(v, starts)
    leads = v == top[gram]
    sole = np.add.reduceat(leads.astype(np.int64), starts) == 1
    runner = np.where(sole, np.maximum.reduceat(np.where(leads, 0, v), starts), top)
    return 2 * np.where(leads, runner[gram], top[gram]) + first


def first_sums(first, gram, v):
    """The n-gram's sum in its first slice, 0 in the others."""
    return np.where(first, np.add.reduceat(v, np.flatnonzero(first))[gram], 0)


def bucket_codes(code, kind):
    """(_slice, _bucket, n, _data): for each blob of a bucket the numbers ``code(first, gram, v)`` of its n-grams."""

    def run(table):
        data, out = table.column("_data"), [None] * len(table)
        for _, at in _of_orders(table):
            v = [unpacked_grams([data[i].as_buffer()], kind) for i in at]
            ends = np.cumsum([len(x) for x in v])
            v = np.concatenate(v)
            order = sorted_grams(v["f"], v["e"])
            starts = run_starts(v["f"][order], v["e"][order])
            first = np.zeros(len(v), dtype=bool)
            first[starts] = True
            numbers = np.empty(len(v), np.int64)
            numbers[order] = code(first, np.cumsum(first) - 1, v["v"][order].astype(np.int64))
            for i, x in zip(at, np.split(numbers, ends[:-1])):
                out[i] = _told(x)
        free_memory()
        return table.select(["_slice", "_bucket", "n"]).append_column("_data", pa.array(out, pa.binary()))

    return run


def _told(numbers):
    """Numbers in few bytes: how many, the size of each, and their compressed byte planes."""
    kind = np.min_scalar_type(int(numbers.max()))
    return np.array([len(numbers), kind.itemsize], "<u4").tobytes() + pa.compress(packed_rows(numbers.astype(kind)), codec="zstd", asbytes=True)


def _numbers(blob):
    rows, size = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    return unpacked_rows([pa.decompress(pa.py_buffer(blob)[8:], size * rows, codec="zstd")], np.dtype(f"<u{size}")).astype(np.int64)


class Shared:
    """Texts dealt to ``slices``, and what their n-grams are in the other slices.

    ``texts`` has a column ``_slice``. ``held(table)`` reads a slice: a function of (orders, turn, turns) to tuples (n, f, e, number, more), n-grams of an order
    once and in the order of their hashes. ``code`` makes the numbers that come back of those of all slices, see ``bucket_codes``."""

    def __init__(self, texts, tokens, orders, slices, size, held, code, kind=SHARED):
        self.texts, self.tokens, self.orders, self.slices, self.held, self.code, self.kind = texts, tokens, orders, slices, held, code, kind
        self.turns = turn_count(size)
        self.buckets = -(-bucket_count(texts.sparkSession, size, orders) // self.turns)

    def codes(self):
        """Numbers of all slices, written turn by turn."""
        tokens, orders, held, turns, buckets, kind = self.tokens, self.orders, self.held, self.turns, self.buckets, self.kind

        def entries(turn):
            def run(batches):
                table = _whole(batches, tokens)
                if table is None:
                    return
                number = table.column("_slice")[0].as_py()
                for n, f, e, v, _ in held(table)(orders, turn, turns):
                    values, bucket = _hashed(kind, f, e, v=v), range_of(f, buckets).astype(np.int32) + turn * buckets
                    at, cuts = _cuts(bucket)
                    yield from pa.table([pa.array(np.full(len(at), number, np.int32)), pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), n, np.int32)),
                                         pa.array([packed_grams(values[s:e]) for s, e in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["_slice", "_bucket", "n", "_data"]).to_batches()
                free_memory()

            return run

        def rows_of(turn):
            rows = self.texts.repartitionById(self.slices, F.col("_slice")).mapInArrow(entries(turn), ENTRIES)
            return by_bucket(rows, [], buckets, bucket_codes(self.code, kind), ENTRIES)

        return in_turns(self.texts.sparkSession, turns, rows_of)

    def finished(self, finish, schema):
        """Rows of ``finish(table, grams)`` per slice; ``grams`` yields what ``held`` does, the numbers that came back before those sent."""
        tokens, orders, held, turns, buckets = self.tokens, self.orders, self.held, self.turns, self.buckets
        both = self.texts.unionByName(self.codes(), allowMissingColumns=True)

        def run(batches):
            codes, texts = {}, []
            for batch in batches:
                back = pc.is_valid(batch.column("_data"))
                told = batch.filter(back)
                for n, bucket, data in zip(*(told.column(c).to_pylist() for c in ("n", "_bucket", "_data"))):
                    codes[n, bucket] = data
                texts.append(batch.filter(pc.invert(back)))
            table = _whole(texts, tokens)
            if table is None:
                return

            def grams():
                read = held(table)
                for turn in range(turns):
                    for n, f, e, sent, more in read(orders, turn, turns):
                        mine = sorted(b for m, b in codes if m == n and b // buckets == turn)
                        numbers = np.concatenate([np.empty(0, np.int64)] + [_numbers(codes[n, b]) for b in mine])
                        if len(numbers) != len(f):
                            raise ValueError("the texts changed between two readings")
                        yield n, f, e, numbers, sent, more

            yield from finish(table, grams())
            free_memory()

        return both.repartitionById(self.slices, F.col("_slice")).mapInArrow(run, schema)


def _whole(batches, tokens):
    """The rows of a task that have tokens as one table, None without any."""
    table = [pa.Table.from_batches([b]) for b in batches]
    table = pa.concat_tables(table) if table else None
    table = None if table is None else table.filter(pc.is_valid(table.column(tokens)))
    return table if table is not None and len(table) else None


def group_hash(by):
    """A 64-bit hash of a group's values; nulls are values."""
    return F.xxhash64(*by, *[F.isnull(c) for c in by]) if by else F.lit(0).cast("long")


def owned_grams(key, tokens, by):
    """Reads a slice: (n, f, e, largest count of a text, owners) of its n-grams; ``owners()`` gives their count, a row of the text with the largest
    one, and the next count. Rows of one group and key are one text. The next is the largest too where no text with a key holds that alone."""

    def held(table):
        code, _ = coded_rows(table, ["_group", key])
        given = np.argsort(code, kind="stable")
        part = Slice(table.take(pa.array(given)), tokens, [], "_group" if by else None)
        code = code[given].astype(np.int32)
        absent = pc.is_null(table.column(key)).to_numpy()[given]

        def read(orders, turn, turns):
            for n, at, f, e in part.grams(orders, turn, turns):
                if not len(at):
                    continue
                order = sorted_grams(f, e)
                f, e, row = f[order], e[order], part.row[at[order]]
                text = code[row]
                fresh = np.append(True, (f[1:] != f[:-1]) | (e[1:] != e[:-1]))
                texts = np.flatnonzero(fresh | np.append(True, text[1:] != text[:-1]))
                count = np.diff(np.append(texts, len(f)))
                starts = np.flatnonzero(fresh[texts])
                top = np.maximum.reduceat(count, starts)

                def owners():
                    size = np.diff(np.append(starts, len(texts)))
                    first = texts[starts]
                    holder, after, total = row[first], np.where(absent[row[first]], top, 0), np.diff(np.append(first, len(f)))
                    # n-grams of several texts
                    some = np.flatnonzero(size > 1)
                    if len(some):
                        mine = np.repeat(size > 1, size)
                        c, r, at = count[mine], row[texts[mine]], np.cumsum(size[some]) - size[some]
                        gram = np.repeat(np.arange(len(some)), size[some])
                        leads = c == top[some][gram]
                        lead = np.flatnonzero(leads)
                        holder[some] = r[lead[np.append(True, gram[lead][1:] != gram[lead][:-1])]]
                        alone = (np.add.reduceat(leads.astype(np.int32), at) == 1) & ~absent[holder[some]]
                        after[some] = np.where(alone, np.maximum.reduceat(np.where(leads, 0, c), at), top[some])
                    return total, given[holder], after

                yield n, f[texts[starts]], e[texts[starts]], top, owners

        return read

    return held


def losses_of(key, by):
    """Rows (by…, key, n, loss, uniq, total) of a slice: the matches that its texts lose, and its n-grams per group beside a null key."""

    def finish(table, grams):
        text, _ = coded_rows(table, ["_group", key])
        group, first_of_group = coded_rows(table, ["_group"])
        first_of_text = np.unique(text, return_index=True)[1]
        loss, uniq, total = {}, {}, {}
        sums = lambda kept, n, at, x, rows: kept.__setitem__(n, kept.get(n, 0) + np.bincount(at, x, rows).astype(np.int64))
        for n, _, _, back, top, owners in grams:
            count, holder, after = owners()
            lost = np.maximum(0, top - np.maximum(after, back >> 1))
            sums(loss, n, text[holder], lost, len(first_of_text))
            sums(uniq, n, group[holder], back & 1, len(first_of_group))
            sums(total, n, group[holder], count, len(first_of_group))
        for n in loss:
            mine, whole = np.flatnonzero(loss[n]), np.flatnonzero(total[n])
            at = np.append(first_of_text[mine], first_of_group[whole])
            zero, none = np.zeros(len(mine), np.int64), np.zeros(len(whole), np.int64)
            named = np.append(np.zeros(len(mine), bool), np.ones(len(whole), bool))
            keys = pc.if_else(pa.array(named), pa.scalar(None, pa.int64()), table.column(key).combine_chunks().take(pa.array(at)))
            columns = [table.column(c).combine_chunks().take(pa.array(at)) for c in by]
            yield from pa.table([*columns, keys, pa.array(np.full(len(at), n, np.int32)), pa.array(np.append(loss[n][mine], none)), pa.array(np.append(zero, uniq[n][whole])),
                                 pa.array(np.append(zero, total[n][whole]))], names=[*by, key, "n", "loss", "uniq", "total"]).to_batches()

    return finish


def merged_copies(tokens, by):
    """Task: (by…, tokens, _copies), the equal rows of a slice once."""

    def run(batches):
        for table in slices_of(batches, tokens):
            yield from table.group_by([*by, tokens]).aggregate([([], "count_all")]).rename_columns([*by, tokens, "_copies"]).to_batches(max_chunksize=4096)

    return run


def placed_grams(tokens, by):
    """Reads a slice: (n, f, e, count, (places, the slice)) of its n-grams, a row's counted as often as it has copies."""

    def held(table):
        part = Slice(table, tokens, [], "_group" if by else None)
        copies = table.column("_copies").to_numpy().astype(np.int64)

        def read(orders, turn, turns):
            for n, at, f, e in part.grams(orders, turn, turns):
                if not len(at):
                    continue
                order = sorted_grams(f, e)
                f, e, at = f[order], e[order], at[order]
                starts = run_starts(f, e)
                yield n, f[starts], e[starts], np.add.reduceat(copies[part.row[at]], starts), (at[starts], part)

        return read

    return held


def named_grams(by):
    """Rows (by…, n, gram, freq) of the n-grams a slice is the first of."""

    def finish(table, grams):
        columns = [table.column(c).combine_chunks() for c in by]
        for n, _, _, freq, _, (place, part) in grams:
            mine = np.flatnonzero(freq)
            mine = mine[np.argsort(place[mine])]
            for s in range(0, len(mine), GATHER_ROWS):
                at, many = place[mine[s : s + GATHER_ROWS]], freq[mine[s : s + GATHER_ROWS]]
                lo, hi = part.start[at], part.stop[at + n - 1]
                ends = np.append(0, np.cumsum(hi - lo)).astype(np.int64)
                gram = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(gathered(part.bytes, lo, hi))).cast(pa.string())
                row = pa.array(part.row[at])
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in columns], pa.array(np.full(len(at), n, np.int32)), gram, pa.array(many)], names=[*by, "n", "gram", "freq"])

    return finish


def blob_schema(df, by):
    return T.StructType([df.schema[c] for c in by] + T._parse_datatype_string("_bucket int, n int, _data binary").fields)


def with_columns_of(df, by, more):
    return T.StructType([df.schema[c] for c in by] + T._parse_datatype_string(more).fields)
