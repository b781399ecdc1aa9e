"""Exact removal of repeated byte windows, by suffix arrays built column by column.

A byte goes if it lies in a window of ``window`` bytes that also starts earlier: in a text of smaller id, or earlier in its own. The
suffixes of a corpus fall into groups that can be sorted apart: the least hash of the k-grams in a window (its
anchor) is the same for equal windows. So texts are cut into runs of windows with one anchor position, and

1. equal runs are one class: all but the first are removed whole, first in their task, then by a shuffle of hashes;
2. anchors with several different runs have their runs' bytes dealt by anchor into collections of bounded size, and
   the collection's transform with common prefixes (``bwt``) gives the groups of equal windows: all but the first are removed;
3. an anchor with more than ``GROUP`` different runs, such as a short line that very many texts hold, is not sorted in one task:
   its windows are dealt again by longer k-grams, at last by whole windows, whose equal runs step 1 removes.

Equal windows stand at the same place of equal anchors, so no window is missed; classes and anchors are told apart by
64-bit hashes, windows by their bytes. Texts move twice, by id: to be cut, and to be removed from.

Edges: null and empty texts, and texts shorter than the window, are kept whole. Ids are integers and order the texts. A row
with a null id is kept whole. Rows of one id are one text: equal rows do not remove each other. An empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textdist.llm.bwt import repeated_windows
from textdist.llm.bytesbatch import flat, mix, slices, tidy
from textdist.session import cut_lineage

WINDOW = 100
#: lengths of the k-grams that give anchors; the last is the window itself
LEVELS = (24, 64)
GROUP = 1000
#: of a slice that is hashed, of the runs a task gathers before it deals them, of a collection
HASH_BYTES, RUNS, COLLECTION_BYTES = 1 << 19, 150_000, 1 << 20
RUNS_PER_BUCKET = 150_000

_rng = np.random.default_rng(7)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n):
    """Powers of BASE and of its inverse mod 2^64, at least n of each."""
    if len(_powers[0]) < n:
        n = 1 << int(n - 1).bit_length()
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    return _powers


class Hashes:
    """Hash of any span of a byte array: sums of byte values times powers, brought to the span's start."""

    def __init__(self, data):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def every(self, k):
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def of(self, starts, ends):
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def least_of(values, width):
    """Least of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def runs(data, offs, k, window):
    """Runs of windows with one anchor position: (piece, start in ``data``, windows, anchor hash, hash of the run's bytes).

    The anchor of a window is the leftmost of its least k-gram hashes, so it depends on the window's bytes alone."""
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < window:
        return nothing
    hashes = Hashes(data)
    grams = hashes.every(k)
    least = least_of(grams, window - k + 1)
    piece = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inside = piece[: len(least)] == piece[window - 1 :]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(fresh & inside)
    if not len(starts):
        return nothing
    stops = np.flatnonzero(inside & np.r_[fresh[1:] | ~inside[1:], True]) + 1
    return piece[starts], starts, stops - starts, least[starts], hashes.of(starts, stops + (window - 1))


def _zip(x):
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unzip(x, n, kind):
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _first_of_class(anchor, body, doc, start):
    """Order by class then place; whether a run opens its class; whether it is a repeat of an earlier place."""
    order = np.lexsort((start, doc, body, anchor))
    anchor, body, doc, start = anchor[order], body[order], doc[order], start[order]
    opens = np.r_[True, (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1])]
    head = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    repeat = (doc != doc[head]) | (start != start[head])
    return order, opens, repeat


def _pieces(batch):
    """Pieces of texts to look at: (data, offs, doc, origin of each piece in its text). Without ranges, whole texts."""
    data, offs = flat(batch.column("_t"))
    doc = batch.column("_k").to_numpy(zero_copy_only=False).astype(np.int64)
    if "ranges" not in batch.schema.names:
        return data, offs, doc, np.zeros(len(doc), np.int64)
    ranges = batch.column("ranges")
    counts = ranges.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    inner = ranges.flatten()
    origin, size = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size"))
    owner = np.repeat(np.arange(len(doc)), counts)
    begin = offs[owner] + origin
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - begin, size)
    return data[at], out, doc[owner], origin


def _dealt(docs, k, window, buckets):
    """Runs of all texts dealt by anchor, rows (bucket, anchors, bodies, docs, starts, sizes), and repeats found on the way (gone)."""
    names = ["bucket", "anchors", "bodies", "docs", "starts", "sizes", "gone"]

    def flush(parts):
        doc, start, size, anchor, body = (np.concatenate(x) for x in zip(*parts))
        order, opens, repeat = _first_of_class(anchor, body, doc, start)
        gone, keep = order[repeat], order[opens]
        doc_, start_, size_ = doc[gone], start[gone], size[gone]
        if len(gone):
            cols = [b"", b"", _zip(doc_), _zip(start_), _zip(size_)]
            yield [int(anchor[gone[0]] % np.uint64(buckets)), *cols, len(gone)]
        bucket = (anchor[keep] % np.uint64(buckets)).astype(np.int32)
        by_place = np.lexsort((start[keep], doc[keep], bucket))
        keep, bucket = keep[by_place], bucket[by_place]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            i = keep[cut[b] : cut[b + 1]]
            if len(i):
                yield [b, anchor[i].tobytes(), body[i].tobytes(), _zip(np.diff(doc[i], prepend=0)), _zip(start[i].astype(np.int64)), _zip(size[i]), 0]

    def rows(made):
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64()]
        made = list(made)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "_t", HASH_BYTES):
                data, offs, doc, origin = _pieces(part)
                piece, start, size, anchor, body = runs(data, offs, k, window)
                if len(piece):
                    parts.append((doc[piece], start - offs[piece] + origin[piece], size, anchor, body))
                    held += len(piece)
                if held >= RUNS:
                    yield from rows(flush(parts))
                    parts, held = [], 0
        if parts:
            yield from rows(flush(parts))

    return docs.mapInArrow(tidy(run), "bucket int, anchors binary, bodies binary, docs binary, starts binary, sizes binary, gone long")


def _sorted_out(group):
    """Rows (kind, doc, start, size, anchor): kind 0 windows to remove, 1 runs to sort, 2 runs of a large anchor.
    ``start`` is in bytes, ``size`` in windows."""
    kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["kind", "doc", "start", "size", "anchor"]

    def rows(kind, doc, start, size, anchor):
        for a in range(0, len(doc), 200_000):
            cols = [np.full(len(doc), kind, np.int8), doc, start, size, anchor.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000], t) for c, t in zip(cols, kinds)], names=names)

    def run(batches):
        parts = []
        for batch in batches:
            for anchors, bodies, docs, starts, sizes, gone in zip(*(batch.column(c).to_pylist() for c in ("anchors", "bodies", "docs", "starts", "sizes", "gone"))):
                n = gone or len(anchors) // 8
                doc, start, size = (_unzip(x, n, np.int64) for x in (docs, starts, sizes))
                if gone:
                    yield from rows(0, doc, start, size, np.zeros(n, np.uint64))
                else:
                    parts.append((np.cumsum(doc), start, size, np.frombuffer(anchors, np.uint64), np.frombuffer(bodies, np.uint64)))
        if not parts:
            return
        doc, start, size, anchor, body = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(anchor)
        same = anchor[order][1:] == anchor[order][:-1]
        order = order[np.r_[same, False] | np.r_[False, same]]
        if not len(order):
            return
        doc, start, size, anchor, body = (x[order] for x in (doc, start, size, anchor, body))
        order, opens, repeat = _first_of_class(anchor, body, doc, start)
        gone = order[repeat]
        yield from rows(0, doc[gone], start[gone], size[gone], anchor[gone])
        first = order[opens]
        edge = np.flatnonzero(np.r_[True, anchor[first][1:] != anchor[first][:-1]])
        many = np.repeat(np.diff(np.r_[edge, len(first)]), np.diff(np.r_[edge, len(first)]))
        for kind, mine in ((1, (many > 1) & (many <= group)), (2, many > group)):
            i = first[mine]
            yield from rows(kind, doc[i], start[i], size[i], anchor[i])

    return run


def _with_ranges(docs, wanted, window):
    """Texts with the byte ranges of the wanted runs, as ``ranges`` (start, size, anchor)."""
    ranges = wanted.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("size") + (window - 1)).alias("size"), "anchor"))).alias("ranges"))
    return docs.join(ranges, F.col("_k") == F.col("doc")).select("_k", "_t", "ranges")


def _collections(docs, wanted, window):
    """Windows to remove among the wanted runs (kind 1): their bytes dealt by anchor, each collection's transform built in one task."""
    total = wanted.agg(F.sum(F.col("size") + (window - 1))).first()[0] or 0
    buckets = max(1, -(-total // COLLECTION_BYTES))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                data, offs, doc, origin = _pieces(part)
                anchor = part.column("ranges").flatten().field("anchor").to_numpy(zero_copy_only=False).astype(np.int64)
                bucket = (mix(anchor.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else [0]
                out = []
                for a, b in zip(edge, edge[1:]):
                    i = order[a:b]
                    size = np.diff(offs)[i]
                    begin = np.cumsum(size) - size
                    at = np.arange(size.sum()) - np.repeat(begin - offs[i], size)
                    out.append([int(bucket[i[0]]), len(i), _zip(np.diff(doc[i], prepend=0)), _zip(origin[i]), _zip(size), len(at), _zip(data[at])])
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "n", "docs", "starts", "sizes", "bytes", "body"])

    def sort(batches):
        held = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["bucket"], []).append(row)
        for rows in held.values():
            doc = np.concatenate([np.cumsum(_unzip(r["docs"], r["n"], np.int64)) for r in rows])
            start = np.concatenate([_unzip(r["starts"], r["n"], np.int64) for r in rows])
            size = np.concatenate([_unzip(r["sizes"], r["n"], np.int64) for r in rows])
            data = np.concatenate([_unzip(r["body"], r["bytes"], np.uint8) for r in rows])
            offs = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=offs[1:])
            text, offset, which = repeated_windows(data, offs, window)
            place = start[text] + offset
            order = np.lexsort((place, doc[text], which))
            head = np.r_[True, which[order][1:] != which[order][:-1]] if len(order) else np.zeros(0, bool)
            head = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else head
            other = (doc[text][order] != doc[text][order][head]) | (place[order] != place[order][head])
            gone = order[other]
            by_place = np.lexsort((place[gone], doc[text[gone]]))
            d, p = doc[text[gone]][by_place], place[gone][by_place]
            if len(d):
                opens = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
                yield pa.RecordBatch.from_arrays([pa.array(d[opens]), pa.array(p[opens]), pa.array(np.diff(np.r_[opens, len(d)]))], names=["doc", "start", "size"])

    dealt = _with_ranges(docs, wanted, window).mapInArrow(tidy(cut), "bucket int, n long, docs binary, starts binary, sizes binary, bytes long, body binary")
    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(sort), "doc long, start long, size long")


def repeated_ranges(df, key="doc_id", text="text", window=WINDOW, levels=LEVELS, group=GROUP):
    """Rows (doc, start, size): ``size`` windows from byte ``start`` on that repeat earlier ones. Ranges may overlap."""
    docs = df.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").cast("binary").alias("_t")).where(F.col("_k").isNotNull())
    todo, found = docs, []
    levels = [k for k in levels if k < window] + [window]
    total = docs.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    for i, k in enumerate(levels):
        buckets = max(8, -(-2 * total // (window - k + 2) // RUNS_PER_BUCKET))
        dealt = _dealt(todo, k, window, buckets).repartitionById(buckets, F.col("bucket"))
        limit = group if i < len(levels) - 1 else 1 << 62
        out = cut_lineage(dealt.mapInArrow(tidy(_sorted_out(limit)), "kind byte, doc long, start long, size long, anchor long"))
        found.append(out.where("kind = 0").select("doc", "start", "size"))
        some = out.where("kind = 1")
        if not some.isEmpty():
            found.append(_collections(docs, some, window))
        large = out.where("kind = 2")
        if large.isEmpty():
            break
        total = large.agg(F.sum(F.col("size") + (window - 1))).first()[0]
        todo = _with_ranges(docs, large, window)
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.unionByName(more)
    return ranges


def remove(df, key="doc_id", text="text", window=WINDOW, carry=(), as_text=False, **options):
    """Rows (key, carried columns, n_bytes, n_removed, n_spans, kept_sha256, kept), one per row of ``df``: length, bytes and
    maximal spans removed, and what is left. That is binary, as a cut may part a character; ``as_text`` gives it as a string
    without the parts of such characters."""
    ranges = repeated_ranges(df, key, text, window, **options).groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))
    rows = df.select(F.col(key).alias("_k"), F.col(text).cast("string").cast("binary").alias("_t"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    rows = rows.join(ranges, F.col("_k").cast("long") == F.col("doc"), "left").drop("doc")
    types = dict(rows.dtypes)
    held = [f"_c{i}" for i in range(len(carry))]
    names = ["_k", *held, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = ", ".join(f"{c} {types[c]}" for c in ["_k", *held]) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + ("string" if as_text else "binary")

    def cut(data, start, size):
        if not len(start):
            return 0, 0, data
        order = np.argsort(start, kind="stable")
        lo, hi = start[order], np.minimum(start[order] + size[order] + window - 1, len(data))
        hi = np.maximum.accumulate(hi)
        opens = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
        lo, hi = lo[opens], hi[np.r_[opens[1:] - 1, len(hi) - 1]]
        flags = np.zeros(len(data) + 1, np.int8)
        flags[lo] = 1
        flags[hi] -= 1
        keep = np.cumsum(flags[:-1]) == 0
        return len(data) - int(keep.sum()), len(lo), data[keep]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                data, offs = flat(part.column("_t"))
                lists = part.column("ranges")
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                inner = lists.flatten()
                starts, sizes = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size"))
                at = np.r_[0, np.cumsum(counts)].tolist()
                made = [cut(data[a:b], starts[i:j], sizes[i:j]) for a, b, i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), at, at[1:])]
                kept = [np.ascontiguousarray(x[2]).tobytes() for x in made]
                columns = [pa.array(np.diff(offs)), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.int64()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                           pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("_k"), *(part.column(c) for c in held), *columns], names=names)

    out = rows.mapInArrow(tidy(run), schema).withColumnRenamed("_k", key)
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"_c{i}", c)
    return out
