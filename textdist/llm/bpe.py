"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regex. Every code point of a slice of texts becomes a symbol (its class, with
what a look-ahead of two needs to know); each symbol is a transition function between the states of a small
automaton. Functions compose associatively, so the slice is cut into blocks whose compositions
are found side by side; a scan over the blocks' functions then gives each block its entry state, and a second pass over
the blocks marks the starts. A text end is a constant function: nothing crosses texts. The slices of bytes between starts are counted as distinct
pieces; each is merged once by rank and kept in a bounded cache. Ids keep their bounds per text and
their byte offsets, from which texts decode.

Edges: null and empty texts have no tokens. Special tokens are ordinary text. A piece of any length is merged
with a heap, so a very long run of letters costs n log n. Rows keep their keys, repeated and null keys included.
"""

import base64
import functools
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textdist.llm.bytesbatch import flat, slices, tidy
from textdist.llm.quality import ragged

CACHE_PIECES = 400_000
#: bytes of text worked at once; arrays over them take several times as much
TEXT_BYTES = 1 << 20
BLOCK = 256

# Code point classes. White space is the 25 code points of the Unicode property (fixed values).
WHITE_SPACE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, WHITE, END = range(5)

# Symbols of the automaton: a class, refined by what follows.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_SPACE_BEFORE, S_WHITE_BEFORE, S_WHITE, S_END = range(9)
# States: what the last code point was.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, PREFIX, TAIL1, TAIL2 = range(8)


def step(state, symbol):
    """Next state, and whether a token starts at this code point.

    A contraction (quote and one or two letters, S_QUOTE1 and S_QUOTE2) counts only where a token starts at its quote,
    that is neither after a lone space nor inside a run of other signs. TAIL2 has two letters to go, TAIL1 one.
    S_SPACE_BEFORE is a space, S_WHITE_BEFORE other white space, that a visible sign follows: the first joins the token after it,
    both are parted from the white space before them."""
    if symbol == S_END:
        return FRESH, False
    if state == TAIL2:
        return TAIL1, False
    if state == TAIL1:
        return FRESH, False
    if symbol in (S_QUOTE1, S_QUOTE2):
        if state in (IN_OTHER, PREFIX):
            return IN_OTHER, False
        return (TAIL1 if symbol == S_QUOTE1 else TAIL2), True
    if symbol == S_SPACE_BEFORE:
        return PREFIX, True
    if symbol == S_WHITE_BEFORE:
        return FRESH, True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER}[symbol]
    return run, state not in (run, PREFIX)


@functools.cache
def automaton():
    """(starts[state, symbol], next[state, symbol], function of each symbol, composition table, functions).

    The functions are the closure of the symbols' under composition; ``compose[f, g]`` is f, then g."""
    nxt = np.array([[step(q, s)[0] for s in range(9)] for q in range(8)], np.uint8)
    starts = np.array([[step(q, s)[1] for s in range(9)] for q in range(8)])
    functions, seen = [], {}

    def number(f):
        if f not in seen:
            seen[f] = len(functions)
            functions.append(f)
        return seen[f]

    of_symbol = [number(tuple(nxt[:, s].tolist())) for s in range(9)]
    done = 0
    while done < len(functions):
        for s in range(9):
            number(tuple(int(nxt[q, s]) for q in functions[done]))
        done += 1
    table = np.array(functions, np.uint8)
    compose = np.array([[seen[tuple(g[list(f)].tolist())] for g in table] for f in functions], np.uint16)
    return starts, nxt, np.array(of_symbol, np.uint16), compose, table


@functools.cache
def classes():
    """Class of every code point by the Unicode tables of the tiktoken library, whose tokens are to be met: a
    vocabulary of single bytes and a pattern of one class give back the code points of that class."""
    import tiktoken

    out = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = bytes(tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode("utf-8").encode("utf-32-le"), np.uint32)] = kind
    out[WHITE_SPACE] = WHITE
    out[0x110000] = END
    return out


def symbols(points):
    """Symbol of every code point; 0x110000 stands for a text end."""
    kind = classes()[points]
    pad = np.full(2, 0x110000, np.uint32)
    one = np.r_[points[1:], pad[:1]]
    after = np.r_[kind[1:], np.uint8(END)]
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_END], np.uint8)[kind]
    visible = (kind == WHITE) & (after < WHITE)
    out[visible] = S_WHITE_BEFORE
    out[visible & (points == 0x20)] = S_SPACE_BEFORE
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        a, b = one[quote], np.r_[points, pad][quote + 2]
        s, t, r, e, v, m, l, d = (ord(c) for c in "strevmld")
        out[quote[(a == s) | (a == t) | (a == m) | (a == d)]] = S_QUOTE1
        out[quote[((a == r) & (b == e)) | ((a == v) & (b == e)) | ((a == l) & (b == l))]] = S_QUOTE2
    return out


def token_starts(points):
    """Positions at which tokens start, by composing transition functions (see the module's text)."""
    starts, nxt, of_symbol, compose, table = automaton()
    sym = symbols(points)
    n = len(sym)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, S_END, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    whole = of_symbol[grid[0]]
    for row in grid[1:]:
        whole = compose[whole, of_symbol[row]]
    reach = 1
    while reach < blocks:  # inclusive scan over the blocks
        whole = np.r_[whole[:reach], compose[whole[:-reach], whole[reach:]]]
        reach *= 2
    state = np.full(blocks, FRESH, np.uint8)
    state[1:] = table[whole[:-1], FRESH]
    flags = np.empty(grid.shape, bool)
    for row, out in zip(grid, flags):
        out[:] = starts[state, row]
        state = nxt[state, row]
    return np.flatnonzero(flags.T.reshape(-1)[:n])


NONE = 1 << 40
LONG_PIECE = 200


class Merges:
    """Rank of every pair of tokens whose bytes together are a token, as a sorted table."""

    def __init__(self, ranks):
        keys = [(ranks[w[:i]] << 32 | ranks[w[i:]], rank) for w, rank in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        keys.sort()
        self.keys, self.ranks = np.array(keys, np.int64).reshape(-1, 2).T.copy()
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left, right):
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merged_together(pieces, merges):
    """Ids of many pieces in a row, and their sizes. Each round merges in every piece the pair of least
    rank, the leftmost of equals; a piece without such a pair leaves."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    token = merges.single[np.frombuffer(b"".join(pieces), np.uint8)]
    piece, start = np.arange(len(pieces)), np.cumsum(size) - size
    rank = np.full(len(token), NONE)
    rank[:-1] = merges.rank(token[:-1], token[1:])
    rank[start + size - 1] = NONE
    done = []
    while len(piece):
        least = np.minimum.reduceat(rank, start)
        open_ = least < NONE
        if not open_.all():
            mine = np.repeat(open_, size)
            done.append((np.repeat(piece[~open_], size[~open_]), token[~mine]))
            token, rank, piece, size, least = token[mine], rank[mine], piece[open_], size[open_], least[open_]
            start = np.cumsum(size) - size
            if not len(piece):
                break
        own = np.repeat(np.arange(len(piece)), size)
        at = np.flatnonzero(rank == least[own])
        at = at[np.r_[True, own[at[1:]] != own[at[:-1]]]]
        token[at] = least
        keep = np.ones(len(token), bool)
        keep[at + 1] = False
        token, rank = token[keep], rank[keep]
        number = np.arange(len(piece))
        at -= number
        start -= number
        size -= 1
        rank[at] = NONE
        right = at < start + size - 1
        rank[at[right]] = merges.rank(token[at[right]], token[at[right] + 1])
        left = at[at > start]
        rank[left - 1] = merges.rank(token[left - 1], token[left])
    which = np.concatenate([x for x, _ in done])
    return np.concatenate([x for _, x in done])[np.argsort(which, kind="stable")].astype(np.uint32), np.bincount(which, minlength=len(pieces))


def merged_long(piece, ranks):
    """Ids of one long piece, by a heap of pairs."""
    n = len(piece)
    right = list(range(1, n + 1))  # end of the part that starts here; 0: merged away
    left = list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = right[i]
        if not j or j >= n or right[j] != end:
            continue
        right[i], right[j] = end, 0
        if end < n:
            left[end] = i
        for k in (i, left[i]):
            if k >= 0 and right[k] < n:
                rank = ranks.get(piece[k : right[right[k]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, right[right[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


@functools.lru_cache(2)
def codec_of(path):
    """One per worker and vocabulary, read once; a task forgets the pieces it merged."""
    return Codec(path)


class Codec:
    def __init__(self, path):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, i in self.ranks.items():
            words[i] = word
        self.words = pa.array(words, pa.large_binary())
        self.lengths = np.fromiter(map(len, words), np.int64, size)
        self.merges = Merges(self.ranks)
        self.forget()

    def forget(self):
        self.known, self.ids, self.bounds = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def rows(self, pieces):
        if len(self.known) > CACHE_PIECES:
            self.forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            short = [p for p in new if len(p) <= LONG_PIECE and p not in self.ranks]
            if short:
                self.keep(short, *merged_together(short, self.merges))
            other = [p for p in new if p not in self.known]
            if other:
                made = [[self.ranks[p]] if p in self.ranks else merged_long(p, self.ranks) for p in other]
                sizes = np.fromiter(map(len, made), np.int64, len(made))
                self.keep(other, np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def keep(self, pieces, ids, sizes):
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def encode(self, data, offs):
        """Ids of all texts in a row, and each text's bounds in them."""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        text_of = np.searchsorted(at, offs)  # code point offset of each text
        ends = text_of[1:]
        # a text end after every text: code point i of text k moves to i + k
        apart = np.insert(points, ends, 0x110000)
        found = token_starts(apart)
        text = np.searchsorted(ends + np.arange(len(ends)), found)
        found = at[found - text] if len(at) else found
        bounds = np.r_[found, len(data)].astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        rows = self.rows(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        where, token_bounds = ragged(self.bounds, rows)
        return self.ids[where], token_bounds[np.searchsorted(found, offs)]

    def decode(self, ids, bounds):
        """Bytes of all texts in a row, and each text's byte offsets."""
        body = self.words.take(pa.array(ids)).buffers()[2]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=ends[1:])
        return (np.frombuffer(body, np.uint8)[: ends[-1]] if body is not None and len(ids) else np.zeros(0, np.uint8)), ends[bounds]

    def offsets(self, ids, bounds):
        """Byte offset of each token in its own text."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        base = np.r_[starts, ends[-1:] if len(ends) else [0]][bounds[:-1]]
        return starts - np.repeat(base, np.diff(bounds))


def _typed(df, key):
    return dict(df.dtypes)[key]


def encode(df, path, key="doc_id", text="text"):
    """Rows (key, ids array<int>, offsets array<int>): token ids and the byte offset of each in its text."""
    rows = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for part in slices(batch, "_t", TEXT_BYTES):
                ids, bounds = codec.encode(*flat(part.column("_t")))
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, codec.offsets(ids, bounds))]
                yield pa.RecordBatch.from_arrays([part.column("_k"), *lists], names=["_k", "ids", "offsets"])
        codec.forget()

    return rows.mapInArrow(tidy(run), f"_k {_typed(df, key)}, ids array<int>, offsets array<int>").withColumnRenamed("_k", key)


def decode(df, path, key="doc_id", ids="ids"):
    """Rows (key, bytes binary) from arrays of ids; null has no ids."""
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("_i"))

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            lists = batch.column("_i")
            bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            body, offs = codec.decode(lists.flatten().to_numpy().astype(np.uint32), bounds)
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(body))])
            yield pa.RecordBatch.from_arrays([batch.column("_k"), out.cast(pa.binary())], names=["_k", "bytes"])

    return rows.mapInArrow(tidy(run), f"_k {_typed(df, key)}, bytes binary").withColumnRenamed("_k", key)


def round_trip(df, path, key="doc_id", text="text"):
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): digests of the ids (little-endian, 32 bits each) and of
    the bytes decoded from them, without the ids leaving the task."""
    rows = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for part in slices(batch, "_t", TEXT_BYTES):
                ids, bounds = codec.encode(*flat(part.column("_t")))
                body, offs = codec.decode(ids, bounds)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4")))
                body = memoryview(np.ascontiguousarray(body))
                own = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                back = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("_k"), pa.array(np.diff(bounds)), pa.array(own), pa.array(back)], names=["_k", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    return rows.mapInArrow(tidy(run), f"_k {_typed(df, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_k", key)
