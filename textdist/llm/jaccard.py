"""N-gram Jaccard join by prefix trees.

Every text is the set of its distinct word shingles, in one global order: frequent shingles last, else by hash. Two
sets that link at threshold t share one of their first n - ceil(t n) + 1 shingles, so these heads alone are
dealt by shingle. A pair is kept only if the overlap of its heads and what remains of the longer rest can still reach the overlap
a link needs, and then only if 16 bits of every shingle of both overlap enough. Sets of kept pairs meet in groups around the pair's smaller id and are joined there by a
trie: sets that start alike share nodes and their partial overlaps, and a subtree is left as soon as its overlap
so far and the remaining lengths cannot reach a link.

What keeps hot groups whole and bounded:
* Equal sets are one class (a partial aggregate); only its least id is compared.
* Frequent shingles are counted over all texts; the list that orders the sets is kept to ``MOST_FREQUENT`` by raising its threshold.
* Near copies are linked first, around the least id that shares one of a few minima, in chunks of at most
  ``CHUNK`` sets, and around the best linked sets found so; shingle groups then only give pairs between components, so a large group of near copies costs no pairs.

The result is exact up to 64-bit hash collisions: links are found between all different sets, and components over all links.

Edges: null, empty and blank texts have an empty set and link with nothing. Ids are integers; a row with a null
id has its size and a null component. Rows of one id are one document to links, each keeps its row. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textdist.llm.bytesbatch import flat, mix, slices, tidy
from textdist.llm.components import components
from textdist.llm.shingles import shingle_sets
from textdist.session import cut_lineage

#: texts that share a frequent shingle, at least; how many such shingles the tasks hold at most
LEAST_FREQUENT, MOST_FREQUENT = 16, 2_000_000
MINIMA = 3
HUBS = 2
#: bytes of text whose sets are worked out at once
SMALL = 1 << 20
CHUNK = 512
HEADS_PER_BUCKET = 400_000
BROADCAST_IDS, BROADCAST_PAIRS = 1_000_000, 500_000
SALTS = mix(np.arange(1, MINIMA + 3))


def _needed(n, num, den):
    """Least overlap of a link of a set of n with any other: ceil(t n)."""
    return (num * n + den - 1) // den


def _sets(part, size):
    """Shingle sets of a slice, worked out in smaller slices."""
    return [s for small in slices(part, "_t", SMALL) for s in shingle_sets(*flat(small.column("_t")), size)]


def _reduced(sets, salts, by):
    """``by`` over the salted shingles of each set, a list per salt; 0 for an empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(salts), len(sets)), np.int64)
    if len(full):
        every, first = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        for row, salt in zip(out, salts):
            row[full] = by.reduceat(mix(every ^ salt), first).view(np.int64)
    return out.tolist()


def _signed(part, size):
    """Shingle sets of a slice and their signatures, worked out in smaller slices."""
    sets, signs = [], []
    for small in slices(part, "_t", SMALL):
        made = shingle_sets(*flat(small.column("_t")), size)
        sets += made
        signs += zip(*_reduced(made, SALTS[-2:], np.add))
    return sets, signs


def _described(docs, size):
    """A row per text: (doc, n, s1, s2, minima)."""
    names = ["doc", "n", "s1", "s2", "minima"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t", SMALL):
                sets = _sets(part, size)
                least = _reduced(sets, SALTS[:MINIMA], np.minimum)
                minima = [[x[i] for x in least] if len(s) else None for i, s in enumerate(sets)]
                made = [[len(s) for s in sets], *_reduced(sets, SALTS[-2:], np.add)]
                yield pa.RecordBatch.from_arrays([part.column("_k"), *(pa.array(x, pa.int64()) for x in made), pa.array(minima, pa.list_(pa.int64()))], names=names)

    return docs.mapInArrow(tidy(run), "doc long, n long, s1 long, s2 long, minima array<long>")


def _zip(x):
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(x, n, kind):
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _steps(x):
    """Numbers in order, packed as steps by byte planes: the high ones are nearly all zero."""
    return _zip(np.diff(x, prepend=x[:1] * 0).view(np.uint8).reshape(-1, x.itemsize).T)


def _of_steps(x, n, kind):
    planes = _unzip(x, n * np.dtype(kind).itemsize, np.uint8).reshape(-1, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _frequent(docs, size, parts):
    """Rows (prefix, df): leading 32 bits of shingles that ``LEAST_FREQUENT`` or more texts share.

    Only an order comes of this, so prefixes stand for shingles and equal sets of a task count once."""
    width = -(-(1 << 32) // parts)

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "_t", 8 << 20):
                low = []
                for s, sign in zip(*_signed(part, size)):
                    if len(s) and sign not in seen:
                        seen.add(sign)
                        low.append((s >> np.uint64(32)).astype(np.uint32))
                low = np.sort(np.concatenate(low)) if low else np.zeros(0, np.uint32)
                cut = np.searchsorted(low, np.minimum(np.arange(parts + 1) * width, (1 << 32) - 1))
                some = [i for i in range(parts) if cut[i + 1] > cut[i]]
                held = [low[cut[i] : cut[i + 1]] for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([len(x) for x in held], pa.int64()), pa.array([_steps(x) for x in held], pa.binary())],
                                                 names=["part", "n", "prefixes"])

    def count(batches):
        held = [_of_steps(x, n, np.uint32) for batch in batches for x, n in zip(batch.column("prefixes").to_pylist(), batch.column("n").to_pylist())]
        if held:
            prefix, df = np.unique(np.concatenate(held), return_counts=True)
            often = df >= LEAST_FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(prefix[often].astype(np.int64)), pa.array(df[often].astype(np.int64))], names=["prefix", "df"])

    return docs.mapInArrow(tidy(run), "part int, n long, prefixes binary").repartitionById(parts, F.col("part")).mapInArrow(tidy(count), "prefix long, df long")


def _most_frequent(rows):
    """Sorted prefixes of the frequent shingles: all, or those at least as frequent as leaves ``MOST_FREQUENT``."""
    rows = cut_lineage(rows)
    classes = rows.groupBy(F.floor(F.log2("df")).alias("c")).count().orderBy(F.desc("c")).collect()  # at most 64
    least, held = 1 << 62, 0
    for c, n in classes:
        held += n
        if held > MOST_FREQUENT:
            break
        least = 1 << c
    return np.sort(rows.where(F.col("df") >= least).select("prefix").toPandas()["prefix"].to_numpy(np.uint32))


def _heads(docs, frequent, buckets, size, num, den):
    """Heads of all sets, dealt by shingle: rows (bucket, tokens, docs, sizes, places), one per slice and bucket; a place is
    a shingle's position in its ordered set.

    A slice gives equal sets once, under their least id there, so the least id of a whole class always has its head."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often = shared.value
        for batch in batches:
            for part in slices(batch, "_t", 8 << 20):
                ids, seen, tokens, own, ns, places = part.column("_k").to_pylist(), set(), [], [], [], []
                for k, s, sign in sorted(((k, s, x) for k, s, x in zip(ids, *_signed(part, size)) if k is not None), key=lambda x: x[0]):
                    n = len(s)
                    if not n or sign in seen:
                        continue
                    seen.add(sign)
                    if len(often):
                        prefix = (s >> np.uint64(32)).astype(np.uint32)
                        hot = often[np.minimum(np.searchsorted(often, prefix), len(often) - 1)] == prefix
                        s = np.concatenate([s[~hot], s[hot]])
                    head = s[: n - _needed(n, num, den) + 1]
                    tokens.append(head)
                    own.append(np.full(len(head), k, np.int64))
                    ns.append(np.full(len(head), n, np.int32))
                    places.append(np.arange(len(head), dtype=np.int32))
                if not tokens:
                    continue
                tokens, own, ns, places = map(np.concatenate, (tokens, own, ns, places))
                bucket = (tokens % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = [b for b in range(buckets) if cut[b + 1] > cut[b]]
                at = [order[cut[b] : cut[b + 1]] for b in some]
                cols = [[tokens[i].tobytes() for i in at], [_zip(np.diff(own[i], prepend=0)) for i in at], [_zip(ns[i]) for i in at], [_zip(places[i]) for i in at]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "tokens", "docs", "sizes", "places"])

    return docs.mapInArrow(tidy(run), "bucket int, tokens binary, docs binary, sizes binary, places binary")


def _shared_heads(batches):
    """Entries (token, doc, n, place) of shingles in the heads of two or more ids."""
    tokens, own, ns, places = [], [], [], []
    for batch in batches:
        for t, d, n, p in zip(*(batch.column(c).to_pylist() for c in ("tokens", "docs", "sizes", "places"))):
            tokens.append(np.frombuffer(t, np.uint64))
            own.append(np.cumsum(_unzip(d, len(tokens[-1]), np.int64)))
            ns.append(_unzip(n, len(tokens[-1]), np.int32))
            places.append(_unzip(p, len(tokens[-1]), np.int32))
    if not tokens:
        return
    tokens = np.concatenate(tokens)
    order = np.argsort(tokens)
    tokens = tokens[order]
    same = tokens[1:] == tokens[:-1]
    keep = np.zeros(len(tokens), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order, tokens = order[keep], tokens[keep]
    own, ns, places = (np.concatenate(v)[order] for v in (own, ns, places))
    for a in range(0, len(tokens), 100_000):
        b = a + 100_000
        yield pa.RecordBatch.from_arrays([pa.array(tokens[a:b].view(np.int64)), pa.array(own[a:b]), pa.array(ns[a:b].astype(np.int64)),
                                          pa.array(places[a:b].astype(np.int64))], names=["token", "doc", "n", "p"])


class Trie:
    """Path-compressed trie over sorted sequences: node i holds tokens[start[i]:end[i]] below parent[i].

    ``least`` and ``most`` are the shortest and longest set that ends in a node's subtree, ``depth`` the tokens to its end."""

    def __init__(self, seqs):
        self.order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u8").tobytes())
        self.start, self.end, self.parent, self.depth, self.leaf, runs = [], [], [], [], [], []
        path, total, previous = [], 0, None  # path: (node, depth at its end)
        for i in self.order:
            s = seqs[i]
            common = 0
            if previous is not None:
                m = min(len(s), len(previous))
                differ = np.flatnonzero(s[:m] != previous[:m])
                common = int(differ[0]) if len(differ) else m
            last = None
            while path and path[-1][1] > common:
                last = path.pop()
            above = path[-1][1] if path else 0
            if last is not None and above < common:  # split the node at ``common``
                node = last[0]
                cut = self.start[node] + common - above
                upper = self.add(self.start[node], cut, self.parent[node], common)
                self.start[node], self.parent[node] = cut, upper
                path.append((upper, common))
            top = path[-1][0] if path else -1
            node = self.add(total, total + len(s) - common, top, len(s))
            runs.append(s[common:])
            total += len(s) - common
            path.append((node, len(s)))
            self.leaf.append(node)
            previous = s
        self.tokens = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        for name in ("start", "end", "parent", "depth", "leaf"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        n = len(self.start)
        self.least, self.most = np.full(n, 1 << 60), np.zeros(n, np.int64)
        sizes = np.array([len(seqs[i]) for i in self.order], np.int64)
        at, own = self.leaf.copy(), sizes
        while len(at):
            np.minimum.at(self.least, at, own)
            np.maximum.at(self.most, at, own)
            up = self.parent[at]
            at, own = up[up >= 0], own[up >= 0]
        level = np.zeros(n, np.int64)
        at = np.arange(n)
        up = self.parent.copy()
        while (up >= 0).any():
            level[up >= 0] += 1
            up = np.where(up >= 0, self.parent[up], -1)
        self.levels = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1)] if n else []
        self.at_leaf = np.full(n, -1, np.int64)
        self.at_leaf[self.leaf] = np.arange(len(self.order))

    def add(self, start, end, parent, depth):
        for x, v in ((self.start, start), (self.end, end), (self.parent, parent), (self.depth, depth)):
            x.append(v)
        return len(self.start) - 1

    def partners(self, query, inside, num, den):
        """Places in ``order`` of the sets that link with ``query``; ``inside`` marks its tokens among ``self.tokens``."""
        q = len(query)
        overlap, alive, found = np.zeros(len(self.start), np.int64), np.ones(len(self.start) + 1, bool), []
        cum = np.r_[0, np.cumsum(inside)]
        for nodes in self.levels:
            up = self.parent[nodes]
            nodes, up = nodes[alive[up]], up[alive[up]]
            have = np.where(up >= 0, overlap[up], 0) + cum[self.end[nodes]] - cum[self.start[nodes]]
            overlap[nodes] = have
            # the most a set below can share, and the least a link needs: den I >= num (q + m - I)
            best = have + np.minimum(q - have, self.most[nodes] - self.depth[nodes])
            good = ((den + num) * best >= num * (q + self.least[nodes])) & (den * self.most[nodes] >= num * q) & (num * self.least[nodes] <= den * q)
            alive[nodes] = good
            ends = nodes[good & (self.at_leaf[nodes] >= 0)]
            if len(ends):
                m = self.depth[ends]
                found.append(self.at_leaf[ends[(den + num) * overlap[ends] >= num * (q + m)]])
            dead = nodes[~good]
            alive[dead] = False
            if not good.any():
                break
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def joined(ids, seqs, num, den, queries=None):
    """Links among the sets that connect all that link: at most one fewer than sets. With ``queries`` (places in
    ``ids``), only the links of these are looked for."""
    trie = Trie(seqs)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    order = np.argsort(trie.tokens)
    ordered = trie.tokens[order]
    mark = np.zeros(len(ordered), np.int64)
    for i in range(len(seqs)) if queries is None else queries:
        s = seqs[i]
        lo, hi = np.searchsorted(ordered, s), np.searchsorted(ordered, s, "right")
        mark[:] = 0
        np.add.at(mark, lo[lo < len(mark)], 1)
        np.subtract.at(mark, hi[hi < len(mark)], 1)
        inside = np.zeros(len(order), np.int64)
        inside[order] = np.cumsum(mark)
        for j in trie.partners(s, inside, num, den).tolist():
            j = trie.order[j]
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


def _sent(docs, pairs, size, form):
    """Sets of ``pairs`` (a, b) brought together, groups of rows (a, chunk, doc, n, tokens): a's set and at most about ``CHUNK`` others.
    ``form`` gives the bytes a set moves as."""
    ids = pairs.select(F.col("a").alias("_i")).union(pairs.select("b")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids) if few else ids, F.col("_k") == F.col("_i"), "left_semi")

    def sets(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                made = _sets(part, size)
                yield pa.RecordBatch.from_arrays([part.column("_k"), pa.array([len(s) for s in made], pa.int64()), pa.array([form(s) for s in made], pa.binary())],
                                                 names=["doc", "n", "tokens"])

    some = some.mapInArrow(tidy(sets), "doc long, n long, tokens binary")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    routes = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("doc"))
    routes = routes.unionByName(chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("doc")))
    # sets are not moved to meet few routes
    routes = F.broadcast(routes) if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else routes
    return some.join(routes, "doc").select("a", "chunk", "doc", "n", "tokens").groupBy("a", "chunk")


def _marks(s):
    """16 bits of each shingle of a set."""
    return _steps(np.sort(s.astype(np.uint16)))


def _possible(docs, pairs, size, num, den):
    """The ``pairs`` whose marks overlap enough for a link. Equal shingles have equal marks, so with repeats counted marks overlap no less
    than the sets, and no pair that links is lost; they move in about a byte for each shingle, where a set takes eight."""
    pairs = cut_lineage(pairs)

    def meet(table):
        lead, found = table.column("a")[0].as_py(), set()
        rows = [(d, n, _of_steps(x, n, np.uint16).astype(np.int64)) for d, n, x in zip(*(table.column(c).to_pylist() for c in ("doc", "n", "tokens"))) if n]
        around = [(n, np.bincount(marks, minlength=1 << 16)) for d, n, marks in rows if d == lead]
        for d, m, marks in rows:
            if d != lead:
                first = np.flatnonzero(np.diff(marks, prepend=-1))
                at, times = marks[first], np.diff(first, append=m)
                if any((den + num) * int(np.minimum(held[at], times).sum()) >= num * (n + m) for n, held in around):
                    found.add(d)
        return pa.table({"a": pa.array([lead] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return _sent(docs, pairs, size, _marks).applyInArrow(meet, "a long, b long")


def _links(docs, pairs, size, num, den, among):
    """Links found around the first ids of ``pairs`` (a, b), a < b: those of all pairs, or links that connect as much. With ``among``,
    links between the other sets of a chunk are looked for too."""
    pairs = cut_lineage(pairs)

    def join(table):
        ids, tokens = table.column("doc").to_pylist(), table.column("tokens").to_pylist()
        once = {i: np.frombuffer(t, np.uint64) for i, t in sorted(zip(ids, tokens)) if len(t)}
        lead = table.column("a")[0].as_py()
        links = joined(list(once), list(once.values()), num, den, None if among else [i for i, k in enumerate(once) if k == lead])
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return _sent(docs, pairs, size, lambda s: s.tobytes()).applyInArrow(join, "a long, b long")


def classes(df, key="doc_id", text="text", size=5, num=75, den=100):
    """Rows (key, n_shingles, class_id, component_id), one per row of ``df``: sizes, the least id with an equal set, and the
    least id that links reach. Sets link when den * overlap >= num * union."""
    docs = df.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t"))
    rows = cut_lineage(_described(docs, size))
    sets = rows.where("n > 0 AND doc IS NOT NULL")
    reps = cut_lineage(sets.groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"), F.first("minima").alias("minima")))
    total = reps.agg(F.sum("n")).first()[0] or 0
    frequent = _most_frequent(_frequent(docs, size, max(8, total // 1_000_000)))

    # near copies: around the least id of one of the minima
    keys = reps.select("rep", F.posexplode("minima").alias("k", "m"))
    lead = keys.groupBy("k", "m").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = keys.join(lead, ["k", "m"]).where("a < rep").groupBy(F.col("rep").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    links = cut_lineage(_links(docs, near, size, num, den, True))
    parts = components(links)

    # copies often link with their original and not with each other: around the set with most links so far that shares a minimum
    for _ in range(HUBS):
        degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        told = keys.join(degree, "rep").join(parts, F.col("rep") == F.col("v"))
        hub = told.groupBy("k", "m").agg(F.max(F.struct("links", F.col("rep").alias("a"), "c")).alias("h")).select("k", "m", "h.a", F.col("h.c").alias("ca"))
        near = keys.join(hub, ["k", "m"]).join(parts, F.col("rep") == F.col("v"), "left").where("a <> rep AND ca <> coalesce(c, rep)")
        near = near.select("a", F.col("rep").alias("b")).distinct()
        more = cut_lineage(_links(docs, near, size, num, den, False))
        if more.isEmpty():
            break
        links = cut_lineage(links.unionByName(more))
        parts = components(links)

    # everything else: pairs between components that share a head and can still reach a link
    buckets = max(8, -(-total * (den - num) // den // HEADS_PER_BUCKET))
    heads = _heads(docs, frequent, buckets, size, num, den).repartitionById(buckets, F.col("bucket"))
    heads = heads.mapInArrow(tidy(_shared_heads), "token long, doc long, n long, p long")
    heads = heads.join(reps.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").join(parts.withColumnRenamed("v", "doc"), "doc", "left")
    heads = cut_lineage(heads.select("token", "doc", "n", "p", F.coalesce("c", "doc").alias("c")))
    mixed = heads.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    heads = heads.join(mixed, "token", "left_semi")
    x, y = (heads.select("token", *[F.col(c).alias(c + s) for c in ("doc", "n", "p", "c")]) for s in "xy")
    # The first common shingle and all that follows it in the shorter rest must suffice. Later ones that fail this fall away,
    # so of a pair that links the first ``c`` common shingles stay, and the rests behind the last of them bound what else is common.
    needed = f"{num} * (nx + ny)"
    met = x.join(y, "token").where(f"docx < docy AND cx <> cy AND {den + num} * least(nx - px, ny - py) >= {needed}")
    met = met.groupBy(F.col("docx").alias("a"), F.col("docy").alias("b"), "nx", "ny").agg(
        F.count_distinct("token").alias("c"), F.max("px").alias("px"), F.max("py").alias("py"))
    pairs = met.where(f"{den + num} * (c + least(nx - px, ny - py) - 1) >= {needed}").select("a", "b").distinct()
    links = links.unionByName(_links(docs, _possible(docs, pairs, size, num, den), size, num, den, False))

    parts = components(links)
    found = reps.join(parts.withColumnRenamed("v", "rep"), "rep", "left").select("s1", "s2", "n", "rep", F.coalesce("c", "rep").alias("component"))
    own = rows.join(found, ["s1", "s2", "n"], "left")
    alone = F.col("doc").isNull() | F.col("rep").isNull()
    return own.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc")).otherwise(F.col("rep")).alias("class_id"), F.when(alone, F.col("doc")).otherwise(F.col("component")).alias("component_id"))
