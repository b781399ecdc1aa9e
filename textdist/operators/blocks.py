"""Exact distance joins over blocks of vectors.

Rows are placed in the cell of their nearest pivot. The triangle inequality then tells
which cells a row can matter to (Lu et al. 2012 describe this kind of pivot partition for
k-NN joins). Cells are dealt to a bounded number of groups; a row travels once to each group
with a cell it can matter to, and a group too large for a task is cut by a hash of the row, so a
task holds two bounded blocks. Nothing is approximated: bounds only skip pairs that
cannot change the result, and a pair whose matrix-product distance lies within rounding of
its threshold is recomputed by direct differences.

Each vector row is (vid, x, …) with ``x array<double>``. The numpy helpers run in Python
workers on one Arrow batch or one pair of blocks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from textdist.functions.vectors import row_norm

BLOCK_ROWS = 4096
MAX_PIVOTS = 1024
PIVOT_BYTES = 64 << 20
STRIP_CELLS = 4 << 20
#: groups of cells on either side of a distance join, and bytes of vectors of a group
GROUPS, GROUP_BYTES = 8, 64 << 20
# Relative error allowed for a squared distance from a matrix product, and for its root,
# which is far larger for rows that nearly coincide.
ROUNDING = 1e-9
ROOT_ROUNDING = 4e-6
PLANE_ROUNDING = 1e-11


def matrix(column):
    """Arrow list column to an (n, d) float64 array."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = chunk.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(chunk), -1).astype(np.float64, copy=False)


def centred(x, y):
    """Both sides moved to the middle of one: same distances, smaller products."""
    middle = y.mean(axis=0)
    return x - middle, y - middle


def pieces(batches, cells):
    """Arrow batches cut so that a (rows × cells) array stays small."""
    step = max(1, STRIP_CELLS // max(1, cells))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield pa.Table.from_batches([batch.slice(start, step)])


def squared_norms(x):
    return np.einsum("ij,ij->i", x, x)


def product_distances(x, y, xx, yy):
    """Squared distances by one matrix product: fast, loses digits for close rows."""
    d2 = xx[:, None] + yy[None, :] - 2.0 * (x @ y.T)
    return np.maximum(d2, 0.0, out=d2)


def direct_distances(x, y, i, j):
    """Distances of the pairs (i, j), differences summed in element order."""
    out = np.empty(len(i))
    step = max(1, STRIP_CELLS // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        diff = (x[i[s : s + step]] - y[j[s : s + step]]).T
        out[s : s + step] = np.sqrt(np.add.reduce(np.ascontiguousarray(diff * diff), axis=0))
    return out


def marked(mask):
    """Row and column of each true cell."""
    flat = np.flatnonzero(mask)
    row = flat // mask.shape[1]
    return row, flat - row * mask.shape[1]


def strips(n_x, n_y):
    step = max(1, STRIP_CELLS // max(1, n_y))
    return [(s, min(n_x, s + step)) for s in range(0, n_x, step)]


class Partition:
    """Pivots and, per cell, what the bounds need. At most ``MAX_PIVOTS`` cells, so it is
    small whatever the data. Plain arrays: it travels in task closures."""

    def __init__(self, pivots, block_rows, largest_norm):
        self.pivots = pivots
        self.margin = ROOT_ROUNDING * largest_norm
        self.plane_margin = PLANE_ROUNDING * largest_norm**2
        self.block_rows = block_rows
        self.norms = squared_norms(pivots)
        self.gaps = np.sqrt(product_distances(pivots, pivots, self.norms, self.norms))
        self.single = len(pivots) == 1

    def distances(self, x):
        return np.sqrt(product_distances(x, self.pivots, squared_norms(x), self.norms))

    def home(self, x):
        d = self.distances(x)
        cell = d.argmin(axis=1)
        return d, cell, d[np.arange(len(x)), cell]


def make_partition(vectors, block_rows, visitors=None):
    """Pivots are distinct rows in hash order, about one per block of data."""
    largest = F.max(row_norm(F.col("x"), "l2"))
    n, d, norm = vectors.agg(F.count("*"), F.max(F.size("x")), largest).first()
    if visitors is not None:
        norm = max(norm, visitors.agg(largest).first()[0] or 0.0)
    wanted = min(MAX_PIVOTS, max(1, PIVOT_BYTES // (8 * max(1, d or 1))), max(1, -(-n // block_rows)))
    rows = vectors.select("x").orderBy(F.xxhash64("vid")).limit(wanted).collect()
    pivots = np.array([r[0] for r in rows], dtype=np.float64)
    return Partition(pivots, block_rows, norm or 0.0)


def lower_bounds(part, dist, cell, home_dist, near, far):
    """Per row and target cell, a distance no member of the cell can undercut, rounding of
    all distances to pivots included."""
    shell = np.maximum(np.maximum(dist - far[None, :], near[None, :] - dist), 0.0)
    gap = part.gaps[cell]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (dist**2 - home_dist[:, None] ** 2 - part.plane_margin) / (2.0 * gap)
    return np.maximum(shell, np.where(gap > part.margin, plane, 0.0)) - part.margin


def place(vectors, part, weight):
    """Rows with weight as ``(cell, pd, w)``: nearest pivot and distance to it."""

    def run(batches):
        for t in pieces(batches, len(part.pivots)):
            _, cell, home = part.home(matrix(t.column("x")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(home), t.column("w").combine_chunks()], ["cell", "pd", "w"])

    return vectors.where(F.col(weight) > 0).select("x", F.col(weight).alias("w")).mapInArrow(
        run, "cell int, pd double, w bigint")


def collect_stats(placed, cells):
    """Counts and distance ranges per cell: at most ``MAX_PIVOTS`` rows."""
    rows = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("pd").alias("near"), F.max("pd").alias("far")).collect()
    count = np.zeros(cells, dtype=np.int64)
    near, far = np.full(cells, np.inf), np.full(cells, -np.inf)
    for r in rows:
        count[r.cell], near[r.cell], far[r.cell] = r.n, r.near, r.far
    return count, near, far


def neighbour_bounds(placed, part, far, k):
    """Per cell, a distance within which each member has k others: from the k+1 rows
    nearest to each pivot (k+1, as one of them may be the member itself)."""
    ranked = Window.partitionBy("cell").orderBy("pd")
    rows = placed.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).select("cell", "pd", "w").collect()
    cell = np.array([r.cell for r in rows], dtype=np.int64)
    pd_, w = np.array([r.pd for r in rows]), np.array([r.w for r in rows])
    bound = np.full(len(part.pivots), np.inf)
    for i in np.flatnonzero(np.isfinite(far)):
        reach = far[i] + part.gaps[i, cell] + pd_
        order = np.argsort(reach)
        enough = np.flatnonzero(np.cumsum(w[order]) >= k + 1)
        if len(enough):
            bound[i] = reach[order[enough[0]]]
    return bound


def block_hash(key="vid"):
    """Place of a row among the blocks of its cell."""
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(1 << 30))


class Layout:
    """Cells dealt to groups, groups to tasks. A row travels once to a group, however many of its cells it can matter to;
    the bounds then choose cells inside the task. There are about ``GROUPS`` groups of either side, so a row has a bounded number of
    copies; more only where a group would exceed ``GROUP_BYTES``. A cell larger than a group is cut by a hash of the row."""

    def __init__(self, part, counts, visits, n_visit, home_groups=GROUPS, visit_groups=GROUPS):
        row_bytes = 8 * max(1, part.pivots.shape[1] if part.pivots.ndim == 2 else 1)
        most = max(1, GROUP_BYTES // row_bytes)
        rows = lambda n, groups: int(min(max(part.block_rows, -(-n // groups)), most))
        wanted = rows(int(counts.sum()), home_groups)
        self.parts = np.maximum(-(-counts // wanted), 1)
        self.first = np.zeros(len(counts), dtype=np.int64)
        self.cells = []
        held = 0
        # Cells near each other share a group, so that a row matters to few groups.
        for c in sorted(np.flatnonzero(counts), key=lambda c: part.gaps[0, c]):
            if self.parts[c] > 1:
                self.first[c] = len(self.cells)
                self.cells += [[c]] * int(self.parts[c])
                held = wanted
                continue
            if not self.cells or held + counts[c] > wanted:
                self.cells.append([])
                held = 0
            self.first[c] = len(self.cells) - 1
            self.cells[-1].append(c)
            held += counts[c]
        self.members = np.array([c for g in self.cells for c in g], dtype=np.int64)
        self.starts = np.cumsum([0] + [len(g) for g in self.cells])[:-1]
        seen = np.array([min(n_visit, int(visits[g].sum())) for g in self.cells], dtype=np.int64)
        self.visit_parts = np.maximum(-(-seen // rows(n_visit, visit_groups)), 1)

    def groups_hit(self, hit):
        """(rows × cells) to (rows × groups)."""
        return np.logical_or.reduceat(hit[:, self.members], self.starts, axis=1) if len(self.cells) else hit[:, :0]


def route(rows, part, targets, columns, layout):
    """Rows to (grp, vb). A home row goes to its group beside every block of visitors; a visiting row goes to its block
    of each group with a target cell. ``targets(dist, cell, home_dist, table)`` is a boolean (rows × cells) array."""
    schema = "grp int, vb int, visit boolean, " + columns

    def emit(batches):
        for t in pieces(batches, len(part.pivots)):
            dist, cell, home = part.home(matrix(t.column("x")))
            h = t.column("h").to_numpy()
            is_home = t.column("is_home").to_numpy(zero_copy_only=False)
            is_visit = t.column("is_visit").to_numpy(zero_copy_only=False)
            data = t.drop_columns(["h", "is_home", "is_visit"])
            row = np.flatnonzero(is_home)
            own = layout.first[cell[row]] + h[row] % layout.parts[cell[row]]
            copies = layout.visit_parts[own]
            take = np.repeat(np.arange(len(row)), copies)
            block = np.arange(len(take)) - np.repeat(np.cumsum(copies) - copies, copies)
            vrow, vgroup = np.nonzero(layout.groups_hit(targets(dist, cell, home, t) & is_visit[:, None]))
            # Other bits than those that cut a cell into groups.
            mine = (h[vrow] >> 10) % layout.visit_parts[vgroup]
            for row, group, block, visit in ((row[take], own[take], block, False), (vrow, vgroup, mine, True)):
                # Bounded slices keep a widely copied batch from growing in memory.
                for s in range(0, len(row), BLOCK_ROWS):
                    out = data.take(pa.array(row[s : s + BLOCK_ROWS]))
                    yield from pa.Table.from_arrays(
                        [pa.array(group[s : s + BLOCK_ROWS].astype(np.int32)), pa.array(block[s : s + BLOCK_ROWS].astype(np.int32)),
                         pa.array(np.full(len(out), visit))] + [out.column(n) for n in out.column_names],
                        names=["grp", "vb", "visit"] + out.column_names,
                    ).to_batches()

    return rows.mapInArrow(emit, schema)


def cell_pairs(home, other, part, targets):
    """Rows of ``home`` in one cell, and rows of ``other`` that the cell is a target of, for each cell of a group. Cells that all
    visitors are targets of come together."""
    every = np.arange(len(other))
    if part.single:
        yield np.arange(len(home)), every
        return
    x = matrix(home.column("x"))
    own = np.concatenate([part.home(matrix(t.column("x")))[1] for t in pieces(home.to_batches(), len(part.pivots))]) if len(x) else every[:0]
    cells = np.unique(own)
    hit = np.concatenate([targets(*part.home(matrix(t.column("x"))), t)[:, cells] for t in pieces(other.to_batches(), len(part.pivots))])
    whole = hit.all(axis=0)
    if whole.any():
        yield np.flatnonzero(np.isin(own, cells[whole])), every
    for at in np.flatnonzero(~whole & hit.any(axis=0)):
        yield np.flatnonzero(own == cells[at]), np.flatnonzero(hit[:, at])


def count_visits(rows, part, targets):
    """Rows that visit each cell: one narrow pass, no vector moves."""

    def tally(batches):
        total = np.zeros(len(part.pivots), dtype=np.int64)
        for t in pieces(batches, len(part.pivots)):
            dist, cell, home = part.home(matrix(t.column("x")))
            is_visit = t.column("is_visit").to_numpy(zero_copy_only=False)
            total += (targets(dist, cell, home, t) & is_visit[:, None]).sum(axis=0)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    out = np.zeros(len(part.pivots), dtype=np.int64)
    for r in rows.mapInArrow(tally, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out
