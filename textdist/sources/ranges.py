"""Large single files by byte ranges: lines with their numbers, and the records of a nested JSON document.

A range is a task. What a task must know of the bytes before its range is a small state, and a range acts on that state as
a function; such functions compose, so one pass over the ranges gives each range's function, the driver composes them in order
(a few numbers for each range), and a second pass reads every range with its true state.

* Lines: the state is the number of lines before. A line belongs to the range in which it starts.
* JSON: the state is whether a string is open, the bracket depth, and for depths down to the wanted array the kind and key of each open
  container. The first two act alike on any start: both cases of the open string are scanned at once. Keys matter only in
  ranges that come up to those depths, so only these are scanned again, with known depths. A record belongs to the range in which its
  brace opens; its task reads on to the brace that closes it.

Files are opened through Arrow's file systems: local ones, and those Arrow knows by their scheme.
"""

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
NAME = "textdist_ranges"
KEEP = "\0keep"


def files_of(spark, path):
    """(location, bytes) of a file, or of the files of a folder in order of their names. Hidden files are no data."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(sc._jsc.hadoopConfiguration())
    found = [(s.getPath(), s.getLen()) for s in store.listStatus(where) if s.isFile()]
    whole = store.getFileStatus(where).isFile()
    return sorted((p.toString(), n) for p, n in found if whole or p.getName()[0] not in "._")


def cut(files, range_bytes=RANGE_BYTES):
    """(location, start, end) of the ranges of files."""
    return [(p, a, min(a + range_bytes, n)) for p, n in files for a in range(0, n, range_bytes)]


def opened(location):
    from pyarrow import fs

    if location.startswith("file:") or "://" not in location:
        return fs.LocalFileSystem().open_input_file("/" + location.removeprefix("file:").lstrip("/"))
    store, path = fs.FileSystem.from_uri(location)
    return store.open_input_file(path)


@dataclass
class Range(InputPartition):
    location: str
    start: int
    end: int
    state: list = field(default_factory=list)


class RangeSource(DataSource):
    """Options: ``ranges``, a JSON list of [location, start, end, state], and ``mode``, a key of MODES."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return MODES[self.options["mode"]][1]

    def reader(self, schema):
        return RangeReader(dict(self.options))


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.ranges = json.loads(options["ranges"])
        self.work, schema = MODES[options["mode"]]
        self.names = [c.strip().split(" ")[0] for c in schema.split(",")]
        self.depth = options.get("at")

    def partitions(self):
        return [Range(*r) for r in self.ranges] or [Range("", 0, 0)]

    def read(self, partition):
        if partition.end > partition.start:
            at = None if self.depth is None else json.loads(self.depth)
            with opened(partition.location) as f:
                for columns in self.work(f, partition, at):
                    yield pa.RecordBatch.from_arrays(columns, names=self.names)


def over(spark, mode, ranges, at=None):
    """One task per range."""
    spark.dataSource.register(RangeSource)
    reader = spark.read.format(NAME).option("mode", mode).option("ranges", json.dumps([list(r) if len(r) == 4 else [*r, []] for r in ranges]))
    return (reader if at is None else reader.option("at", json.dumps(list(at)))).load()


def chunks(f, start, end):
    f.seek(start)
    while start < end and (data := f.read(min(CHUNK_BYTES, end - start))):
        yield data
        start += len(data)


def as_text(rows):
    """Arrow strings of byte strings; what is no UTF-8 stays as it is."""
    return pa.array(rows, pa.binary()).view(pa.string())


# lines

def _starts_line(f, start):
    if start == 0:
        return True
    f.seek(start - 1)
    return f.read(1) == b"\n"


def count_lines(f, part, _):
    """Lines that start in the range: at its first byte if that starts one, and after every line end but one at its last byte."""
    n = int(_starts_line(f, part.start))
    last = b""
    for data in chunks(f, part.start, part.end):
        n += data.count(b"\n")
        last = data[-1:]
    yield [as_text([part.location.encode()]), pa.array([part.start]), pa.array([n - (last == b"\n")])]


def read_lines(f, part, _):
    """(number, line) of lines that start in the range. The state is [lines before, limit or None]."""
    number, limit = part.state
    skip = not _starts_line(f, part.start)
    rest, at = b"", part.start
    for data in chunks(f, part.start, part.end):
        at += len(data)
        if skip:
            cut_at = data.find(b"\n")
            if cut_at < 0:
                continue
            data, skip = data[cut_at + 1 :], False
        *lines, rest = (rest + data).split(b"\n")
        if lines:
            lines = lines if limit is None else lines[: max(limit - number, 0)]
            yield [pa.array(range(number, number + len(lines)), pa.int64()), as_text([x.removesuffix(b"\r") for x in lines])]
            number += len(lines)
        if limit is not None and number >= limit:
            return
    # the last line goes on behind the range; none starts at the range's very end
    while rest and (more := f.read(1 << 16)):
        head, found, _ = more.partition(b"\n")
        rest += head
        if found:
            break
    if rest and not skip and (limit is None or number < limit):
        yield [pa.array([number], pa.int64()), as_text([rest.removesuffix(b"\r")])]


def line_index(spark, path, range_bytes=RANGE_BYTES, limit=None):
    """[location, start, end, lines before] of each range, in stored order. With a limit only as many ranges are read as hold that many
    lines: first one for each core, then twice as many each time."""
    ranges, out, before = cut(files_of(spark, path), range_bytes), [], 0
    step = spark.sparkContext.defaultParallelism if limit is not None else len(ranges)
    while ranges and (limit is None or before < limit):
        some, ranges, step = ranges[:step], ranges[step:], 2 * step
        counts = {(r.location, r.start): r.lines for r in over(spark, "count_lines", some).collect()}
        for location, start, end in some:
            if limit is None or before < limit:
                out.append((location, start, end, before))
            before += counts[location, start]
    return out


def lines(spark, path, limit=None, range_bytes=RANGE_BYTES):
    """Rows (number, line) of the first ``limit`` lines, or all, of a file or of a folder's files in order of their names. A limit reads
    the ranges that hold these lines and no others."""
    index = line_index(spark, path, range_bytes, limit)
    return over(spark, "read_lines", [(p, a, b, [n, limit]) for p, a, b, n in index])


# nested JSON

QUOTE, BACKSLASH = 34, 92


class Scanner:
    """Structure of a JSON text that comes in chunks: brackets outside strings, depths, and at depths up to ``at`` the open containers.

    ``inside``: a string is open. ``escaped``: the first byte of the next chunk is escaped. ``stack``: [kind, key] of the open
    containers of the least depths, at most ``at``'s length and one."""

    def __init__(self, at, inside=False, escaped=False, depth=0, stack=()):
        self.at, self.goal = list(at), len(at) + 1
        self.inside, self.escaped, self.depth = bool(inside), bool(escaped), depth
        self.stack = [list(x) for x in stack]
        self.least = depth
        self.string = None  # bytes of a string of small depth that is open or was the last, if it began in what was scanned
        self.closed = False

    def quotes(self, data):
        """Places of the quotes that are not escaped."""
        found = np.flatnonzero(data == QUOTE)
        slash = data == BACKSLASH
        escaped = False
        if slash.any() or self.escaped:
            other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
            last = np.r_[-1, other][found]  # last byte before the quote that is no backslash
            run = found - 1 - last + ((last < 0) & self.escaped)
            found = found[run % 2 == 0]
            run = len(data) - 1 - other[-1] + (other[-1] < 0 and self.escaped)
            escaped = bool(run % 2)
        self.escaped = escaped
        return found

    def feed(self, raw):
        """Places, whether they open, and depths before, of the brackets outside strings; and places from which the wanted array is
        open or closed again, as (place, open)."""
        data = np.frombuffer(raw, np.uint8)
        quotes = self.quotes(data)
        low = data | 0x20  # [ and {, ] and } differ in this bit
        places = np.flatnonzero((low == 0x7B) | (low == 0x7D))
        places = places[(np.searchsorted(quotes, places) + self.inside) % 2 == 0]
        opens = low[places] == 0x7B
        after = self.depth + np.cumsum(np.where(opens, 1, -1))
        before = after - np.where(opens, 1, -1)
        lowest = int(min(self.depth, after.min(initial=self.depth)))
        switches = [(0, self.active())]
        if lowest < self.goal or self.string is not None:
            switches += self._shallow(raw, data, quotes, places, opens, before, after)
        self.least = min(self.least, lowest)
        self.depth = int(after[-1]) if len(after) else self.depth
        self.inside = bool((len(quotes) + self.inside) % 2)
        return places, opens, before, switches

    def _shallow(self, raw, data, quotes, places, opens, before, after):
        """Follow what happens above the wanted depth: brackets, strings and colons there."""
        shallow = np.minimum(before, after) < self.goal
        events = [(p, "bracket", (chr(data[p]), int(b))) for p, b in zip(places[shallow].tolist(), np.minimum(before, after)[shallow].tolist())]
        depth_at = lambda x: np.r_[self.depth, after][np.searchsorted(places, x)]
        colons = np.flatnonzero(data == 0x3A)
        colons = colons[(np.searchsorted(quotes, colons) + self.inside) % 2 == 0]
        events += [(p, "colon", int(d)) for p, d in zip(colons.tolist(), depth_at(colons).tolist()) if d < self.goal]
        ends = quotes[int(not self.inside) :: 2]
        starts = quotes[int(self.inside) :: 2]
        if self.string is not None and not self.closed:
            cut_at = int(ends[0]) if len(ends) else len(raw)
            self.string += raw[:cut_at]
            self.closed = bool(len(ends))
        small = depth_at(starts) < self.goal
        stop = ends[int(self.inside) :]
        stop = np.concatenate([stop, np.full(len(starts) - len(stop), len(raw))])
        events += [(a, "string", (a + 1, b)) for a, b in zip(starts[small].tolist(), stop[small].tolist())]
        out = []
        for place, kind, what in sorted(events):
            if kind == "string":
                self.string, self.closed = raw[what[0] : what[1]], what[1] < len(raw)
            elif kind == "colon":
                if self.string is not None and self.closed and 0 < what <= len(self.stack):
                    self.stack[what - 1][1] = name_of(self.string)
                self.string = None
            else:
                self.string = None
                mark, depth = what
                self.stack = self.stack[:depth] + ([[mark, None]] if mark in "[{" else [])
            out.append((place, self.active()))
        return out

    def active(self):
        """Whether the innermost container so far is the wanted array."""
        *objects, last = self.stack[: self.goal] or [[None, None]]
        return len(self.stack) >= self.goal and last[0] == "[" and all(x[0] == "{" and x[1] == k for x, k in zip(objects, self.at))

    def settle(self, more):
        """Read on while the last string may still be a key."""
        while self.string is not None and (byte := more(1)):
            if not self.closed:
                if byte == b'"' and not self.escaped:
                    self.closed = True
                else:
                    self.escaped = byte == b"\\" and not self.escaped
                    self.string += byte
            elif byte == b":":
                if 0 < self.depth <= len(self.stack):
                    self.stack[self.depth - 1][1] = name_of(self.string)
                self.string = None
            elif byte not in b" \t\r\n":
                self.string = None


def name_of(raw):
    try:
        return json.loads(b'"' + raw + b'"')
    except ValueError:
        return raw.decode("utf-8", "replace")


def escaped_at(f, start):
    """Whether an odd run of backslashes ends before ``start``."""
    run = 0
    while start > 0:
        size = min(start, 4096)
        f.seek(start - size)
        data = f.read(size)
        tail = len(data) - len(data.rstrip(b"\\"))
        run, start = run + tail, start - size
        if tail < size:
            break
    return run % 2 == 1


def scan_json(f, part, at):
    """For a string closed and open before the range: whether one is open after it, the change of depth, and the least depth on the way."""
    escaped = escaped_at(f, part.start)
    both = [Scanner([], inside, escaped) for inside in (False, True)]
    # depths are relative and may be negative here, so no container is followed
    for s in both:
        s.goal = -(1 << 60)
    for raw in chunks(f, part.start, part.end):
        for s in both:
            s.feed(raw)
    yield [as_text([part.location.encode()]), pa.array([part.start]), *(pa.array([x]) for s in both for x in (s.inside, s.depth, s.least))]


def scan_keys(f, part, at):
    """The open containers after the range, [kind, key] each, where those before it are unknown. The state is [inside, depth]."""
    inside, depth = part.state
    s = Scanner(at, inside, escaped_at(f, part.start), depth, [[None, KEEP]] * min(depth, len(at) + 1))
    for raw in chunks(f, part.start, part.end):
        s.feed(raw)
    s.settle(f.read)
    yield [as_text([part.location.encode()]), pa.array([part.start]), pa.array([json.dumps(s.stack[: s.goal])])]


def read_records(f, part, at):
    """Objects that are elements of the array at path ``at`` and open in the range. The state is [inside, depth, stack]."""
    inside, depth, stack = part.state or [False, 0, []]
    s = Scanner(at, inside, escaped_at(f, part.start), depth, stack)
    pending, done, place = None, [], part.start
    f.seek(part.start)
    while place < part.end or pending is not None:
        raw = f.read(min(CHUNK_BYTES, part.end - place) if place < part.end else 1 << 16)
        if not raw:
            break
        places, opens, before, switches = s.feed(raw)
        own = np.flatnonzero((before == s.goal) & opens & (np.frombuffer(raw, np.uint8)[places] == 0x7B))
        ends = places[(before == s.goal + 1) & ~opens] + 1
        if pending is not None:
            if not len(ends):
                pending += raw
            else:
                done.append(pending + raw[: ends[0]])
                pending = None
        if place < part.end:
            starts = places[own]
            marks, flags = zip(*switches)
            starts = starts[np.array(flags)[np.searchsorted(marks, starts, side="right") - 1]]
            stops = np.searchsorted(ends, starts, side="right")
            for a, i in zip(starts.tolist(), stops.tolist()):
                if i < len(ends):
                    done.append(raw[a : ends[i]])
                else:
                    pending = raw[a:]
        place += len(raw)
        if done:
            yield [as_text(done)]
            done = []


def composed(ranges, found):
    """State [inside, depth] before and least depth inside each range, from the functions of the ranges."""
    out, location = [], None
    for r in ranges:
        if r[0] != location:
            location, inside, depth = r[0], False, 0
        ends, change, least = found[r[0], r[1]][int(inside)]
        out.append((inside, depth, depth + least))
        inside, depth = ends, depth + change
    return out


def nested_records(spark, path, at, range_bytes=RANGE_BYTES):
    """Rows (record): the text of every object in the array at key path ``at`` of the JSON documents of a file, or of a folder's files. A
    file may hold one document of any size or several, one after the other. Elements that are no objects are no records."""
    ranges = cut(files_of(spark, path), range_bytes)
    many = {r[0] for r in ranges if r[1] > 0}
    split = [r for r in ranges if r[0] in many]
    states = {}
    if split:
        found = {(r.location, r.start): ((r.in0, r.d0, r.m0), (r.in1, r.d1, r.m1)) for r in over(spark, "scan_json", split).collect()}
        before = composed(split, found)
        goal = len(at) + 1
        up = [(*r, [inside, depth]) for r, (inside, depth, least) in zip(split, before) if least < goal]
        keys = {(r.location, r.start): json.loads(r.stack) for r in over(spark, "scan_keys", up, at).collect()}
        location, stack = None, []
        for r, (inside, depth, _) in zip(split, before):
            if r[0] != location:
                location, stack = r[0], []
            states[r[0], r[1]] = [inside, depth, stack]
            if (r[0], r[1]) in keys:
                after = keys[r[0], r[1]]
                stack = [[stack[i][0] if kind is None else kind, stack[i][1] if key == KEEP else key] for i, (kind, key) in enumerate(after)]
    return over(spark, "read_records", [(*r, states.get((r[0], r[1]), [])) for r in ranges], at)


MODES = {
    "count_lines": (count_lines, "location string, start long, lines long"),
    "read_lines": (read_lines, "number long, line string"),
    "scan_json": (scan_json, "location string, start long, in0 boolean, d0 long, m0 long, in1 boolean, d1 long, m1 long"),
    "scan_keys": (scan_keys, "location string, start long, stack string"),
    "read_records": (read_records, "record string"),
}
