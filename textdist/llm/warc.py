"""WARC archives as a PySpark Python data source, and writing pages with revisit records.

Reading: one partition for a range of each file. ``pushFilters`` takes equality and membership on record type and header
columns; a task inflates a record's headers first and passes over the payload of a record the filters reject, or
where the option ``payload`` is false. Gzip members written here carry their length in an ``sl`` extra field, so what is passed over is
not even inflated; members without it are inflated to find their end. A range starts at the first member at or after its
start. Plain ``.warc`` files are read in one partition.

Writing: one file (or several of ``file_bytes``) for each task. A file gets its final name when the whole write
commits; what lost or repeated tasks wrote stays under a hidden name and is removed.
Files are opened by pyarrow's file systems, so the folder may be on any store it knows.

Edges: a null payload is empty, a null url writes no target, a null id writes a random record id and reads back null. Line ends in a url are percent-escaped.
An empty table writes no records, and a folder without records reads as no rows.
"""

import base64
import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
          "content_type string, payload_bytes long, payload binary, file string, offset long")
PREFIX = "urn:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
#: columns that headers alone decide
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
             "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
HEAD_BYTES = 4096
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def file_system(path):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def digest(payload):
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind, ident, uri, payload, refers_to=None, date="1970-01-01T00:00:00Z"):
    """Bytes of one WARC record. A revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}"]
    if uri is not None:
        uri = uri.replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {uri}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(body, level=1):
    """A gzip member with its own and its body's length in the extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    raw = z.compress(body) + z.flush()
    end = struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(raw) + 8
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(body) & 0xFFFFFFFF)
    if size >> 32:
        return MAGIC + b"\0\0\0\0\0\0\xff" + raw + end
    return MAGIC + b"\x04\0\0\0\0\0\xff" + extra + raw + end


def headers(head):
    """(lower-case name to value, offset of the block) from the start of a record; None if it does not reach that far."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    return {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}, end + 4


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


def _flat(predicate):
    """(column, allowed values) of a filter on a header column, else None."""
    if isinstance(predicate, EqualTo) and len(predicate.attribute) == 1 and predicate.attribute[0] in HEADER_OF and predicate.value is not None:
        return predicate.attribute[0], {predicate.value}
    if isinstance(predicate, In) and len(predicate.attribute) == 1 and predicate.attribute[0] in HEADER_OF:
        return predicate.attribute[0], {v for v in predicate.value if v is not None}
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", 32 << 20))
        self.wanted = []

    def pushFilters(self, filters):
        for f in filters:
            taken = _flat(f)
            if taken:
                self.wanted.append(taken)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = file_system(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith((".warc", ".warc.gz")) and info.base_name[0] not in "._":
                step = self.split if info.base_name.endswith(".gz") else max(info.size, 1)
                out += [Range(info.path, a, min(a + step, info.size)) for a in range(0, info.size, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = file_system(self.path)
        with store.open_input_file(partition.path) as f:
            rows, size = [], 0
            for row in (self.zipped if partition.path.endswith(".gz") else self.plain)(f, partition):
                rows.append(row)
                size += len(row[8] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows):
        types = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def accepts(self, values):
        return all(values[c] in allowed for c, allowed in self.wanted)

    def row(self, head, block, path, at):
        """A row from headers, and a function that gives the block's bytes (all, or at least so many)."""
        values = {c: head.get(h) for c, h in HEADER_OF.items()}
        for c in ("record_id", "refers_to"):
            if values[c]:
                values[c] = values[c].strip("<>")
        if values["payload_digest"]:
            values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
        if not self.accepts(values):
            return None
        size, payload = None, None
        if (values["content_type"] or "").startswith("application/http"):
            keep = self.payload and values["record_type"] == "response"
            least = HEAD_BYTES
            raw = block(None if keep else least)
            while headers(raw) is None and not keep and len(raw) >= least:
                least *= 2
                raw = block(least)
            http = headers(raw)
            if http:
                size = http[0].get("content-length")
                payload = raw[http[1]:] if keep else None
                size = int(size) if size and size.isdigit() else (len(payload) if keep else None)
        elif self.payload:
            payload = block(None)
            size = len(payload)
        return (*(values[c] for c in HEADER_OF), size, payload, path, at)

    def plain(self, f, part):
        at = 0
        while at < part.end:
            f.seek(at)
            head = f.read(HEAD_BYTES)
            while headers(head) is None and (more := f.read(len(head))):
                head += more
            if headers(head) is None:
                return
            fields, start = headers(head)
            length = int(fields.get("content-length", 0))

            def block(least, a=at + start, n=length):
                f.seek(a)
                return f.read(n if least is None else min(n, least))

            row = self.row(fields, block, part.path, at)
            if row:
                yield row
            at += start + length + 4

    def zipped(self, f, part):
        at = 0 if part.start == 0 else self.first(f, part.start, part.end)
        while at is not None and at < part.end:
            f.seek(at)
            head = f.read(HEAD_BYTES)
            if not head.startswith(MAGIC):
                at = self.first(f, at + 1, part.end)  # no member here: go on with the next one that holds a record
                continue
            size = None
            if head[3] & 4 and head[12:14] == b"sl":
                size = struct.unpack("<I", head[16:20])[0]
            z, text = zlib.decompressobj(31), b""
            feed = head if size is None else head[:size]
            text = z.decompress(feed, HEAD_BYTES)
            while headers(text) is None and not z.eof:
                feed = z.unconsumed_tail or f.read(HEAD_BYTES)
                if not feed:
                    break
                text += z.decompress(feed, HEAD_BYTES)
            if headers(text) is None or not text.startswith(b"WARC/"):
                at = self.first(f, at + 1, part.end)
                continue
            fields, start = headers(text)
            length = int(fields.get("content-length", 0))
            state = [text]

            def more(n, z=z, state=state):
                """Inflate until n bytes are there; None: to the member's end."""
                parts, have = state, sum(map(len, state))
                while not z.eof and (n is None or have < n):
                    feed = z.unconsumed_tail or f.read(1 << 16)
                    if not feed:
                        break
                    parts.append(z.decompress(feed, 1 << 20))
                    have += len(parts[-1])
                state[:] = [b"".join(parts)]
                return state[0]

            def block(least, start=start, length=length):
                return more(start + (length if least is None else min(length, least)))[start : start + length]

            row = self.row(fields, block, part.path, at)
            if row:
                yield row
            if size is None:
                more(None)
                size = f.tell() - len(z.unused_data) - at
            at += size

    @staticmethod
    def first(f, start, end):
        """Offset of the first member at or after ``start`` and before ``end``."""
        at, overlap = start, len(MAGIC) - 1
        while at < end:
            f.seek(at)
            chunk = f.read(1 << 20)
            i = chunk.find(MAGIC)
            while i >= 0 and at + i < end:
                f.seek(at + i)
                try:
                    if zlib.decompressobj(31).decompress(f.read(HEAD_BYTES), 16).startswith(b"WARC/"):
                        return at + i
                except zlib.error:
                    pass
                i = chunk.find(MAGIC, i + 1)
            if len(chunk) <= overlap:
                return None
            at += len(chunk) - overlap
        return None


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, target_uri, refers_to, payload); ids and refers_to are record ids."""

    def __init__(self, options):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", 1 << 30))
        self.level = int(options.get("level", 1))
        self.run = uuid.uuid4().hex

    def write(self, iterator):
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{root}/.{self.run}-{files[-1]}", compression=None), 0
                    ident = r["record_id"] or f"urn:uuid:{uuid.uuid4()}"
                    data = member(record(r["record_type"], ident, r["target_uri"], r["payload"] or b"", r["refers_to"]), self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages):
        store, root = file_system(self.path)
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{root}/.{self.run}-{name}", f"{root}/{name}")
        self.sweep(store, root)

    def abort(self, messages):
        self.sweep(*file_system(self.path))

    def sweep(self, store, root):
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f".{self.run}-"):
                store.delete_file(info.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark):
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def marked(pages, key="page_id", url="url", payload="html", least_bytes=0):
    """Rows of the writer: of the rows with equal payloads of at least ``least_bytes`` bytes, that of the largest key is
    the response and those of smaller keys revisit it. Rows of a null key are responses; of repeated rows of the largest key, all are.

    Payloads are compared by SHA-1 and length; they move once, by key, after the decision."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("_k"), F.col(url).alias("target_uri"), body.cast("binary").alias("payload"), F.sha1(body).alias("_d"), F.octet_length(body).alias("_n"))
    ids = rows.select("_k", "_d", "_n").where(F.col("_k").isNotNull() & (F.col("_n") >= least_bytes))
    keep = ids.groupBy("_d", "_n").agg(F.max("_k").alias("_keep"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    again = ids.join(keep, ["_d", "_n"]).where("_k < _keep").select("_k", "_d", "_keep").distinct()
    rows = rows.join(again, ["_k", "_d"], "left")
    ident = lambda c: F.concat(F.lit(PREFIX), c.cast("string"))
    return rows.select(F.when(F.col("_keep").isNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
                       ident(F.col("_k")).alias("record_id"), F.col("target_uri").cast("string").alias("target_uri"), ident(F.col("_keep")).alias("refers_to"), "payload")


def write_pages(pages, path, **options):
    register(pages.sparkSession)
    marked(pages, **options).write.format("warc").mode("append").save(path)


def read(spark, path, payload=True, **options):
    register(spark)
    return spark.read.format("warc").options(path=path, payload=str(payload).lower(), **options).load()


def key_of(record_id, kind="long"):
    """The key a record id was made of; null for others."""
    return F.when(record_id.startswith(PREFIX), F.substring(record_id, len(PREFIX) + 1, 1 << 20).cast(kind))


def page_records(spark, path):
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive. Responses are digested from their
    payloads, revisits take length and digest from their headers and no payload is decoded for them."""
    def base32(batches):
        for b in batches:
            p = b.column("payload").to_pylist()
            made = [pa.array([len(x) for x in p]), pa.array([digest(x) for x in p])]
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("record_type"), b.column("refers_to"), *made], names=names)

    names = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    full = read(spark, path).where("record_type = 'response'").select("record_id", "record_type", "refers_to", "payload")
    full = full.mapInArrow(base32, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string")
    light = read(spark, path, payload=False).where("record_type = 'revisit'").select(*names)
    rows = full.unionByName(light)
    return rows.select(key_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", key_of(F.col("refers_to")).alias("refers_to"))
