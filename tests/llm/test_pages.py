"""WARC archives and language identification."""

import base64
import collections
import gzip
import hashlib

from textdist.llm import langid, warc


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_warc_round_trip(spark, messy, messy_rows, nothing, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_pages(messy, path)
    best = {}
    for k, t in messy_rows:
        if k is not None:
            best[t or ""] = max(k, best.get(t or "", k))
    want = collections.Counter()
    for k, t in messy_rows:
        top = best.get(t or "")
        again = k is not None and k < top
        want[k, len((t or "").encode()), digest(t), "revisit" if again else "response", top if again else None] += 1
    assert collections.Counter(map(tuple, warc.page_records(spark, path).collect())) == want
    warc.write_pages(nothing, f"file://{tmp_path}/none")
    assert warc.page_records(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_ranges_filters_and_skipping(spark, tmp_path):
    path = f"file://{tmp_path}/split"
    rows = [(i, f"http://h{i % 3}.example.org/{i}\r\nx", f"<p>{i}</p>" * (i * 40 % 977)) for i in range(200)]
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    for split in (1 << 25, 1000, 333):
        got = warc.read(spark, path, split_bytes=split)
        assert sorted(r.record_id for r in got.collect()) == sorted(f"{warc.PREFIX}{i}" for i in range(200))
    one = warc.read(spark, path, payload=False).where("record_type = 'response' AND target_uri IN ('http://h1.example.org/4%0D%0Ax', 'http://h1.example.org/7%0D%0Ax')")
    assert {(r.record_id, r.payload) for r in one.collect()} == {(f"{warc.PREFIX}4", None), (f"{warc.PREFIX}7", None)}
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and all(b.num_rows == 0 for p in reader.partitions() for b in reader.read(p))


def test_warc_foreign_files(spark, tmp_path):
    """Members without the length field, and a plain file."""
    records = [warc.record("response", f"urn:record:{i}", f"http://a/{i}", b"payload %d" % i * 3000) for i in range(5)]
    records.append(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    for payload in (True, False):
        rows = warc.read(spark, f"file://{tmp_path}", payload=payload).collect()
        kinds = collections.Counter((r.file.rsplit("/")[-1], r.record_type) for r in rows)
        assert kinds == {("a.warc.gz", "response"): 5, ("a.warc.gz", "warcinfo"): 1, ("b.warc", "response"): 5, ("b.warc", "warcinfo"): 1}
        if payload:
            assert {bytes(r.payload) for r in rows} == {b"payload %d" % i * 3000 for i in range(5)} | {b"abcd"}


def test_warc_passes_over_what_is_no_record(spark, tmp_path):
    """Members that hold no record, bytes between members, and HTTP headers over 4096 bytes."""
    def long_headers(i):
        block = b"HTTP/1.1 200 OK\r\nX-Long: " + b"x" * 9000 + b"\r\nContent-Length: 3\r\n\r\nabc"
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    records = [long_headers(i) for i in range(4)]
    noise = [b"", gzip.compress(b"no record\r\n\r\n at all"), b"\0" * 50, gzip.compress(b"short")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(n + gzip.compress(x) for n, x in zip(noise, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    for payload in (True, False):
        rows = warc.read(spark, f"file://{tmp_path}", payload=payload).collect()
        assert sorted((r.file.rsplit("/")[-1], r.record_id, r.payload_bytes) for r in rows) == [(f, f"urn:{i}", 3) for f in ("a.warc.gz", "b.warc") for i in range(4)]


def test_language(spark):
    en, fr = "the house and the garden are in the sun with all of them ", "la maison et le jardin sont dans le soleil avec tous les autres "
    labelled = spark.createDataFrame([(en * 5, "en"), (fr * 5, "fr"), ("x", None), (None, "en")], "text string, lang string")
    page = lambda t, lang="": f"<html {lang}><body><script>the the</script><p>{t}</p></body></html>"
    rows = [(1, "http://a.site.fr/x", page(fr)), (2, "http://b.site.com/", page(en, 'lang="en-GB"')), (3, "http://b.site.com/2", page(en, 'lang="fr"')),
            (4, None, None), (5, "http://c.site.fr/", ""), (None, "http://b.site.com/", page(en)), (1, "http://a.site.fr/x", page(fr)), (6, "http://new.org", page("en " * 30_000))]
    rows += [(10 + i, f"http://d.site.de/{i}", page(fr)) for i in range(40)] + [(60, "http://d.site.de/z", page("ok", ""))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, share int")
    got = langid.identify(pages, labelled).collect()
    assert len(got) == len(rows)
    lang = {r.page_id: r.lang for r in got}
    assert (lang[1], lang[2], lang[3], lang[5], lang[60], lang[None]) == ("fr", "en", "en", "fr", "fr", "en") and lang[4] in ("en", "fr")
    assert {r.page_id: r.declared for r in got}[2] == "en"
    empty = langid.identify(pages, labelled.where("1 = 0")).collect()
    assert len(empty) == len(rows) and all(r.lang is None for r in empty)
    assert langid.identify(pages.where("1 = 0"), labelled).count() == 0


def test_language_on_held_out_documents(spark):
    """Trained on even documents, right on the odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = docs.where("doc_id % 2 = 1 AND n_chars > 200").selectExpr("doc_id AS page_id", "concat('http://h', doc_id % 7, '.example.com/') AS url", "concat('<html><p>', text, '</p></html>') AS html", "lang")
    got = langid.identify(pages, docs.where("doc_id % 2 = 0")).join(pages.select("page_id", pages["lang"].alias("truth")), "page_id")
    n = got.count()
    assert got.where("lang = truth").count() >= 0.97 * n
