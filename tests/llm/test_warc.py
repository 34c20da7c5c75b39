"""WARC records: derivation against the standard library's parser, edges, files."""

import base64
import hashlib
import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from relweave.llm import queries, warc

DATE = "2024-01-01T00:00:00Z"
ROWS = [
    (1, "http://a.example/x", "<html><head><title>T &amp; t</title></head><body><a href='/y?a=1&amp;b=2'>go</a><p>One <b>two</b>\n three<br>four<script>x()</script></p><img src=i.png></body>"),
    (1, "http://a.example/x", None),
    (2, None, ""),
    (None, "http://b.example/\nz", "no markup: WARC/1.0\r\n\r\nWARC/1.0\r"),
    (3, "http://c.example/é", "<p>" + "long " * 100_000),
    (4, "http://d.example/", "plain"),
    (4, "http://d.example/", "plain"),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id int, url string, html string")
    return df.withColumn("block", F.lit("clash")).withColumn("type", F.lit("clash"))


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives(spark, pages):
    sources = warc.responses(pages, DATE)
    by = {r["record_id"]: r for r in sources.collect()}
    made = warc.derive(sources).collect()
    assert len(made) == 2 * len(ROWS) and len(by) == len(ROWS) - 1
    for r in made:
        source = by[r["refers_to"]]
        fields = dict(warc.header_pairs(r["headers"]))
        assert (r["target_uri"], r["date"], r["payload_digest"], r["page_id"]) == (source["target_uri"], source["date"], source["payload_digest"], source["page_id"])
        assert r["block_digest"] == fields["WARC-Block-Digest"] == sha1(bytes(r["block"])) and int(fields["Content-Length"]) == len(r["block"])
        assert fields["WARC-Refers-To"] == source["record_id"] and fields["WARC-Concurrent-To"] in {m["record_id"] for m in made if m["refers_to"] == source["record_id"] and m["type"] != r["type"]}
        if r["type"] == "metadata":
            assert json.loads(bytes(r["block"]))["Envelope"]["WARC-Header-Metadata"] == dict(warc.header_pairs(source["headers"]))
    texts = {(r["page_id"], r["payload_digest"]): bytes(r["block"]).decode() for r in made if r["type"] == "conversion"}
    assert texts[1, sha1(ROWS[0][2].encode())] == "go\nOne two three\nfour" and texts[2, sha1(b"")] == "" and texts[3, sha1(ROWS[4][2].encode())] == ("long " * 100_000).strip()
    page = next(json.loads(bytes(r["block"])) for r in made if r["type"] == "metadata" and r["payload_digest"] == sha1(ROWS[0][2].encode()))
    found = page["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert found["HTML-Metadata"] == {"Title": "T & t", "Links": [{"path": "a@/href", "url": "/y?a=1&b=2"}, {"path": "img@/src", "url": "i.png"}]}
    assert found["Response-Message"] == "HTTP/1.1 200 OK" and found["Headers"]["Content-Type"].startswith("text/html")
    assert warc.derive(warc.derive(sources)).count() == 0 and warc.derive(warc.responses(pages.limit(0), DATE)).count() == 0


def test_files_round_trip_and_broken_lengths_fail(spark, pages, tmp_path):
    plain = warc.responses(pages.filter("page_id IS NOT NULL"), DATE).drop("page_id").repartition(2)
    every = plain.unionByName(warc.derive(plain))
    key = lambda df: sorted(repr(r.asDict()) for r in df.collect())
    for compression in (None, "gzip"):
        folder = f"{tmp_path}/{compression}"
        warc.write(every, folder, compression)
        assert key(warc.parse(spark, folder)) == key(every)
    # Blocks that hold the record mark themselves are put together again.
    marked = warc.responses(pages.filter("page_id IS NULL").withColumn("html", F.lit("a\r\n\r\nWARC/1.0\r\nb\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.")), DATE).drop("page_id")
    both = marked.unionByName(plain).coalesce(1)
    warc.write(both, f"{tmp_path}/mark")
    assert key(warc.parse(spark, f"{tmp_path}/mark")) == key(both)
    (tmp_path / "short.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception):  # noqa: B017
        warc.parse(spark, f"{tmp_path}/short.warc").collect()


def test_other_versions_spellings_and_repeated_headers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/html; charset=ISO-8859-1\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nX-Long: one\r\n two\r\n\r\n<p>caf\xe9 \x93q\x94</p>"
    one = lambda kind, block, more="": f"WARC/1.1\r\nwarc-type: {kind}\r\nwarc-record-id: <urn:{kind}{more}>\r\nWARC-Date: {DATE}\r\ncontent-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    png = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
    plain = "HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=utf-16le\r\n\r\n".encode() + "a <b> \u00fc".encode("utf-16le")
    (tmp_path / "x.warc").write_bytes(one("warcinfo", b"software: x") + one("response", http) + one("response", png, "2") + one("response", plain, "3") + one("response", b"HTTP/1.1 200 OK\r\n\r\n<meta charset=koi8-r><p>\xd7", "4"))
    read = warc.parse(spark, f"{tmp_path}/x.warc")
    assert [r["type"] for r in read.collect()] == ["warcinfo", *["response"] * 4]
    made = warc.derive(read).collect()
    assert {r["refers_to"]: bytes(r["block"]).decode() for r in made if r["type"] == "conversion"} == {"<urn:response>": "caf\u00e9 \u201cq\u201d", "<urn:response3>": "a <b> \u00fc", "<urn:response4>": "\u0432"}
    metas = {r["refers_to"]: json.loads(bytes(r["block"]))["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"] for r in made if r["type"] == "metadata"}
    assert metas["<urn:response>"]["Headers"] == {"content-type": "text/html; charset=ISO-8859-1", "Set-Cookie": ["a=1", "b=2"], "X-Long": "one two"}
    assert len(metas) == 4 and "HTML-Metadata" not in metas["<urn:response2>"]
    assert all("WARC-Concurrent-To" not in r["headers"] for r in made if r["refers_to"] == "<urn:response2>")


def test_codings_and_undeclared_bodies(spark, tmp_path):
    import gzip
    import zlib

    import zstandard

    page = "<title>t</title><p>h\u00e9llo</p>".encode()
    raw = zlib.compressobj(wbits=-15)
    chunked = lambda b: b"".join(b"%x;x=1\r\n%s\r\n" % (len(b[i : i + 7]), b[i : i + 7]) for i in range(0, len(b), 7)) + b"0\r\nTrailer: x\r\n\r\n"
    html = "Content-Type: text/html\r\n"
    cases = {
        "gzip": (html + "Content-Encoding: gzip\r\n", gzip.compress(page[:9]) + gzip.compress(page[9:])),
        "deflate": (html + "Content-Encoding: deflate\r\n", zlib.compress(page)),
        "raw": (html + "content-encoding: deflate\r\n", raw.compress(page) + raw.flush()),
        "zstd": (html + "Content-Encoding: zstd\r\n", zstandard.compress(page)),
        "twice": (html + "Content-Encoding: deflate\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", chunked(gzip.compress(zlib.compress(page)))),
        "chunked": (html + "Transfer-Encoding: chunked\r\n", chunked(page)),
        "decoded": (html + "Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", page),
        "bare": ("", page),
        "unknown": (html + "Content-Encoding: br\r\n", b"\x0b\x02\x80"),
        "png": ("", b"\x89PNG\r\n\x1a\n\x00\x00"),
        "pdf": ("", b"%PDF-1.7 words"),
        "cut": (html + "Content-Encoding: gzip\r\n", gzip.compress(b"x" * 99)[:20]),
    }
    made = {}
    for name, (fields, body) in cases.items():
        block = f"HTTP/1.1 200 OK\r\n{fields}\r\n".encode() + body
        for r in warc.derivatives(warc.record("response", f"<urn:{name}>", "http://h/", DATE, "application/http", block)):
            made[name, r["type"]] = r["block"].decode("utf-8", "replace")
    assert {n for n, k in made if k == "metadata"} == set(cases)
    texts = {n: t for (n, k), t in made.items() if k == "conversion"}
    assert {n for n, t in texts.items() if t == "h\u00e9llo"} == {"gzip", "deflate", "raw", "zstd", "twice", "chunked", "decoded", "bare"}
    assert set(cases) - set(texts) == {"unknown", "png", "pdf"}


def test_blocks_full_of_marks_take_linear_time(spark, tmp_path):
    import time

    took = []
    for n in (4_000, 32_000):
        block = b"\r\n\r\nWARC/1.0\r\nx" * n
        path = tmp_path / f"{n}.warc"
        path.write_bytes(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
        began = time.time()
        (row,) = warc.parse(spark, str(path)).collect()
        took.append(time.time() - began)
        assert bytes(row["block"]) == block
    assert took[1] < 10 + 4 * took[0]


def test_records_over_the_borders_of_ranges(spark, tmp_path):
    """Files inside files: blocks that hold whole WARC records, read in ranges far smaller than a block."""
    import random

    rng = random.Random(4)
    one = lambda i, block: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    inner = lambda n: b"".join(one(f"in{k}", b"x" * rng.randrange(200)) for k in range(n))
    blocks = [rng.choice([b"", b"plain", inner(3), inner(40), b"\r\n\r\nWARC/1.0\r\n" * 50, b"y" * 3000]) for _ in range(60)]
    (tmp_path / "w").mkdir()
    for k in (0, 1):
        (tmp_path / "w" / f"{k}.warc").write_bytes(b"".join(one(i, b) for i, b in enumerate(blocks) if i % 2 == k))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for size in (700, 20_000):
            spark.conf.set(names[0], str(size))
            spark.conf.set(names[1], "1")
            got = {r["record_id"]: bytes(r["block"]) for r in warc.parse(spark, str(tmp_path / "w")).collect()}
            assert got == {f"<urn:{i}>": b for i, b in enumerate(blocks)}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


class Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.parts.append("\x00" if tag in warc._BREAKS else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.parts.append("\x00" if tag in warc._BREAKS else "")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_query_against_the_standard_parser(spark, small):
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op3_warc(spark, small).collect()
    assert len(rows) == 2 * len(sources)
    for r in rows:
        assert r["payload_digest"] == sha1(sources[r["page_id"]].encode())
        if r["type"] == "conversion":
            parser = Text()
            parser.feed(sources[r["page_id"]])
            parser.close()
            blocks = (" ".join(b.split()) for b in "".join(parser.parts).split("\x00"))
            assert r["block"] == "\n".join(b for b in blocks if b)
