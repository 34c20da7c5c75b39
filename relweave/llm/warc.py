"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Every derived record refers to its response (WARC-Refers-To), carries the
response's URI and date, and keeps its payload digest; metadata records hold the
response's own WARC and HTTP headers, title and links as JSON, conversion
records the text of a page or of plain text. Where there are two derivatives of
a response they name each other (WARC-Concurrent-To). Ids are name-based UUIDs
of the response's id, so the same input gives the same records whatever task
makes them.

WARC files are read and written by Spark's text source with the record mark as
line separator: reads split inside files, and no file passes through one row. A
block may hold the mark itself; such a record is put together again from the
pieces by its Content-Length, over the borders of the ranges, too.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.common import kept, pieces, staged
from relweave.llm.markup import BLOCK, RAW, TAG, raw_end

VERSION = "WARC/1.0"
_END = "\r\n\r\n"
FIELDS = ("record_id", "type", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest")
SCHEMA = ", ".join([*(f"{f} string" for f in FIELDS), "headers string, block binary"])
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

# Elements of HTML whose text isn't shown, and those that break a line.
_HIDDEN = RAW
_BREAKS = BLOCK - frozenset("caption details dialog head legend optgroup summary tbody tfoot thead title".split()) | {"br"}
# Elements that link, and the attribute that says where to.
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "source": "src", "embed": "src"}
# Media types of pages; other text is taken as it is.
_PAGES = frozenset(("", "text/html", "application/xhtml+xml"))
_VALUE = r"\b{}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
_TARGETS = {t: re.compile(_VALUE.format(a), re.I) for t, a in _LINKS.items()}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_DECLARED = re.compile(rb"<meta[^>]{1,200}?charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{record_id} {kind}')}>"


def read_page(source: str) -> tuple[str, str, list[dict]]:
    """Title, text (a line per block, white space collapsed) and links (element, url) of a page, in one pass."""
    parts, links, title, at = [], [], "", 0
    while m := TAG.search(source, at):
        parts.append(source[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if tag in _BREAKS:
            parts.append("\x00")
        if tag in _LINKS and not m[1] and (v := _TARGETS[tag].search(m[3])):
            links.append({"path": f"{tag}@/{_LINKS[tag]}", "url": entities.unescape(v[1] or v[2] or v[3] or "")})
        if tag in _HIDDEN and not m[1] and not m[3].endswith("/"):
            end, after = raw_end(source, tag, at)
            if tag == "title" and not title:
                title = " ".join(entities.unescape(source[at:end]).split())
            at = after
    parts.append(source[at:])
    blocks = (" ".join(entities.unescape(b).split()) for b in "".join(parts).split("\x00"))
    return title, "\n".join(b for b in blocks if b), links


def response(url: str, body: bytes, date: str, name: str) -> dict:
    """A response record of a fetched page; name decides its id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}{_END}".encode()
    return record("response", named(name, "response"), url, date, "application/http; msgtype=response", http + body, payload_digest=digest(body))


def record(kind: str, record_id: str, url: str, date: str, content_type: str, block: bytes, refers_to: str = "", payload_digest: str = "", more: tuple = ()) -> dict:
    block_digest = digest(block)
    # Line feeds in a URI would end its header.
    uri = " ".join(url.split())
    pairs = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to), *more, ("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", block_digest), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    headers = "\r\n".join(f"{k}: {v}" for k, v in pairs if v)
    return {"record_id": record_id, "type": kind, "refers_to": refers_to or None, "target_uri": uri or None, "date": date, "content_type": content_type, "payload_digest": payload_digest or None, "block_digest": block_digest, "headers": headers, "block": block}


def header_pairs(headers: str) -> Headers:
    """Names and values in order, repeated names and all. A line that begins with white space goes on with the one before."""
    out: Headers = []
    for line in headers.split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        else:
            name, _, value = line.partition(":")
            if name.strip():
                out.append((name.strip(), value.strip()))
    return out


def value_of(headers: Headers, name: str) -> str | None:
    """The first value of a header, whose name may be spelt in any case."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _grouped(headers: Headers) -> dict[str, str | list[str]]:
    """As JSON has them: a list for a name that comes several times, under the spelling that came first."""
    spelt: dict[str, str] = {}
    values: dict[str, list[str]] = {}
    for k, v in headers:
        values.setdefault(spelt.setdefault(k.lower(), k), []).append(v)
    return {k: v if len(v) > 1 else v[0] for k, v in values.items()}


def decoded(body: bytes, content_type: str) -> str:
    """Text by the charset of the header, else that of a meta element near the start, else UTF-8; what can't be read becomes U+FFFD."""
    found = _CHARSET.search(content_type)
    name = found[1] if found else (m[1].decode("ascii", "replace") if (m := _DECLARED.search(body[:1024])) else "utf-8")
    try:
        # Pages that say Latin-1 or ASCII are read as Windows-1252, as browsers read them.
        name = {"iso8859-1": "cp1252", "ascii": "cp1252"}.get(codecs.lookup(name).name, name)
        return body.decode(name, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def unchunked(body: bytes) -> bytes:
    """A body without the chunks of its transfer. One that isn't made of chunks, though its header says so, stays as it is."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (m := _CHUNK.fullmatch(body, at, end)):
        size, at = int(m[1], 16), end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            break
        parts.append(body[at : at + size])
        at += size + 2
    return body


def _inflated(data: bytes, raw: bool) -> bytes:
    """All members of gzip data, or a zlib or bare deflate stream."""
    parts = []
    while data:
        stream = zlib.decompressobj(-zlib.MAX_WBITS if raw else zlib.MAX_WBITS + 32)
        parts += [stream.decompress(data), stream.flush()]
        if not stream.eof:
            raise zlib.error("the stream is cut short")
        data = stream.unused_data if not raw and stream.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(parts)


def uncoded(payload: bytes, codings: str) -> bytes | None:
    """A payload without its content codings. What doesn't decode is taken for decoded already; None for a coding that isn't known."""
    for name in reversed([c.strip().lower() for c in codings.split(",") if c.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                payload = _inflated(payload, False)
            elif name == "deflate":
                try:
                    payload = _inflated(payload, False)
                except zlib.error:
                    payload = _inflated(payload, True)
            elif name == "zstd":
                import zstandard

                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload) if payload[:4] == b"\x28\xb5\x2f\xfd" else payload
            elif name != "identity":
                return None
        except zlib.error:
            continue
    return payload


def binary(payload: bytes) -> bool:
    """Whether a payload of no declared type is no text: control bytes near its start, or the mark of a PDF file; a byte order mark says text."""
    head = payload[:1445]
    return not head.startswith((b"\xff\xfe", b"\xfe\xff", b"\xef\xbb\xbf")) and (head.startswith(b"%PDF-") or bool(_CONTROL.search(head)))


def derivatives(source: dict) -> list[dict]:
    """The metadata record of a response and, for a page or other text, its conversion record; none of a record of another type.

    Text is that of the payload without transfer and content codings; one in an
    unknown coding, and one of no declared type that is no text, have none.
    """
    if source["type"] != "response":
        return []
    head, _, body = source["block"].partition(_END.encode())
    status, _, fields = head.decode("latin-1").partition("\r\n")
    http = header_pairs(fields)
    content_type = value_of(http, "Content-Type") or ""
    if "chunked" in (value_of(http, "Transfer-Encoding") or "").lower():
        body = unchunked(body)
    plain = uncoded(body, ",".join(v for k, v in http if k.lower() == "content-encoding"))
    kind = content_type.partition(";")[0].strip().lower()
    seen: dict = {"Response-Message": status, "Headers": _grouped(http), "Entity-Length": len(body), "Entity-Digest": digest(body)}
    text = None
    if plain is not None and kind in _PAGES and (kind or not binary(plain)):
        title, text, links = read_page(decoded(plain, content_type))
        seen["HTML-Metadata"] = {"Title": title, "Links": links}
    elif plain is not None and kind.startswith("text/"):
        text = decoded(plain, content_type)
    envelope = {"Envelope": {"WARC-Header-Metadata": _grouped(header_pairs(source["headers"])), "Payload-Metadata": {"HTTP-Response-Metadata": seen}}}
    ids = {k: named(source["record_id"], k) for k in ("metadata", "conversion")}
    common = {"url": source["target_uri"] or "", "date": source["date"] or "", "refers_to": source["record_id"], "payload_digest": source["payload_digest"] or digest(body)}
    meta = json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    beside = lambda k: () if text is None else (("WARC-Concurrent-To", ids[k]),)
    made = [record("metadata", ids["metadata"], content_type="application/json", block=meta, more=beside("conversion"), **common)]
    if text is not None:
        made.append(record("conversion", ids["conversion"], content_type="text/plain", block=text.encode("utf-8", "surrogatepass"), more=beside("metadata"), **common))
    return made


def _batch(rows: list[dict], keep: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    names = [*FIELDS, "headers"]
    columns = [pa.array([r[n] for r in rows], pa.string()) for n in names] + [pa.array([r["block"] for r in rows], pa.binary())]
    extra = keep or {}
    return pa.RecordBatch.from_arrays([*extra.values(), *columns], [*extra, *names, "block"])


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response record per page, with its id. A null html is an empty payload, a null URL leaves the URI out. Equal rows give equal records."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            yield _batch([response(u or "", h or b"", date, f"{i} {u} {digest(h or b'')}") for i, u, h in rows], {"page_id": part.column("page_id")})

    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, {SCHEMA}")


def derive(records: DataFrame) -> DataFrame:
    """The derivatives of all response records, with the other columns of `records` kept. No shuffle; an empty table gives an empty one."""
    own = [*FIELDS, "headers", "block"]
    fields = [f for f in records.schema.fields if f.name.lower() not in own]
    schema = T.StructType([*fields, *T.StructType.fromDDL(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "block"):
            made = [derivatives(r) for r in part.select(own).to_pylist()]
            at = pa.array([i for i, d in enumerate(made) for _ in d], pa.int64())
            yield _batch([r for d in made for r in d], {f.name: c.take(at) for f, c in zip(fields, part.columns, strict=False)})

    return records.select(*kept(fields), *own).mapInArrow(run, schema)


def write(records: DataFrame, path: str, compression: str | None = None) -> None:
    """WARC files, a part per partition."""
    whole = F.concat(F.lit(f"{VERSION}\r\n").cast("binary"), F.col("headers").cast("binary"), F.lit(_END).cast("binary"), F.col("block"))
    options = {"lineSep": _END} | ({"compression": compression} if compression else {})
    records.select(whole.cast("string").alias("value")).write.options(**options).text(path)


def _fields(headers: bytes) -> Headers:
    return header_pairs(headers.decode("utf-8", "replace"))


def _size(headers: bytes) -> int:
    size = value_of(_fields(headers), "Content-Length")
    if size is None or not size.isdigit():
        raise ValueError(f"a record has no Content-Length: {headers[:200]!r}")
    return int(size)


# Between two pieces of a file stands this mark. Both versions' marks begin alike: the rest of the first line is cut off below.
_MARK = f"{_END}WARC/1."
WHOLE, BEGUN, GOING, ENDED = range(4)


def _record(value: bytes) -> dict:
    headers, _, block = value.partition(_END.encode())
    size, fields = _size(headers), _fields(headers)
    if len(block) < size or block[size:].strip():
        raise ValueError(f"{value_of(fields, 'WARC-Record-ID')}: the block has {len(block)} bytes, its header says {size}")
    get = lambda k: value_of(fields, k) or None
    return {"record_id": get("WARC-Record-ID"), "type": get("WARC-Type"), "refers_to": get("WARC-Refers-To"), "target_uri": get("WARC-Target-URI"), "date": get("WARC-Date"), "content_type": get("Content-Type"), "payload_digest": get("WARC-Payload-Digest"), "block_digest": get("WARC-Block-Digest"), "headers": headers.decode("utf-8", "replace"), "block": block[:size]}


def _joined(rows: Iterator[tuple], strict: bool) -> Iterator[tuple[str, int, int, int, int, bytes]]:
    """file, block, seq, kind, lacks, bytes of the records that begin in a range, and of their pieces that leave it.

    rows: value, file, block (first byte of the range) and owed (bytes that the
    range begins with of a record before it). Without strict what has no length
    is passed over: it may be the inside of a record that isn't known yet.
    """
    mark, at, held, lacks, kind, seq = _MARK.encode(), None, [], 0, WHOLE, 0
    for value, file, block, owed in rows:
        if (file, block) != at:
            if held:
                yield (*at, seq, kind, lacks, b"".join(held))
            at, held, lacks, kind, seq = (file, block), [], owed, GOING if owed else BEGUN, 0
        if held or kind == GOING:
            held += [mark, value]
            lacks -= len(mark) + len(value)
        else:
            record = value.partition(b"\r\n")[2]  # without the version, of which the mark may have left a digit
            headers, _, block_bytes = record.partition(_END.encode())
            try:
                lacks = _size(headers) - len(block_bytes)
            except ValueError:
                if strict:
                    raise
                continue
            held = [record]
        if lacks <= 0:
            yield (*at, seq, ENDED if kind == GOING else WHOLE, 0, b"".join(held))
            held, kind, seq = [], BEGUN, seq + 1
    if held:
        yield (*at, seq, kind, lacks, b"".join(held))


def parse(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files of version 1.0 or 1.1.

    Where a block holds the record mark, it comes in several pieces, which a
    task joins while the header says that more is due. What a range of a file
    owes to the next one (a record that goes on past its end) is found in rounds,
    the first of which assumes that every range begins with a record: as a rule
    it is the last, too. A record that is cut short fails the read.
    """
    raw = spark.read.option("lineSep", _MARK).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in pieces(batches, "value"):
            yield from zip(*(part.column(c).to_pylist() for c in ("value", "file", "block", "owed")), strict=True)

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """file, block, lacks of every range: what it owes to the next one."""
        ends: dict[tuple[str, int], int] = {}

        def seen(source: Iterator[tuple]) -> Iterator[tuple]:
            for r in source:
                ends.setdefault((r[1], r[2]), 0)
                yield r

        for file, block, _, _, lacks, _ in _joined(seen(rows(batches)), False):
            ends[file, block] = lacks
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in ends], pa.string()), pa.array([b for _, b in ends], pa.int64()), pa.array(list(ends.values()), pa.int64())], ["file", "block", "lacks"])

    def owing(owed: DataFrame | None) -> DataFrame:
        # A row for each range that begins inside a record: few, and no more than the ranges that the driver lists itself.
        marked = raw.join(F.broadcast(owed), ["file", "block"], "left") if owed is not None else raw.withColumn("owed", F.lit(0))
        return marked.select("value", "file", "block", F.coalesce("owed", F.lit(0)).cast("bigint").alias("owed"))

    owed, before = None, None
    while True:
        ends = owing(owed).mapInArrow(outcome, "file string, block bigint, lacks bigint")
        along = Window.partitionBy("file").orderBy("block")
        owed = staged(ends.select("file", "block", F.lag("lacks").over(along).alias("owed")).filter("owed > 0"), "owed")
        now = owed.agg(F.count("*"), F.sum(F.xxhash64("file", "block", "owed") % (1 << 40))).first()
        if now == before or not now[0]:
            break
        before = now

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, seq, kind, lacks, value in _joined(rows(batches), True):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([seq], pa.int64()), pa.array([kind], pa.int32()), pa.array([value], pa.binary())], ["file", "block", "seq", "kind", "value"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "value"):
            yield _batch([_record(v) for v in part.column("value").to_pylist()])

    found = owing(owed if now[0] else None).mapInArrow(cut, "file string, block bigint, seq bigint, kind int, value binary")
    whole = found.filter(F.col("kind") == WHOLE).select("value")
    if now[0]:
        left = staged(found.filter(F.col("kind") != WHOLE), "pieces")
        begun = F.sum((F.col("kind") == BEGUN).cast("int")).over(Window.partitionBy("file").orderBy("block", "seq"))
        joined = left.withColumn("of", begun).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("p"))
        whole = whole.unionByName(joined.select(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["value"])).alias("value")))
    else:
        whole = found.select("value")  # a last record that is cut short fails as such
    return whole.mapInArrow(made, SCHEMA)
