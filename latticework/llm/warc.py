"""WARC derivatives: each response gives a linked metadata record and a plain-text conversion record.

Both refer to their response by WARC-Refers-To, with its target and date, keep
its source headers, and carry SHA-1 block and payload digests of their own and
of their source.  Record ids are made from what they name, so reruns agree.

Null html, url, headers or dates count as empty; a response without text still
gives both records, the conversion with an empty block.  Repeated rows repeat
their records, an empty table gives none.  Blocks are whole, however long.
Other columns play no part unless they are carried.

A payload of bytes is kept as it is: source digests are those the source
gives, or are computed from its bytes, and only the text is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.html_blocks import parse
from latticework.llm.runtime import ship, table

DATE = "2024-01-01T00:00:00Z"
#: Records read or derived at a time.
BATCH_ROWS = 128

RESPONSE = "record_id string, target_uri string, warc_date string, http_headers string, payload string"
READ = RESPONSE.replace("payload string", "payload binary") + ", block_digest string, payload_digest string"
DERIVED = (
    "record_type string, record_id string, refers_to string, target_uri string, refers_to_date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, source_block_digest string, source_payload_digest string, source_headers string, block string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name-based id: equal parts, equal id."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def header_fields(headers: str) -> list[tuple[str, str]]:
    """Names and values of an HTTP header block, folded lines joined, the status line left out."""
    lines = re.sub(r"\r?\n[ \t]+", " ", headers).splitlines()
    return [(n.strip(), v.strip()) for n, mark, v in (line.partition(":") for line in lines if not line.upper().startswith("HTTP/")) if mark and n.strip()]


def plain(value: str) -> str:
    """A value on one line, as record fields need it."""
    return " ".join(value.split())


def unchunked(body: bytes) -> bytes:
    """A body without its chunk lines; as it is where it has none, as in files that were stored without."""
    out, at = [], 0
    while mark := re.compile(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n").match(body, at):
        size = int(mark[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[mark.end() : mark.end() + size])
        at = mark.end() + size + 2
    return b"".join(out) if out and at >= len(body) else body


def decoded(headers: str, body: bytes) -> str:
    """The text of a body by its transfer encoding, content encoding and charset; none if it is of no text type."""
    fields = {n.lower(): v for n, v in header_fields(headers)}
    kind = fields.get("content-type", "").lower()
    if kind and not re.match(r"text/|application/[^;]*(html|xml|json|javascript)", kind):
        return ""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for coding in reversed(re.findall(r"[\w-]+", fields.get("content-encoding", "").lower())):
        if coding == "br":  # no decoder here
            return ""
        if coding in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):
                try:
                    body = zlib.decompressobj(bits).decompress(body)
                    break
                except zlib.error:
                    continue
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind)
    meta = re.search(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", body, re.I)
    names = ["utf-8-sig"] if body.startswith(b"\xef\xbb\xbf") else [named[1]] if named else [meta[1].decode()] if meta else []
    for name in [*names, "utf-8"]:
        try:
            return body.decode("cp1252" if name.lower() in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii") else name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("cp1252", "replace")


def derive_one(rid: str, uri: str, date: str, headers: str, body: bytes, block_digest: str = "", payload_digest: str = "", raw: bool = False) -> list[tuple]:
    """The metadata and the conversion record of one response; a body that is not ``raw`` is a text in UTF-8."""
    blocks, title, links = parse(decoded(headers, body) if raw else body.decode("utf-8", "replace"))
    head = headers if not headers or headers.endswith("\r\n\r\n") else headers.rstrip("\r\n") + "\r\n\r\n"
    source = (block_digest or digest(head.encode() + body), payload_digest or digest(body))
    rid = rid or record_id("response", uri, date, *source)
    fields = [("source-record", rid), ("source-block-digest", source[0]), ("source-payload-digest", source[1])]
    fields += [(f"source-header-{n}", v) for n, v in header_fields(headers)]
    fields += [("title", title)] * bool(title) + [("outlink", link) for link in links if link]
    made = (
        ("metadata", "application/warc-fields", "".join(f"{n}: {plain(v)}\r\n" for n, v in fields)),
        ("conversion", "text/plain; charset=utf-8", "".join(b.text + "\n" for b in blocks)),
    )
    out = []
    for kind, content, block in made:
        data = block.encode()
        own = digest(data)
        out.append((kind, record_id(kind, rid, own), rid, uri, date, content, len(data), own, own, *source, headers, block))
    return out


def derivatives(responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns and the derived records of every response (columns of RESPONSE, or of READ with bytes and digests)."""
    kinds = dict(responses.dtypes)
    raw = kinds["payload"] == "binary"
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), DERIVED])
    names = [c.split()[0] for c in DERIVED.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.string() for c in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                rows, back = [], []
                for i, row in enumerate(zip(*(c.to_pylist() for c in part.columns[:7]), strict=True)):
                    made = derive_one(*row, raw)
                    rows += made
                    back += [i] * len(made)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(back, pa.int32())) for c in part.columns[7:]), *cols], [*carry, *names])

    given = [F.coalesce(responses[c].cast("string"), F.lit("")).alias(f"__{c}") for c in ("record_id", "target_uri", "warc_date", "http_headers")]
    given.append(F.coalesce(responses["payload"].cast("binary"), F.lit(b"")).alias("__payload"))
    given += [(F.coalesce(responses[c], F.lit("")) if c in kinds else F.lit("")).alias(f"__{c}") for c in ("block_digest", "payload_digest")]
    return responses.select(*given, *[responses[c] for c in carry]).mapInArrow(run, schema)


def page_responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Responses of a crawl of ``pages``: RESPONSE columns beside the page's id."""
    key = F.sha2(F.concat_ws("\0", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    rid = F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * (i > 0) + [F.substring(key, a, n)])], F.lit(">"))
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def written(record: dict, made: str | None = None) -> bytes:
    """A derived record as it stands in a WARC file.

    ``made`` is the time of its making, that of the response where none is
    given.  Digests and HTTP headers of the source stand in extension fields,
    one for each header line, so that a conversion record keeps them too.
    """
    fields = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", made or record["refers_to_date"]), ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Refers-To", record["refers_to"]), ("WARC-Refers-To-Target-URI", record["target_uri"]), ("WARC-Refers-To-Date", record["refers_to_date"]),
        ("WARC-Block-Digest", record["block_digest"]), ("WARC-Payload-Digest", record["payload_digest"]),
        ("X-Source-Block-Digest", record["source_block_digest"]), ("X-Source-Payload-Digest", record["source_payload_digest"]),
        *((f"X-Source-Header-{n}", v) for n, v in header_fields(record["source_headers"] or "")),
        ("Content-Type", record["content_type"]), ("Content-Length", str(record["content_length"])),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{n}: {plain(v)}\r\n" for n, v in fields if v) + "\r\n").encode() + record["block"].encode() + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased fields, block) of each record of a WARC file, compressed by record or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0:
            return
        fields = {n.lower(): v for n, v in header_fields(data[at:cut].decode("utf-8", "replace").partition("\r\n")[2])}
        size = int(fields.get("content-length") or 0)
        yield fields, data[cut + 4 : cut + 4 + size]
        at = cut + 4 + size


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """READ rows of the response records in WARC files; a file is one row of at most 2 GB while it is read."""
    ship(spark)
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.binary() if c.endswith(" binary") else pa.string() for c in READ.split(", ")]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows: list[tuple] = []
                for fields, block in read_records(data.as_py()):
                    if fields.get("warc-type") == "response":
                        head, mark, body = block.partition(b"\r\n\r\n")
                        rows.append((fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), (head + mark).decode("utf-8", "replace"), body, fields.get("warc-block-digest") or digest(block), fields.get("warc-payload-digest") or digest(body)))
                    if len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def serialised(derived: DataFrame, compress: bool = True, made: str | None = None) -> DataFrame:
    """record_id and warc: each record's bytes (a gzip member of its own), ready to be laid end to end; ``made`` as in written()."""
    names = [c.split()[0] for c in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [written(r, made) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([gzip.compress(r, mtime=0) if compress else r for r in rows], pa.binary())], ["record_id", "warc"])

    return derived.select(*names).mapInArrow(run, "record_id string, warc binary")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(page_responses(table(spark, sf_dir, "pages")), carry=("page_id",))


QUERIES = {"op1_warc_derivatives": op1_warc_derivatives}
SQL: dict[str, str] = {}
