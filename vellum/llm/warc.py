"""WARC files: writing, and normalising a monolithic gzip stream to one member a record with an offset index.

A monolithic archive is one gzip stream over the whole file, so no record can be read without inflating all
before it. ``normalise`` inflates such a stream once, in pieces, cuts it into records by their
Content-Length, writes every record as a gzip member of its own and a sidecar with a line per record
(``offset length id type``), by which single records are read. It holds one record at a time.

``archive`` writes pages: of records with equal payloads of at least ``SMALLEST`` bytes the one with the
largest page_id is a response and the others are revisits that refer to it. Files carry their attempt's own
name and count only through the manifest of the attempt that succeeded; remains of lost tasks are not read.

Defined results: null html is an empty payload, a null url gives no target; rows without page_id are
responses; repeated rows of the largest page_id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, lean, shared_folder, table, written
from .ordered import parts_for

#: Bytes from which equal payloads become revisits.
SMALLEST = 1000
#: Payload bytes of a file.
FILE_BYTES = 32 << 20
#: Tasks that the copies of one payload are dealt to.
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
_ID = "<urn:page:%s>"


def warc_record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to=None) -> bytes:
    """A response with its payload, or without it a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_ID % page_id}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_ID % refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """A record's headers (lower-case names), its block's HTTP headers and its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin1").split("\r\n")[1:])}
    return {"fields": fields, "http": sent, "payload": payload}


def inflated(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, in pieces."""
    z = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            yield z.decompress(data, 4 * size)
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail


def records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Cuts a WARC stream into records, each with its two closing line ends."""
    held, need, source = bytearray(), 0, iter(pieces)
    while True:
        if not need:
            end = held.find(b"\r\n\r\n")
            if end >= 0:
                found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", held[:end])
                if not found:
                    raise ValueError("a record without Content-Length")
                need = end + 8 + int(found[1])
        if need and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            need = 0
            continue
        piece = next(source, None)
        if piece is None:
            if held.strip():
                raise ValueError("the stream ends within a record")
            return
        held += piece


def normalise(stream, out) -> Iterator[tuple[int, int, str, str]]:
    """Rewrites a monolithic stream to out, a member a record; yields offset, length, id and type of each."""
    at = 0
    for record in records(inflated(stream)):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        out.write(member)
        fields = parse(record)["fields"]
        yield at, len(member), fields["warc-record-id"], fields["warc-type"]
        at += len(member)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and size of each payload, which goes on compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha1(x).hexdigest() for x in raw]), pa.array([press.compress(x) for x in raw], pa.binary())],
            names=["page_id", "url", "size", "digest", "packed"],
        )


def _write(folder: str, file_bytes: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        open_, inflate = None, zstandard.ZstdDecompressor()

        def close():
            out, z, name, n, _ = open_
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, size, digest, packed, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "size", "digest", "packed", "refers_to")), strict=True):
                if open_ and open_[4] >= file_bytes:
                    yield close()
                    open_ = None
                if not open_:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    open_ = [fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), name, 0, 0]
                payload = inflate.decompress(packed) if refers is None else None
                record = warc_record(page_id, url, payload, size, digest, refers)
                open_[0].write(open_[1].compress(record))
                open_[3] += 1
                open_[4] += len(record)
        if open_:
            yield close()

    return f


def archive(pages: DataFrame, folder: str, smallest: int = SMALLEST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes monolithic archives of pages (page_id, url, html); the manifest: file, records."""
    packed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html")).mapInArrow(lean(_pack), "page_id long, url string, size long, digest string, packed binary")
    # digests of null html are those of the empty text, which is small
    digests = pages.select(F.sha1(F.encode("html", "UTF-8")).alias("d"), F.octet_length("html").alias("size"), F.col("page_id").cast("long").alias("page_id")).where(F.col("size") >= smallest)
    kept = digests.groupBy("d").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    dealt = packed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(kept, (dealt["digest"] == kept["d"]) & (dealt["salt"] == kept["s"]), "left")
    refers = F.when((F.col("size") >= smallest) & (F.col("page_id") < F.col("kept")), F.col("kept"))
    return written(joined.select("page_id", "url", "size", "digest", "packed", refers.alias("refers_to")).mapInArrow(lean(_write(folder, file_bytes)), "file string, records long"), "monoliths")


def _normalise(source: str, target: str):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(source)
        to, out_base = filesystem(target)
        to.create_dir(out_base, recursive=True)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream, to.open_output_stream(f"{out_base}/{name}", compression=None) as out, to.open_output_stream(f"{out_base}/{name}.idx") as index:
                    n = 0
                    for entry in normalise(stream, out):
                        index.write(("\t".join(map(str, entry)) + "\n").encode())
                        n += 1
                yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return f


def normalised(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Every file of a manifest as a file with a member a record and its sidecar; the new manifest."""
    return written(manifest.select("file").repartition(parts_for(manifest), "file").mapInArrow(lean(_normalise(source, target)), "file string, records long"), "members")


def read_member(file, offset: int, length: int) -> dict:
    """One record by its index entry, without reading what stands before it."""
    file.seek(offset)
    return parse(zlib.decompress(file.read(length), 31))


def _read(folder: str):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{base}/{name}.idx") as x:
                    entries = [e.split("\t") for e in x.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(f"{base}/{name}") as file:
                    for offset, length, *_ in entries:
                        r = read_member(file, int(offset), int(length))
                        fields = r["fields"]
                        if fields["warc-type"] == "response":
                            size, digest, refers = len(r["payload"]), hashlib.sha1(r["payload"]).hexdigest(), None
                        else:
                            size, digest, refers = int(r["http"]["content-length"]), base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), _number(fields["warc-refers-to"])
                        rows.append((_number(fields["warc-record-id"]), size, digest, fields["warc-type"], refers))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return f


def _number(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id)
    return int(found[1]) if found else None


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record of normalised files: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return manifest.select("file").repartition(parts_for(manifest), "file").mapInArrow(lean(_read(folder)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, members = shared_folder(spark, "warc-monolithic"), shared_folder(spark, "warc-members")
    return read(normalised(archive(table(spark, sf_dir, "pages"), raw), raw, members), members)


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
g as (select html, max(page_id) as kept from p where n >= 1000 group by html)
select p.page_id, cast(p.n as bigint) as payload_bytes, sha1(p.html) as payload_digest,
  case when p.page_id < g.kept then 'revisit' else 'response' end as record_type,
  case when p.page_id < g.kept then g.kept end as refers_to
from p left join g on p.html = g.html
"""
