"""WARC archives: one gzip member a record, written and read back in sequence.

Of records with equal payloads of at least MIN_REVISIT bytes the one of smallest id is a response and
holds the payload; the others are revisits that hold the HTTP header alone and refer to it by
record id. Every record names the digest and, in its HTTP header, the length of the full payload.

Reading is sequential: a member is decompressed piece by piece, the record's header ends at an
empty line, its Content-Length frames the block, and both digests of a response are verified.
"""
from __future__ import annotations

from collections.abc import Iterator
import base64
import hashlib
import re
from urllib.parse import quote, unquote
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ringside.llm import files
from ringside.llm.common import blocks, mapped, new_path, spread, store

MIN_REVISIT = 100
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 64 << 10
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(key: int | None, rid: int) -> str:
    return f"<urn:x-record:{'null' if key is None else key}:{rid}>"


def parse_id(text: str) -> tuple[int | None, int]:
    key, rid = re.fullmatch(r"<urn:x-record:(null|-?\d+):(\d+)>", text).groups()
    return None if key == "null" else int(key), int(rid)


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha256(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", len(block))]), b"", b""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"\r\n".join(lines) + block + b"\r\n\r\n") + squeeze.flush()


class Members:
    """The bytes of one gzip member after another, from a stream that is read piece by piece."""

    def __init__(self, stream):
        self.stream, self.left = stream, b""

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self.left or self._more():
            expand = zlib.decompressobj(31)

            def pieces():
                while not expand.eof:
                    if not self.left and not self._more():
                        raise ValueError("an archive ends within a record")
                    data, self.left = self.left, b""
                    while not expand.eof:
                        piece = expand.decompress(data, READ_BYTES)
                        data = expand.unconsumed_tail
                        if piece:
                            yield piece
                        elif not data:
                            break
                    if expand.eof:
                        self.left = expand.unused_data

            member = pieces()
            yield member
            for _ in member:  # whatever a reader has left of it
                pass

    def _more(self) -> bool:
        self.left = self.stream.read(READ_BYTES)
        return bool(self.left)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    for member in Members(stream):
        held = b""
        while b"\r\n\r\n" not in held:
            piece = next(member, None)
            if piece is None:
                raise ValueError("a record has no end of header")
            held += piece
        head, _, body = held.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:20]}")
        fields = dict(line.split(": ", 1) for line in lines)
        parts, have, need = [body], len(body), int(fields["Content-Length"])
        for piece in member:
            parts.append(piece)
            have += len(piece)
        whole = b"".join(parts)
        if have != need + 4 or whole[need:] != b"\r\n\r\n":
            raise ValueError(f"{fields.get('WARC-Record-ID')}: Content-Length {need} doesn't frame {have - 4} bytes")
        yield fields, whole[:need]


def write(pages: DataFrame, key: str = "page_id", url: str | None = "url", payload: str = "html") -> tuple[str, DataFrame]:
    """Write one record a row; the folder and a manifest (file) of its archives. Null payloads are empty, keys are
    integers or null (null last, then in the order read), a missing address is left out."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce(pages[f"`{payload}`"], F.lit("")), "utf-8")
    address = pages[f"`{url}`"] if url else F.lit(None).cast("string")
    rows = store(pages.select(F.monotonically_increasing_id().alias("rid"), pages[f"`{key}`"].cast("long").alias("key"), address.alias("url"), body.alias("payload"),
                              F.sha2(body, 256).alias("digest")), "pages")
    # equal payloads: groups of two and more, found from digests alone
    first = F.min(F.struct(F.col("key").isNull().alias("unkeyed"), F.col("key").alias("key"), F.col("rid").alias("rid"), F.col("url").alias("url")))
    repeated = (rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    narrow = rows.where(F.octet_length("payload") >= MIN_REVISIT).select("rid", "digest")
    revisits = narrow.join(repeated, "digest").where(F.col("rid") != F.col("first.rid")).select("rid", "first")
    rows = rows.join(store(revisits, "revisits"), "rid", "left").select("rid", "key", "url", "payload", F.col("first.key").alias("to_key"), F.col("first.rid").alias("to_rid"), F.col("first.url").alias("to_url"))
    folder = new_path(spark, "archives")
    files.make_folder(folder)

    def run(batches):
        from pyspark import TaskContext
        part, turn, out = TaskContext.get().partitionId(), 0, None
        for block, payloads in blocks(batches, "payload"):
            columns = [block.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)]
            for data, rid, own, address, to_key, to_rid, to_address in zip(payloads, *columns):
                if out is None:
                    name = f"{part:08d}-{turn:06d}.warc.gz"
                    out = files.Writer(f"{folder}/{name}")
                http = _HTTP % len(data)
                fields = [("WARC-Record-ID", record_id(own, rid)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
                if address is not None:
                    fields.append(("WARC-Target-URI", quote(address, safe="!#$%&'()*+,/:;=?@[]~")))
                fields.append(("WARC-Payload-Digest", f"sha256:{digest32(data)}"))
                if to_rid is None:
                    block_ = http + data
                    fields = [("WARC-Type", "response"), *fields]
                else:
                    block_ = http
                    fields = [("WARC-Type", "revisit"), *fields, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(to_key, to_rid))]
                    if to_address is not None:
                        fields.append(("WARC-Refers-To-Target-URI", quote(to_address, safe="!#$%&'()*+,/:;=?@[]~")))
                out.write(record([*fields, ("WARC-Block-Digest", f"sha256:{digest32(block_)}")], block_))
                if out.size >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])
                    turn, out = turn + 1, None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return folder, store(mapped(rows, run, "file string"), "manifest")


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """key, url, payload (null of revisits), payload_bytes, payload_digest, record_type and refers_to of every record.

    A record whose block or payload doesn't have the digest or length that its header names is an error.
    """
    names = ["key", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.reader(f"{folder}/{name}") as stream:
                    rows, size = [], 0
                    for fields, block in records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                        named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        kept = fields["WARC-Type"] == "response"
                        if fields["WARC-Block-Digest"] != f"sha256:{digest32(block)}" or kept and (length != len(payload) or named != digest32(payload)):
                            raise ValueError(f"{fields['WARC-Record-ID']}: digest or length is wrong")
                        address = fields.get("WARC-Target-URI")
                        rows.append((parse_id(fields["WARC-Record-ID"])[0], None if address is None else unquote(address), payload if kept else None, length, base64.b32decode(named).hex(),
                                     fields["WARC-Type"], parse_id(fields["WARC-Refers-To"])[0] if "WARC-Refers-To" in fields else None))
                        size += len(block) + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return mapped(spread(manifest), run, "key bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
