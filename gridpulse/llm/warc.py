"""WARC archives: one gzip member per record, written per partition and read back sequentially.

The reader takes the archive in small blocks, inflates member by member (``zlib.decompressobj`` tells
where a member ends), frames each record by its Content-Length and checks block and payload digests.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, run_folder, text_of, written

#: Equal payloads of fewer bytes are stored again.
MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 16
LEVEL = 3


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    """The page that a record id of this writer names; None of any other."""
    own = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(own[1]) if own else None


class DamagedArchive(ValueError):
    """A record that can't be read as it says, or that differs from its digest."""


def verify(named: str | None, data: bytes, what: str) -> None:
    """Check a digest ``algorithm:value`` (hexadecimal or base 32); one that is missing or of an unknown algorithm is passed over."""
    algorithm, _, value = (named or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return
    digest = hashlib.new(algorithm, data).digest()
    if value.lower() != digest.hex() and value.upper().rstrip("=") != base64.b32encode(digest).decode().rstrip("="):
        raise DamagedArchive(f"{what} digest differs")


def to_record(page_id: int | None, url: str | None, payload: bytes, sha256: str, refers_to: int | None) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    # a URI holds no white space or control characters
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{sha256}",
            "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(file, read_bytes: int = READ_BYTES) -> Iterator[Iterator[bytes]]:
    """For each gzip member an iterator of its inflated parts; the file is read once, in blocks."""
    left = b""

    def parts():
        nonlocal left
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            left = left or file.read(read_bytes)
            if not left:
                raise DamagedArchive("the archive ends within a record")
            try:
                yield inflate.decompress(left)
            except zlib.error as bad:
                raise DamagedArchive("not a gzip member") from bad
            left = inflate.unused_data
    while left := left or file.read(read_bytes):
        one = parts()
        yield one
        for _ in one:  # what the caller left
            pass


class _Framed:
    """Reads a member's parts up to a mark or a length."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.rest = parts, b""

    def _more(self) -> bytes:
        for part in self.parts:
            return part
        raise DamagedArchive("a record ends within its header or block")

    def until(self, mark: bytes) -> bytes:
        while (at := self.rest.find(mark)) < 0:
            self.rest += self._more()
        head, self.rest = self.rest[:at], self.rest[at + len(mark):]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            self.rest = self.rest or self._more()
            part, self.rest = self.rest[:n], self.rest[n:]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(file) -> Iterator[dict]:
    """Every record: its fields, payload length (of a revisit that of the HTTP header, None without) and payload (None of a revisit).

    The payload of an HTTP response or request is what follows its header, of any other record the block. Digests that are there are verified;
    ``DamagedArchive`` is raised for anything else than whole records.
    """
    for parts in members(file):
        framed = _Framed(parts)
        record = fields(framed.until(b"\r\n\r\n"))
        if not record.get("content-length", "").isdigit() or "warc-type" not in record:
            raise DamagedArchive("a record without a type or a length")
        block = b"".join(framed.take(int(record["content-length"])))
        if b"".join([framed.rest, *framed.parts]) != b"\r\n\r\n":
            raise DamagedArchive("a record doesn't end where its Content-Length says")
        verify(record.get("warc-block-digest"), block, "block")
        http, _, payload = block.partition(b"\r\n\r\n") if record.get("content-type", "").startswith("application/http") else (b"", b"", block)
        if record["warc-type"] == "revisit":
            length = fields(http).get("content-length", "")
            record["payload_bytes"] = int(length) if length.isdigit() else None
        else:
            verify(record.get("warc-payload-digest"), payload, "payload")
            record["payload_bytes"], record["payload"] = len(payload), payload
        yield record


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", body_column: str = "html",
                   min_revisit_bytes: int = MIN_REVISIT_BYTES, level: int = LEVEL) -> DataFrame:
    """Write one record per row into archives in ``folder``; returns the manifest (shard, file, records, bytes).

    Of rows with equal payloads (SHA-256 over UTF-8) of ``min_revisit_bytes`` or more, the smallest id is the response and
    the others revisit it; a null body is an empty payload. Rows that repeat an id: each is a record; those with the smallest id of their
    payload are all responses. A null id is never referred to: it revisits if a row with an id has its payload, else it is a response.
    An empty table gives no archive. Other columns are not read.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("i"), F.col(url_column).cast("string").alias("u"), text_of(body_column).cast("binary").alias("b"))
    rows = rows.withColumn("d", F.sha2("b", 256))
    # one row for each payload that came more than once: combined before the shuffle, so copies by the thousand are one row a task
    first = (rows.filter(F.octet_length("b") >= min_revisit_bytes).groupBy("d").agg(F.min("i").alias("f"), F.count("*").alias("n"))
             .filter("n > 1").select("d", "f"))
    first = written(first, folder, "first")
    rows = rows.join(first, "d", "left").select("i", "u", "b", "d", F.when(F.col("i").isNull() | (F.col("f") < F.col("i")), F.col("f")).alias("f"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        shard, records, size, out = TaskContext.get().partitionId(), 0, 0, None
        files, path = file_system(folder)
        mine = f"{path}/.{shard:07d}-{uuid.uuid4().hex}"
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(mine, compression=None)
            for i, u, b, d, f in zip(*(map(lambda x: x.as_py(), c) for c in batch.columns)):
                size += out.write(gzip_member(to_record(i, u, b, d, f), level))
                records += 1
        if out is not None:
            out.close()
            files.move(mine, f"{path}/pages-{shard:07d}.warc.gz")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"pages-{shard:07d}.warc.gz"], "records": [records], "bytes": [size]})

    return written(rows.mapInArrow(write, "shard long, file string, records long, bytes long"), folder, "manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every response and revisit of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null of revisits).

    page_id and refers_to are null where a record's id isn't one of this writer's; a digest of another algorithm than SHA-256 keeps its name in front.
    """
    files = manifest.select("shard", "file").repartition(max(1, manifest.count()), "shard")

    def read(batches):
        import pyarrow as pa
        source, path = file_system(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(1).to_pylist():
                with source.open_input_stream(f"{path}/{name}", compression=None) as file:
                    rows, held = [], 0
                    for r in read_records(file):
                        if r["warc-type"] not in ("response", "revisit"):
                            continue
                        payload = r.get("payload")
                        rows.append((page_of(r.get("warc-record-id")), r.get("warc-target-uri"), r["payload_bytes"], (r.get("warc-payload-digest") or "").removeprefix("sha256:") or None, r["warc-type"],
                                     page_of(r.get("warc-refers-to")), payload if with_payload else None))
                        held += 256 + len(payload or b"") * with_payload
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    folder = run_folder(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder, with_payload=False).drop("payload", "url")
