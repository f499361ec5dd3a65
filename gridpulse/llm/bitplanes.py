"""Token-id files in bit or byte planes.

A file holds the ids of one range of documents in blocks of a fixed number of
ids. A block's uint32 ids are transposed into 4 byte planes (or 32 bit
planes), each plane is compressed with zstandard on its own, so the planes
that vocabulary sizes leave empty cost a few bytes. Behind the blocks stand the
document table (id, number of ids) and the chunk index: offset, ids and plane lengths
of each block, by which any block can be read alone.

    magic | planes of block 0 | ... | document table | chunk index (JSON) | its length (8 bytes) | magic

Files are written to a name of their own first and then moved, so a task that
runs twice, or is lost half-way, leaves whole files only.
"""
from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, run_folder, text_of, written
from .encoding import END_ID, WORD_BPE, encoder

MAGIC = b"IDPLANE1"
#: Ids in a block.
BLOCK_IDS = 65_536
LEVEL = 3


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first; a bit plane is padded with zeros to whole bytes."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(len(ids), 4)
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(cells.T)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(n)


class PlaneWriter:
    """Writes one file; memory holds one block and the document table of 17 bytes a document."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL):
        import zstandard
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.chunks: list[list] = []
        self.docs, self.sizes, self.nulls = [], [], []
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.at = out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_waiting >= self.block_ids:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, whole, self.block_ids):
            block = ids[i:min(i + self.block_ids, whole)]
            packed = [self.packer.compress(p) for p in to_planes(block, self.kind)]
            self.chunks.append([self.at, len(block), [len(p) for p in packed]])
            self.at += self.out.write(b"".join(packed))
        self.waiting, self.n_waiting = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> int:
        self._blocks(last=True)
        table = self.packer.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes())
        index = json.dumps({"kind": self.kind, "ids": self.n_ids, "docs": len(self.docs), "table": [self.at, len(table)], "chunks": self.chunks}).encode()
        self.at += self.out.write(table) + self.out.write(index) + self.out.write(struct.pack("<Q", len(index)) + MAGIC)
        return self.at


class PlaneReader:
    """Reads one file by its chunk index."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a whole id-plane file")
        n, = struct.unpack("<Q", tail[:8])
        self.index = json.loads(self._at(size - 16 - n, n))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, number of ids, whether the id is null) of each document in order."""
        import zstandard
        raw, n = zstandard.ZstdDecompressor().decompress(self._at(*self.index["table"])), self.index["docs"]
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "u1", n, 16 * n).astype(bool)

    def block(self, i: int) -> np.ndarray:
        """Ids of one block, read alone."""
        import zstandard
        offset, n, lengths = self.index["chunks"][i]
        raw, planes, unpack = self._at(offset, sum(lengths)), [], zstandard.ZstdDecompressor()
        for k in lengths:
            planes.append(unpack.decompress(raw[:k]))
            raw = raw[k:]
        return from_planes(planes, n, self.index["kind"])

    def texts(self) -> Iterator[tuple[int | None, list[bytes]]]:
        """(document, its ids as pieces of bytes) in order; a document may lie in several blocks."""
        ids, at, chunk = b"", 0, 0
        for doc, n, null in zip(*self.documents()):
            pieces, left = [], 4 * int(n)
            while left:
                if at == len(ids):
                    ids, at, chunk = self.block(chunk).tobytes(), 0, chunk + 1
                pieces.append(ids[at:at + left])
                at += len(pieces[-1])
                left -= len(pieces[-1])
            yield None if null else int(doc), pieces


def write_ids(docs: DataFrame, folder: str, vocabulary: str = WORD_BPE, kind: str = "byte", block_ids: int = BLOCK_IDS,
              id_column: str = "doc_id", text_column: str = "text", tokenizers: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each document and write the ids in ascending id order.

    Returns the manifest (shard, path, docs, ids, bytes), a row for each file; shards ascend with the
    document ids. A null text counts as empty; a null id comes first; rows with equal ids stand in the
    order of their texts' hashes and texts; an empty table gives no file. Other columns are not read.
    """
    if kind not in ("byte", "bit"):
        raise ValueError("kind is 'byte' or 'bit'")
    spark = docs.sparkSession
    rows = (docs.select(F.col(id_column).cast("long").alias("i"), text_of(text_column).alias("t"))
            .withColumn("h", F.xxhash64("t")))
    rows = rows.repartitionByRange("i", "h").sortWithinPartitions("i", "h", "t").select("i", "t")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        writer = None
        files, path = file_system(folder)
        mine = f"{path}/.{shard:07d}-{uuid.uuid4().hex}"
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if writer is None and batch.num_rows:
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(mine, compression=None)
                writer = PlaneWriter(out, kind, block_ids)
            for i, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary, tokenizers).encode_column(batch.column(1))):
                writer.add(i, ids + end)
        if writer is not None:
            size = writer.close()
            out.close()
            name = f"{path}/ids-{shard:07d}.planes"
            files.move(mine, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name.rsplit("/", 1)[1]], "docs": [len(writer.docs)], "ids": [writer.n_ids], "bytes": [size]},
                                             schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    return written(rows.mapInArrow(write, "shard long, file string, docs long, ids long, bytes long"), folder, "manifest")


def read_ids(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files of ``manifest``, read back block by block.

    ``start``: ids of all documents before it. ``ids``: little-endian uint32, null unless asked for.
    The running total over files is one row a file, not a row a document.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("shard", "file", before.alias("base"))
    files = files.repartition(max(1, manifest.count()), "shard")

    def read(batches):
        import pyarrow as pa
        source, path = file_system(folder)
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with source.open_input_file(f"{path}/{name}") as file:
                    rows, held = [], 0
                    for doc, pieces in PlaneReader(file).texts():
                        n, crc = sum(map(len, pieces)) // 4, 0
                        for p in pieces:
                            crc = zlib.crc32(p, crc)
                        rows.append((doc, start, n, crc, b"".join(pieces) if with_ids else None))
                        start += n
                        held += 4 * n * with_ids + 64
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op7_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files over all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    folder = run_folder(spark, "bitplanes")
    manifest = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_ids(spark, manifest, folder, with_ids=False).drop("ids")
