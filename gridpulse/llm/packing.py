"""Bounded-space online packing of documents into fixed-length training sequences.

Each partition keeps at most ``open_windows`` unfinished windows. A document's
ids are cut into whole sequences and a rest; the rest goes where it leaves the
least room (best fit), and when it fits nowhere the fullest window is emitted and a new
one opened. What stays open at the end of each partition, a bounded number of windows, is merged:
neighbouring partitions form groups, and each group's open pieces are packed once more,
longest first. Memory is bounded by the window count, whatever the partition holds.
"""
from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import run_folder, text_of, written
from .encoding import BYTE_BPE, END_ID, encoder

LENGTH = 2048
OPEN_WINDOWS = 128
#: Partitions whose leftovers are merged together: at most 16 * 128 windows in one group.
MERGED_PARTITIONS = 16

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """At most ``limit`` unfinished windows of ``length`` ids; ``place`` returns the windows that are emitted."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.pieces: dict[int, list] = {}
        self.next = 0

    def place(self, piece: tuple, n: int) -> list[list]:
        out = []
        at = bisect_left(self.room, (n, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) == self.limit:
                out.append(self.pieces.pop(self.room.pop(0)[1]))  # the fullest
            room, window = self.length, self.next
            self.next += 1
            self.pieces[window] = []
        self.pieces[window].append(piece)
        if room == n:
            out.append(self.pieces.pop(window))
        else:
            insort(self.room, (room - n, window))
        return out


def pack(docs: DataFrame, folder: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, vocabulary: str = BYTE_BPE,
         id_column: str = "doc_id", text_column: str = "text", tokenizers: str | None = None, end_id: int = END_ID,
         merged_partitions: int = MERGED_PARTITIONS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    ``start``: the document's ids before the piece; ``offset``: its place in the sequence, gapless from 0;
    ``doc_tokens`` counts the end id that every document gets. A null text counts as empty and gives the end id alone;
    a null id is kept; repeated rows are documents of their own; texts longer than a sequence are cut;
    an empty table gives no row. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("i"), text_of(text_column).alias("t"))

    def frame(pa, kinds, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    def online(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open_in", pa.int64())])
        windows, end, sequence, rows, held = OpenWindows(length, open_windows), np.array([end_id], "<u4").tobytes(), part << 32, [], 0

        def emit(pieces, open_in):
            nonlocal sequence, held
            offset = 0
            for piece in pieces:
                rows.append((*piece, sequence, offset, open_in))
                offset += piece[2]
            held += 4 * offset
            sequence += 1

        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary, tokenizers).encode_column(batch.column(1))):
                ids += end
                total = len(ids) // 4
                whole = total // length * length
                for start in range(0, whole, length):
                    emit([(i, start, length, ids[4 * start:4 * (start + length)], total)], None)
                if total > whole:
                    for done in windows.place((i, whole, total - whole, ids[4 * whole:], total), total - whole):
                        emit(done, None)
                if held > 4_000_000:
                    yield frame(pa, kinds, rows)
                    rows, held = [], 0
        for left in windows.pieces.values():
            emit(left, part)
        if rows:
            yield frame(pa, kinds, rows)

    first = rows.mapInArrow(online, f"{PIECES}, open_in long")
    path = f"{folder}/pieces"
    first.write.option("compression", "zstd").parquet(path)
    first = docs.sparkSession.read.schema(first.schema).parquet(path)

    def merge(key, batches):
        """Best fit of one group's open pieces, longest first."""
        import pyarrow as pa
        table = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        cells = table.to_pydict()
        order = sorted(range(table.num_rows), key=lambda k: (-cells["length"][k], cells["sequence_id"][k], cells["offset"][k]))
        windows, number, out = OpenWindows(length, table.num_rows + 1), (1 << 62) | (key[0].as_py() << 32), []
        done = [w for k in order for w in windows.place(k, cells["length"][k])]
        for window in [*done, *windows.pieces.values()]:
            offset = 0
            for k in window:
                out.append([cells[c][k] for c in ("doc_id", "start", "length", "ids", "doc_tokens")] + [number, offset])
                offset += cells["length"][k]
            number += 1
        kinds = pa.schema([f for f in table.schema if f.name in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)

    group = F.floor(F.col("open_in") / merged_partitions).cast("long")
    merged = first.filter("open_in is not null").withColumn("g", group).groupBy("g").applyInArrow(merge, PIECES)
    return first.filter("open_in is null").drop("open_in").union(merged)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the digest of their ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), run_folder(spark, "packing"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
