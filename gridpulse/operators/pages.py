"""R21 on stored lists: a list is written once in its order, range-partitioned, with an index of row count and first key per file; a page then reads
only the files that hold it, however deep it lies.

``PagedList.page`` is OFFSET/LIMIT, ``PagedList.after`` the rows behind a given one. Order columns ascend, nulls first, as in Spark's sort; columns
of the list that the order leaves out are appended to it, so that the order is total but for equal rows, which are interchangeable.
The index has one row per file (``rows_per_file`` bounds their number) and is the only thing that comes to the driver.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import VersionedStore

ROWS_PER_FILE = 1_000_000


def _behind(order: list[str], key: dict) -> Column:
    """Rows whose order columns come behind those of ``key``."""
    out, equal = F.lit(False), F.lit(True)
    for c in order:
        more = F.col(c).isNotNull() if key[c] is None else F.coalesce(F.col(c) > F.lit(key[c]), F.lit(False))
        out, equal = out | (equal & more), equal & F.col(c).eqNullSafe(F.lit(key[c]))
    return out


class PagedList:
    """A stored list of one version of ``store``; make it with ``write``."""

    def __init__(self, store: VersionedStore, name: str, manifest: dict | None = None):
        manifest = manifest or store.manifest()
        self.store, self.folder, self.order = store, store.full(manifest["tables"][name]), manifest["notes"][f"order of {name}"]
        index = store.spark.read.parquet(store.full(manifest["tables"][f"{name}-index"])).orderBy("first").collect()
        self.files, self.starts, self.rows = [r["file"] for r in index], [], 0
        for r in index:
            self.starts.append(self.rows)
            self.rows += r["rows"]
        self.firsts = [r["first"].asDict() for r in index]
        self.schema = store.spark.read.parquet(self.folder).schema

    @classmethod
    def write(cls, df: DataFrame, order: list[str], store: VersionedStore, name: str, rows_per_file: int = ROWS_PER_FILE) -> PagedList:
        """Store ``df`` as a list: it is computed once, into loose files; their rows are counted and sampled, shuffled by range and written in order; the index
        takes each file's rows and first row."""
        order = [*order, *(c for c in df.columns if c not in order)]
        base, folder, index = store.manifest(), store.new_folder(name), store.new_folder(f"{name}-index")
        loose = store.full(store.new_folder(f"{name}-loose"))  # named by no manifest: expire() removes it by age
        df.sortWithinPartitions(*order).write.parquet(loose)  # neighbours that resemble each other are small in the shuffle
        rows = store.spark.read.schema(df.schema).parquet(loose)
        files = max(1, -(-rows.count() // rows_per_file))
        rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 2 * rows_per_file).parquet(store.full(folder))
        written, file = store.spark.read.schema(df.schema).parquet(store.full(folder)), F.col("_metadata.file_path").alias("file")
        firsts = written.where("_metadata.row_index = 0").select(file, F.struct(*order).alias("first"))  # files are sorted
        per_file = written.select(file).groupBy("file").agg(F.count(F.lit(1)).alias("rows")).join(firsts, "file")
        per_file.coalesce(1).write.parquet(store.full(index))
        store.commit({name: folder, f"{name}-index": index}, base, {f"order of {name}": order})
        return cls(store, name)

    def _read(self, first: int, last: int) -> DataFrame:
        """Files ``first`` to ``last``, not included."""
        reader = self.store.spark.read.schema(self.schema)
        return reader.parquet(*self.files[first:last]) if first < last else self.store.spark.createDataFrame([], self.schema)

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the list."""
        first = max((k for k, s in enumerate(self.starts) if s <= offset), default=0)
        last = sum(s < offset + limit for s in self.starts)
        skipped = offset - self.starts[first] if self.files else 0
        return self._read(first, last).orderBy(*self.order).offset(skipped).limit(limit)

    def after(self, key: dict, limit: int) -> DataFrame:
        """The ``limit`` rows behind the row with these order columns (a row of the page before, as a dict)."""
        rank = [tuple((v is not None, v) for v in (f[c] for c in self.order)) for f in self.firsts]
        mine = tuple((v is not None, v) for v in (key[c] for c in self.order))
        first = max(0, sum(r <= mine for r in rank) - 1)
        wanted = self.starts[first + 1] + limit if first + 1 < len(self.starts) else self.rows
        return self._read(first, sum(s < wanted for s in self.starts)).where(_behind(self.order, key)).orderBy(*self.order).limit(limit)
