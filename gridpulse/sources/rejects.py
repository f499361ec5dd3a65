"""Rejects of file reads (S5, S11): rows that can't be taken whole are kept apart with their file, their text and the reasons, and counted.

The plain readers of ``files`` keep a row with an unreadable date (as null) and drop incomplete mapping rows; here nothing vanishes: rows read =
rows kept + rows rejected, the rows read being counted by a scan of their own. Spark knows no line numbers of a split text file, so a reject is found
by its file and text.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import not_blank
from .files import COMPLAINT_TIME_FORMATS, GEO_MAP_COLUMNS, parse_mixed_timestamp
from .versions import VersionedStore

#: The whole line where its number of cells isn't the header's, else null; and the file.
CORRUPT, FILE = "_corrupt_record", "_file"
WRONG_CELLS = "wrong number of cells"


def read_strings(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """CSV cells as strings with ``_corrupt_record`` and ``_file``. Without ``header`` the files' first lines name the columns, and a file
    with another first line is an error; with it the files have no such line."""
    names = header or spark.read.option("header", "true").csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in [*names, CORRUPT]])
    reader = (spark.read.schema(schema).option("header", str(header is None).lower()).option("enforceSchema", "false").option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", "false"))  # pruned reads don't count cells
    return reader.csv(path).withColumn(FILE, F.col("_metadata.file_name"))


def complaint_reasons(df: DataFrame, formats=COMPLAINT_TIME_FORMATS) -> dict[str, Column]:
    """A cell that should hold a time and has text that no format reads. Blank cells are no fault."""
    times = [c for c in ("CreatedDate", "ClosedDate") if c in df.columns]
    return {f"{c} is no time": not_blank(c) & parse_mixed_timestamp(c, formats).isNull() for c in times}


def mapping_reasons(df: DataFrame) -> dict[str, Column]:
    """A geo cell that is null or blank (headers trimmed)."""
    named = {c.strip(): c for c in df.columns}
    return {f"{c} is blank": ~not_blank(F.col(f"`{named[c]}`")) for c in GEO_MAP_COLUMNS[1:]}


def with_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``df`` with ``reasons`` (empty for a good row) and ``record``, its text. A line with the wrong number of cells has no other reason:
    which cell is which isn't known."""
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons.items()], F.lit(None).cast("string")), lambda x: x.isNotNull())
    cells = [c for c in df.columns if c not in (CORRUPT, FILE)]
    record = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cells]))
    if CORRUPT in df.columns:
        found = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit(WRONG_CELLS))).otherwise(found)
        record = F.coalesce(F.col(CORRUPT), record)
    return df.withColumns({"reasons": found, "record": record})


class Quarantine:
    """Kept and rejected rows of a read below ``store``, written in one pass and visible together."""

    def __init__(self, store: VersionedStore, name: str):
        self.store, self.name = store, name

    def write(self, df: DataFrame, reasons: dict[str, Column]) -> Quarantine:
        base, folder = self.store.manifest(), self.store.new_folder(self.name)
        rows = with_reasons(df, reasons).withColumn("rejected", F.when(F.size("reasons") > 0, 1).otherwise(0))
        rows.write.partitionBy("rejected").parquet(self.store.full(folder))
        self.store.commit({self.name: folder}, base, {f"schema {self.name}": rows.schema.json()})
        return self

    def _stored(self) -> DataFrame:
        """Kept and rejected rows, the latter as ``rejected`` = 1; an empty read has no file, so the schema is the manifest's."""
        manifest = self.store.manifest()
        schema = StructType.fromJson(json.loads(manifest["notes"][f"schema {self.name}"]))
        return self.store.spark.read.schema(schema).parquet(self.store.full(manifest["tables"][self.name]))

    def _cells(self, df: DataFrame) -> list[Column]:
        return [F.col(f"`{c}`") for c in df.columns if c not in (CORRUPT, FILE, "reasons", "record", "rejected")]

    def kept(self) -> DataFrame:
        df = self._stored().where("rejected = 0")
        return df.select(*self._cells(df))

    def rejects(self) -> DataFrame:
        """The cells, ``file`` (if known), ``reasons`` and ``record`` of the rejected rows."""
        df = self._stored().where("rejected = 1")
        file = [F.col(FILE).alias("file")] if FILE in df.columns else []
        return df.select(*self._cells(df), *file, "reasons", "record")

    def reconciliation(self, source: DataFrame) -> DataFrame:
        """One row: rows read (a scan of ``source``), kept and rejected (of the written tables), and whether they agree."""
        stored = self._stored().agg(F.count_if(F.col("rejected") == 0).alias("kept"), F.count_if(F.col("rejected") == 1).alias("rejected"))
        both = stored.unionByName(source.agg(F.count(F.lit(1)).alias("read")), allowMissingColumns=True)
        return (both.agg(*[F.max(c).alias(c) for c in ("read", "kept", "rejected")])
                .withColumn("balanced", F.col("read") == F.col("kept") + F.col("rejected")))
