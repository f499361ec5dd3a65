"""Sinks: layout of summaries and their versioned refresh (S9), column-aligned bulk writer."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import VersionedStore


def write_summary(df: DataFrame, path: str, partition_col: str | None = "period_type") -> None:
    """A summary's files in a new folder. Period-typed summaries are laid out by
    period_type (partition pruning for the dashboards) and sorted by period_start
    inside files (min/max statistics for date ranges). Readers find it once a
    version names it (``refresh``, ``plans.pipeline.run``)."""
    part = partition_col if partition_col in df.columns else None
    order = [c for c in (part, "period_start") if c and c in df.columns]
    w = df.sortWithinPartitions(*order) if order else df
    (w.write.partitionBy(part) if part else w.write).parquet(path)


def refresh(store: VersionedStore, frames: dict[str, DataFrame]) -> int:
    """Full refresh of some summaries under one version; the others stay."""
    base, folders = store.manifest(), {name: store.new_folder(name) for name in frames}
    for name, df in frames.items():
        write_summary(df, store.full(folders[name]))
    return store.commit(folders, base)


def align_to_target(df: DataFrame, target: StructType, rename: dict | None = None) -> DataFrame:
    """Optional rename map, lower-case names, keep only columns the target
    has (in target order), cast to the target types; absent columns become null."""
    if rename:
        df = df.withColumnsRenamed(rename)
    df = df.toDF(*[c.lower() for c in df.columns])
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields]
    return df.select(*cols)


def write_aligned(df: DataFrame, target: StructType, store: VersionedStore | None = None, name: str = "aligned",
                  rename: dict | None = None, jdbc: dict | None = None) -> None:
    """Write the aligned frame as a new version of ``name``, or to a database with
    truncate + 5,000-row batches when ``jdbc`` options are given."""
    out = align_to_target(df, target, rename)
    if jdbc:
        (out.write.mode("overwrite").format("jdbc").options(truncate="true", batchsize="5000", **jdbc).save())
    else:
        refresh(store, {name: out})
