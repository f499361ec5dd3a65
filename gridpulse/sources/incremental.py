"""Daily incremental load with upsert into staging, keyed by meter/ticket; the newest version of each key wins.

``latest_by_key`` finds the newest load time per key by a hash aggregate and joins back, so whole rows are neither sorted nor kept in aggregation
buffers; the join's key holds the load time, too, so the many versions of a hot key lie in many tasks.

``BucketedStage`` keeps the staging table in buckets of the key's hash, each a folder that the newest manifest names. A load reads and
writes only the buckets that its keys fall into and commits them together with its own id; a load that is known already does nothing.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import VersionedStore


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _matching(rows: DataFrame, best: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` columns equal those of a row of ``best``, nulls being equal."""
    best = best.select(*[F.col(c).alias(f"_b_{i}") for i, c in enumerate(on)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b_{i}")) for i, c in enumerate(on)])
    return rows.join(best, same, "left_semi")


def latest_by_key(df: DataFrame, key: str | list[str], order_col: str = "load_ts") -> DataFrame:
    """The newest row of each key; null load times are the oldest, null keys are one key. Of different rows of one load time the one with
    the largest hash is taken, so that a repeated run takes the same one."""
    keys = _keys(key)
    others = [c for c in df.columns if c not in keys and c != order_col]
    rows = df.withColumn("_h", F.xxhash64(*df.columns))
    newest = _matching(rows, rows.groupBy(*keys).agg(F.max(order_col).alias(order_col)), keys + [order_col])
    one = _matching(newest, newest.groupBy(*keys).agg(F.max("_h").alias("_h")), keys + ["_h"])
    return one.select(*keys, order_col, *others).distinct()


def upsert(current: DataFrame, delta: DataFrame, key: str | list[str], order_col: str = "load_ts") -> DataFrame:
    """Staging after applying ``delta``: union by name, newest per key."""
    return latest_by_key(current.unionByName(delta, allowMissingColumns=True), key, order_col)


class BucketedStage:
    """Staging table below ``root``. Give it about one bucket per 256 MB of the table; the number is fixed by the first load."""

    def __init__(self, spark: SparkSession, root: str, key: str | list[str] | None = None, buckets: int = 64, order_col: str = "load_ts"):
        self.store, self.order_col = VersionedStore(spark, root), order_col
        notes = self.store.manifest()["notes"]
        self.keys = notes.get("keys") or ([] if key is None else _keys(key))
        self.buckets = notes.get("buckets") or buckets
        if key is not None and self.keys != _keys(key):
            raise ValueError(f"the stage is keyed by {self.keys}")

    def frame(self, manifest: dict | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The staging table of one version (or some of its buckets); None before the first load."""
        manifest = manifest or self.store.manifest()
        folders = [self.store.full(f) for b, f in manifest["tables"].items() if only is None or int(b) in only]
        return self.store.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def load(self, delta: DataFrame, load_id: str) -> bool:
        """Apply a load; False if its id is known. The list of touched buckets (at most ``buckets`` numbers) goes through the driver."""
        base = self.store.manifest()
        if load_id in base["notes"].get("loads", []):
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in delta.select(bucket.alias("b")).distinct().collect())
        folder, tables = self.store.new_folder(load_id), {}
        if touched:
            current = self.frame(base, touched)
            new = latest_by_key(delta, self.keys, self.order_col) if current is None else upsert(current, delta, self.keys, self.order_col)
            new.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(self.store.full(folder))
            tables = {str(b): f"{folder}/_bucket={b}" for b in touched}
        self.store.commit(tables, base, {"keys": self.keys, "buckets": self.buckets, "loads": [*base["notes"].get("loads", []), load_id]})
        return True
