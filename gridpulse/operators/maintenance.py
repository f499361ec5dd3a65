"""Maintenance operators: missing-geo count (M1), geo backfill (M2 = S11 + J3 + J4)
and the non-SAT ageing period table (M3).

Joins on the meter serial are skew-proof: both sides are first reduced to one
row per trimmed serial (the meter side carries a multiplicity), so a serial
shared by a large share of the meters is one row in the shuffle.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import config as C
from ..functions import predicates as P
from ..functions.periods import label_ddmmyy, roll_up
from ..sources.versions import VersionedStore

GEO = C.GEO5


def _serial_ok(c="meterserialnumber"):
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "")


def missing_geo_meters(meters: DataFrame) -> DataFrame:
    """M1: distinct trimmed, non-blank serials with any geo column missing (one row)."""
    return (meters.where(_serial_ok() & P.missing_geo(GEO))
            .agg(F.count_distinct(F.trim("meterserialnumber")).alias("missing_geo_meters")))


def dedup_mapping(mapping: DataFrame) -> DataFrame:
    """One mapping tuple per serial: the reference updates from an arbitrary
    duplicate; we take the smallest (discom, zone, circle, division, subdivision)."""
    best = F.min(F.struct(*[F.col(c) for c in GEO])).alias("_m")
    return (mapping.groupBy("meter_serial_number").agg(best, F.count(F.lit(1)).alias("map_rows"))
            .select("meter_serial_number", "map_rows", *[F.col(f"_m.{c}").alias(c) for c in GEO]))


def backfill_geo(meters: DataFrame, mapping_raw: DataFrame, usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: returns (repaired meters, one-row stats).

    stats: loaded, filtered, missing_before, would_update (J3: join pairs of
    missing meters x usable mapping rows), updated (target rows with a match),
    missing_after. Dry run = compute the stats and do not write the meters.
    """
    m = dedup_mapping(usable)
    missing = P.missing_geo(GEO)
    per_serial = (meters.where(missing & F.col("meterserialnumber").isNotNull())
                  .groupBy(F.trim("meterserialnumber").alias("meter_serial_number")).agg(F.count(F.lit(1)).alias("rows")))
    return with_mapping(meters, m), _stats(per_serial, m, mapping_raw)


def with_mapping(meters: DataFrame, m: DataFrame) -> DataFrame:
    """Update-from-join, only where geo is missing and a mapping exists. Rows with all their geo pass by the join, so ``meters`` should be a table:
    it is read twice. The mapping has one row per serial; AQE picks the join by its measured size and splits hot serials of the meter side."""
    lacks = P.missing_geo(GEO)
    mp = m.select("meter_serial_number", *[F.col(c).alias(f"_n_{c}") for c in GEO])
    j = meters.where(lacks).join(mp, F.trim(F.col("meterserialnumber")) == F.col("meter_serial_number"), "left")
    hit = F.col("meter_serial_number").isNotNull()
    filled = j.select(*[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in GEO else F.col(c) for c in meters.columns])
    return meters.where(~lacks).union(filled)


def _stats(per_serial: DataFrame, m: DataFrame, mapping_raw: DataFrame) -> DataFrame:
    """M2's figures from one row per serial of the missing meters (``rows``) and one per serial of the mapping (``map_rows``). Both are partitioned on the
    serial by their own grouping, so the outer join shuffles nothing more. A mapping row is complete (S11), so a matched serial isn't missing after."""
    both = per_serial.join(m.select("meter_serial_number", "map_rows"), "meter_serial_number", "full")
    met, named = F.col("map_rows").isNotNull(), F.col("rows").isNotNull() & (F.col("meter_serial_number") != "")

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")
    figures = both.agg(total("map_rows").alias("filtered"), F.count_if(named).alias("missing_before"),
                       total(F.col("rows") * F.col("map_rows")).alias("would_update"), total(F.when(met, F.col("rows"))).alias("updated"),
                       F.count_if(named & ~met).alias("missing_after"))
    loaded = mapping_raw.agg(F.count(F.lit(1)).alias("loaded"))
    cols = ["loaded", "filtered", "missing_before", "would_update", "updated", "missing_after"]
    return figures.unionByName(loaded, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in cols])


class MeterFiles:
    """A meter table in ``store`` whose manifest names its files one by one, each with the number of its rows that lack geo.

    ``repair`` scans the serial and geo columns of the files that have such rows, and rewrites only the files that hold a hit; the others
    stay as they are, under the new version too. Through the driver go file names and counts only (one entry per file: write files of
    256 MB or more). A repeated repair finds no hit and commits nothing.
    """

    def __init__(self, store: VersionedStore, name: str = "meters"):
        self.store, self.name = store, name

    def _written(self, df: DataFrame) -> tuple[dict[str, str], dict[str, int]]:
        """Write ``df`` into a new folder: (manifest entries, missing rows) of its files."""
        folder = self.store.new_folder(self.name)
        df.write.parquet(self.store.full(folder))
        file = F.col("_metadata.file_name").alias("file")
        found = (self.store.spark.read.parquet(self.store.full(folder)).select(file, *GEO).groupBy("file")
                 .agg(F.count_if(P.missing_geo(GEO)).alias("n")).collect())
        return {f"{self.name}/{r.file}": f"{folder}/{r.file}" for r in found}, {r.file: r.n for r in found}

    def _notes(self, manifest: dict) -> dict:
        return manifest["notes"].get(f"files {self.name}", {"schema": None, "missing": {}})

    def create(self, df: DataFrame) -> MeterFiles:
        base = self.store.manifest()
        entries, missing = self._written(df)
        old = [t for t in base["tables"] if t.startswith(f"{self.name}/")]
        self.store.commit(entries, base, {f"files {self.name}": {"schema": df.schema.json(), "missing": missing}}, drop=old)
        return self

    def files(self, manifest: dict | None = None) -> dict[str, str]:
        """file name -> full path, of one version."""
        manifest = manifest or self.store.manifest()
        prefix = f"{self.name}/"
        return {t[len(prefix):]: self.store.full(f) for t, f in manifest["tables"].items() if t.startswith(prefix)}

    def frame(self, manifest: dict | None = None, only: list[str] | None = None) -> DataFrame:
        """The table, or some of its files; an empty table keeps its columns."""
        manifest = manifest or self.store.manifest()
        schema = self._notes(manifest)["schema"]
        if schema is None:
            raise ValueError(f"{self.name} has not been created")
        paths = [p for f, p in self.files(manifest).items() if only is None or f in only]
        schema = StructType.fromJson(json.loads(schema))
        return self.store.spark.read.schema(schema).parquet(*paths) if paths else self.store.spark.createDataFrame([], schema)

    def repair(self, mapping_raw: DataFrame, usable: DataFrame, execute: bool = True) -> DataFrame:
        """M2 on files; returns the one-row stats of :func:`backfill_geo`, for a dry run too (which writes no meter)."""
        base, spark = self.store.manifest(), self.store.spark
        note = self._notes(base)
        lacking = [f for f, n in note["missing"].items() if n]
        work = self.store.full(self.store.new_folder(f"{self.name}-work"))  # named by no manifest: expire() removes it by age
        dedup_mapping(usable).write.parquet(f"{work}/mapping")
        m = spark.read.parquet(f"{work}/mapping")
        # the only scan of meters besides the rewritten files: a hot serial is one row a file
        rows = self.frame(base, lacking)
        file = F.col("_metadata.file_name") if lacking else F.lit("")
        (rows.where(P.missing_geo(GEO) & F.col("meterserialnumber").isNotNull())
         .groupBy(file.alias("file"), F.trim("meterserialnumber").alias("meter_serial_number")).agg(F.count(F.lit(1)).alias("rows"))
         .write.parquet(f"{work}/missing"))
        missing = spark.read.parquet(f"{work}/missing")
        stats = _stats(missing.groupBy("meter_serial_number").agg(F.sum("rows").alias("rows")), m, mapping_raw)
        met = missing.join(m.select("meter_serial_number"), "meter_serial_number", "left_semi")
        hit = sorted(r.file for r in met.select("file").distinct().collect())
        if execute and hit:
            # only the mapping rows that some missing meter takes
            needed = m.join(met.select("meter_serial_number"), "meter_serial_number", "left_semi")
            entries, counts = self._written(with_mapping(self.frame(base, hit), needed))
            kept = {f: n for f, n in note["missing"].items() if f not in hit}
            self.store.commit(entries, base, {f"files {self.name}": {"schema": note["schema"], "missing": kept | counts}},
                              drop=[f"{self.name}/{f}" for f in hit])
        return stats


NSA = ["total_non_sat", "age_gt_30", "age_gt_60", "age_gt_90", "age_gt_120"]


def non_sat_ageing_periods(non_sat: DataFrame) -> DataFrame:
    """M3: A7 rows by MIDIM x daily/weekly/monthly of installation date with
    cumulative counts over 30/60/90/120 days."""
    d = F.col("ageing_days")
    rows = non_sat.select(*C.MIDIM, F.col("installation_date").alias("d"), "ageing_days")
    counts = {"total_non_sat": F.count(F.lit(1))} | {f"age_gt_{k}": F.count_if(d > k) for k in (30, 60, 90, 120)}
    out = roll_up(rows, C.MIDIM, "d", counts)
    return out.select(*C.MIDIM, "period_type", label_ddmmyy("period_start").alias("period_value"),
                      F.col("period_start").alias("date_value"), *NSA)


def geo_backfill_job(spark, meters: DataFrame, csv_path: str, out_path: str | None = None,
                     execute: bool = False) -> DataFrame:
    """M2 as a job: read the remediation CSV (S11), compute the stats and, when
    ``execute`` is set, write the repaired meter table to ``out_path`` (a new
    location; the input is never overwritten in place). Dry run writes nothing
    and reports updated = 0, as the reference does."""
    from ..sources.files import read_geo_mapping

    raw, usable = read_geo_mapping(spark, csv_path)
    repaired, stats = backfill_geo(meters, raw, usable)
    if not execute:
        return stats.withColumn("updated", F.lit(0).cast("long")).withColumn("missing_after", F.lit(None).cast("long"))
    if not out_path:
        raise ValueError("execute=True needs out_path")
    repaired.write.mode("overwrite").parquet(out_path)
    return stats
