"""Geo repair (M2): figures from one scan of the meters, and only the files that hold a hit are rewritten."""
import glob
import hashlib

from pyspark.sql import functions as F

from gridpulse.operators import maintenance as M
from gridpulse.sources.files import clean_geo_mapping
from gridpulse.sources.versions import VersionedStore
from plan_tools import named

GEO = "discom string, zone string, circle string, division string, subdivision string"
FULL = ("d", "z", "c", "v", "s")


def meters(spark, rows):
    return spark.createDataFrame([(s, *geo) for s, geo in rows], f"meterserialnumber string, {GEO}")


def mapping(spark, rows):
    return spark.createDataFrame(rows, f"meter_serial_number string, {GEO}")


def digests(root):
    return {f.rsplit("/", 1)[1]: hashlib.sha1(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{root}/data/meters-*/part-*.parquet")}


def table(spark, tmp_path):
    """Four files: complete rows; missing rows without a mapping; a hit; a hot serial that hits, beside null and blank serials."""
    parts = [[("A", FULL)] * 5, [("B", (None, *FULL[1:]))] * 3 + [("A", FULL)], [(" M1", ("d", " ", "c", "v", "s")), ("A", FULL)],
             [("HOT ", (None,) * 5)] * 1000 + [(None, (None,) * 5), (" ", (None,) * 5), ("HOT", FULL)]]
    rows = [(s, geo, k) for k, part in enumerate(parts) for s, geo in part]
    df = spark.createDataFrame([(s, *geo, k) for s, geo, k in rows], f"meterserialnumber string, {GEO}, k int")
    df = df.repartitionById(4, F.col("k")).drop("k")
    files = M.MeterFiles(VersionedStore(spark, str(tmp_path / "s"))).create(df)
    raw = mapping(spark, [(" M1 ", *FULL), ("M1", "a", *FULL[1:]), ("HOT", "h", *FULL[1:]), ("B", "", *FULL[1:]), ("A", "x", *FULL[1:]), (None, *FULL)])
    return files, raw, clean_geo_mapping(raw)


def test_only_files_with_a_hit_are_rewritten(spark, tmp_path):
    files, raw, usable = table(spark, tmp_path)
    expected, stats = M.backfill_geo(files.frame(), raw, usable)
    before, wanted = digests(tmp_path / "s"), sorted(map(str, expected.collect()))
    assert len(before) == 4
    dry = files.repair(raw, usable, execute=False).collect()
    assert files.store.manifest()["version"] == 1 and dry == stats.collect()
    done = files.repair(raw, usable).collect()
    assert done == dry and done[0].asDict() == {"loaded": 6, "filtered": 5, "missing_before": 3, "would_update": 1002, "updated": 1001, "missing_after": 1}
    assert sorted(map(str, files.frame().collect())) == wanted
    now = files.files()
    after = digests(tmp_path / "s")
    assert all(after[f] == d for f, d in before.items())  # no file is changed in place
    assert len(set(before) & set(now)) == 2 and len(set(before) - set(now)) == 2
    assert files.frame().where("discom = 'a'").count() == 1  # the smallest tuple of M1
    # a reader of the old version still sees it; a repeated repair has nothing to do
    assert files.frame(files.store.manifest(1)).where("discom = 'h'").count() == 0
    again = files.repair(raw, usable).first()
    assert (again.would_update, again.updated, files.store.manifest()["version"]) == (0, 0, 2)


def test_empty_tables(spark, tmp_path):
    files, raw, usable = table(spark, tmp_path)
    none = files.repair(raw.limit(0), usable.limit(0)).first()
    assert none.asDict() == {"loaded": 0, "filtered": 0, "missing_before": 3, "would_update": 0, "updated": 0, "missing_after": 3}
    empty = M.MeterFiles(VersionedStore(spark, str(tmp_path / "e"))).create(files.frame().limit(0))
    assert empty.repair(raw, usable).first().missing_before == 0 and empty.frame().count() == 0


def test_stats_scan_the_meters_once(spark, tmp_path):
    meters(spark, [("A", FULL), ("M1", (None,) * 5)]).write.parquet(str(tmp_path / "m"))
    mapping(spark, [("M1", *FULL)]).write.parquet(str(tmp_path / "map"))
    raw = spark.read.parquet(str(tmp_path / "map"))
    _, stats = M.backfill_geo(spark.read.parquet(str(tmp_path / "m")), raw, clean_geo_mapping(raw))
    assert stats.first().updated == 1
    scans = [n for n in named(stats, "FileSourceScanExec") if "meterserialnumber" in n.toString()]
    assert len(scans) == 1
