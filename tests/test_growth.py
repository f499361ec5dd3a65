"""Work that must not be done twice: shuffles and bindings of the queries that grew too fast."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixture_paths import SF_SMALL
from gridpulse.functions.periods import roll_up
from gridpulse.operators import builders_mi as BM
from gridpulse.operators import maintenance as M
from gridpulse.operators.ageing import AgeHistogram
from gridpulse.operators.pages import PagedList
from gridpulse.plans import registry
from gridpulse.sources.fixtures import bind_meters
from gridpulse.sources.versions import VersionedStore
from plan_tools import named, shuffled_rows

registry.load_all()
GEO = "discom string, zone string, circle string, division string, subdivision string"


def test_names_that_differ_in_case_can_be_written(spark, tmp_path):
    import pyarrow.dataset as ds
    df = registry.REGISTRY["s04_inventory_staging"][0](spark, SF_SMALL)
    df.write.parquet(str(tmp_path / "out"))
    assert ds.dataset(str(tmp_path / "out")).schema.names == df.columns and {"DIDate", "didate"} <= set(df.columns)
    assert spark.conf.get("spark.sql.caseSensitive") == "false"  # the caller's session stays as it is


def test_a_list_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(0, 1000, 1, 4).mapInArrow(counted, "id long")
    pages = PagedList.write(df, ["id"], VersionedStore(spark, str(tmp_path / "s")), "once", rows_per_file=100)
    assert seen.value == 1000 and [r.id for r in pages.page(995, 10).collect()] == [995, 996, 997, 998, 999]


def test_lineitem_is_shuffled_twice(spark):
    """By part and by order; the customers go to the orders."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = bind_meters(spark, SF_SMALL)
        rows = len(df.collect())
        orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
        assert shuffled_rows(df) < 2 * rows + 4 * orders < 3 * rows + orders
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grains_of_a4_share_one_exchange(spark):
    df = BM.inventory_utilization(bind_meters(spark, SF_SMALL).limit(2000).localCheckpoint())
    df.collect()
    assert len(named(df, "ShuffleExchangeExec")) <= 3  # limit, groups, groups by the shared columns
    assert shuffled_rows(df) <= 2 * 2000 + 2000


def test_coarser_grains_share_one_exchange(spark):
    rows = spark.range(0, 3000, 1, 3).select((F.col("id") % 1000).alias("k"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 300).cast("int")).alias("d"))
    out = roll_up(rows, ["k"], "d", {"n": F.count(F.lit(1))})
    out.collect()
    assert shuffled_rows(out) <= 2 * 3000


def test_only_rows_without_geo_are_joined(spark, tmp_path):
    full, none = ("d", "z", "c", "v", "s"), (None,) * 5
    spark.createDataFrame([(f"A{k}", *full) for k in range(500)] + [("B", *none), (" B ", *none), ("C", *none), (None, *none), ("B", *full)],
                          f"meterserialnumber string, {GEO}").write.parquet(str(tmp_path / "m"))
    m = M.dedup_mapping(spark.createDataFrame([("B", "x", *full[1:]), ("A1", "x", *full[1:])], f"meter_serial_number string, {GEO}"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.with_mapping(spark.read.parquet(str(tmp_path / "m")), m)
        got = sorted(map(str, [tuple(r) for r in out.collect()]))
        want = [(f"A{k}", *full) for k in range(500)] + [("B", "x", *full[1:]), (" B ", "x", *full[1:]), ("C", *none), (None, *none), ("B", *full)]
        assert got == sorted(map(str, want)) and shuffled_rows(out) < 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["m02_geo_backfill_result", "m02_file_repair_stats", "m02_file_repair_result", "s11_rejects"])
def test_meters_are_bound_once(spark, monkeypatch, name):
    """What the queries read after the meter table has been written is the written table."""
    from gridpulse.plans import extras
    inputs = []
    real = extras._mapping_raw
    monkeypatch.setattr(extras, "_mapping_raw", lambda meters: inputs.extend(meters.inputFiles()) or real(meters))
    registry.REGISTRY[name][0](spark, SF_SMALL).collect()
    assert inputs and not any(f.startswith(f"file://{SF_SMALL}") for f in inputs)


def test_loads_of_one_scan(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", day, True), ("a", day, False), ("b", day, True), ("b", None, False), (None, day, False)], "k string, d date, left boolean")
    one = AgeHistogram(VersionedStore(spark, str(tmp_path / "1")), "h", ["k"], "d").add(df, "in").add(df.where("left"), "out", -1).add(df.where("false"), "none")
    all_ = AgeHistogram(VersionedStore(spark, str(tmp_path / "2")), "h", ["k"], "d").add_all(
        df, {"in": (F.lit(True), 1), "out": (F.col("left"), -1), "none": (F.lit(False), 1)})
    assert sorted(map(str, all_.rows().collect())) == sorted(map(str, one.rows().collect()))
    dates, classes = [day, dt.date(2024, 3, 1)], {"young": (None, 30), "old": (30, None)}
    both = all_.at(dates, classes, "month")
    want = [str((d, *r)) for d in dates for r in one.at(d, classes, "month").collect()]
    assert both.columns == ["as_of", "k", "period_start", "young", "old"] and sorted(str(tuple(r)) for r in both.collect()) == sorted(want)
    assert len(named(both, "ShuffleExchangeExec")) == 1  # one aggregate for all run dates
