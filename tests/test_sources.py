"""Sources, sinks, streaming upsert and maintenance on small hand-made inputs."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from gridpulse.operators import maintenance as M
from gridpulse.schemas import METERS, rows_to_df
from gridpulse.sources import files as S
from gridpulse.sources.incremental import latest_by_key


def test_mixed_date_parse(spark):
    df = spark.createDataFrame([("2024-05-06",), ("06-05-2024",), ("xx",), (None,)], "s string")
    got = [r[0] for r in df.select(S.parse_mixed_date("s")).collect()]
    assert got == [dt.date(2024, 5, 6), dt.date(2024, 5, 6), None, None]


def test_complaint_csvs_align(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    closed = os.path.join(d, "closed.csv")
    opened = os.path.join(d, "open.csv")
    with open(closed, "w") as f:
        f.write("TicketId,FeederName,complaintBy,CreatedDate,ClosedDate,NewSmartMeterNumber,ComplaintCategory\n"
                "1,F1,Auto,2024-01-01 10:00:00,2024-01-02 10:00:00,N1,METER\n")
    with open(opened, "w") as f:
        f.write("TicketId,Feeder,ComplaintBy,CreatedDate,Extra\n2,F2,Walk-in,2024-01-03 09:00:00,z\n")
    df = S.read_complaint_files(spark, {"Consumer": {"closed": closed, "open": opened}})
    assert "Extra" not in df.columns and {"Feeder", "ComplaintBy", "ClosedDate"} <= set(df.columns)
    rows = {r.TicketId: r for r in df.collect()}
    assert rows["2"].ClosedDate is None and rows["1"].MeterCategory == "Consumer"
    assert rows["1"].closed_date == dt.datetime(2024, 1, 2, 10)


def test_geo_mapping_clean_and_backfill(spark):
    raw = spark.createDataFrame(
        [(" M1 ", "D", "Z", "C", "V", "S"), ("M1", "A", "Z", "C", "V", "S"), ("M2", "D", "", "C", "V", "S"),
         ("M3", "D", "Z", "C", "V", "S")],
        "meter_serial_number string, discom string, zone string, circle string, division string, subdivision string")
    raw = raw.toDF(*[" " + c + " " if c == "zone" else c for c in raw.columns])
    usable = S.clean_geo_mapping(raw)
    assert usable.count() == 3
    m = rows_to_df(spark, METERS, [{"meterserialnumber": "M1", "discom": None, "zone": "z"},
                                   {"meterserialnumber": " M1", "discom": "x", "zone": "z", "circle": "c",
                                    "division": "v", "subdivision": "s"},
                                   {"meterserialnumber": "M2", "discom": None}])
    repaired, stats = M.backfill_geo(m, raw, usable)
    s = stats.collect()[0]
    assert (s.loaded, s.filtered, s.missing_before, s.would_update, s.updated, s.missing_after) == (4, 3, 2, 2, 1, 1)
    fixed = [r for r in repaired.collect() if r.meterserialnumber == "M1"][0]
    assert fixed.discom == "A"   # smallest mapping tuple wins


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, "w")],
                               "k string, load_ts int, v string")
    got = {r.k: r.v for r in latest_by_key(df, "k").collect()}
    assert got == {"a": "y", "b": "z"}


def test_streaming_upsert(spark):
    from gridpulse.streaming.incremental import current_snapshot, start_incremental_upsert
    src = tempfile.mkdtemp(dir="/tmp")
    staging = tempfile.mkdtemp(dir="/tmp")
    ck = tempfile.mkdtemp(dir="/tmp")
    schema = "ticket_id string, status string, load_ts timestamp_ntz"
    spark.createDataFrame([("1", "open", dt.datetime(2024, 1, 1)), ("2", "open", dt.datetime(2024, 1, 1))],
                          schema).write.mode("append").parquet(src)
    spark.createDataFrame([("1", "closed", dt.datetime(2024, 1, 5))], schema).write.mode("append").parquet(src)
    q = start_incremental_upsert(spark, src, spark.createDataFrame([], schema).schema, "ticket_id", staging, ck)
    q.awaitTermination(120)
    snap = {r.ticket_id: r.status for r in current_snapshot(spark, staging).collect()}
    assert snap == {"1": "closed", "2": "open"}


def test_summary_sink_roundtrip(spark):
    from gridpulse.sources.sinks import align_to_target, write_summary
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    d = tempfile.mkdtemp(dir="/tmp")
    df = spark.createDataFrame([("daily", "A", 1), ("monthly", "B", 2)], "period_type string, Project string, n long")
    write_summary(df.withColumn("period_start", F.current_date()), d + "/s")
    assert spark.read.parquet(d + "/s").where("period_type = 'daily'").count() == 1
    tgt = StructType([StructField("project", StringType()), StructField("n", LongType()), StructField("x", StringType())])
    out = align_to_target(df, tgt)
    assert out.columns == ["project", "n", "x"] and out.where(F.col("x").isNull()).count() == 2


def test_geo_backfill_job_dry_run_and_execute(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    csv = os.path.join(d, "map.csv")
    with open(csv, "w") as f:
        f.write(" meter_serial_number ,discom,zone,circle,division,subdivision\n M1 ,D,Z,C,V,S\nM2,D,,C,V,S\n")
    m = rows_to_df(spark, METERS, [{"meterserialnumber": "M1", "discom": None}, {"meterserialnumber": "M2"}])
    dry = M.geo_backfill_job(spark, m, csv).collect()[0]
    assert (dry.loaded, dry.filtered, dry.would_update, dry.updated) == (2, 1, 1, 0)
    out = os.path.join(d, "repaired")
    done = M.geo_backfill_job(spark, m, csv, out, execute=True).collect()[0]
    assert done.updated == 1 and done.missing_after == 1
    assert spark.read.parquet(out).where("discom = 'D'").count() == 1


def test_filters_from_params():
    from gridpulse.functions.filters import Filters
    f = Filters.from_params({"project": "asia", "meter_category": "dt", "period": "weekly", "zone": "Z1",
                             "om_category": "DTR", "limit": "10", "start_date": ""})
    assert (f.project, f.category, f.duration, f.limit, f.start_date) == ("asia", "total", "weekly", 10, None)
    assert set(f.dims) == {("zone", "Z1"), ("meter_category", "dt")}  # om_category only where meter_category is missing
    assert set(Filters.from_params({"om_category": "DTR"}).dims) == {("meter_category", "DTR")}
    fallback = lambda p: Filters.from_params(p, category_from_meter=True)
    assert (fallback({"meter_category": "DT"}).category, fallback({"meter_category": "DT"}).dims) == ("DT", ())
    assert fallback({"category": "total", "meter_category": "DT"}).dims == (("meter_category", "DT"),)


def test_lists_and_summaries_filter_by_meter_category(spark):
    from gridpulse.plans import api
    from gridpulse.plans.queries_dash import base_frames
    from fixture_paths import SF_SMALL
    bases = base_frames(spark, SF_SMALL, ["a04", "a18", "a19"])
    rows = lambda path, p: api.dashboard(path, p, bases)
    every = rows("/api/om/open-ageing", {"limit": 50000})["rows"].collect()
    some = rows("/api/om/open-ageing", {"limit": 50000, "meter_category": "dt"})["rows"].collect()
    assert 0 < len(some) < len(every) and {r.meter_category.strip().upper() for r in some} == {"DT"}
    assert some == rows("/api/om/open-ageing", {"limit": 50000, "om_category": "DT"})["rows"].collect()
    closed = rows("/api/om/avg-closure-time", {"limit": 50000, "meter_category": "feeder"})["rows"].collect()
    assert {r.meter_category.strip().upper() for r in closed} == {"FEEDER"}
    total = rows("/api/mi/inventory-utilization/summary", {"category": "total"})["summary"].first()
    part = rows("/api/mi/inventory-utilization/summary", {"category": "total", "meter_category": "DT"})["summary"].first()
    assert 0 < part.total_inventory < total.total_inventory
