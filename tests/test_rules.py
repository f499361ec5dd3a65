"""Rules with expected rows made by hand: rounding, journey weights, categories, complaint files, the summary sink."""
import glob
import os
import random
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridpulse import config as C
from gridpulse.functions.filters import Filters
from gridpulse.operators import dual as D
from gridpulse.plans import dashboards_mi as QM
from gridpulse.sources import files as S
from gridpulse.sources import sinks


def test_round2_is_pythons_round(spark):
    rng = random.Random(7)
    xs = [0.125, 0.625, 2.675, 0.375, 1.005, 0.005, 0.015, 0.0, 100.0, 33.335, 5 / 8, 1e9 + 0.125]
    xs += [rng.randint(0, 10**6) / rng.randint(1, 1000) for _ in range(3000)] + [(2 * rng.randint(0, 10**6) + 1) / 200 for _ in range(3000)]
    xs += [rng.randint(0, 10**5) / 8 for _ in range(500)]
    xs += [-x for x in xs]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", D.r2_col(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.r != round(r.x, 2)] == []
    assert spark.sql("select cast(null as double) as x").select(D.r2_col(F.col("x"))).first()[0] is None


def journey_rows(spark, rows):
    stages = ", ".join(f"{s} double, {s}_sum long, {s}_n long" for s in QM.JOURNEY)
    schema = ", ".join(f"{c} string" for c in C.MIDIM) + f", period_type string, period_start date, meter_count long, {stages}"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_journey_weighs_stored_means_by_meter_count(spark):
    scope = {"project": C.DEFAULT.projects[0], "meter_category": "FEEDER", "period_type": "monthly"}
    one = {**scope, "zone": "Z1", "meter_count": 2, "inventory_to_store": 10.0, "inventory_to_store_sum": 10, "inventory_to_store_n": 1}
    two = {**scope, "zone": "Z2", "meter_count": 1, "inventory_to_store": 20.0, "inventory_to_store_sum": 20, "inventory_to_store_n": 1}
    none = {**scope, "zone": "Z3", "meter_count": 50}
    base = {"a08": journey_rows(spark, [one, two, none])}
    f = Filters(category="feeder", duration="monthly")
    row = QM.q09_meter_journey(f)["summary"].spark(base).first()
    assert (row.inventory_to_store, row.inventory_to_store_exact, row.sat_to_invoice, row.meter_count) == (14, 15, None, 53)
    row = QM.q09_meter_journey(f.with_(category="total"))["summary"].spark(base).first()
    assert (row.inventory_to_store__FEEDER, row.inventory_to_store__total, row.inventory_to_store_exact__total) == (14, 14, 15)
    assert row.inventory_to_store__DT is None and row.meter_count__DT == 0


def test_dtr_is_a_category_of_revenue_ageing_and_defects_only(spark):
    for q in (QM.q01_progress, QM.q02_technician_productivity, QM.q04_inventory_utilization, QM.q07_mi_vs_sat, QM.q09_meter_journey,
              QM.q10_pending_funnel, QM.q12_revenue_realized):
        with pytest.raises(ValueError):
            q(Filters(category="dtr"))
    dims = ", ".join(f"{c} string" for c in C.MIDIM)
    rows = [{"project": C.DEFAULT.projects[0], "meter_category": c, "period_type": "monthly"} for c in ("DT", "DTR")]
    ages = [f"{a} long" for a in QM.AGE4]
    schema = f"{dims}, period_type string, period_start date, period_value string, {', '.join(ages)}"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    base = spark.createDataFrame([tuple(1 if n in QM.AGE4 else r.get(n) for n in names) for r in rows], schema)
    for category in ("dt", "dtr"):
        row = QM.q13_revenue_ageing(Filters(category=category))["summary"].spark({"a15": base}).first()
        assert row.total_pending == 4  # the row of DT alone
    both = base.withColumn("defective_type", F.lit(C.DEFECT_BURNT)).withColumn("meter_count", F.lit(1).cast("long"))
    for category in ("dt", "dtr"):
        assert QM.q14_defective_meters(Filters(category=category))["summary"].spark({"a16": both}).first().burnt == 2


def test_performers_break_ties_by_name(spark):
    from gridpulse.operators import rollups as R
    rows = [("b", "2024-01-01", 5), ("a", "2024-01-01", 5), ("c", "2024-01-01", 1), ("d", "2024-01-02", 1), (None, "2024-01-02", 9)]
    df = spark.createDataFrame(rows, "technician string, day string, n long")
    got = R.performers("x", D.and_(), day="day", who="technician", measure="n").spark({"x": df}).collect()
    assert [tuple(r) for r in got] == [("top", "a", 5.0), ("lowest", "d", 1.0)]
    assert R.performers("x", D.and_(), day="day", who="technician", measure="n").spark({"x": df.limit(0)}).collect() == []


def test_complaint_times_in_all_formats(spark):
    raw = spark.createDataFrame([("1", "06-05-2024 10:11:12", "07-05-2024"), ("2", "2024-05-06 01:02:03", "2024-05-07"), ("3", "n/a", None)],
                                "ticket string, CreatedDate string, ClosedDate string")
    closed = S.complaint_frame(raw, "DT", "closed").orderBy("ticket").collect()
    assert [str(r.created_date) for r in closed] == ["2024-05-06 10:11:12", "2024-05-06 01:02:03", "None"]
    assert [str(r.closed_date)[:10] for r in closed] == ["2024-05-07", "2024-05-07", "None"]
    opened = S.complaint_frame(raw, "DT", "open").collect()
    assert all(r.closed_date is None and r.ClosedDate is None for r in opened)
    with pytest.raises(ValueError):
        S.complaint_frame(raw.drop("CreatedDate"), "DT", "open")
    day = S.enrich_time(S.complaint_frame(raw, "DT", "closed")).where("ticket = '1'").first()
    assert (str(day.closed_day), str(day.closed_week), day.closed_month, day.created_month) == ("2024-05-07", "2024-05-06", "May 2024", "May 2024")


def test_files_of_a_summary_are_sorted(spark):
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "s")
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "daily").otherwise("monthly").alias("period_type"), "id",
                                 F.date_add(F.lit("2024-01-01"), F.pmod(F.xxhash64("id"), F.lit(300)).cast("int")).alias("period_start")).coalesce(2)
    sinks.write_summary(df, path)
    assert spark.read.parquet(path).count() == 400
    for f in glob.glob(f"{path}/*/*.parquet"):
        days = pq.ParquetFile(f).read(["period_start"]).column(0).to_pylist()
        assert days == sorted(days)


def test_nested_breakdown_totals_and_unknown(spark):
    from gridpulse.plans import extras
    rows = spark.createDataFrame([("C", "1P", 1, 2), ("C", "1P", 3, None), ("C", None, 5, 0), (None, "1P", 7, 1), ("Unknown", "1P", 1, 1)], "cat string, typ string, x int, y int")
    plan = extras._nested("base", ["cat", "typ"], {"x": "x", "y": "y"}, row_total=True)
    got = {tuple(r) for r in plan.spark({"base": rows}).select("cat", "typ", "x", "y", "total", "level").collect()}
    assert got == {("C", "1P", 4, 2, 6, 0), ("C", "Unknown", 5, 0, 5, 0), ("C", None, 9, 2, 11, 1), ("Unknown", "1P", 8, 2, 10, 0), ("Unknown", None, 8, 2, 10, 1)}


def test_documented_lists_and_grains_are_registered():
    from gridpulse.plans import registry
    registry.load_all()
    assert {"q27_technician_period_list_page", "q29_inventory_list_page", "q29_mi_vs_sat_list_page", "q29_journey_list_page", "q29_stock_ageing_nested_category",
            "q29_stock_ageing_nested_period", "q33_kpi07_mi_vs_sat_weekly_series", "r07_nested_category", "r07_nested_period"} <= set(registry.REGISTRY)
