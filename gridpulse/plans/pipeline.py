"""Full-refresh job: facts -> 19 summaries (the reference's ETL run), as one
Spark application.

The meter fact is normalised once (derived columns computed by built-in
expressions) and written to the shared checkpoint folder as Parquet; every
builder then reads only the columns it needs from that columnar copy, so the
wide fact table is parsed once, not once per builder, and a lost executor only
recomputes from that written table rather than from the raw lineage.
"""
from __future__ import annotations

import datetime as dt
import os
import time

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import builders_mi as BM
from ..operators import builders_om as BO
from ..operators import maintenance as MT
from ..session import ensure_checkpoint_dir
from ..sources.sinks import write_summary
from ..sources.versions import VersionedStore

SUMMARIES = {
    "sql_mi_progress": ("m", BM.mi_progress),
    "sql_mi_technician_productivity": ("m", BM.mi_technician_productivity),
    "sql_inventory_utilization": ("m", BM.inventory_utilization),
    "sql_stock_ageing": ("m_asof", BM.stock_ageing),
    "sql_mi_vs_sat": ("m", BM.mi_vs_sat),
    "sql_non_sat_ageing": ("m_asof", BM.non_sat_ageing),
    "sql_meter_journey_avg_time": ("m", BM.meter_journey),
    "sql_meter_current_stage": ("m", BM.meter_stage),
    "dashboard_command_center": ("m", BM.command_center),
    "dashboard_command_center_trend": ("m", BM.command_center_trend),
    "dashboard_command_center_milestone": ("m", BM.command_center_milestone),
    "sql_mi_sat_invoice": ("m", BM.mi_sat_invoice),
    "sql_revenue_realized": ("m", BM.revenue_realized),
    "sql_revenue_ageing": ("m_asof", BM.revenue_ageing),
    "sql_defective_meters": ("cm", BO.defective_meters),
    "sql_om_team_productivity_dashboard": ("c", BO.om_team_productivity),
    "sql_om_open_ageing": ("c_asof", BO.om_open_ageing),
    "sql_om_avg_closure_time": ("c", BO.om_avg_closure_time),
    "sql_om_closed_analysis": ("c", BO.om_closed_analysis),
    # M3: the period table the reference declares but never fills
    "sql_non_sat_ageing_dashboard": ("m_asof", lambda m, as_of: MT.non_sat_ageing_periods(BM.non_sat_ageing(m, as_of))),
}


def build(name: str, meters: DataFrame | None, complaints: DataFrame | None, cfg: C.Config = C.DEFAULT) -> DataFrame:
    kind, fn = SUMMARIES[name]
    if kind == "m":
        return fn(meters)
    if kind == "m_asof":
        return fn(meters, cfg.meter_as_of)
    if kind == "c":
        return fn(complaints)
    if kind == "c_asof":
        return fn(complaints, cfg.complaint_as_of)
    return fn(complaints, meters)


def build_all(meters: DataFrame, complaints: DataFrame, cfg: C.Config = C.DEFAULT,
              pipeline: str = "all") -> dict[str, DataFrame]:
    """All summary DataFrames (lazy). pipeline: 'mi', 'om' or 'all'."""
    out = {}
    for name, (kind, _) in SUMMARIES.items():
        is_om = kind.startswith("c")
        if pipeline == "all" or (pipeline == "om") == is_om:
            out[name] = build(name, meters, complaints, cfg)
    return out


def stage_facts(spark: SparkSession, meters: DataFrame, complaints: DataFrame, run_id: str | None = None):
    """Write the fact frames once to the shared checkpoint folder and read them
    back (cuts lineage; the columnar copy serves every builder)."""
    root = ensure_checkpoint_dir(spark)
    run_id = run_id or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    base = os.path.join(root, f"facts-{run_id}")
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=2) as ex:   # two independent jobs
        list(ex.map(lambda kv: kv[1].write.mode("overwrite").parquet(f"{base}/{kv[0]}"),
                    [("meters", meters), ("complaints", complaints)]))
    return spark.read.parquet(f"{base}/meters"), spark.read.parquet(f"{base}/complaints")


def run(spark: SparkSession, meters: DataFrame, complaints: DataFrame, out_dir: str,
        cfg: C.Config = C.DEFAULT, pipeline: str = "all", stage: bool = True,
        max_parallel: int = 4) -> dict[str, float]:
    """Refresh every summary of ``out_dir`` (a ``VersionedStore``) under one version; returns seconds per summary.

    Readers see the old version until all summaries are written; a run that fails changes
    nothing, and a run of one pipeline leaves the other's summaries as they are.
    The summaries are independent jobs, so up to ``max_parallel`` are submitted at once
    (Spark schedules concurrent jobs over the same executors; short stages of
    one job fill the slots another leaves idle).
    """
    from concurrent.futures import ThreadPoolExecutor

    if stage:
        meters, complaints = stage_facts(spark, meters, complaints)
    frames = build_all(meters, complaints, cfg, pipeline)
    store = VersionedStore(spark, out_dir)
    base, folders = store.manifest(), {name: store.new_folder(name) for name in frames}

    def one(item):
        name, df = item
        t0 = time.time()
        write_summary(df, store.full(folders[name]))
        return name, time.time() - t0

    with ThreadPoolExecutor(max_workers=max(1, max_parallel)) as ex:
        times = dict(ex.map(one, frames.items()))
    store.commit(folders, base)
    return times


def main(argv=None) -> None:
    """spark-submit entry: refresh summaries from fact Parquet (or the test binding)."""
    import argparse
    import json

    from ..session import get_spark
    from ..sources.fixtures import bind_complaints, bind_meters

    ap = argparse.ArgumentParser(description="full refresh of the KPI summaries")
    ap.add_argument("--meters")
    ap.add_argument("--complaints")
    ap.add_argument("--sf-dir", help="bind the facts from test tables instead")
    ap.add_argument("--out", required=True)
    ap.add_argument("--pipeline", choices=["mi", "om", "all"], default="all")
    ap.add_argument("--meter-as-of", help="YYYY-MM-DD run date for meter ageing (default: today, UTC)")
    ap.add_argument("--complaint-as-of", help="YYYY-MM-DDTHH:MM:SS run time for ticket ageing (default: now, UTC)")
    a = ap.parse_args(argv)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    cfg = C.Config(meter_as_of=dt.date.fromisoformat(a.meter_as_of) if a.meter_as_of else now.date(),
                   complaint_as_of=dt.datetime.fromisoformat(a.complaint_as_of) if a.complaint_as_of else now)
    spark = SparkSession.getActiveSession() or get_spark()
    if a.sf_dir:
        meters, complaints = bind_meters(spark, a.sf_dir), bind_complaints(spark, a.sf_dir)
    else:
        meters, complaints = spark.read.parquet(a.meters), spark.read.parquet(a.complaints)
    # facts that are Parquet already are read where they lie; the test binding is a join, computed once
    print(json.dumps(run(spark, meters, complaints, a.out, cfg=cfg, pipeline=a.pipeline, stage=bool(a.sf_dir))))


if __name__ == "__main__":
    main()
