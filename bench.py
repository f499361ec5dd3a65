"""Benchmark: full refresh of the 19 summaries and every dashboard over them.

Runs on local[$BENCH_CPUS] against $BENCH_SF_DIR (default /root/testdata/sf0.1)
and prints one JSON line. Timings are wall seconds of a cold run in one JVM:
  load_facts    bind the two fact tables from the test tables and stage them
                as Parquet in the checkpoint folder (the ETL's input)
  aNN_*         build + write one summary (full refresh, S9)
  qNN_*         all sections of one dashboard, computed and collected from
                the written summaries
  summaries_all / dashboards_all   wall time of each phase; independent jobs
                are submitted concurrently ($BENCH_PARALLEL, default 4), so the
                per-item times overlap and do not add up to the phase time
"""
import json
import os
from concurrent.futures import ThreadPoolExecutor
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridpulse import config as C  # noqa: E402
from gridpulse.plans import dashboards_mi as QM  # noqa: E402
from gridpulse.plans import dashboards_om as QO  # noqa: E402
from gridpulse.plans import pipeline  # noqa: E402
from gridpulse.session import get_spark  # noqa: E402
from gridpulse.sources.fixtures import bind_complaints, bind_meters  # noqa: E402
from gridpulse.sources.versions import VersionedStore  # noqa: E402

PARALLEL = int(os.environ.get("BENCH_PARALLEL", "4"))

BASE_TABLE = {
    "a01": "sql_mi_progress", "a02": "sql_mi_technician_productivity", "a04": "sql_inventory_utilization",
    "a05": "sql_stock_ageing", "a06": "sql_mi_vs_sat", "a07": "sql_non_sat_ageing",
    "a08": "sql_meter_journey_avg_time", "a09": "sql_meter_current_stage", "a10": "dashboard_command_center",
    "a11": "dashboard_command_center_trend", "a12": "dashboard_command_center_milestone",
    "a13": "sql_mi_sat_invoice", "a14": "sql_revenue_realized", "a15": "sql_revenue_ageing",
    "a16": "sql_defective_meters", "a17": "sql_om_team_productivity_dashboard", "a18": "sql_om_open_ageing",
    "a19": "sql_om_avg_closure_time", "a20": "sql_om_closed_analysis", "m03": "sql_non_sat_ageing_dashboard",
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="gridpulse-bench")
    out = tempfile.mkdtemp(prefix="gridpulse-bench-", dir="/tmp")
    times = {}

    t_all = time.time()
    t0 = time.time()
    meters, complaints = pipeline.stage_facts(spark, bind_meters(spark, sf_dir), bind_complaints(spark, sf_dir))
    times["load_facts"] = time.time() - t0

    inv = {v: k for k, v in BASE_TABLE.items()}
    t0 = time.time()
    per = pipeline.run(spark, meters, complaints, out, stage=False, max_parallel=PARALLEL)
    times["summaries_all"] = time.time() - t0
    for name, sec in per.items():
        times[f"{inv[name]}_{name}"] = sec

    frames = VersionedStore(spark, out).frames()
    bases = {k: frames[v] for k, v in BASE_TABLE.items()}
    dashboards = {
        "q01_progress": QM.q01_progress(), "q02_technician_productivity": QM.q02_technician_productivity(),
        "q03_productivity_trend": QM.q03_productivity_trend(), "q04_inventory_utilization": QM.q04_inventory_utilization(),
        "q05_pace_vs_stock": QM.q05_pace_vs_stock(), "q06_stock_ageing": QM.q06_stock_ageing(),
        "q07_mi_vs_sat": QM.q07_mi_vs_sat(), "q08_non_sat_ageing": QM.q08_non_sat_ageing(),
        "q09_meter_journey": QM.q09_meter_journey(), "q10_pending_funnel": QM.q10_pending_funnel(),
        "q11_sat_invoice": QM.q11_sat_invoice(), "q12_revenue_realized": QM.q12_revenue_realized(),
        "q13_revenue_ageing": QM.q13_revenue_ageing(), "q14_defective_meters": QM.q14_defective_meters(),
        "q15_command_center": QM.q15_command_center(C.DEFAULT.stage9_project),
        "q18_team_productivity": QO.q18_team_productivity(), "q19_productivity_trend": QO.q19_productivity_trend(),
        "q20_open_tickets": {"page": QO.q20_open_tickets()}, "q21_open_ageing": QO.q21_open_ageing(),
        "q22_closure_list": {"page": QO.q22_closure_list()}, "q23_closure_time": QO.q23_closure_time(),
        "q24_closed_analysis": QO.q24_closed_analysis(), "q31_closure_time_nested": QO.q31_closure_time_nested(),
    }
    def run_dashboard(item):
        # the sections of one dashboard are independent jobs: submit them together
        qname, sections = item
        t0 = time.time()
        with ThreadPoolExecutor(max_workers=len(sections)) as ex:
            list(ex.map(lambda p: p.spark(bases).collect(), sections.values()))
        return qname, time.time() - t0

    t0 = time.time()
    with ThreadPoolExecutor(max_workers=PARALLEL) as ex:
        for qname, sec in ex.map(run_dashboard, dashboards.items()):
            times[qname] = sec
    times["dashboards_all"] = time.time() - t0
    total = time.time() - t_all
    print(json.dumps({"metric": "full_refresh_plus_dashboards_wall", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()},
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
