"""Dashboard lookup by the reference's read-API path.

``dashboard(path, params, bases)`` returns ``{section: DataFrame}`` for a
request path such as ``/api/mi/progress/dashboard`` and its query-parameter
dict. ``bases`` maps summary ids (``a01`` ... ``a20``) to DataFrames, for
example ``read_summaries(spark, out_dir)`` over the pipeline's output. This is
a function table, not a server.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..functions.filters import Filters
from ..sources.versions import VersionedStore
from . import dashboards_mi as QM
from . import dashboards_om as QO

SUMMARY_TABLES = {
    "a01": "sql_mi_progress", "a02": "sql_mi_technician_productivity", "a04": "sql_inventory_utilization",
    "a05": "sql_stock_ageing", "a06": "sql_mi_vs_sat", "a07": "sql_non_sat_ageing",
    "a08": "sql_meter_journey_avg_time", "a09": "sql_meter_current_stage", "a10": "dashboard_command_center",
    "a11": "dashboard_command_center_trend", "a12": "dashboard_command_center_milestone",
    "a13": "sql_mi_sat_invoice", "a14": "sql_revenue_realized", "a15": "sql_revenue_ageing",
    "a16": "sql_defective_meters", "a17": "sql_om_team_productivity_dashboard", "a18": "sql_om_open_ageing",
    "a19": "sql_om_avg_closure_time", "a20": "sql_om_closed_analysis",
}

ROUTES = {
    "/api/mi/progress/dashboard": lambda f, cfg: QM.q01_progress(f, cfg),
    "/api/mi/productivity/team/dashboard": lambda f, cfg: QM.q02_technician_productivity(f, cfg),
    "/api/mi/productivity/trend/dashboard": lambda f, cfg: QM.q03_productivity_trend(f, cfg),
    "/api/mi/inventory-utilization/summary": lambda f, cfg: QM.q04_inventory_utilization(f, cfg),
    "/api/mi/pace-vs-stock/summary": lambda f, cfg: QM.q05_pace_vs_stock(f, cfg),
    "/api/mi/stock-ageing/dashboard": lambda f, cfg: QM.q06_stock_ageing(f, cfg),
    "/api/mi/mi-vs-sat/summary": lambda f, cfg: QM.q07_mi_vs_sat(f, cfg),
    "/api/mi/non-sat-ageing/dashboard": lambda f, cfg: QM.q08_non_sat_ageing(f, cfg),
    "/api/mi/meter-journey/dashboard": lambda f, cfg: QM.q09_meter_journey(f, cfg),
    "/api/mi/meter-stage": lambda f, cfg: QM.q10_pending_funnel(f, cfg),
    "/api/mi/mi-vs-sat-vs-invoice/summary": lambda f, cfg: QM.q11_sat_invoice(f, cfg),
    "/api/mi/revenue-realized/summary": lambda f, cfg: QM.q12_revenue_realized(f, cfg),
    "/api/mi/revenue-ageing/summary": lambda f, cfg: QM.q13_revenue_ageing(f, cfg),
    "/api/mi/defective-meters/summary": lambda f, cfg: QM.q14_defective_meters(f, cfg),
    "/api/mi/sat-dash/satBlueData": lambda f, cfg: {"cards": QM.q16_stage_cards_all(cfg)},
    "/api/om/productivity-team/dashboard": lambda f, cfg: QO.q18_team_productivity(f),
    "/api/om/productivity-trend/dashboard": lambda f, cfg: QO.q19_productivity_trend(f),
    "/api/om/open-ageing": lambda f, cfg: {"rows": QO.q20_open_tickets(f)},
    "/api/om/open-ageing/dashboard": lambda f, cfg: QO.q21_open_ageing(f),
    "/api/om/avg-closure-time": lambda f, cfg: {"rows": QO.q22_closure_list(f)},
    "/api/om/avg-closure-time/dashboard": lambda f, cfg: QO.q23_closure_time(f),
    "/api/om/closed-analysis/dashboard": lambda f, cfg: QO.q24_closed_analysis(f),
}
#: Here a meter_category stands for a category that is not given; elsewhere it is a filter of its own.
CATEGORY_FROM_METER = {"/api/mi/revenue-ageing/summary", "/api/mi/defective-meters/summary"}
REGION_ROUTES = {
    "/api/mi/command-center/": lambda region, cfg: QM.q15_command_center(region, cfg),
    "/api/mi/sat-dash/": lambda region, cfg: {"monthly": QM.q17_region_monthly(region, cfg)},
}


def read_summaries(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """Summary DataFrames of the pipeline's newest version, resolved once (lazy reads)."""
    frames = VersionedStore(spark, out_dir).frames()
    return {k: frames[v] for k, v in SUMMARY_TABLES.items() if v in frames}


def dashboard(path: str, params: dict | None, bases: dict, cfg: C.Config = C.DEFAULT) -> dict[str, DataFrame]:
    path = path.rstrip("/")
    f = Filters.from_params(params or {}, category_from_meter=path in CATEGORY_FROM_METER)
    if path in ROUTES:
        plans = ROUTES[path](f, cfg)
    else:
        prefix = next((p for p in REGION_ROUTES if path.startswith(p)), None)
        if prefix is None:
            raise KeyError(f"unknown dashboard path {path!r}")
        plans = REGION_ROUTES[prefix](path[len(prefix):], cfg)
    return {name: plan.spark(bases) for name, plan in plans.items()}
