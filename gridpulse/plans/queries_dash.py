"""Registers every dashboard section as a query (default parameters plus a few
parameter variants that exercise the other code paths)."""
from __future__ import annotations

from .. import config as C
from ..functions.filters import Filters
from ..operators import builders_mi as BM
from ..operators import builders_om as BO
from ..oracles import builders as OB
from ..sources.fixtures import as_ctes, bind_complaints, bind_meters, with_facts
from . import dashboards_mi as QM
from .base import Plan
from .registry import REGISTRY

BASES = {
    "a01": ("m", BM.mi_progress, OB.a01), "a02": ("m", BM.mi_technician_productivity, OB.a02),
    "a04": ("m", BM.inventory_utilization, OB.a04), "a05": ("m", BM.stock_ageing, OB.a05),
    "a06": ("m", BM.mi_vs_sat, OB.a06), "a07": ("m", BM.non_sat_ageing, OB.a07),
    "a08": ("m", BM.meter_journey, OB.a08), "a09": ("m", BM.meter_stage, OB.a09),
    "a10": ("m", BM.command_center, OB.a10), "a11": ("m", BM.command_center_trend, OB.a11),
    "a12": ("m", BM.command_center_milestone, OB.a12), "a13": ("m", BM.mi_sat_invoice, OB.a13),
    "a14": ("m", BM.revenue_realized, OB.a14), "a15": ("m", BM.revenue_ageing, OB.a15),
    "a16": ("mc", BO.defective_meters, OB.a16), "a17": ("c", BO.om_team_productivity, OB.a17),
    "a18": ("c", BO.om_open_ageing, OB.a18), "a19": ("c", BO.om_avg_closure_time, OB.a19),
    "a20": ("c", BO.om_closed_analysis, OB.a20),
}


def base_frames(spark, sf_dir: str, keys) -> dict:
    out, facts = {}, {}
    for k in keys:
        kind, fn, _ = BASES[k]
        if "m" in kind and "m" not in facts:
            facts["m"] = bind_meters(spark, sf_dir)
        if "c" in kind and "c" not in facts:
            facts["c"] = bind_complaints(spark, sf_dir)
        out[k] = fn(facts["c"], facts["m"]) if kind == "mc" else fn(facts[kind])
    return out


def plan_query(plan: Plan):
    return lambda spark, sf: plan.spark(base_frames(spark, sf, plan.bases))


def plan_oracle(plan: Plan):
    def build():
        ctes = [c for k in plan.bases for c in as_ctes(f"b_{k}", BASES[k][2]())]
        return with_facts(*ctes, select=plan.sql({k: f"b_{k}" for k in plan.bases}))
    return build


def reg_plan(name: str, plan: Plan) -> None:
    REGISTRY[name] = (plan_query(plan), plan_oracle(plan))


def reg_dash(prefix: str, sections: dict) -> None:
    for sec, plan in sections.items():
        reg_plan(f"{prefix}_{sec}", plan)


F0 = Filters()
reg_dash("q01_progress", QM.q01_progress(F0))
reg_dash("q01_progress_consumer_zone", {k: v for k, v in QM.q01_progress(F0.with_(category="consumer", level="zone")).items() if k != "total"})
reg_dash("q01_progress_asia_feeder_weekly", QM.q01_progress(F0.with_(project="asia", category="feeder", level="circle", duration="weekly")))
reg_dash("q02_technician_productivity", QM.q02_technician_productivity(F0))
reg_dash("q02_technician_productivity_dated", {k: v for k, v in QM.q02_technician_productivity(
    F0.with_(duration="weekly", level="project", start_date="1995-01-01", end_date="1996-06-30")).items()
    if k in ("summary", "trend", "comparison")})
reg_dash("q03_productivity_trend", QM.q03_productivity_trend(F0))
reg_dash("q04_inventory_utilization", QM.q04_inventory_utilization(F0))
reg_dash("q04_inventory_utilization_consumer_monthly", QM.q04_inventory_utilization(F0.with_(category="consumer", duration="monthly")))
reg_dash("q05_pace_vs_stock", QM.q05_pace_vs_stock(F0.with_(duration="weekly")))
reg_dash("q06_stock_ageing", QM.q06_stock_ageing(F0))
reg_dash("q06_stock_ageing_consumer", QM.q06_stock_ageing(F0.with_(category="consumer", level="division")))
reg_dash("q07_mi_vs_sat", QM.q07_mi_vs_sat(F0))
reg_dash("q08_non_sat_ageing", QM.q08_non_sat_ageing(F0))
reg_dash("q08_non_sat_ageing_dt", QM.q08_non_sat_ageing(F0.with_(category="dt", project="america", level="zone")))
reg_dash("q09_meter_journey", QM.q09_meter_journey(F0))
reg_dash("q09_meter_journey_feeder_monthly", QM.q09_meter_journey(F0.with_(category="feeder", duration="monthly")))
reg_dash("q10_pending_funnel", QM.q10_pending_funnel(F0))
reg_dash("q11_sat_invoice", QM.q11_sat_invoice(F0))
reg_dash("q11_sat_invoice_consumer", QM.q11_sat_invoice(F0.with_(category="consumer")))
reg_dash("q12_revenue_realized", QM.q12_revenue_realized(F0))
reg_dash("q13_revenue_ageing", QM.q13_revenue_ageing(F0))
reg_dash("q14_defective_meters", QM.q14_defective_meters(F0))
reg_dash("q15_command_center", QM.q15_command_center(C.DEFAULT.stage9_project))
reg_plan("q16_stage_cards_all", QM.q16_stage_cards_all())
reg_plan("q17_region_monthly", QM.q17_region_monthly("asia"))
reg_dash("q34_sat_invoice_combined", {"summary": QM.q11_sat_invoice(F0, combined_invoice=True)["summary"]})


# O&M ---------------------------------------------------------------------------
from . import dashboards_om as QO  # noqa: E402

reg_dash("q18_team_productivity", QO.q18_team_productivity(F0))
reg_dash("q18_team_productivity_asia_weekly", {k: v for k, v in QO.q18_team_productivity(
    F0.with_(project="asia", duration="weekly", level="zone", category="dt")).items() if k != "insights"})
reg_dash("q19_productivity_trend", QO.q19_productivity_trend(F0))
reg_plan("q20_open_tickets_default_page", QO.q20_open_tickets(Filters()))
reg_plan("q22_closure_list_default_page", QO.q22_closure_list(Filters()))
reg_plan("q20_open_tickets_page", QO.q20_open_tickets(Filters(limit=100, offset=50)))
reg_dash("q21_open_ageing", QO.q21_open_ageing(F0))
reg_dash("q21_open_ageing_dated", {k: v for k, v in QO.q21_open_ageing(
    F0.with_(level="circle", duration="weekly", start_date="2023-10-01", end_date="2023-12-15")).items()
    if k in ("summary", "trend", "comparison")})
reg_plan("q20_open_tickets_meter_category", QO.q20_open_tickets(Filters.from_params({"meter_category": "dt", "limit": 500})))
reg_plan("q22_closure_list_om_category", QO.q22_closure_list(Filters.from_params({"om_category": "Feeder", "limit": 500})))
reg_dash("q04_inventory_utilization_meter_category", QM.q04_inventory_utilization(Filters.from_params({"category": "total", "meter_category": "con%"})))
reg_dash("q06_stock_ageing_meter_category", {"summary": QM.q06_stock_ageing(Filters.from_params({"meter_category": "dt"}))["summary"]})
reg_dash("q14_defective_meters_meter_category", {"summary": QM.q14_defective_meters(
    Filters.from_params({"meter_category": "Consumer"}, category_from_meter=True))["summary"]})
reg_plan("q22_closure_list_page", QO.q22_closure_list(Filters(limit=200, offset=10)))
reg_dash("q23_closure_time", QO.q23_closure_time(F0))
reg_dash("q23_closure_time_consumer_daily", QO.q23_closure_time(F0.with_(category="consumer", duration="daily", level="zone")))
reg_dash("q24_closed_analysis", QO.q24_closed_analysis(F0))
reg_dash("q24_closed_analysis_monthly", QO.q24_closed_analysis(F0.with_(duration="monthly", project="africa", level="division")))
reg_plan("q32_open_and_closure", QO.q32_open_and_closure(F0))
reg_dash("q31_closure_time_nested", QO.q31_closure_time_nested(F0))

# Parameter variants: bucket paths (consumer sub-buckets, flat feeder/dt), one
# project with a lower level, date ranges, non-default grains.
FC = F0.with_(category="consumer")
reg_dash("q07_mi_vs_sat_consumer_zone", QM.q07_mi_vs_sat(FC.with_(level="zone")))
reg_dash("q07_mi_vs_sat_asia_dt_dated", QM.q07_mi_vs_sat(F0.with_(project="asia", category="dt", level="feeder",
                                                                 start_date="1995-01-01", end_date="1996-12-31")))
reg_dash("q09_meter_journey_consumer_weekly", QM.q09_meter_journey(FC.with_(duration="weekly", level="circle")))
reg_dash("q10_pending_funnel_consumer", QM.q10_pending_funnel(FC))
reg_dash("q10_pending_funnel_africa_feeder_substation", QM.q10_pending_funnel(
    F0.with_(project="africa", category="feeder", level="substation")))
reg_dash("q12_revenue_realized_consumer_monthly", QM.q12_revenue_realized(FC.with_(duration="monthly")))
reg_dash("q13_revenue_ageing_consumer", QM.q13_revenue_ageing(FC.with_(level="dtr")))
reg_dash("q13_revenue_ageing_dt", QM.q13_revenue_ageing(F0.with_(category="dt", project="asia")))
reg_dash("q14_defective_meters_consumer_daily", QM.q14_defective_meters(FC.with_(duration="daily")))
reg_dash("q14_defective_meters_dt_weekly", QM.q14_defective_meters(F0.with_(category="dt", duration="weekly", level="zone")))
reg_dash("q03_productivity_trend_consumer_weekly", QM.q03_productivity_trend(FC.with_(duration="weekly", level="circle")))
reg_dash("q19_productivity_trend_dt", QO.q19_productivity_trend(F0.with_(category="dt", level="division")))
reg_dash("q24_closed_analysis_consumer_weekly", QO.q24_closed_analysis(
    F0.with_(category="consumer", duration="weekly", start_date="2023-11-01", end_date="2024-01-15")))
reg_dash("q23_closure_time_asia_weekly", QO.q23_closure_time(F0.with_(project="asia", duration="weekly", level="dtr")))
reg_dash("q21_open_ageing_feeder_monthly", QO.q21_open_ageing(F0.with_(category="feeder", duration="monthly", project="europe")))
reg_dash("q15_command_center_asia", QM.q15_command_center("asia"))

from .extras import register_all as _register_extras  # noqa: E402

_register_extras()

# dimension filters with odd case and wildcards, dt and dtr, alias durations, typo and unknown levels
reg_dash("q01_progress_dims", QM.q01_progress(F0.with_(dims=(("discom", "%Na%"),))))
reg_dash("q01_progress_unknown_level", {"comparison": QM.q01_progress(F0.with_(level="block"))["comparison"]})
reg_dash("q09_meter_journey_as_on", QM.q09_meter_journey(F0.with_(duration="latest_sat", level="divison")))
reg_dash("q09_meter_journey_unknown_level", {"comparison": QM.q09_meter_journey(F0.with_(level="block"))["comparison"]})
reg_dash("q13_revenue_ageing_dtr", QM.q13_revenue_ageing(F0.with_(category="dtr")))
reg_dash("q14_defective_meters_dtr", QM.q14_defective_meters(F0.with_(category="dtr", duration="weekly")))

from .crews import register_all as _register_crews  # noqa: E402

_register_crews()
