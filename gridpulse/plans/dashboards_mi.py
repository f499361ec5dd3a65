"""Meter (MI) dashboards Q1-Q17 over the summary tables.

Each function takes :class:`Filters` and returns ``{section: Plan}``. Sections
are flat frames: bucketed measures are columns ``<metric>__<bucket>``.
"""
from __future__ import annotations

from .. import config as C
from ..functions.filters import Filters, normalise_duration
from ..operators import dual as D
from ..operators import rollups as R
from ..operators.sections import Section
from .base import Plan, category_scope, chain, date_range, dim_filters, mi_label, project_scope_mi, single

ALL_MI_COLS = set(C.MIDIM) | {"period_type", "period_value"}
GEO_LEVELS = ["discom", "zone", "circle", "division", "subdivision", "substation", "feeder", "dtr"]


def _n(x):
    return D.c(x).alias(x)


def _where(f: Filters, cfg, *, restrict_three, period_type=None, date_col="period_start", dt_rows=()):
    preds = dim_filters(f, ALL_MI_COLS - {"project", "period_type"})
    if period_type:
        preds.append(D.eq(D.c("period_type"), D.lit(period_type)))
    preds.append(project_scope_mi(f, cfg))
    preds.append(category_scope(f, restrict_three, dt_rows))
    if date_col:
        preds += date_range(f, date_col)
    return D.and_(*[p for p in preds if p is not None])


def _period_keys():
    return [_n("period_start"), _n("period_value")]


def _label(f, allowed=tuple(C.MIDIM), project_level=False):
    return [mi_label(f, list(allowed), project_level).alias("label")]


def _total_mode(f):
    return "mapped" if f.category_l != "consumer" else "all"


# Q1 --------------------------------------------------------------------------
def q01_progress(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """MI progress: grand total, trend by period and comparison by label, each
    pivoted into category buckets (KPI 1 restricts `total` to the 3 categories)."""
    dur = normalise_duration(f.duration, "daily")
    w = _where(f, cfg, restrict_three=True, period_type=dur)
    m = {"total_mi_progress": D.c("total_mi_progress")}
    aggs = D.bucket_aggs(m, f.category_l, total_mode=_total_mode(f))
    return {
        "total": single("a01", Section(where=w, aggs=[D.sum0(D.c("total_mi_progress")).alias("total_progress")])),
        "trend": single("a01", Section(where=w, group=_period_keys(), aggs=aggs, order=["period_start"])),
        "comparison": single("a01", Section(where=w, group=[mi_label(f, C.MIDIM, unknown_is_discom=True).alias("label")], aggs=aggs,
                                            order=["label"])),
    }


# Q2 / Q3 ---------------------------------------------------------------------
def _prod_where(f, cfg):
    preds = dim_filters(f, set(GEO_LEVELS) | {"new_meter_type"})
    preds.append(project_scope_mi(f, cfg))
    preds.append(category_scope(f, False))
    preds += date_range(f, "installation_date")
    return D.and_(*[p for p in preds if p is not None])


def _bucket_label(dur: str) -> D.E:
    d = D.c("installation_date")
    if dur == "weekly":
        return D.date_fmt(D.trunc(d, "week"), "yyyy-MM-dd", "%Y-%m-%d")
    if dur == "monthly":
        return D.date_fmt(d, "yyyy-MM", "%Y-%m")
    return D.date_fmt(d, "yyyy-MM-dd", "%Y-%m-%d")


PROD_LEVELS = ["project", "discom", "zone", "circle", "division", "subdivision"]


def _with_spine(plan: Plan, key: str, cols: list[str], f: Filters, zero_double=()) -> Plan:
    """Keep CONSUMER/FEEDER/DT present (zero rows) when category=total."""
    if f.category_l != "total":
        return plan
    from pyspark.sql import functions as F

    def sp(d):
        df = plan.spark(d)
        zero = {c: F.lit(0.0) if c in zero_double else F.lit(0).cast("long") for c in cols}
        spine = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in C.CATEGORY_KEYS])).alias(key))
        both = df.select(key, *cols).unionByName(spine.select(key, *[zero[c].alias(c) for c in cols]))
        return both.groupBy(key).agg(*[F.max(c).alias(c) for c in cols])  # no measure is below zero

    def sq(n):
        body = plan.sql(n)
        vals = ", ".join(f"('{k}')" for k in C.CATEGORY_KEYS)
        zs = ", ".join(("CAST(0 AS DOUBLE)" if c in zero_double else "CAST(0 AS BIGINT)") + f" AS {D.q(c)}" for c in cols)
        return (f"SELECT * FROM ({body}) _b UNION ALL SELECT s.k AS {D.q(key)}, {zs} FROM (VALUES {vals}) s(k) "
                f"WHERE s.k NOT IN (SELECT {D.q(key)} FROM ({body}) _c WHERE {D.q(key)} IS NOT NULL)")
    return Plan(plan.bases, sp, sq)


def q02_technician_productivity(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 2.5: Σ installs, distinct technicians, active days and the mean of
    daily (installs / technicians) ratios, by total / period / label / category."""
    dur = normalise_duration(f.duration, "daily")
    w = _prod_where(f, cfg)
    kw = dict(day="installation_date", who="technician", measure="total_installations",
              out_total="total_installations")
    summary = R.productivity("a02", [], w, people_col="total_active_technicians", **kw)
    trend = R.productivity("a02", [_bucket_label(dur).alias("date")], w, order=["date"], **kw)
    comparison = R.productivity("a02", _label(f, PROD_LEVELS, project_level=True), w, order=["label"], **kw)
    cat = R.productivity("a02", [D.coalesce(D.c("meter_category"), D.lit("Unknown")).alias("meter_category")], w, **kw)
    cat = _with_spine(cat, "meter_category", ["total_installations", "active_technicians", "active_days",
                                              "productivity_per_technician_per_day"], f,
                      zero_double=("productivity_per_technician_per_day",))
    insights = R.performers("a02", w, day="installation_date", who="technician", measure="total_installations")
    return {"summary": summary, "trend": trend, "comparison": comparison, "category": cat, "insights": insights}


def q03_productivity_trend(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 3.5: monthly trend shape; summary counts distinct months."""
    dur = normalise_duration(f.duration, "monthly")
    w = _prod_where(f, cfg)
    kw = dict(day="installation_date", who="technician", measure="total_installations",
              out_total="total_installations", people_col=None, extra=True)
    # summary: Σ installs, distinct months, mean daily ratio
    stages = R.daily_grain([], w, "installation_date", "technician", "total_installations")
    s3 = Section(aggs=[D.sum0(D.c("day_total")).alias("total_installations"),
                       D.count_distinct(D.date_fmt(D.c("installation_date"), "yyyy-MM", "%Y-%m")).alias("total_active_months"),
                       D.avg(D.c("daily_prod")).alias("_p")],
                 post=[_n("total_installations"), _n("total_active_months"),
                       D.round2(D.c("_p")).alias("productivity_per_technician_per_day")])
    summary = chain("a02", *stages, s3)
    trend = R.productivity("a02", [_bucket_label(dur).alias("month")], w, order=["month"], **kw)
    comparison = R.productivity("a02", _label(f, PROD_LEVELS, project_level=True), w, order=["label"], **kw)
    cat = R.productivity("a02", [D.coalesce(D.c("meter_category"), D.lit("Unknown")).alias("meter_category")], w, **kw)
    cat = _with_spine(cat, "meter_category", ["total_installations", "active_days", "avg_active_technicians",
                                              "productivity_per_technician_per_day"], f,
                      zero_double=("avg_active_technicians", "productivity_per_technician_per_day"))
    return {"summary": summary, "trend": trend, "comparison": comparison, "category": cat}


# Q4 / Q5 ---------------------------------------------------------------------
def _inv_section(f, w, group, pace: bool, order):
    b, keys = D.bucket(f.category_l)
    aggs = [D.sum0(D.c("total_inventory")).alias("total_inventory"),
            D.sum0(D.c("total_installed")).alias("total_installed")]
    post = [_n(g.name) for g in group] + [_n("total_inventory"), _n("total_installed")]
    post.append(D.clamp0(D.c("total_inventory"), D.c("total_installed")).alias("remaining_stock") if pace
                else D.pct2(D.c("total_installed"), D.c("total_inventory")).alias("utilization_rate_pct"))
    for k in keys:
        is_k = D.eq(b, D.lit(k))
        aggs += [D.sum_if0(is_k, D.c("total_inventory")).alias(f"inventory__{k}"),
                 D.sum_if0(is_k, D.c("total_installed")).alias(f"installed__{k}")]
        post += [_n(f"inventory__{k}"), _n(f"installed__{k}")]
        post.append(D.clamp0(D.c(f"inventory__{k}"), D.c(f"installed__{k}")).alias(f"remaining_stock__{k}") if pace
                    else D.pct2(D.c(f"installed__{k}"), D.c(f"inventory__{k}")).alias(f"utilization_rate_pct__{k}"))
    return Section(where=w, group=group, aggs=aggs, post=post, order=order)


def q04_inventory_utilization(f: Filters = Filters(), cfg: C.Config = C.DEFAULT, pace: bool = False) -> dict:
    """KPI 4 (and 5 with pace=True): inventory vs installed, totals, period
    breakdown and comparison with per-bucket inventory/installed and pct
    (or clamped remaining stock)."""
    dur = normalise_duration(f.duration, "daily")
    w = _where(f, cfg, restrict_three=False, period_type=dur)
    summary = Section(where=w, aggs=[D.sum0(D.c("total_inventory")).alias("total_inventory"),
                                     D.sum0(D.c("total_installed")).alias("total_installed"),
                                     D.sum0(D.c("remaining_stock")).alias("remaining_stock")],
                      post=[_n("total_inventory"), _n("total_installed"),
                            D.pct2(D.c("total_installed"), D.c("total_inventory")).alias("utilization_rate_pct"),
                            _n("remaining_stock")])
    return {
        "summary": single("a04", summary),
        "period_breakdown": single("a04", _inv_section(f, w, _period_keys(), pace, ["period_start"])),
        "comparison": single("a04", _inv_section(f, w, _label(f), pace, ["label"])),
    }


def q05_pace_vs_stock(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    return q04_inventory_utilization(f, cfg, pace=True)


# Q6 / Q8 / Q13: bucketed age classes ----------------------------------------
AGE4 = ["age_0_30", "age_31_60", "age_61_90", "age_90_plus"]


def _bucketed(f, w, group, measures: dict, grand: list, order, substring=False):
    aggs = grand + D.bucket_aggs(measures, f.category_l, total_mode="mapped", substring=substring)
    return Section(where=w, group=group, aggs=aggs, order=order)


def q06_stock_ageing(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 6: four stock-age classes by buckets, plus total_stock over all rows."""
    dur = normalise_duration(f.duration, "monthly")
    w = _where(f, cfg, restrict_three=False, period_type=dur)
    m = {a: D.c(a) for a in AGE4}
    grand = [D.sum0(D.add(*[D.c(a) for a in AGE4])).alias("total_stock")]
    return {"summary": single("a05", _bucketed(f, w, [], m, grand, None)),
            "comparison": single("a05", _bucketed(f, w, _label(f), m, grand, ["label"]))}


def q07_mi_vs_sat(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 7: total_mi, total_sat, pct and nine stage counts by buckets (no period filter)."""
    w = _where(f, cfg, restrict_three=False)
    sat = {f"sat_{k}": D.c(f"sat_{k}") for k in C.SAT_STAGES}
    grand = [D.sum0(D.c("total_mi")).alias("total_mi"), D.sum0(D.c("total_sat")).alias("total_sat")]

    def with_pct(sec, group):
        names = [g.name for g in group] + [a.name for a in sec.aggs]
        post = [_n(x) for x in names] + [D.pct2(D.c("total_sat"), D.c("total_mi")).alias("sat_progress_pct")]
        return Section(where=sec.where, group=sec.group, aggs=sec.aggs, post=post, order=sec.order)
    lab = _label(f)
    return {"summary": single("a06", with_pct(_bucketed(f, w, [], sat, grand, None), [])),
            "comparison": single("a06", with_pct(_bucketed(f, w, lab, sat, grand, ["label"]), lab))}


R17 = [("age_0_30", None, 30), ("age_31_60", 30, 60), ("age_61_90", 60, 90), ("age_91_120", 90, 120),
       ("age_120_plus", 120, None)]


def _age_flag(lo, hi, col="ageing_days") -> D.E:
    d = D.c(col)
    conds = []
    if lo is not None:
        conds.append(D.E(lambda: d.col > lo, f"({d.sql} > {lo})"))
    if hi is not None:
        conds.append(D.E(lambda: d.col <= hi, f"({d.sql} <= {hi})"))
    cond = D.and_(*conds)
    return D.case_when([(cond, D.lit(1))], D.lit(0))


def q08_non_sat_ageing(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 8: installed-without-SAT meters in five day classes by buckets."""
    w = _where(f, cfg, restrict_three=False, date_col="installation_date")
    m = {name: _age_flag(lo, hi) for name, lo, hi in R17}
    summary = _bucketed(f, w, [], m, [D.count_star().alias("total_non_sat")], None)
    comp = _bucketed(f, w, _label(f), m, [D.count_col(D.c("meter_serial_number")).alias("total_non_sat")], ["label"])
    return {"summary": single("a07", summary), "comparison": single("a07", comp)}


JOURNEY = ["inventory_to_store", "store_to_agency", "agency_to_meter_installation", "meter_installation_to_sat",
           "sat_to_invoice", "invoice_to_revenue", "total_journey"]


def _journey_section(f, w, group, order):
    """R11+R13: per bucket and stage the ceiled mean of the stored means, weighed by meter_count
    where the mean is not null (§2.14 #5-6); ``<stage>_exact`` is the ceiled Σ day sums / Σ non-null
    counts beside it; meter_count summed."""
    b, keys = D.bucket(f.category_l)
    scopes = [("", D.lit(True))] if b is None else [(f"__{k}", D.eq(b, D.lit(k))) for k in keys] + [("__total", D.not_null(b))]
    aggs, post, exact = [], [_n(g.name) for g in group], []
    mc = D.c("meter_count")
    for s in JOURNEY:
        for tail, scope in scopes:
            have = D.and_(scope, D.not_null(D.c(s)))
            aggs += [D.sum_where(have, D.mul(D.c(s), mc)).alias(f"_{s}{tail}_d"), D.sum_where(have, mc).alias(f"_{s}{tail}_w"),
                     D.sum_if0(scope, D.c(f"{s}_sum")).alias(f"_{s}{tail}_s"), D.sum_if0(scope, D.c(f"{s}_n")).alias(f"_{s}{tail}_n")]
            post.append(D.ceil_days(D.ratio(D.c(f"_{s}{tail}_d"), D.c(f"_{s}{tail}_w"))).alias(f"{s}{tail}"))
            exact.append(D.ceil_days(D.ratio(D.c(f"_{s}{tail}_s"), D.c(f"_{s}{tail}_n"))).alias(f"{s}_exact{tail}"))
    for tail, scope in scopes:
        aggs.append(D.sum_if0(scope, mc).alias(f"meter_count{tail}"))
        post.append(_n(f"meter_count{tail}"))
    return Section(where=w, group=group, aggs=aggs, post=post + exact, order=order)


def q09_meter_journey(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 9: stage means weighed by meter count, ceiled; the exact means as second metrics."""
    dur = normalise_duration(f.duration, "daily")
    dur = "daily" if dur == "as_on" else dur
    w = _where(f, cfg, restrict_three=True, period_type=dur)
    lab = [mi_label(f, GEO_LEVELS).alias("label")]
    return {"summary": single("a08", _journey_section(f, w, [], None)),
            "comparison": single("a08", _journey_section(f, w, lab, ["label"]))}


FUNNEL = {"inventory": "pending_inventory", "installed": "pending_installed", "sat_done": "pending_sat_done",
          "invoice_done": "pending_invoice_done"}


def q10_pending_funnel(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 10: pending-collection funnel (no time filter)."""
    w = _where(f, cfg, restrict_three=True, date_col=None)
    m = {k: D.c(v) for k, v in FUNNEL.items()}
    return {"summary": single("a09", _bucketed(f, w, [], m, [], None)),
            "comparison": single("a09", _bucketed(f, w, _label(f), m, [], ["label"]))}


SAT_INV = ["total_mi", "total_sat", "total_lumpsum_invoice", "total_pmpm_invoice"]


def q11_sat_invoice(f: Filters = Filters(), cfg: C.Config = C.DEFAULT, combined_invoice: bool = False) -> dict:
    """KPI 11: four counts by buckets (substring consumer rule P18).
    With combined_invoice=True (Q34) a total_invoice = lumpsum + PMPM column is added."""
    w = _where(f, cfg, restrict_three=False)
    m = {x: D.c(x) for x in SAT_INV}
    if combined_invoice:
        m["total_invoice"] = D.add(D.c("total_lumpsum_invoice"), D.c("total_pmpm_invoice"))
    return {"summary": single("a13", _bucketed(f, w, [], m, [], None, substring=True)),
            "comparison": single("a13", _bucketed(f, w, _label(f), m, [], ["label"], substring=True))}


REV = ["total_lumpsum_invoice", "total_pmpm_invoice", "total_lumpsum_collection", "total_pmpm_collection"]


def q12_revenue_realized(f: Filters = Filters(), cfg: C.Config = C.DEFAULT, apply_dates: bool = False) -> dict:
    """KPI 12: duration 'all' = no period filter; start/end dates are ignored
    unless apply_dates=True (the documented form, §2.14 #7)."""
    dur = (f.duration or "all").lower()
    w = _where(f, cfg, restrict_three=True, period_type=None if dur == "all" else dur,
               date_col="period_start" if apply_dates else None)
    m = {x: D.c(x) for x in REV}
    return {"summary": single("a14", _bucketed(f, w, [], m, [], None)),
            "comparison": single("a14", _bucketed(f, w, _label(f), m, [], ["label"]))}


def q13_revenue_ageing(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 13: four ages of uncollected revenue by buckets + total_pending; dtr is another name of dt."""
    dur = normalise_duration(f.duration, "monthly")
    w = _where(f, cfg, restrict_three=False, period_type=dur, dt_rows=("DT",))
    m = {a: D.c(a) for a in AGE4}
    grand = [D.sum0(D.add(*[D.c(a) for a in AGE4])).alias("total_pending")]
    return {"summary": single("a15", _bucketed(f, w, [], m, grand, None)),
            "comparison": single("a15", _bucketed(f, w, _label(f), m, grand, ["label"]))}


DEFECTS = [("total", None), ("burnt", C.DEFECT_BURNT), ("faulty", C.DEFECT_FAULTY), ("others", C.DEFECT_OTHERS)]


def q14_defective_meters(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """KPI 14: total/burnt/faulty/others (R20) by buckets; summary, period
    breakdown (label normalised to YYYY-MM-DD, P22) and comparison. dt and dtr
    both take the stored DT and DTR. A category replaces a meter_category filter."""
    dur = normalise_duration(f.duration, "monthly")
    if f.category_l != "total":
        f = f.with_(dims=tuple(d for d in f.dims if d[0] != "meter_category"))
    w = _where(f, cfg, restrict_three=False, period_type=dur, dt_rows=("DT", "DTR"))
    mc = D.c("meter_count")
    m = {}
    for name, t in DEFECTS:
        m[name] = mc if t is None else D.case_when([(D.eq(D.c("defective_type"), D.lit(t)), mc)], D.lit(0))
    pk = [_n("period_start"), D.date_fmt(D.c("period_start"), "yyyy-MM-dd", "%Y-%m-%d").alias("period_value")]
    return {"summary": single("a16", _bucketed(f, w, [], m, [], None)),
            "period_breakdown": single("a16", _bucketed(f, w, pk, m, [], ["period_start"])),
            "comparison": single("a16", _bucketed(f, w, _label(f), m, [], ["label"]))}


# Q15-Q17: command center ----------------------------------------------------
def _last_stage(project_upper: D.E, cfg) -> D.E:
    """The configured project shows stage 9 as its last card, others stage 8."""
    return D.case_when([(D.eq(project_upper, D.lit(cfg.stage9_project.upper())), D.lit(9))], D.lit(8))


def _cards(where: D.E, cfg) -> Plan:
    """Stage cards: one row per (project, card) with eligibility, achievement,
    throughput and the stage start date (MM/DD/YYYY)."""
    from pyspark.sql import functions as F

    def sp(d):
        cc = d["a10"].where(where.col)
        last = _last_stage(D.c("project"), cfg).col
        cards = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"sat_{k}_eligibility").alias("e"),
                                   F.col(f"sat_{k}_achievement").alias("a"),
                                   F.col(f"sat_{k}_throughput_pct").alias("t")) for k in C.SAT_STAGES])
        x = (cc.select("project", last.alias("_last"), F.explode(cards).alias("_c"))
             .where((F.col("_c.k") <= 7) | (F.col("_c.k") == F.col("_last")))
             .select("project", F.col("_c.k").alias("card"), F.concat(F.lit("SAT-"), F.col("_c.k").cast("string")).alias("stage"),
                     F.col("_c.e").alias("installedBase"), F.col("_c.a").alias("cumulativeSat"),
                     F.col("_c.t").alias("efficiencyPct"),
                     F.concat(F.lit("s"), F.col("_c.k").cast("string")).alias("_s")))
        ms = d["a12"].select(F.col("project").alias("_p"), F.col("stage").alias("_s2"), "start_date")
        j = x.join(ms, (x["project"].eqNullSafe(ms["_p"])) & (x["_s"] == ms["_s2"]), "left")
        return (j.select("project", "card", "stage", "installedBase", "cumulativeSat", "efficiencyPct",
                         F.date_format("start_date", "MM/dd/yyyy").alias("startSAT"))
                .orderBy("project", "card"))

    def sq(n):
        last = _last_stage(D.c("project"), cfg).sql
        unions = " UNION ALL ".join(
            f"SELECT project, {k} AS card, 'SAT-{k}' AS stage, sat_{k}_eligibility AS \"installedBase\", "
            f"sat_{k}_achievement AS \"cumulativeSat\", sat_{k}_throughput_pct AS \"efficiencyPct\", 's{k}' AS s, "
            f"{last} AS last FROM {n['a10']} WHERE {where.sql}" for k in C.SAT_STAGES)
        return (f"SELECT x.project, x.card, x.stage, x.\"installedBase\", x.\"cumulativeSat\", x.\"efficiencyPct\", "
                f"strftime(m.start_date, '%m/%d/%Y') AS \"startSAT\" FROM ({unions}) x "
                f"LEFT JOIN {n['a12']} m ON x.project IS NOT DISTINCT FROM m.project AND x.s = m.stage "
                f"WHERE x.card <= 7 OR x.card = x.last")
    return Plan(("a10", "a12"), sp, sq)


def q15_command_center(region: str, cfg: C.Config = C.DEFAULT) -> dict:
    """Command center for one region: snapshot, stage cards, monthly series, milestones."""
    w = D.ilike(D.c("project"), region)
    snap = Section(where=w, group=[_n("project")],
                   aggs=[D.sum0(D.c(x)).alias(x) for x in ("inventory", "installed", "total_sat", "total_invoice")])
    last = _last_stage(D.upper_trim(D.c("project")), cfg)
    sat_last = D.case_when([(D.eq(last, D.lit(9)), D.c("s9_added"))], D.c("s8_added"))
    series = Section(where=D.and_(w, D.eq(D.c("period_type"), D.lit("monthly"))),
                     group=[_n("project"), _n("period_start"), D.c("period_value").alias("month"),
                            D.c("inventory_added").alias("received"), D.c("installed_added").alias("installed"),
                            *[_n(f"s{k}_added") for k in range(1, 8)], sat_last.alias("s_last_added")],
                     aggs=[], order=["period_start"])
    ms = Section(where=w, group=[_n("project"), _n("stage"),
                                 *[D.date_fmt(D.c(c), "MM/dd/yyyy", "%m/%d/%Y").alias(c) for c in
                                   ("start_date", "lumpsum_inv_date", "pmpm_inv_date", "lumpsum_col_date", "pmpm_col_date")]],
                 aggs=[], order=["stage"])
    return {"snapshot": single("a10", snap), "cards": _cards(w, cfg), "monthly": single("a11", series),
            "milestones": single("a12", ms)}


def q16_stage_cards_all(cfg: C.Config = C.DEFAULT) -> Plan:
    """Stage cards for every configured region (missing region -> no rows)."""
    return _cards(D.isin(D.upper_trim(D.c("project")), [p.upper() for p in cfg.projects]), cfg)


def q17_region_monthly(region: str, cfg: C.Config = C.DEFAULT) -> Plan:
    """Monthly series for one validated region."""
    if region.upper() not in [p.upper() for p in cfg.projects]:
        raise ValueError(f"unknown region {region!r}")
    return q15_command_center(region, cfg)["monthly"]
