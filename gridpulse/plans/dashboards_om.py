"""Service-ticket (O&M) dashboards Q18-Q24 (+ Q32) over the complaint summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.filters import Filters, normalise_level, page_rows
from ..operators import dual as D
from ..operators import rollups as R
from ..operators.sections import Section
from .base import Plan, chain, date_range, dim_filters, project_scope_om, single

OM_FILTER_DIMS = {"discom", "zone", "circle", "division", "subdivision", "feeder", "dtr"}
OM_LEVELS = ["discom", "zone", "circle", "division", "subdivision", "feeder", "dtr"]


def _n(x):
    return D.c(x).alias(x)


def _category_om(f: Filters):
    """F13 (O&M): total -> none; dt -> DT or DTR; else ILIKE the given value."""
    cat = f.category_l
    if cat == "total":
        return None
    if cat == "dt":
        return D.isin(D.E(lambda: F.lower(F.trim(F.col("meter_category"))), "LOWER(TRIM(meter_category))"),
                      ["dt", "dtr"])
    return D.ilike(D.c("meter_category"), cat)


def _ts_range(f: Filters, col: str):
    """compare a timestamp with midnight of the given day (the end day is cut off)."""
    out = []
    for v, op in ((f.start_date, ">="), (f.end_date, "<=")):
        if v:
            ts = D.E(lambda v=v: F.to_timestamp_ntz(F.lit(v)), f"TIMESTAMP '{v} 00:00:00'")
            out.append(D.ge(D.c(col), ts) if op == ">=" else D.le(D.c(col), ts))
    return out


def _where(f: Filters, date_col: str | None = None, ts: bool = False, period_type: str | None = None,
           extra=()):
    preds = dim_filters(f, OM_FILTER_DIMS)
    preds += [project_scope_om(f), _category_om(f)]
    if date_col:
        preds += _ts_range(f, date_col) if ts else date_range(f, date_col)
    if period_type:
        preds.append(D.eq(D.c("period_type"), D.lit(period_type)))
    preds += list(extra)
    return D.and_(*[p for p in preds if p is not None])


def om_label(f: Filters, levels=OM_LEVELS, table_cols=None):
    """P20 (O&M): one project -> level; all + discom -> raw project; else
    project || ' | ' || level (null if any part null). Rows with a null level
    are dropped (F14). Returns (label, predicate)."""
    level = normalise_level(f.level, levels)
    if table_cols is not None and level not in table_cols:
        raise ValueError(f"level {level!r} is not a column of this summary")   # §2.14 #10
    lv = D.c(level)
    if f.project_l != "all":
        lab = lv
    elif level == "discom":
        lab = D.c("project")
    else:
        lab = D.E(lambda: F.concat(F.col("project"), F.lit(" | "), lv.col), f"(project || ' | ' || {lv.sql})")
    nz = D.E(lambda: F.coalesce(F.nullif(lab.col, F.lit("")), F.lit("Unknown")),
             f"COALESCE(NULLIF({lab.sql}, ''), 'Unknown')")
    return nz, D.E(lambda: lv.col.isNotNull(), f"({lv.sql} IS NOT NULL)")


def _cat_key():
    return (D.E(lambda: F.coalesce(F.nullif(F.col("meter_category"), F.lit("")), F.lit("Unknown")),
                "COALESCE(NULLIF(meter_category, ''), 'Unknown')").alias("meter_category"),
            D.E(lambda: F.col("meter_category").isNotNull(), "(meter_category IS NOT NULL)"))


def _period_label(col: str, dur: str, monthly_trunc: bool = False) -> D.E:
    d = D.c(col)
    if dur == "weekly":
        return D.date_fmt(D.trunc(d, "week"), "yyyy-MM-dd", "%Y-%m-%d")
    if dur == "monthly":
        return D.date_fmt(d, "yyyy-MM", "%Y-%m")
    return D.date_fmt(d, "yyyy-MM-dd", "%Y-%m-%d")


# Q18 / Q19 -------------------------------------------------------------------
A17_COLS = {"project", "discom", "zone", "circle", "division", "subdivision", "meter_category"}


def q18_team_productivity(f: Filters = Filters()) -> dict:
    """O&M-1: closed tickets per technician per day (R8), insights."""
    dur = (f.duration or "daily").lower()
    w = _where(f, "closed_day")
    kw = dict(day="closed_day", who="technician", measure="closed_tickets", out_total="total_closed_tickets")
    lab, has_level = om_label(f, table_cols=A17_COLS)
    cat, has_cat = _cat_key()
    summary = R.productivity("a17", [], w, people_col="total_active_technicians", **kw)
    trend = R.productivity("a17", [_period_label("closed_day", dur).alias("date")], w, order=["date"], **kw)
    comp = R.productivity("a17", [lab.alias("label")], D.and_(w, has_level), order=["label"], **kw)
    catp = R.productivity("a17", [cat], D.and_(w, has_cat), **kw)
    ins = R.performers("a17", w, day="closed_day", who="technician", measure="closed_tickets")
    drop_days = lambda p: p
    return {"summary": drop_days(summary), "trend": trend, "comparison": comp, "category": catp, "insights": ins}


def q19_productivity_trend(f: Filters = Filters()) -> dict:
    """O&M-2: always monthly; summary = mean of monthly means of daily ratios."""
    w = _where(f, "closed_day")
    month = D.date_fmt(D.c("closed_day"), "yyyy-MM", "%Y-%m").alias("month")
    stages = R.daily_grain([month], w, "closed_day", "technician", "closed_tickets")
    per_month = Section(group=[_n("month")], aggs=[D.sum0(D.c("day_total")).alias("month_tickets"),
                                                   D.count_star().alias("active_days"),
                                                   D.avg(D.c("daily_prod")).alias("monthly_prod"),
                                                   D.avg(D.c("day_who")).alias("avg_techs")])
    summary = chain("a17", *stages, per_month, Section(
        aggs=[D.sum0(D.c("month_tickets")).alias("total_closed_tickets"), D.count_star().alias("total_active_months"),
              D.avg(D.c("monthly_prod")).alias("_p")],
        post=[_n("total_closed_tickets"), _n("total_active_months"),
              D.round2(D.c("_p")).alias("avg_monthly_productivity_per_technician_per_day")]))
    trend = chain("a17", *stages, Section(
        group=[_n("month")], aggs=per_month.aggs,
        post=[_n("month"), D.c("month_tickets").alias("total_closed_tickets"), _n("active_days"),
              D.round2(D.c("avg_techs")).alias("avg_active_technicians"),
              D.round2(D.c("monthly_prod")).alias("productivity_per_technician_per_day")], order=["month"]))
    lab, has_level = om_label(f, table_cols=A17_COLS)
    cat, has_cat = _cat_key()

    def mean_daily(key, where, out):
        st = R.daily_grain([key], where, "closed_day", "technician", "closed_tickets")
        return chain("a17", *st, Section(group=[_n(key.name)], aggs=[D.avg(D.c("daily_prod")).alias("_p")],
                                         post=[_n(key.name), D.round2(D.c("_p")).alias(out)]))
    return {"summary": summary, "trend": trend,
            "comparison": mean_daily(lab.alias("label"), D.and_(w, has_level), "productivity_per_technician_per_day"),
            "category": mean_daily(cat, D.and_(w, has_cat), "avg_monthly_productivity_per_technician_per_day")}


# Q20 / Q22: paged lists -------------------------------------------------------
A18_COLS = C.OMDIM + ["ticket_id", "created_date", "ageing_days", "technician", "agency", "complaint_by"]


def _page(base: str, where, cols: list[str], order: list[str], limit: int, offset: int) -> Plan:
    """OFFSET/LIMIT over a stable order (nulls first, as Spark's ascending sort)."""
    def sp(d):
        return d[base].where(where.col).select(*cols).orderBy(*order).offset(offset).limit(limit)

    def sq(n):
        ob = ", ".join(f"{D.q(c)} ASC NULLS FIRST" for c in order)
        return (f"SELECT {', '.join(D.q(c) for c in cols)} FROM {n[base]} WHERE {where.sql} "
                f"ORDER BY {ob} LIMIT {limit} OFFSET {offset}")
    return Plan((base,), sp, sq)


def q20_open_tickets(f: Filters = Filters()) -> Plan:
    """Open tickets list with standard filters, meter_category among them."""
    preds = dim_filters(f, OM_FILTER_DIMS | {"meter_category", "project"})
    if f.project_l != "all":
        preds.append(D.ilike(D.c("project"), f.project))
    preds += _ts_range(f, "created_date")
    return _page("a18", D.and_(*preds), A18_COLS, ["ticket_id"] + [c for c in A18_COLS if c != "ticket_id"], page_rows(f), f.offset)


A19_KEYS = C.OMDIM + ["created_day", "closed_date"]
A19_LIST = C.OMDIM + ["period_type", "period_value_created", "period_value_closed", "avg_resolution_days",
                      "closed_tickets", "closed_date", "created_day"]


def q22_closure_list(f: Filters = Filters()) -> Plan:
    """Closure-time rows of one period type (default daily), paged; date filters have no effect."""
    preds = dim_filters(f, OM_FILTER_DIMS | {"meter_category", "project"})
    preds.append(D.eq(D.c("period_type"), D.lit((f.duration or "daily").lower())))
    return _page("a19", D.and_(*preds), A19_LIST, A19_KEYS, page_rows(f), f.offset)


# Q21 -------------------------------------------------------------------------
SOURCES = [("auto_ticketing", "auto"), ("1912_helpdesk", "helpdesk"), ("others", "others")]
OPEN_CLASSES = [("age_less_than_3_days", None, 3), ("age_less_than_7_days", 3, 7), ("age_less_than_15_days", 7, 15),
                ("age_less_than_30_days", 15, 30), ("age_less_than_3_months", 30, 90),
                ("age_less_than_6_months", 90, 180), ("age_6_months_and_above", 180, None)]


def _src(kind: str) -> D.E:
    """P19 on complaint_by (null -> others; a value can match both patterns)."""
    by = D.coalesce(D.c("complaint_by"), D.lit(""))
    auto = D.ilike(by, C.SOURCE_AUTO_PATTERN)
    help_ = D.ilike(by, C.SOURCE_HELPDESK_PATTERN)
    if kind == "auto":
        return auto
    if kind == "helpdesk":
        return help_
    return D.E(lambda: ~(auto.col | help_.col), f"(NOT ({auto.sql} OR {help_.sql}))")


def _age_class(lo, hi) -> D.E:
    """Half-open classes on fractional days."""
    a = D.c("ageing_days")
    parts = []
    if lo is not None:
        parts.append(D.E(lambda: a.col >= lo, f"(ageing_days >= {lo})"))
    if hi is not None:
        parts.append(D.E(lambda: a.col < hi, f"(ageing_days < {hi})"))
    return D.and_(*parts)


def _open_aggs(with_classes: bool):
    aggs = [D.count_star().alias("total")]
    aggs += [D.count_if(_src(k)).alias(name) for name, k in SOURCES]
    if with_classes:
        for cname, lo, hi in OPEN_CLASSES:
            cond = _age_class(lo, hi)
            aggs.append(D.count_if(cond).alias(f"{cname}__total"))
            aggs += [D.count_if(D.and_(cond, _src(k))).alias(f"{cname}__{name}") for name, k in SOURCES]
    return aggs


def q21_open_ageing(f: Filters = Filters()) -> dict:
    """O&M-3: open tickets by source and 7 age classes."""
    dur = (f.duration or "daily").lower()
    w = _where(f, "created_date", ts=True)
    lab, has_level = om_label(f)
    cat, has_cat = _cat_key()
    if dur == "monthly":
        tl = D.date_fmt(D.c("created_date"), "yyyy-MM", "%Y-%m")
    else:
        tl = _period_label("created_date", dur)
    return {
        "summary": single("a18", Section(where=w, aggs=_open_aggs(True))),
        "category": single("a18", Section(where=D.and_(w, has_cat), group=[cat], aggs=_open_aggs(True))),
        "trend": single("a18", Section(where=D.and_(w, D.E(lambda: F.col("created_date").isNotNull(),
                                                           "(created_date IS NOT NULL)")),
                                       group=[tl.alias("period_value")], aggs=_open_aggs(False),
                                       order=["period_value"])),
        "comparison": single("a18", Section(where=D.and_(w, has_level), group=[lab.alias("label")],
                                            aggs=_open_aggs(True), order=["label"])),
    }


# Q23 / Q32 -------------------------------------------------------------------
def _closure_aggs():
    """Σ(mean_i * n_i) / Σ(n_i, 0 -> 1); mean_i * n_i is carried exactly as
    integer microseconds, so the weighted mean is Σ us / 86400e6 / Σ n."""
    w = D.E(lambda: F.when(F.col("closed_tickets") > 0, F.col("closed_tickets")).otherwise(F.lit(1)),
            "CASE WHEN closed_tickets > 0 THEN closed_tickets ELSE 1 END")
    return [D.sum0(D.c("closed_tickets")).alias("total_closed_tickets"),
            D.sum0(D.c("resolution_us")).alias("_us"), D.sum0(w).alias("_w")]


def _closure_post(keys):
    mean = D.E(lambda: F.col("_us").cast("double") / F.lit(86400000000.0) / F.col("_w").cast("double"),
               "CAST(_us AS DOUBLE) / CAST(86400000000 AS DOUBLE) / CAST(_w AS DOUBLE)")
    return [_n(k) for k in keys] + [_n("total_closed_tickets"), D.round2(mean).alias("avg_resolution_days")]


def q23_closure_time(f: Filters = Filters()) -> dict:
    """O&M-4: closed tickets and weighted mean resolution days."""
    dur = (f.duration or "monthly").lower()
    w = _where(f, "closed_date")
    lab, has_level = om_label(f)
    cat, has_cat = _cat_key()
    tl = _period_label("closed_date", dur).alias("period_value")
    mk = lambda where, group, order=None: single("a19", Section(
        where=where, group=group, aggs=_closure_aggs(), post=_closure_post([g.name for g in group]), order=order))
    return {"summary": mk(w, []),
            "trend": mk(D.and_(w, D.E(lambda: F.col("closed_date").isNotNull(), "(closed_date IS NOT NULL)")),
                        [tl], ["period_value"]),
            "comparison": mk(D.and_(w, has_level), [lab.alias("label")], ["label"]),
            "category": mk(D.and_(w, has_cat), [cat])}


def q32_open_and_closure(f: Filters = Filters()) -> Plan:
    """Declared metric: open-ticket count beside the weighted mean closure days."""
    from .base import merged
    open_p = single("a18", Section(where=_where(f), aggs=[D.count_star().alias("open_tickets")]))
    clo = single("a19", Section(where=_where(f), aggs=_closure_aggs(), post=_closure_post([])))
    return merged([], [(open_p, ["open_tickets"]), (clo, ["total_closed_tickets", "avg_resolution_days"])])


# Q24 -------------------------------------------------------------------------
def _closed_aggs():
    t = D.coalesce(D.c("closed_tickets"), D.lit(0))
    return [D.sum_if0(_src(k), t).alias(name) for name, k in SOURCES]


def q24_closed_analysis(f: Filters = Filters()) -> dict:
    """O&M-5: closed tickets split by source (R19) by total/period/label/category."""
    dur = (f.duration or "daily").lower()
    w = _where(f, "closed_date", period_type=dur)
    lab, has_level = om_label(f)
    cat, has_cat = _cat_key()
    nz = D.E(lambda: F.col("period_value").isNotNull() & (F.col("period_value") != ""),
             "(period_value IS NOT NULL AND period_value <> '')")
    return {
        "summary": single("a20", Section(where=w, aggs=_closed_aggs())),
        "trend": single("a20", Section(where=D.and_(w, nz), group=[_n("period_value")], aggs=_closed_aggs(),
                                       order=["period_value"])),
        "comparison": single("a20", Section(where=D.and_(w, has_level), group=[lab.alias("label")],
                                            aggs=_closed_aggs(), order=["label"])),
        "category": single("a20", Section(where=D.and_(w, has_cat), group=[cat], aggs=_closed_aggs())),
    }


# Q31 -------------------------------------------------------------------------
def q31_closure_time_nested(f: Filters = Filters()) -> dict:
    """Q23 with category-bucket nesting (documented form). Only the `total`
    nesting exists: the consumer sub-buckets need a meter type that the
    closure summary does not carry. Per bucket: closed tickets and the R12
    weighted mean; `__total` over the mapped rows."""
    if f.category_l != "total":
        raise ValueError("only category=total nesting is available for closure time")
    dur = (f.duration or "monthly").lower()
    w = _where(f, "closed_date")
    lab, has_level = om_label(f)
    b, keys = D.bucket("total")
    wt = D.E(lambda: F.when(F.col("closed_tickets") > 0, F.col("closed_tickets")).otherwise(F.lit(1)),
             "CASE WHEN closed_tickets > 0 THEN closed_tickets ELSE 1 END")

    def section(group, where, order):
        aggs, post = [], [_n(g.name) for g in group]
        for k in keys + ["total"]:
            cond = D.E(lambda: b.col.isNotNull(), f"({b.sql} IS NOT NULL)") if k == "total" else D.eq(b, D.lit(k))
            aggs += [D.sum_if0(cond, D.c("closed_tickets")).alias(f"total_closed_tickets__{k}"),
                     D.sum_if0(cond, D.c("resolution_us")).alias(f"_us_{k}"), D.sum_if0(cond, wt).alias(f"_w_{k}")]
            mean = D.E(lambda k=k: F.when(F.col(f"_w_{k}") > 0, F.col(f"_us_{k}").cast("double") / F.lit(86400000000.0)
                                          / F.col(f"_w_{k}").cast("double")),
                       f"CASE WHEN _w_{k} > 0 THEN CAST(_us_{k} AS DOUBLE) / CAST(86400000000 AS DOUBLE) "
                       f"/ CAST(_w_{k} AS DOUBLE) END")
            post += [_n(f"total_closed_tickets__{k}"), D.round2(mean).alias(f"avg_resolution_days__{k}")]
        return single("a19", Section(where=where, group=group, aggs=aggs, post=post, order=order))
    tl = _period_label("closed_date", dur).alias("period_value")
    return {"summary": section([], w, None),
            "trend": section([tl], D.and_(w, D.E(lambda: F.col("closed_date").isNotNull(), "(closed_date IS NOT NULL)")),
                             ["period_value"]),
            "comparison": section([lab.alias("label")], D.and_(w, has_level), ["label"])}
