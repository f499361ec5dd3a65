"""Meter (MI) summary builders A1-A15.

Every builder takes the meter fact frame (S1) and returns the summary frame
with the reference's columns plus a real ``period_start`` DATE. Plans are
written so Catalyst prunes to the needed columns and pushes filters to the
scan; multi-grain builders aggregate the facts once, at their finest grain,
and sum the coarser grains from its groups (``periods.roll_up``).
"""
from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..functions import predicates as P
from ..functions.periods import clustered, label_ddmmyy, label_mon_yy, label_quarter, period_start, roll_up

GEO = ["discom", "zone", "circle", "division", "subdivision", "substation", "feeder", "dtr"]


def _dims(project_normalised: bool):
    """MIDIM select list: project (raw or P3), geo, new_meter_type, meter_category."""
    # a redundant alias would make the branches of a roll-up differ, and its exchange would be computed more than once
    proj = X.norm_upper("project").alias("project") if project_normalised else F.col("project")
    return [proj, *[F.col(g) for g in GEO],
            F.col("metertype").alias("new_meter_type"), X.meter_category().alias("meter_category")]


def _pct(num, den):
    """CASE WHEN den > 0 THEN num/den*100 ELSE 0 END as double."""
    return F.when(F.col(den) > 0, F.col(num).cast("double") / F.col(den).cast("double") * 100).otherwise(F.lit(0.0))


def _stage_counts(prefix="s", suffix=""):
    return [F.count_if(P.sat_achieved(stage=k)).alias(f"{prefix}{k}{suffix}") for k in C.SAT_STAGES]


def _finish(df: DataFrame, label=label_ddmmyy) -> DataFrame:
    return df.withColumn("period_value", label("period_start"))


# A1 -------------------------------------------------------------------------
def mi_progress(meters: DataFrame) -> DataFrame:
    """A1: verified installations by MIDIM (raw project) x daily/weekly/monthly of mi_date."""
    rows = (meters.where(P.verified_installation())
            .select(*_dims(False), F.col("mi_date").alias("d")))
    out = roll_up(rows, C.MIDIM, "d", {"total_mi_progress": F.count(F.lit(1))})
    return _finish(out).select(*C.MIDIM, "period_type", "period_value", "period_start", "total_mi_progress")


# A2 -------------------------------------------------------------------------
def mi_technician_productivity(meters: DataFrame) -> DataFrame:
    """A2: verified installations per technician per day (normalised project)."""
    tech = X.blank_to_null("technicianname")
    return (meters.where(P.verified_installation() & tech.isNotNull())
            .select(F.col("mi_date").alias("installation_date"), *_dims(True), tech.alias("technician"))
            .groupBy("installation_date", *C.MIDIM, "technician")
            .agg(F.count(F.lit(1)).alias("total_installations")))


# A3/A4 ----------------------------------------------------------------------
def _inventory_measures(n="n", inst="inst"):
    return [F.col(n).alias("total_inventory"), F.col(inst).alias("total_installed"),
            _pct(inst, n).alias("utilization_rate_pct"),
            (F.col(n) - F.col(inst)).alias("remaining_stock")]


def inventory_utilization(meters: DataFrame) -> DataFrame:
    """A4: inventory vs verified installations.

    weekly: raw project, week of mi_date; monthly/daily: normalised project,
    COALESCE(didate, mi_date). No row filter, so a null period group exists.
    The facts are aggregated once, by raw project, day of the basis and week of
    mi_date; these groups are shuffled once more, by the columns that all grains
    share, and the three grains are summed where they lie. One such key has no
    more groups than there are projects, days and weeks, however many rows.
    """
    inst = P.verified_installation()
    basis = F.coalesce(F.col("didate"), F.col("mi_date"))
    rest = [*GEO, "new_meter_type", "meter_category"]
    state = (meters.select(*_dims(False), basis.alias("day"), F.trunc(F.col("mi_date"), "week").alias("week"), inst.alias("_inst"))
             .groupBy(*C.MIDIM, "day", "week").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_inst")).alias("inst")))
    # the dates in one array (of a struct each grain would take its own fields): all grains need the same columns, and share the exchange
    state = state.select(*C.MIDIM, F.array("day", "week").alias("_at"), "n", "inst")
    state = clustered(state, rest)
    named, day, week = X.norm_upper("project"), F.get("_at", F.lit(0)), F.get("_at", F.lit(1))
    grains = (("weekly", F.col("project"), week), ("monthly", named, F.trunc(day, "month")), ("daily", named, day))
    parts = [state.groupBy(p.alias("project"), *rest, d.alias("period_start")).agg(F.sum("n").alias("n"), F.sum("inst").alias("inst"))
             .select("project", *rest, F.lit(g).alias("period_type"), "period_start", "n", "inst") for g, p, d in grains]
    agg = reduce(DataFrame.union, parts)
    return _finish(agg).select(*C.MIDIM, "period_type", "period_value", "period_start", *_inventory_measures())


# A5 -------------------------------------------------------------------------
def _age_buckets(days, bounds, names):
    """count_if per class; upper bounds inclusive; last class open."""
    d = F.col(days)
    out, lo = [], None
    for b, name in zip(bounds, names):
        cond = d <= b if lo is None else (d > lo) & (d <= b)
        out.append(F.count_if(cond).alias(name))
        lo = b
    out.append(F.count_if(d > lo).alias(names[len(bounds)]))
    return out


AGE4 = ["age_0_30", "age_31_60", "age_61_90", "age_90_plus"]


def stock_ageing(meters: DataFrame, as_of: dt.date = C.DEFAULT.meter_as_of) -> DataFrame:
    """A5: uninstalled stock by month of didate, four age classes vs as_of."""
    out = (meters.where(P.uninstalled_stock())
           .select(*_dims(False), F.trunc("didate", "month").alias("period_start"),
                   X.age_days(as_of, "didate").alias("days"))
           .groupBy(*C.MIDIM, "period_start")
           .agg(*_age_buckets("days", C.STOCK_AGE_BOUNDS, AGE4))
           .withColumn("period_type", F.lit("monthly")))
    return _finish(out).select(*C.MIDIM, "period_type", "period_value", "period_start", *AGE4)


# A6 -------------------------------------------------------------------------
SAT_COLS = [f"sat_{k}" for k in C.SAT_STAGES]


def mi_vs_sat(meters: DataFrame) -> DataFrame:
    """Installs vs SAT stages, daily, normalised project."""
    out = (meters.where(F.col("mi_date").isNotNull() & X.not_blank("sat_no"))
           .select(*_dims(True), F.col("mi_date").alias("period_start"), "meterserialnumber", "sat_no")
           .groupBy(*C.MIDIM, "period_start")
           .agg(F.count("meterserialnumber").alias("total_mi"),
                F.count_if(P.sat_achieved()).alias("total_sat"),
                *_stage_counts("sat_"))
           .withColumn("sat_progress_pct", _pct("total_sat", "total_mi"))
           .withColumn("period_type", F.lit("daily")))
    return _finish(out).select(*C.MIDIM, "period_type", "period_value", "period_start",
                               "total_mi", "total_sat", *SAT_COLS, "sat_progress_pct")


# A7 -------------------------------------------------------------------------
def non_sat_ageing(meters: DataFrame, as_of: dt.date = C.DEFAULT.meter_as_of) -> DataFrame:
    """Row-level installed-without-SAT meters with whole-day age."""
    return (meters.where(P.installed_without_sat())
            .select(*_dims(False), F.col("meterserialnumber").alias("meter_serial_number"),
                    F.col("mi_date").alias("installation_date"),
                    X.age_days(as_of, "mi_date").alias("ageing_days")))


# A8 -------------------------------------------------------------------------
JOURNEY = [
    ("inventory_to_store", "gmrtoagencyts", "didate"),
    ("store_to_agency", "agencytosupts", "gmrtoagencyts"),
    ("agency_to_meter_installation", "installedts", "agencytosupts"),
    ("meter_installation_to_sat", "sat_date", "installedts"),
    ("sat_to_invoice", "pmpm_invoice_date", "sat_date"),
    ("invoice_to_revenue", "pmpm_collection_date", "pmpm_invoice_date"),
    ("total_journey", "pmpm_collection_date", "didate"),
]
JOURNEY_NAMES = [j[0] for j in JOURNEY]


def meter_journey(meters: DataFrame) -> DataFrame:
    """Stage-duration means by MIDIM x weekly/monthly/daily of pmpm_collection_date.

    Per stage the integer day sum and the non-null count are carried
    (``<stage>_sum``, ``<stage>_n``) so that roll-ups re-weight exactly; the
    mean column equals AVG (nulls skipped). ``meter_count`` is COUNT(*).
    """
    diffs = [F.datediff(F.to_date(F.col(b)), F.to_date(F.col(a))).alias(n) for n, b, a in JOURNEY]
    rows = (meters.where(P.journey_cohort())
            .select(*_dims(False), F.col("pmpm_collection_date").alias("d"), *diffs))
    sums = {f"{n}_sum": F.sum(n).cast("long") for n in JOURNEY_NAMES} | {f"{n}_n": F.count(n) for n in JOURNEY_NAMES}
    out = roll_up(rows, C.MIDIM, "d", sums | {"meter_count": F.count(F.lit(1))}, ("weekly", "monthly", "daily"))
    means = [F.when(F.col(f"{n}_n") > 0, F.col(f"{n}_sum").cast("double") / F.col(f"{n}_n").cast("double"))
             .alias(n) for n in JOURNEY_NAMES]
    return _finish(out).select(*C.MIDIM, "period_type", "period_value", "period_start", *means,
                               "meter_count", *[f"{n}_sum" for n in JOURNEY_NAMES],
                               *[f"{n}_n" for n in JOURNEY_NAMES])


# A9 -------------------------------------------------------------------------
STAGE_FUNNEL = ["inventory", "installed", "sat_done", "revenue_collected",
                "pending_inventory", "pending_installed", "pending_sat_done", "pending_invoice_done"]


def meter_stage(meters: DataFrame) -> DataFrame:
    """Funnel counts by normalised MIDIM (no period)."""
    inst = P.verified_installation()
    pend = F.col("pmpm_collection_date").isNull()
    return (meters.select(*_dims(True), inst.alias("_i"), "sat_date", "pmpm_collection_date", "pmpm_invoice_date")
            .groupBy(*C.MIDIM)
            .agg(F.count(F.lit(1)).alias("inventory"),
                 F.count_if(F.col("_i")).alias("installed"),
                 F.count_if(F.col("sat_date").isNotNull()).alias("sat_done"),
                 F.count_if(~pend).alias("revenue_collected"),
                 F.count_if(pend).alias("pending_inventory"),
                 F.count_if(pend & F.col("_i")).alias("pending_installed"),
                 F.count_if(pend & F.col("sat_date").isNotNull()).alias("pending_sat_done"),
                 F.count_if(pend & F.col("pmpm_invoice_date").isNotNull()).alias("pending_invoice_done")))


# A10 ------------------------------------------------------------------------
def command_center_columns():
    """Eligibility e_k = installed - sum(s_j, j>k); achievement a_k = sum(s_j, j<=k);
    throughput = a_k/e_k*100 if e_k > 0 else 0."""
    s = {k: F.col(f"s{k}") for k in C.SAT_STAGES}
    elig, ach, pct = [], [], []
    for k in C.SAT_STAGES:
        later = [s[j] for j in C.SAT_STAGES if j > k]
        e = F.col("installed") - sum(later[1:], later[0]) if later else F.col("installed")
        a = sum([s[j] for j in C.SAT_STAGES if 1 < j <= k], s[1])
        elig.append(e.alias(f"sat_{k}_eligibility"))
        ach.append(a.alias(f"sat_{k}_achievement"))
        pct.append(F.when(e > 0, a.cast("double") / e.cast("double") * 100).otherwise(F.lit(0.0))
                   .alias(f"sat_{k}_throughput_pct"))
    return elig, ach, pct


def command_center(meters: DataFrame) -> DataFrame:
    """A10: per normalised project snapshot with eligibility/achievement/throughput."""
    base = (meters.select(X.norm_upper("project").alias("project"),
                          P.verified_installation().alias("_i"), "sat_no")
            .groupBy("project")
            .agg(F.count(F.lit(1)).alias("inventory"),
                 F.count_if(F.col("_i")).alias("installed"),
                 F.count_if(P.sat_achieved()).alias("total_sat"),
                 *_stage_counts()))
    elig, ach, pct = command_center_columns()
    return base.select("project", "inventory", "installed", "total_sat",
                       F.col("total_sat").alias("total_invoice"), *elig, *ach, *pct)


# A11 ------------------------------------------------------------------------
TREND_COLS = ["inventory_added", "installed_added"] + [f"s{k}_added" for k in C.SAT_STAGES]


def command_center_trend(meters: DataFrame) -> DataFrame:
    """Monthly and quarterly activity per normalised project over the
    union of inventory (didate) and progress (mi_date) periods, zero filled.

    Single pass instead of spine + two left joins (U2 + J2): each meter emits
    up to two events (inventory at didate, progress at mi_date); months count
    every kind and quarters are sums of months.
    A (project, period) exists iff some event falls in it, which is exactly the
    UNION of the two activity key sets. A null project never matches in the
    reference's join, so its counts are zero.
    """
    nb = X.not_blank("sat_no")
    ev = F.array(
        F.struct(F.lit("inv").alias("k"), F.col("didate").alias("d")),
        F.struct(F.lit("prog").alias("k"), F.col("mi_date").alias("d")),
    )
    e = (meters.select(X.norm_upper("project").alias("project"), "sat_no", F.explode(ev).alias("_e"))
         .where(F.col("_e.d").isNotNull())
         .select("project", "sat_no", F.col("_e.k").alias("kind"), F.col("_e.d").alias("d")))
    is_prog = F.col("kind") == "prog"
    counts = {"inventory_added": F.count_if(F.col("kind") == "inv"), "installed_added": F.count_if(is_prog & nb)}
    counts |= {f"s{k}_added": F.count_if(is_prog & P.sat_achieved(stage=k)) for k in C.SAT_STAGES}
    agg = roll_up(e, ["project"], "d", counts, ("monthly", "quarterly"))
    label = (F.when(F.col("period_type") == "monthly", label_mon_yy("period_start"))
              .otherwise(label_quarter("period_start")))
    zeroed = [F.when(F.col("project").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
              for c in TREND_COLS]
    return agg.select("project", "period_type", label.alias("period_value"), "period_start", *zeroed)


# A12 ------------------------------------------------------------------------
MILESTONE_DATES = [("start_date", "sat_date"), ("lumpsum_inv_date", "lumpsum_invoice_date"),
                   ("pmpm_inv_date", "pmpm_invoice_date"), ("lumpsum_col_date", "lumpsum_collection_date"),
                   ("pmpm_col_date", "pmpm_collection_date")]


def command_center_milestone(meters: DataFrame) -> DataFrame:
    """Earliest stage dates by normalised project x stage (stage not null)."""
    return (meters.select(X.norm_upper("project").alias("project"), X.sat_stage().alias("stage"),
                          *[F.col(src) for _, src in MILESTONE_DATES])
            .where(F.col("stage").isNotNull())
            .groupBy("project", "stage")
            .agg(*[F.min(src).alias(name) for name, src in MILESTONE_DATES]))


# A13 ------------------------------------------------------------------------
def mi_sat_invoice(meters: DataFrame) -> DataFrame:
    """Monthly (mi_date) counts of installs, SAT dates and invoices."""
    out = (meters.where(F.col("mi_date").isNotNull())
           .select(*_dims(False), F.trunc("mi_date", "month").alias("period_start"), "sat_no", "sat_date",
                   "lumpsum_invoice_date", "pmpm_invoice_date")
           .groupBy(*C.MIDIM, "period_start")
           .agg(F.count_if(X.not_blank("sat_no")).alias("total_mi"),
                F.count("sat_date").alias("total_sat"),
                F.count("lumpsum_invoice_date").alias("total_lumpsum_invoice"),
                F.count("pmpm_invoice_date").alias("total_pmpm_invoice"))
           .withColumn("period_type", F.lit("monthly")))
    return _finish(out).select(*C.MIDIM, "period_type", "period_value", "period_start",
                               "total_mi", "total_sat", "total_lumpsum_invoice", "total_pmpm_invoice")


# A14 ------------------------------------------------------------------------
REVENUE_COLS = ["total_lumpsum_invoice", "total_pmpm_invoice", "total_lumpsum_collection", "total_pmpm_collection"]


def revenue_realized(meters: DataFrame) -> DataFrame:
    """Revenue counts by month of the first present of collection/invoice dates."""
    basis = F.coalesce("lumpsum_collection_date", "pmpm_collection_date", "lumpsum_invoice_date", "pmpm_invoice_date")
    out = (meters.where(P.any_revenue_date())
           .select(*_dims(False), F.trunc(basis, "month").alias("period_start"),
                   "lumpsum_invoice_date", "pmpm_invoice_date", "lumpsum_collection_date", "pmpm_collection_date")
           .groupBy(*C.MIDIM, "period_start")
           .agg(F.count("lumpsum_invoice_date").alias("total_lumpsum_invoice"),
                F.count("pmpm_invoice_date").alias("total_pmpm_invoice"),
                F.count("lumpsum_collection_date").alias("total_lumpsum_collection"),
                F.count("pmpm_collection_date").alias("total_pmpm_collection"))
           .withColumn("period_type", F.lit("monthly")))
    return _finish(out).select(*C.MIDIM, "period_type", "period_value", "period_start", *REVENUE_COLS)


# A15 ------------------------------------------------------------------------
def revenue_ageing(meters: DataFrame, as_of: dt.date = C.DEFAULT.meter_as_of) -> DataFrame:
    """SAT done but uncollected, aged from sat_date, by month of sat_date."""
    out = (meters.where(P.sat_not_collected())
           .select(*_dims(False), F.trunc("sat_date", "month").alias("period_start"),
                   X.age_days(as_of, "sat_date").alias("days"))
           .groupBy(*C.MIDIM, "period_start")
           .agg(*_age_buckets("days", C.STOCK_AGE_BOUNDS, AGE4))
           .withColumn("period_type", F.lit("monthly")))
    return _finish(out).select(*C.MIDIM, "period_type", "period_value", "period_start", *AGE4)
