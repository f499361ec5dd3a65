"""Complaint (O&M) summary builders A16-A20.

A16 joins complaints to meters (J1). The join is made skew-proof by
pre-aggregating both sides before the shuffle: complaints collapse to
(dims, serial, type, day) counts, meters collapse to the distinct
(serial, substation, metertype, fallback category) tuples with a multiplicity.
The left join then fans out only over distinct meter tuples per serial, and
the row count of the reference's fan-out is restored by multiplying counts, so
a serial shared by a third of all meters costs one row, not a third of them.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..functions import predicates as P
from ..functions.periods import label_ddmmyy, roll_up

OM_GEO = ["discom", "zone", "circle", "division"]


def _om_dims():
    """OMDIM from the complaint table: raw project, sub_division -> subdivision, NULL substation."""
    return [F.col("project"), *[F.col(g) for g in OM_GEO], F.col("sub_division").alias("subdivision"),
            X.null_str().alias("substation"), F.col("feeder"), F.col("dtr"), F.col("meter_category")]


# A16 ------------------------------------------------------------------------
DEFECT_DIMS = ["project", "discom", "zone", "circle", "division", "subdivision", "substation",
               "feeder", "dtr", "meter_category", "new_meter_type", "defective_type"]


def meter_side_for_defects(meters: DataFrame) -> DataFrame:
    """Distinct meter tuples per serial with their multiplicity (J1 right side)."""
    return (meters.select(F.col("meterserialnumber").alias("serial"), F.col("substation").alias("m_substation"),
                          F.col("metertype").alias("m_metertype"),
                          X.fallback_category("metertype", "consumerno").alias("m_fallback"))
            .groupBy("serial", "m_substation", "m_metertype", "m_fallback")
            .agg(F.count(F.lit(1)).alias("m_n")))


def defective_meters(complaints: DataFrame, meters: DataFrame) -> DataFrame:
    """Replaced-meter complaints classified by defect, joined to the meter
    table on the old serial (untrimmed, left join, duplicates fan out), counted
    by dims x defect x daily/weekly/monthly of created_date."""
    c = (complaints.where(P.replaced_meter())
         .select("project", *OM_GEO, F.col("sub_division").alias("subdivision"), "feeder", "dtr",
                 F.col("meter_category").alias("c_category"),
                 F.col("old_smart_meter_number").alias("serial"),
                 X.defect_type(X.clean_complaint_type()).alias("defective_type"),
                 F.to_date("created_date").alias("d"))
         .groupBy("project", *OM_GEO, "subdivision", "feeder", "dtr", "c_category", "serial",
                  "defective_type", "d")
         .agg(F.count(F.lit(1)).alias("c_n")))
    m = meter_side_for_defects(meters)
    j = c.join(m, on="serial", how="left")
    rows = j.select(
        "project", *OM_GEO, "subdivision",
        F.coalesce("m_substation", F.lit("Unknown")).alias("substation"),
        "feeder", "dtr",
        X.refined_complaint_category("c_category", "m_fallback").alias("meter_category"),
        F.coalesce("m_metertype", F.lit("Unknown")).alias("new_meter_type"),
        "defective_type", "d",
        (F.col("c_n") * F.coalesce(F.col("m_n"), F.lit(1))).alias("w"))
    out = roll_up(rows, DEFECT_DIMS, "d", {"meter_count": F.sum("w")})
    return (out.withColumn("period_value", label_ddmmyy("period_start"))
            .select(*DEFECT_DIMS, "period_type", "period_value", "period_start", "meter_count"))


# A17 ------------------------------------------------------------------------
def om_team_productivity(complaints: DataFrame) -> DataFrame:
    """Closed tickets per technician (P5) and closed day."""
    tech = X.technician_or_supervisor()
    return (complaints.where(P.closed_ticket() & tech.isNotNull())
            .select(X.norm_upper("project").alias("project"), *OM_GEO,
                    F.col("sub_division").alias("subdivision"),
                    X.norm_upper("meter_category").alias("meter_category"),
                    tech.alias("technician"), F.to_date("closed_date").alias("closed_day"))
            .groupBy("project", *OM_GEO, "subdivision", "meter_category", "technician", "closed_day")
            .agg(F.count(F.lit(1)).alias("closed_tickets")))


# A18 ------------------------------------------------------------------------
def om_open_ageing(complaints: DataFrame, as_of: dt.datetime = C.DEFAULT.complaint_as_of) -> DataFrame:
    """Open tickets with fractional age (days) against as_of."""
    return (complaints.where(P.open_ticket())
            .select(*_om_dims(), "ticket_id", "created_date",
                    X.fractional_days("created_date", F.to_timestamp_ntz(F.lit(as_of.isoformat(sep=" ")))).alias("ageing_days"),
                    "technician", "agency", "complaint_by"))


# A19 ------------------------------------------------------------------------
def om_avg_closure_time(complaints: DataFrame) -> DataFrame:
    """Mean resolution days and count by dims x created day x closed day.

    ``resolution_us`` (integer microseconds) is kept so roll-ups re-weight
    exactly; the mean is resolution_us / closed_tickets / 86400e6.
    """
    out = (complaints.where(P.closed_ticket())
           .select(*_om_dims(), F.to_date("created_date").alias("created_day"),
                   F.to_date("closed_date").alias("closed_date_d"),
                   X.micros_between("created_date", "closed_date").alias("us"))
           .groupBy(*C.OMDIM, "created_day", "closed_date_d")
           .agg(F.sum("us").alias("resolution_us"), F.count(F.lit(1)).alias("closed_tickets")))
    return out.select(
        *C.OMDIM, F.lit("daily").alias("period_type"),
        label_ddmmyy("created_day").alias("period_value_created"),
        label_ddmmyy("closed_date_d").alias("period_value_closed"),
        (F.col("resolution_us").cast("double") / F.col("closed_tickets").cast("double")
         / F.lit(86400000000.0)).alias("avg_resolution_days"),
        "closed_tickets", F.col("closed_date_d").alias("closed_date"), "created_day", "resolution_us")


# A20 ------------------------------------------------------------------------
CLOSED_KEYS = C.OMDIM + ["complaint_type", "complaint_category", "complaint_by"]


def om_closed_analysis(complaints: DataFrame) -> DataFrame:
    """Closed tickets by dims x type x category x source x daily/weekly/monthly
    of closed_date; ``closed_date`` holds the bucket start."""
    rows = (complaints.where(P.closed_ticket())
            .select(*_om_dims(), "complaint_type", "complaint_category", "complaint_by",
                    F.to_date("closed_date").alias("d")))
    out = roll_up(rows, CLOSED_KEYS, "d", {"closed_tickets": F.count(F.lit(1))})
    label = (F.when(F.col("period_type") == "monthly", F.date_format("period_start", "yyyy-MM"))
              .otherwise(F.date_format("period_start", "yyyy-MM-dd")))
    return out.select(*CLOSED_KEYS, "period_type", label.alias("period_value"), "closed_tickets",
                      F.col("period_start").alias("closed_date"))
