"""Shared SQL fragments (DuckDB dialect) for the oracles."""
from .. import config as C

#: What a meter without a consumer stands for, by its type; any other is a consumer's.
NO_CONSUMER = ", ".join(f"'{metertype}': '{category}'" for metertype, category in
                        ((C.DT_FALLBACK_METERTYPE, "DT"), (C.FEEDER_FALLBACK_METERTYPE, "FEEDER")))
CAT = f"COALESCE(upper(trim(connection_type)), IF(length(trim(COALESCE(consumerno, ''))) = 0, MAP {{{NO_CONSUMER}}}[metertype], NULL), 'CONSUMER')"
GEO = "discom, zone, circle, division, subdivision, substation, feeder, dtr"
DIMS_RAW = f"project, {GEO}, metertype AS new_meter_type, {CAT} AS meter_category"
DIMS_NORM = f"UPPER(TRIM(project)) AS project, {GEO}, metertype AS new_meter_type, {CAT} AS meter_category"
MIDIM = ", ".join(C.MIDIM)
OMDIM = ", ".join(C.OMDIM)
F1 = "(mi_date IS NOT NULL AND sat_no IS NOT NULL AND TRIM(sat_no) != '')"
NB_SAT = "(sat_no IS NOT NULL AND TRIM(sat_no) != '')"


def sat_like(k=None):
    return f"LOWER(TRIM(sat_no)) LIKE 'sat-{'' if k is None else k}%'"


def trunc(unit, expr):
    return f"CAST(date_trunc('{unit}', {expr}) AS DATE)"


def ddmmyy(expr):
    return f"strftime({expr}, '%d-%m-%y')"


def cnt(expr="*"):
    return f"CAST(COUNT({expr}) AS BIGINT)"


def cntf(cond):
    return f"CAST(COUNT(*) FILTER (WHERE {cond}) AS BIGINT)"


def bsum(expr):
    return f"CAST(SUM({expr}) AS BIGINT)"


def pct(num, den):
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100 ELSE CAST(0 AS DOUBLE) END"


def age_buckets(days, names=("age_0_30", "age_31_60", "age_61_90", "age_90_plus"), bounds=(30, 60, 90)):
    out, lo = [], None
    for b, n in zip(bounds, names):
        cond = f"{days} <= {b}" if lo is None else f"{days} > {lo} AND {days} <= {b}"
        out.append(f"{cntf(cond)} AS {n}")
        lo = b
    out.append(f"{cntf(f'{days} > {lo}')} AS {names[len(bounds)]}")
    return ", ".join(out)
