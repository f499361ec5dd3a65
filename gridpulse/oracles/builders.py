"""Oracles for the summary builders A1-A20 (written in the reference's shape:
one SELECT per grain joined by UNION ALL, spine + left joins, fan-out join)."""
from .. import config as C
from ..sources.fixtures import with_facts
from .sqlbits import (DIMS_NORM, DIMS_RAW, F1, MIDIM, NB_SAT, OMDIM, age_buckets, bsum, cnt, cntf,
                      ddmmyy, pct, sat_like, trunc)

AS_OF = f"DATE '{C.DEFAULT.meter_as_of.isoformat()}'"
AS_OF_TS = f"TIMESTAMP '{C.DEFAULT.complaint_as_of.isoformat(sep=' ')}'"


GRAINS3 = "(VALUES ('daily'), ('weekly'), ('monthly')) g(period_type)"


def grain_start(day):
    """Start of the grain g.period_type holding ``day``."""
    return (f"CASE g.period_type WHEN 'daily' THEN CAST({day} AS DATE) "
            f"WHEN 'weekly' THEN {trunc('week', day)} ELSE {trunc('month', day)} END")


def a01():
    ps = grain_start("mi_date")
    return with_facts(select=f"""
SELECT {DIMS_RAW}, g.period_type, {ddmmyy(ps)} AS period_value, {ps} AS period_start,
       {cnt()} AS total_mi_progress
FROM meters CROSS JOIN {GRAINS3}
WHERE {F1} GROUP BY ALL""")


def a02():
    return with_facts(select=f"""
SELECT mi_date AS installation_date, {DIMS_NORM}, NULLIF(TRIM(technicianname), '') AS technician,
       {cnt()} AS total_installations
FROM meters WHERE {F1} AND NULLIF(TRIM(technicianname), '') IS NOT NULL
GROUP BY ALL""")


def a04():
    meas = (f"{cnt()} AS total_inventory, {cntf(F1)} AS total_installed, "
            f"{pct(f'COUNT(*) FILTER (WHERE {F1})', 'COUNT(*)')} AS utilization_rate_pct, "
            f"CAST(COUNT(*) - COUNT(*) FILTER (WHERE {F1}) AS BIGINT) AS remaining_stock")
    wk = trunc("week", "mi_date")
    mo = trunc("month", "COALESCE(didate, mi_date)")
    return with_facts(select=f"""
SELECT {DIMS_RAW}, 'weekly' AS period_type, {ddmmyy(wk)} AS period_value, {wk} AS period_start, {meas}
FROM meters GROUP BY ALL
UNION ALL
SELECT {DIMS_NORM}, 'monthly', {ddmmyy(mo)}, {mo}, {meas} FROM meters GROUP BY ALL
UNION ALL
SELECT {DIMS_NORM}, 'daily', {ddmmyy('COALESCE(didate, mi_date)')}, COALESCE(didate, mi_date), {meas}
FROM meters GROUP BY ALL""")


def a05(as_of=AS_OF):
    mo = trunc("month", "didate")
    return with_facts(f"b AS (SELECT {DIMS_RAW}, didate, CAST(date_diff('day', didate, {as_of}) AS INTEGER) AS days_diff "
                      f"FROM meters WHERE installedts IS NULL AND didate IS NOT NULL)", select=f"""
SELECT {MIDIM}, 'monthly' AS period_type, {ddmmyy(mo)} AS period_value, {mo} AS period_start,
       {age_buckets('days_diff')}
FROM b GROUP BY ALL""")


def a06():
    stages = ", ".join(f"{cntf(sat_like(k))} AS sat_{k}" for k in C.SAT_STAGES)
    return with_facts(select=f"""
SELECT *, {pct('total_sat', 'total_mi')} AS sat_progress_pct FROM (
  SELECT {DIMS_NORM}, 'daily' AS period_type, {ddmmyy('mi_date')} AS period_value, mi_date AS period_start,
         {cnt('meterserialnumber')} AS total_mi, {cntf(sat_like())} AS total_sat, {stages}
  FROM meters WHERE mi_date IS NOT NULL AND {NB_SAT}
  GROUP BY ALL)""")


def a07():
    return with_facts(select=f"""
SELECT {DIMS_RAW}, meterserialnumber AS meter_serial_number, mi_date AS installation_date,
       CAST(date_diff('day', mi_date, {AS_OF}) AS INTEGER) AS ageing_days
FROM meters
WHERE mi_date IS NOT NULL
  AND (sat_no IS NULL OR TRIM(sat_no) = '' OR LOWER(TRIM(sat_no)) = 'sat pending')
  AND (sat_no IS NULL OR LOWER(TRIM(sat_no)) NOT LIKE 'sat-%')""")


JOURNEY = [
    ("inventory_to_store", "gmrtoagencyts", "didate"),
    ("store_to_agency", "agencytosupts", "gmrtoagencyts"),
    ("agency_to_meter_installation", "installedts", "agencytosupts"),
    ("meter_installation_to_sat", "sat_date", "installedts"),
    ("sat_to_invoice", "pmpm_invoice_date", "sat_date"),
    ("invoice_to_revenue", "pmpm_collection_date", "pmpm_invoice_date"),
    ("total_journey", "pmpm_collection_date", "didate"),
]


def a08():
    diffs = ", ".join(f"date_diff('day', CAST({a} AS DATE), CAST({b} AS DATE)) AS {n}" for n, b, a in JOURNEY)
    avgs = ", ".join(f"AVG({n}) AS {n}" for n, _, _ in JOURNEY)
    sums = ", ".join(f"{bsum(n)} AS {n}_sum" for n, _, _ in JOURNEY)
    ns = ", ".join(f"{cnt(n)} AS {n}_n" for n, _, _ in JOURNEY)
    cohort = "pmpm_collection_date IS NOT NULL AND sat_date <= (SELECT MAX(sat_date) FROM meters)"
    ps = grain_start("pmpm_collection_date")
    return with_facts(f"j AS (SELECT {DIMS_RAW}, pmpm_collection_date, {diffs} FROM meters WHERE {cohort})", select=f"""
SELECT {MIDIM}, g.period_type, {ddmmyy(ps)} AS period_value, {ps} AS period_start,
       {avgs}, {cnt()} AS meter_count, {sums}, {ns}
FROM j CROSS JOIN {GRAINS3} GROUP BY ALL""")


def a09():
    pend = "pmpm_collection_date IS NULL"
    return with_facts(select=f"""
SELECT {DIMS_NORM}, {cnt()} AS inventory, {cntf(F1)} AS installed,
       {cntf('sat_date IS NOT NULL')} AS sat_done, {cntf('pmpm_collection_date IS NOT NULL')} AS revenue_collected,
       {cntf(pend)} AS pending_inventory, {cntf(f'{pend} AND {F1}')} AS pending_installed,
       {cntf(f'{pend} AND sat_date IS NOT NULL')} AS pending_sat_done,
       {cntf(f'{pend} AND pmpm_invoice_date IS NOT NULL')} AS pending_invoice_done
FROM meters GROUP BY ALL""")


def a10():
    S = C.SAT_STAGES

    def later(k):
        rest = [f"s{j}" for j in S if j > k]
        return f"(installed - ({' + '.join(rest)}))" if rest else "installed"

    def upto(k):
        return "(" + " + ".join(f"s{j}" for j in S if j <= k) + ")"
    stage_counts = ", ".join(f"{cntf(sat_like(k))} AS s{k}" for k in S)
    cols = ([f"{later(k)} AS sat_{k}_eligibility" for k in S] + [f"{upto(k)} AS sat_{k}_achievement" for k in S] +
            [f"CASE WHEN {later(k)} > 0 THEN CAST({upto(k)} AS DOUBLE) / CAST({later(k)} AS DOUBLE) * 100 "
             f"ELSE CAST(0 AS DOUBLE) END AS sat_{k}_throughput_pct" for k in S])
    return with_facts(select=f"""
SELECT project, inventory, installed, total_sat, total_sat AS total_invoice, {', '.join(cols)}
FROM (SELECT UPPER(TRIM(project)) AS project, {cnt()} AS inventory, {cntf(F1)} AS installed,
             {cntf(sat_like())} AS total_sat, {stage_counts}
      FROM meters GROUP BY UPPER(TRIM(project))) per_project""")


def a11():
    """Each meter contributes an inventory event (didate) and a progress event
    (mi_date); counts per project and month/quarter. A null project keeps its
    periods with zero counts."""
    stage = ", ".join(f"CAST(COUNT(*) FILTER (WHERE kind = 'prog' AND {sat_like(k)}) AS BIGINT) AS s{k}_added"
                      for k in C.SAT_STAGES)
    ps = ("CASE g.period_type WHEN 'monthly' THEN CAST(date_trunc('month', d) AS DATE) "
          "ELSE CAST(date_trunc('quarter', d) AS DATE) END")
    zero = ", ".join(f"CASE WHEN project IS NULL THEN CAST(0 AS BIGINT) ELSE {c} END AS {c}"
                     for c in ["inventory_added", "installed_added"] + [f"s{k}_added" for k in C.SAT_STAGES])
    return with_facts(f"""ev AS (
  SELECT UPPER(TRIM(project)) AS project, sat_no, 'inv' AS kind, didate AS d FROM meters WHERE didate IS NOT NULL
  UNION ALL
  SELECT UPPER(TRIM(project)), sat_no, 'prog', mi_date FROM meters WHERE mi_date IS NOT NULL)""",
        f"""counted AS (
  SELECT project, g.period_type, {ps} AS period_start,
         CAST(COUNT(*) FILTER (WHERE kind = 'inv') AS BIGINT) AS inventory_added,
         CAST(COUNT(*) FILTER (WHERE kind = 'prog' AND {NB_SAT}) AS BIGINT) AS installed_added, {stage}
  FROM ev CROSS JOIN (VALUES ('monthly'), ('quarterly')) g(period_type) GROUP BY ALL)""", select=f"""
SELECT project, period_type,
       CASE period_type WHEN 'monthly' THEN strftime(period_start, '%b-%y')
            ELSE CAST(year(period_start) AS VARCHAR) || '-Q' || CAST(quarter(period_start) AS VARCHAR) END AS period_value,
       period_start, {zero}
FROM counted""")


def a12():
    """Stage = 's' + the digit after 'sat-' (1-9), i.e. the first matching prefix."""
    s5 = "substr(LOWER(TRIM(sat_no)), 5, 1)"
    stage = f"CASE WHEN LOWER(TRIM(sat_no)) LIKE 'sat-%' AND {s5} BETWEEN '1' AND '9' THEN 's' || {s5} END"
    return with_facts(select=f"""
SELECT UPPER(TRIM(project)) AS project, {stage} AS stage, MIN(sat_date) AS start_date,
       MIN(lumpsum_invoice_date) AS lumpsum_inv_date, MIN(pmpm_invoice_date) AS pmpm_inv_date,
       MIN(lumpsum_collection_date) AS lumpsum_col_date, MIN(pmpm_collection_date) AS pmpm_col_date
FROM meters WHERE {stage} IS NOT NULL GROUP BY ALL""")


def a13():
    mo = trunc("month", "mi_date")
    return with_facts(select=f"""
SELECT {DIMS_RAW}, 'monthly' AS period_type, {ddmmyy(mo)} AS period_value, {mo} AS period_start,
       {cntf(NB_SAT)} AS total_mi, {cntf('sat_date IS NOT NULL')} AS total_sat,
       {cntf('lumpsum_invoice_date IS NOT NULL')} AS total_lumpsum_invoice,
       {cntf('pmpm_invoice_date IS NOT NULL')} AS total_pmpm_invoice
FROM meters WHERE mi_date IS NOT NULL GROUP BY ALL""")


def a14():
    mo = ("COALESCE(" + ", ".join(trunc("month", c) for c in
          ("lumpsum_collection_date", "pmpm_collection_date", "lumpsum_invoice_date", "pmpm_invoice_date")) + ")")
    return with_facts(select=f"""
SELECT {DIMS_RAW}, 'monthly' AS period_type, {ddmmyy(mo)} AS period_value, {mo} AS period_start,
       {cntf('lumpsum_invoice_date IS NOT NULL')} AS total_lumpsum_invoice,
       {cntf('pmpm_invoice_date IS NOT NULL')} AS total_pmpm_invoice,
       {cntf('lumpsum_collection_date IS NOT NULL')} AS total_lumpsum_collection,
       {cntf('pmpm_collection_date IS NOT NULL')} AS total_pmpm_collection
FROM meters
WHERE lumpsum_invoice_date IS NOT NULL OR pmpm_invoice_date IS NOT NULL
   OR lumpsum_collection_date IS NOT NULL OR pmpm_collection_date IS NOT NULL
GROUP BY ALL""")


def a15(as_of=AS_OF):
    mo = trunc("month", "sat_date")
    return with_facts(f"b AS (SELECT {DIMS_RAW}, sat_date, CAST(date_diff('day', sat_date, {as_of}) AS INTEGER) AS days_diff "
                      f"FROM meters WHERE sat_date IS NOT NULL AND lumpsum_collection_date IS NULL "
                      f"AND pmpm_collection_date IS NULL)", select=f"""
SELECT {MIDIM}, 'monthly' AS period_type, {ddmmyy(mo)} AS period_value, {mo} AS period_start,
       {age_buckets('days_diff')}
FROM b GROUP BY ALL""")


def a16():
    """Replaced-meter complaints (both serials non-blank) left-joined to every
    meter with the same serial, classified, counted per grain of created_date."""
    kind = ("TRIM(REPLACE(REPLACE(c.complaint_type, '\"', ''), chr(160), ' '))")
    burnt = ", ".join(f"'{t}'" for t in C.BURNT_TYPES)
    own = "UPPER(TRIM(c.meter_category))"
    fallback = ("CASE WHEN m.metertype IN ('3PLTCTSM', 'HTCTPTSM') AND (m.consumerno IS NULL OR TRIM(m.consumerno) = '') "
                "THEN CASE m.metertype WHEN '3PLTCTSM' THEN 'DT' ELSE 'FEEDER' END ELSE 'CONSUMER' END")
    ps = grain_start("c.created_date")
    return with_facts(select=f"""
SELECT c.project, c.discom, c.zone, c.circle, c.division, c.sub_division AS subdivision,
       COALESCE(m.substation, 'Unknown') AS substation, c.feeder, c.dtr,
       CASE WHEN TRIM(COALESCE(c.meter_category, '')) <> '' THEN (CASE WHEN {own} = 'DTR' THEN 'DT' ELSE {own} END)
            ELSE {fallback} END AS meter_category,
       COALESCE(m.metertype, 'Unknown') AS new_meter_type,
       CASE WHEN {kind} IN ({burnt}) THEN '{C.DEFECT_BURNT}' WHEN {kind} = '{C.FAULTY_TYPE}' THEN '{C.DEFECT_FAULTY}'
            ELSE '{C.DEFECT_OTHERS}' END AS defective_type,
       g.period_type, {ddmmyy(ps)} AS period_value, {ps} AS period_start, {cnt()} AS meter_count
FROM complaints c
LEFT JOIN meters m ON c.old_smart_meter_number = m.meterserialnumber
CROSS JOIN {GRAINS3}
WHERE TRIM(COALESCE(c.old_smart_meter_number, '')) <> '' AND TRIM(COALESCE(c.new_smart_meter_number, '')) <> ''
GROUP BY ALL""")


def a17():
    tech = "COALESCE(NULLIF(TRIM(technician), ''), supervisor)"
    return with_facts(select=f"""
SELECT UPPER(TRIM(project)) AS project, discom, zone, circle, division, sub_division AS subdivision,
       UPPER(TRIM(meter_category)) AS meter_category, {tech} AS technician,
       CAST(closed_date AS DATE) AS closed_day, {cnt()} AS closed_tickets
FROM complaints WHERE closed_date IS NOT NULL AND {tech} IS NOT NULL
GROUP BY ALL""")


OM_DIMS_SQL = ("project, discom, zone, circle, division, sub_division AS subdivision, "
               "CAST(NULL AS VARCHAR) AS substation, feeder, dtr, meter_category")


def a18():
    return with_facts(select=f"""
SELECT {OM_DIMS_SQL}, ticket_id, created_date,
       CAST(date_diff('microsecond', created_date, {AS_OF_TS}) AS DOUBLE) / CAST(86400000000 AS DOUBLE) AS ageing_days,
       technician, agency, complaint_by
FROM complaints WHERE closed_date IS NULL""")


def a19():
    return with_facts(f"""b AS (
  SELECT {OM_DIMS_SQL}, CAST(created_date AS DATE) AS created_day, CAST(closed_date AS DATE) AS closed_day,
         date_diff('microsecond', created_date, closed_date) AS us
  FROM complaints WHERE closed_date IS NOT NULL)""", select=f"""
SELECT {OMDIM}, 'daily' AS period_type, {ddmmyy('created_day')} AS period_value_created,
       {ddmmyy('closed_day')} AS period_value_closed,
       CAST(SUM(us) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) / CAST(86400000000 AS DOUBLE) AS avg_resolution_days,
       {cnt()} AS closed_tickets, closed_day AS closed_date, created_day, {bsum('us')} AS resolution_us
FROM b GROUP BY {OMDIM}, created_day, closed_day""")


def a20():
    keys = f"{OM_DIMS_SQL}, complaint_type, complaint_category, complaint_by"
    ps = grain_start("closed_date")
    return with_facts(select=f"""
SELECT {keys}, g.period_type,
       CASE g.period_type WHEN 'monthly' THEN strftime({ps}, '%Y-%m') ELSE strftime({ps}, '%Y-%m-%d') END AS period_value,
       {cnt()} AS closed_tickets, {ps} AS closed_date
FROM complaints CROSS JOIN {GRAINS3}
WHERE closed_date IS NOT NULL GROUP BY ALL""")
