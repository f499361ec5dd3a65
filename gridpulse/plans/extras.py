"""Ingestion, maintenance and documented-only queries registered against the
test tables (S6-S8, S12, M1-M3, J7, P25, F23, R7, Q25-Q30, Q33).

Inputs that the reference reads from files (mixed-format dates, partial CSV
extracts, incremental loads, a remediation mapping) are derived from the test
tables by fixed rules, so every query's work grows with the data.
"""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from .. import config as C
from ..functions import columns as X
from ..functions import predicates as P
from ..functions.filters import Filters
from ..operators import builders_mi as BM
from ..operators import dual as D
from ..operators import joins as J
from ..operators import maintenance as M
from ..operators.ageing import AgeHistogram, classes_of
from ..operators.pages import PagedList
from ..operators.sections import Section
from ..oracles import builders as OB
from ..oracles.sqlbits import F1, MIDIM, cnt, ddmmyy, trunc
from ..session import case_sensitive, ensure_checkpoint_dir
from ..sources import files as S
from ..sources import incremental as INC
from ..sources import rejects as RJ
from ..sources.fixtures import as_ctes, bind_complaints, bind_meters, with_facts
from ..sources.sinks import write_aligned
from ..sources.versions import VersionedStore
from . import dashboards_mi as QM
from . import dashboards_om as QO
from .base import Plan, merged, single
from .registry import REGISTRY


def reg(name, fn, oracle):
    REGISTRY[name] = (fn, oracle)


# S6 -------------------------------------------------------------------------------
def _s06(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    ok = F.col("l_orderkey")
    raw = (F.when(ok % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
            .when(ok % 3 == 1, F.date_format("l_shipdate", "dd-MM-yyyy"))
            .otherwise(F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))))
    d = li.select("l_orderkey", "l_linenumber", raw.alias("raw_date"))
    return d.select("*", S.parse_mixed_date("raw_date").alias("parsed_date"))


def _s06_sql():
    return with_facts("""d AS (SELECT l_orderkey, l_linenumber,
  CASE l_orderkey % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%d-%m-%Y')
       ELSE 'x' || CAST(l_linenumber AS VARCHAR) END AS raw_date FROM lineitem)""", select="""
SELECT l_orderkey, l_linenumber, raw_date,
       CAST(COALESCE(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%d-%m-%Y')) AS DATE) AS parsed_date
FROM d""")


# S3 / S4 --------------------------------------------------------------------------
def _mixed(c, key):
    """Render a date as text, ISO for even keys and DD-MM-YYYY for odd ones."""
    return F.when(F.col(key) % 2 == 0, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "dd-MM-yyyy"))


def _staging_src(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def _s03(spark, sf):
    src = _staging_src(spark, sf).select(
        "l_orderkey", "l_linenumber", _mixed(F.col("l_shipdate"), "l_partkey").alias("installationDate"))
    return S.installation_staging(src)


def _s04(spark, sf):
    src = _staging_src(case_sensitive(spark), sf).select(  # DIDate and didate
        "l_orderkey", "l_linenumber", F.lit(" asia ").alias("project"),
        _mixed(F.col("o_orderdate"), "l_orderkey").alias("DIDate"),
        _mixed(F.col("l_shipdate"), "l_linenumber").alias("InstalledTS"))
    return S.inventory_staging(src)


def _mixed_sql(c, key):
    return f"CASE WHEN {key} % 2 = 0 THEN strftime({c}, '%Y-%m-%d') ELSE strftime({c}, '%d-%m-%Y') END"


def _parse_sql(c):
    return f"CAST(COALESCE(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d-%m-%Y')) AS DATE)"


def _s03_sql():
    return with_facts(f"""src AS (SELECT l_orderkey, l_linenumber, {_mixed_sql('l_shipdate', 'l_partkey')} AS "installationDate"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
                      select=f'SELECT *, {_parse_sql(chr(34) + "installationDate" + chr(34))} AS installation_date FROM src')


def _s04_sql():
    return with_facts(f"""src AS (SELECT l_orderkey, l_linenumber, ' asia ' AS project,
  {_mixed_sql('o_orderdate', 'l_orderkey')} AS "DIDate", {_mixed_sql('l_shipdate', 'l_linenumber')} AS "InstalledTS"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""", select=f"""
SELECT *, project AS project_name, {_parse_sql('"DIDate"')} AS didate, {_parse_sql('"InstalledTS"')} AS installed_date
FROM src""")


# S7 -------------------------------------------------------------------------------
OPEN_MISSING = ["closed_date", "new_smart_meter_number", "complaint_category"]


def _s07(spark, sf):
    c = bind_complaints(spark, sf)
    closed = c.where(P.closed_ticket()).withColumn("status", F.lit("closed"))
    opened = c.where(P.open_ticket()).drop(*OPEN_MISSING).withColumn("status", F.lit("open"))
    return S.align_and_concat([closed, opened])


def _s07_sql():
    from ..schemas import COMPLAINTS
    common = [f.name for f in COMPLAINTS.fields if f.name not in OPEN_MISSING] + ["status"]
    cols = ", ".join(common)
    return with_facts(select=f"""
SELECT {cols} FROM (SELECT *, 'closed' AS status FROM complaints WHERE closed_date IS NOT NULL)
UNION ALL SELECT {cols} FROM (SELECT *, 'open' AS status FROM complaints WHERE closed_date IS NULL)""")


# S8 -------------------------------------------------------------------------------
def _s08(spark, sf):
    c = bind_complaints(spark, sf).select("ticket_id", "created_date", "closed_date")
    return S.enrich_time(c).drop("created_date", "closed_date")


def _s08_sql():
    return with_facts(select="""
SELECT ticket_id, CAST(created_date AS DATE) AS created_day, CAST(closed_date AS DATE) AS closed_day,
       CAST(date_trunc('week', created_date) AS DATE) AS created_week, strftime(created_date, '%b %Y') AS created_month,
       CAST(date_trunc('week', closed_date) AS DATE) AS closed_week, strftime(closed_date, '%b %Y') AS closed_month
FROM complaints""")


# S5 -------------------------------------------------------------------------------
def _s05(spark, sf):
    """Closed tickets as a closed file and all tickets as an open one, their times in two formats."""
    def text(c):
        return F.when(F.dayofmonth(c) % 2 == 0, F.date_format(c, "dd-MM-yyyy HH:mm:ss")).otherwise(
            F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    raw = bind_complaints(spark, sf).select("ticket_id", text("created_date").alias("CreatedDate"),
                                            text("closed_date").alias("ClosedDate"))
    closed = S.complaint_frame(raw.where(F.col("ClosedDate").isNotNull()), "CONSUMER", "closed")
    both = S.align_and_concat([closed, S.complaint_frame(raw, "CONSUMER", "open")])
    return both.select("ticket_id", "MeterCategory", "status", F.to_date("created_date").alias("created_day"),
                       F.to_date("closed_date").alias("closed_day"))


def _s05_sql():
    return with_facts(select="""
SELECT ticket_id, 'CONSUMER' AS "MeterCategory", 'closed' AS status, CAST(created_date AS DATE) AS created_day,
       CAST(closed_date AS DATE) AS closed_day FROM complaints WHERE closed_date IS NOT NULL
UNION ALL
SELECT ticket_id, 'CONSUMER', 'open', CAST(created_date AS DATE), CAST(NULL AS DATE) FROM complaints""")


# S5, S11 with rejects --------------------------------------------------------------
def _complaint_lines(spark, sf):
    """Tickets as CSV lines in files; those whose number ends in 1 to 4 are damaged, in four ways."""
    raw = bind_complaints(spark, sf).select("ticket_id", "created_date", "closed_date")
    kind = F.col("ticket_id").cast("long") % 10
    time = "yyyy-MM-dd HH:mm:ss"
    created = F.when(kind == 3, "31-02-2023 10:00:00").otherwise(F.date_format("created_date", time))
    closed = F.when(kind == 4, "never").otherwise(F.coalesce(F.date_format("closed_date", time), F.lit("")))
    cells = F.when(kind == 1, F.array("ticket_id", created, closed, F.lit("more"))).when(kind == 2, F.array("ticket_id", created)).otherwise(
        F.array("ticket_id", created, closed))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/complaint-lines-{uuid.uuid4().hex[:12]}"
    raw.select(F.array_join(cells, ",").alias("line")).write.text(path)
    return RJ.read_strings(spark, path, ["ticket_id", "CreatedDate", "ClosedDate"])


def _quarantined(spark, rows, reasons):
    store = VersionedStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarantine-{uuid.uuid4().hex[:12]}")
    return RJ.Quarantine(store, "rows").write(rows, reasons(rows))


def _s05_rejects(spark, sf):
    rejects = _quarantined(spark, _complaint_lines(spark, sf), RJ.complaint_reasons).rejects()
    return rejects.select("ticket_id", F.array_join("reasons", "; ").alias("reasons"), "record")


def _s05_kept(spark, sf):
    kept = S.complaint_frame(_quarantined(spark, _complaint_lines(spark, sf), RJ.complaint_reasons).kept(), "CONSUMER", "closed")
    return kept.select("ticket_id", F.to_date("created_date").alias("created_day"), F.to_date("closed_date").alias("closed_day"))


def _s05_balance(spark, sf):
    rows = _complaint_lines(spark, sf)
    return _quarantined(spark, rows, RJ.complaint_reasons).reconciliation(rows)


def _s11_rejects(spark, sf):
    raw = _staged(spark, "mapping", _mapping_raw(_geo_meters(spark, sf)))
    rejects = _quarantined(spark, raw, RJ.mapping_reasons).rejects()
    return rejects.select(F.trim("meter_serial_number").alias("meter_serial_number"), F.array_join("reasons", "; ").alias("reasons"))


_TICKET_KIND = "CAST(ticket_id AS BIGINT) % 10"


def _s05_rejects_sql():
    created, closed = "strftime(created_date, '%Y-%m-%d %H:%M:%S')", "COALESCE(strftime(closed_date, '%Y-%m-%d %H:%M:%S'), '')"
    return with_facts(select=f"""
SELECT ticket_id, CASE {_TICKET_KIND} WHEN 3 THEN 'CreatedDate is no time' WHEN 4 THEN 'ClosedDate is no time' ELSE 'wrong number of cells' END AS reasons,
       ticket_id || CASE {_TICKET_KIND} WHEN 1 THEN ',' || {created} || ',' || {closed} || ',more' WHEN 2 THEN ',' || {created}
                    WHEN 3 THEN ',31-02-2023 10:00:00,' || {closed} ELSE ',' || {created} || ',never' END AS record
FROM complaints WHERE {_TICKET_KIND} BETWEEN 1 AND 4""")


def _s05_kept_sql():
    return with_facts(select=f"""SELECT ticket_id, CAST(created_date AS DATE) AS created_day, CAST(closed_date AS DATE) AS closed_day
FROM complaints WHERE {_TICKET_KIND} NOT BETWEEN 1 AND 4""")


def _s05_balance_sql():
    return with_facts(select=f"""SELECT CAST(COUNT(*) AS BIGINT) AS "read", CAST(COUNT(*) FILTER (WHERE {_TICKET_KIND} NOT BETWEEN 1 AND 4) AS BIGINT) AS kept,
       CAST(COUNT(*) FILTER (WHERE {_TICKET_KIND} BETWEEN 1 AND 4) AS BIGINT) AS rejected, TRUE AS balanced FROM complaints""")


def _s11_rejects_sql():
    return with_facts(MAPPING_SQL, select="""SELECT TRIM(meter_serial_number) AS meter_serial_number, 'division is blank' AS reasons
FROM raw_map WHERE TRIM(division) = ''""")


# Ageing from a histogram ------------------------------------------------------------
#: Two run dates: the fixtures' own and one that cuts the facts in two.
RUN_DATES = (C.DEFAULT.meter_as_of, dt.date(1996, 3, 15))


def _histogram(spark, name, day):
    return AgeHistogram(VersionedStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/ageing-{uuid.uuid4().hex[:12]}"), name, C.MIDIM, day)


def _aged(hist, names):
    """A5's and A15's rows at both run dates, of one histogram."""
    return hist.at([*RUN_DATES], classes_of(C.STOCK_AGE_BOUNDS, names), "month").select("as_of", *C.MIDIM, "period_start", *names)


def _a05_histogram(spark, sf):
    """Stock as what came in less what was installed: two loads."""
    came = bind_meters(spark, sf).where(F.col("didate").isNotNull()).select(*BM._dims(False), "didate", "installedts")
    hist = _histogram(spark, "stock", "didate").add_all(came, {"received": (F.lit(True), 1), "installed": (F.col("installedts").isNotNull(), -1)})
    return _aged(hist, BM.AGE4)


def _a15_histogram(spark, sf):
    due = bind_meters(spark, sf).where(P.sat_not_collected()).select(*BM._dims(False), "sat_date")
    early = F.col("sat_date") < F.lit(dt.date(1995, 6, 1))
    return _aged(_histogram(spark, "uncollected", "sat_date").add_all(due, {"early": (early, 1), "late": (~early, 1)}), BM.AGE4)


def _aged_sql(builder):
    # each run date keeps its own fact CTEs
    dates = ", ".join(f"d{i} AS ({builder(f"DATE '{d}'")})" for i, d in enumerate(RUN_DATES))
    parts = [f"SELECT DATE '{d}' AS as_of, {MIDIM}, period_start, {', '.join(BM.AGE4)} FROM d{i}" for i, d in enumerate(RUN_DATES)]
    return f"WITH {dates} " + " UNION ALL ".join(parts)


# S12 ------------------------------------------------------------------------------
# R21 ------------------------------------------------------------------------------
def _last_page(base: str, cols: list[str], order: list[str], rows: int, where=None):
    """The last ``rows`` rows of a list as a page of the stored list, and its SQL."""
    from .queries_dash import BASES, base_frames
    order = [*order, *(c for c in cols if c not in order)]

    def fn(spark, sf):
        df = base_frames(spark, sf, [base])[base]
        df = (df.where(where.col) if where else df).select(*cols)
        store = VersionedStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex[:12]}")
        pages = PagedList.write(df, order, store, base, rows_per_file=100_000)
        return pages.page(max(0, pages.rows - rows), rows)

    def sql():
        source = f"(SELECT {', '.join(map(D.q, cols))} FROM b_{base}{f' WHERE {where.sql}' if where else ''})"
        by = ", ".join(f"{D.q(c)} DESC NULLS LAST" for c in order)
        return with_facts(*as_ctes(f"b_{base}", BASES[base][2]()), select=f"SELECT * FROM {source} x ORDER BY {by} LIMIT {rows}")
    return fn, sql


# S10 ------------------------------------------------------------------------------
#: A target as a database declares it: other order and case, other types, a column the source lacks.
S10_TARGET = StructType([StructField(n, t) for n, t in (("ticket_id", StringType()), ("discom", StringType()), ("kind", StringType()),
                                                        ("created_day", DateType()), ("remark", StringType()))])


def _s10(spark, sf):
    """Complaints aligned to the target, written as a version and read back."""
    c = bind_complaints(spark, sf).select(F.col("ticket_id").alias("TICKET_ID"), F.col("discom").alias("Discom"), "complaint_type",
                                          F.col("created_date").alias("CREATED_DAY"), "supervisor")
    store = VersionedStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/s10-{uuid.uuid4().hex[:12]}")
    write_aligned(c, S10_TARGET, store, "tickets", rename={"complaint_type": "kind"})
    return store.frame("tickets")


def _s10_sql():
    return with_facts(select="""
SELECT ticket_id, discom, complaint_type AS kind, CAST(created_date AS DATE) AS created_day, CAST(NULL AS VARCHAR) AS remark FROM complaints""")


def _s12(spark, sf):
    c = bind_complaints(spark, sf)
    load1 = c.select("ticket_id", F.lit("open").alias("status"), F.col("technician"),
                     F.col("created_date").alias("load_ts"))
    load2 = c.where(P.closed_ticket()).select("ticket_id", F.lit("closed").alias("status"),
                                              X.technician_or_supervisor().alias("technician"),
                                              F.col("closed_date").alias("load_ts"))
    return INC.upsert(load1, load2, "ticket_id")


def _s12_buckets(spark, sf):
    """The same two loads one after the other, the second one repeated, into the bucketed stage."""
    c = bind_complaints(spark, sf)
    load1 = c.select("ticket_id", F.lit("open").alias("status"), F.col("technician"), F.col("created_date").alias("load_ts"))
    load2 = c.where(P.closed_ticket()).select("ticket_id", F.lit("closed").alias("status"), X.technician_or_supervisor().alias("technician"),
                                              F.col("closed_date").alias("load_ts"))
    stage = INC.BucketedStage(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/s12-{uuid.uuid4().hex[:12]}", "ticket_id", buckets=8)
    for load_id, load in (("1", load1), ("2", load2), ("2", load2)):
        stage.load(load, load_id)
    return stage.frame()


def _s12_sql():
    return with_facts("""loads AS (
  SELECT ticket_id, 'open' AS status, technician, created_date AS load_ts FROM complaints
  UNION ALL
  SELECT ticket_id, 'closed', COALESCE(NULLIF(TRIM(technician), ''), supervisor), closed_date
  FROM complaints WHERE closed_date IS NOT NULL)""", select="""
SELECT ticket_id, load_ts, status, technician FROM loads
QUALIFY ROW_NUMBER() OVER (PARTITION BY ticket_id ORDER BY load_ts DESC) = 1""")


# M1 / M2 --------------------------------------------------------------------------
def _mapping_raw(meters):
    """Remediation mapping derived from the meters: one padded row per missing
    serial, a partial row (blank division) for some, a duplicate for others and
    rows that match nothing."""
    miss = meters.where(P.missing_geo() & X.not_blank("meterserialnumber")).select(
        F.trim("meterserialnumber").alias("s")).distinct()
    s = F.col("s")
    base = miss.select(F.concat(F.lit(" "), s, F.lit(" ")).alias("meter_serial_number"),
                       F.lit("FIX-D").alias("discom"), F.lit("FIX-Z").alias("zone"), F.lit("FIX-C").alias("circle"),
                       F.when(F.length(s) % 3 == 0, F.lit("")).otherwise(F.lit("FIX-V")).alias("division"),
                       F.lit("FIX-S").alias("subdivision"))
    dup = miss.where(s.endswith("-1")).select(s.alias("meter_serial_number"), F.lit("ALT-D").alias("discom"),
                                             F.lit("FIX-Z").alias("zone"), F.lit("FIX-C").alias("circle"),
                                             F.lit("FIX-V").alias("division"), F.lit("FIX-S").alias("subdivision"))
    stray = miss.where(s.endswith("-2")).select(F.concat(s, F.lit("X")).alias("meter_serial_number"),
                                               F.lit("FIX-D").alias("discom"), F.lit("FIX-Z").alias("zone"),
                                               F.lit("FIX-C").alias("circle"), F.lit("FIX-V").alias("division"),
                                               F.lit("FIX-S").alias("subdivision"))
    return base.unionByName(dup).unionByName(stray)


MISSING_SQL = ("(discom IS NULL OR TRIM(discom) = '' OR zone IS NULL OR TRIM(zone) = '' OR circle IS NULL OR "
               "TRIM(circle) = '' OR division IS NULL OR TRIM(division) = '' OR subdivision IS NULL OR "
               "TRIM(subdivision) = '')")
MAPPING_SQL = f"""miss AS (
  SELECT DISTINCT TRIM(meterserialnumber) AS s FROM meters
  WHERE {MISSING_SQL} AND meterserialnumber IS NOT NULL AND TRIM(meterserialnumber) <> ''),
raw_map AS (
  SELECT ' ' || s || ' ' AS meter_serial_number, 'FIX-D' AS discom, 'FIX-Z' AS zone, 'FIX-C' AS circle,
         CASE WHEN length(s) % 3 = 0 THEN '' ELSE 'FIX-V' END AS division, 'FIX-S' AS subdivision FROM miss
  UNION ALL SELECT s, 'ALT-D', 'FIX-Z', 'FIX-C', 'FIX-V', 'FIX-S' FROM miss WHERE s LIKE '%-1'
  UNION ALL SELECT s || 'X', 'FIX-D', 'FIX-Z', 'FIX-C', 'FIX-V', 'FIX-S' FROM miss WHERE s LIKE '%-2'),
usable AS (
  SELECT TRIM(meter_serial_number) AS s, TRIM(discom) AS discom, TRIM(zone) AS zone, TRIM(circle) AS circle,
         TRIM(division) AS division, TRIM(subdivision) AS subdivision
  FROM raw_map WHERE TRIM(discom) <> '' AND TRIM(zone) <> '' AND TRIM(circle) <> '' AND TRIM(division) <> ''
    AND TRIM(subdivision) <> '')"""


def _staged(spark, name: str, df):
    """``df`` written once, as the job finds its input files."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _geo_meters(spark, sf):
    """The meter table of M2, bound once: the mapping, its figures and the repair all read it."""
    return _staged(spark, "meters", bind_meters(spark, sf).select("meterserialnumber", *C.GEO5))


def _m02(spark, sf):
    m = _geo_meters(spark, sf)
    raw = _staged(spark, "mapping", _mapping_raw(m))
    return M.backfill_geo(m, raw, S.clean_geo_mapping(raw))


def _m02_files(spark, sf):
    """The meter table repaired file by file; (files, stats)."""
    m = bind_meters(spark, sf).select("meterserialnumber", *C.GEO5)
    files = M.MeterFiles(VersionedStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/meter-files-{uuid.uuid4().hex[:12]}")).create(m)
    raw = _staged(spark, "mapping", _mapping_raw(files.frame()))  # from the written table: the binding isn't computed again
    return files, files.repair(raw, S.clean_geo_mapping(raw))


def _m02_files_result(spark, sf):
    return _m02_files(spark, sf)[0].frame().groupBy(*C.GEO5).agg(F.count(F.lit(1)).alias("meters"))


def _m02_stats_sql():
    return with_facts(MAPPING_SQL, select=f"""
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM raw_map) AS loaded,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM usable) AS filtered,
       (SELECT CAST(COUNT(DISTINCT TRIM(meterserialnumber)) AS BIGINT) FROM meters
         WHERE meterserialnumber IS NOT NULL AND TRIM(meterserialnumber) <> '' AND {MISSING_SQL}) AS missing_before,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM meters t JOIN usable u ON TRIM(t.meterserialnumber) = u.s
         WHERE {MISSING_SQL.replace('discom', 't.discom').replace('zone', 't.zone').replace('circle', 't.circle').replace('division', 't.division').replace('subt.division', 't.subdivision')}) AS would_update,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM meters t WHERE {MISSING_SQL}
         AND TRIM(meterserialnumber) IN (SELECT s FROM usable)) AS updated,
       (SELECT CAST(COUNT(DISTINCT TRIM(meterserialnumber)) AS BIGINT) FROM meters
         WHERE meterserialnumber IS NOT NULL AND TRIM(meterserialnumber) <> '' AND {MISSING_SQL}
           AND TRIM(meterserialnumber) NOT IN (SELECT s FROM usable)) AS missing_after""")


def _m02_result_sql():
    return with_facts(MAPPING_SQL, """best AS (
  SELECT * FROM usable QUALIFY ROW_NUMBER() OVER (PARTITION BY s ORDER BY discom, zone, circle, division, subdivision) = 1),
repaired AS (
  SELECT CASE WHEN b.s IS NOT NULL AND {miss} THEN b.discom ELSE m.discom END AS discom,
         CASE WHEN b.s IS NOT NULL AND {miss} THEN b.zone ELSE m.zone END AS zone,
         CASE WHEN b.s IS NOT NULL AND {miss} THEN b.circle ELSE m.circle END AS circle,
         CASE WHEN b.s IS NOT NULL AND {miss} THEN b.division ELSE m.division END AS division,
         CASE WHEN b.s IS NOT NULL AND {miss} THEN b.subdivision ELSE m.subdivision END AS subdivision
  FROM meters m LEFT JOIN best b ON TRIM(m.meterserialnumber) = b.s)""".format(
        miss="(m.discom IS NULL OR TRIM(m.discom) = '' OR m.zone IS NULL OR TRIM(m.zone) = '' OR m.circle IS NULL OR "
             "TRIM(m.circle) = '' OR m.division IS NULL OR TRIM(m.division) = '' OR m.subdivision IS NULL OR "
             "TRIM(m.subdivision) = '')"), select="""
SELECT discom, zone, circle, division, subdivision, CAST(COUNT(*) AS BIGINT) AS meters
FROM repaired GROUP BY ALL""")


def _m02_result(spark, sf):
    repaired, _ = _m02(spark, sf)
    return repaired.groupBy(*C.GEO5).agg(F.count(F.lit(1)).alias("meters"))


# M3 -------------------------------------------------------------------------------
def _m03_sql():
    parts = []
    for g, ps in (("daily", "installation_date"), ("weekly", trunc("week", "installation_date")),
                  ("monthly", trunc("month", "installation_date"))):
        parts.append(f"""SELECT {MIDIM}, '{g}' AS period_type, {ddmmyy(ps)} AS period_value, {ps} AS date_value,
  {cnt()} AS total_non_sat, {", ".join(f"CAST(COUNT(*) FILTER (WHERE ageing_days > {k}) AS BIGINT) AS age_gt_{k}" for k in (30, 60, 90, 120))}
FROM b GROUP BY ALL""")
    return with_facts(*as_ctes("b", OB.a07()), select=" UNION ALL ".join(parts))


# J7 / P25 / F23 / R7 ----------------------------------------------------------------
def _j07(spark, sf):
    m = bind_meters(spark, sf)
    inv = m.where(F.col("didate").isNotNull()).select("meterserialnumber", "project", "didate")
    ins = m.where(P.verified_installation()).select("meterserialnumber")
    return J.inventory_installations(inv, ins)


def _j07_sql():
    return with_facts(f"ins AS (SELECT DISTINCT meterserialnumber AS s FROM meters WHERE {F1})", select="""
SELECT UPPER(TRIM(project)) AS project, CAST(date_trunc('month', didate) AS DATE) AS period_start,
       CAST(COUNT(*) AS BIGINT) AS total_inventory, CAST(COUNT(i.s) AS BIGINT) AS total_installed
FROM meters m LEFT JOIN ins i ON m.meterserialnumber = i.s
WHERE didate IS NOT NULL GROUP BY ALL""")


def _p25(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    r = spark.read.parquet(f"{sf}/region.parquet")
    lookup = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("discom"), F.col("r_name").alias("project_label"))
    m = bind_meters(spark, sf).select("discom", X.norm_upper("project").alias("project"))
    return (J.project_from_discom(m, lookup).groupBy("project", "project_label")
            .agg(F.count(F.lit(1)).alias("meters")))


def _p25_sql():
    return with_facts("lk AS (SELECT n_name AS discom, r_name AS project_label FROM nation JOIN region ON n_regionkey = r_regionkey)",
                      select="""
SELECT UPPER(TRIM(m.project)) AS project, lk.project_label, CAST(COUNT(*) AS BIGINT) AS meters
FROM meters m LEFT JOIN lk ON m.discom = lk.discom GROUP BY ALL""")


def _fy_label(ps):
    y = F.year(F.add_months(ps, -3))
    return F.concat(F.lit("FY"), y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def _f23(spark, sf):
    a1 = BM.mi_progress(bind_meters(spark, sf)).where(F.col("period_type") == "monthly")
    return (a1.groupBy(X.norm_upper("project").alias("project"), _fy_label(F.col("period_start")).alias("financial_year"))
            .agg(F.sum("total_mi_progress").alias("total_mi_progress")))


def _f23_sql():
    y = "year(period_start - INTERVAL 3 MONTH)"
    return with_facts(*as_ctes("a1", OB.a01()), select=f"""
SELECT UPPER(TRIM(project)) AS project, 'FY' || CAST({y} AS VARCHAR) || '-' || lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0') AS financial_year,
       CAST(SUM(total_mi_progress) AS BIGINT) AS total_mi_progress
FROM a1 WHERE period_type = 'monthly' GROUP BY ALL""")


def _r07(spark, sf, cfg=C.DEFAULT):
    a1 = BM.mi_progress(bind_meters(spark, sf)).where(
        (F.col("period_type") == "monthly") & X.norm_upper("project").isin(*cfg.projects))
    return (a1.rollup("period_start", "meter_category", "new_meter_type")
            .agg(F.sum("total_mi_progress").alias("total"), F.grouping_id().cast("int").alias("level")))


def _r07_sql(cfg=C.DEFAULT):
    projects = ", ".join(f"'{p}'" for p in cfg.projects)
    return with_facts(*as_ctes("a1", OB.a01()), select=f"""
SELECT period_start, meter_category, new_meter_type, CAST(SUM(total_mi_progress) AS BIGINT) AS total,
       CAST(GROUPING(period_start, meter_category, new_meter_type) AS INTEGER) AS level
FROM a1 WHERE period_type = 'monthly' AND UPPER(TRIM(project)) IN ({projects})
GROUP BY ROLLUP (period_start, meter_category, new_meter_type)""")


def _nested(base, keys, values, where=None, row_total=False):
    """Sums of ``values`` (name -> column) by all of ``keys`` and by each shorter prefix, null keys as ``Unknown``;
    ``level`` counts the keys that a total leaves out. ``row_total`` adds the sum of all values as ``total``."""
    sets = [keys[:n] for n in range(len(keys), 0, -1)]

    def sp(d):
        rows = d[base] if where is None else d[base].where(where.col)
        rows = rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("Unknown")).alias(k) for k in keys],
                           *[F.coalesce(F.col(c), F.lit(0)).alias(f"_{v}") for v, c in values.items()])
        sums = {v: F.sum(f"_{v}").cast("long") for v in values}
        if row_total:
            sums["total"] = F.sum(sum((F.col(f"_{v}") for v in values), F.lit(0))).cast("long")
        return (rows.groupingSets([[F.col(k) for k in x] for x in sets], *[F.col(k) for k in keys])
                .agg(*[e.alias(v) for v, e in sums.items()], F.grouping_id().cast("int").alias("id"))
                .select(*keys, *sums, F.bit_count("id").cast("int").alias("level")))

    def sq(n):
        parts = []
        for x in sets:
            cols = [f"COALESCE(CAST({k} AS VARCHAR), 'Unknown') AS {k}" if k in x else f"CAST(NULL AS VARCHAR) AS {k}" for k in keys]
            cols += [f"CAST(SUM(COALESCE({c}, 0)) AS BIGINT) AS {v}" for v, c in values.items()]
            if row_total:
                cols.append(f"CAST(SUM({' + '.join(f'COALESCE({c}, 0)' for c in values.values())}) AS BIGINT) AS total")
            cond = "" if where is None else f" WHERE {where.sql}"
            parts.append(f"SELECT {', '.join(cols)}, {len(keys) - len(x)} AS level FROM {n[base]}{cond} "
                         f"GROUP BY {', '.join(str(i + 1) for i in range(len(x)))}")
        return " UNION ALL ".join(parts)
    return Plan((base,), sp, sq)


def _q27_periods():
    """KPI 2's list with the contract's period columns (ISO days)."""
    order = ["installation_date"] + C.MIDIM + ["technician"]
    page = QO._page("a02", D.and_(), order + ["total_installations"], order, 100, 0)

    def sp(d):
        return page.spark(d).select(*C.MIDIM, "technician", F.lit("daily").alias("period_type"),
                                    F.date_format("installation_date", "yyyy-MM-dd").alias("period_value"),
                                    F.col("total_installations").alias("daily_installations"))

    def sq(n):
        return (f"SELECT {', '.join(C.MIDIM)}, technician, 'daily' AS period_type, strftime(installation_date, '%Y-%m-%d') AS period_value, "
                f"total_installations AS daily_installations FROM ({page.sql(n)})")
    return Plan(("a02",), sp, sq)


def register_all():
    from .queries_dash import reg_plan
    reg("s03_installation_staging", _s03, _s03_sql)
    reg("s04_inventory_staging", _s04, _s04_sql)
    reg("s05_complaint_files", _s05, _s05_sql)
    reg("s05_rejects", _s05_rejects, _s05_rejects_sql)
    reg("s05_kept_rows", _s05_kept, _s05_kept_sql)
    reg("s05_reconciliation", _s05_balance, _s05_balance_sql)
    reg("s11_rejects", _s11_rejects, _s11_rejects_sql)
    reg("a05_stock_ageing_two_dates", _a05_histogram, lambda: _aged_sql(OB.a05))
    reg("a15_revenue_ageing_two_dates", _a15_histogram, lambda: _aged_sql(OB.a15))
    reg("s06_mixed_date_parse", _s06, _s06_sql)
    reg("s07_align_concat", _s07, _s07_sql)
    reg("s08_time_enrichment", _s08, _s08_sql)
    reg("s10_aligned_round_trip", _s10, _s10_sql)
    reg("s12_latest_by_key", _s12, _s12_sql)
    reg("s12_bucketed_loads", _s12_buckets, _s12_sql)
    reg("m01_missing_geo", lambda s, sf: M.missing_geo_meters(bind_meters(s, sf)), lambda: with_facts(select=f"""
SELECT CAST(COUNT(DISTINCT TRIM(meterserialnumber)) AS BIGINT) AS missing_geo_meters FROM meters
WHERE meterserialnumber IS NOT NULL AND TRIM(meterserialnumber) <> '' AND {MISSING_SQL}"""))
    reg("m02_geo_backfill_stats", lambda s, sf: _m02(s, sf)[1], _m02_stats_sql)
    reg("m02_geo_backfill_result", _m02_result, _m02_result_sql)
    reg("m02_file_repair_stats", lambda s, sf: _m02_files(s, sf)[1], _m02_stats_sql)
    reg("m02_file_repair_result", _m02_files_result, _m02_result_sql)
    reg("m03_non_sat_ageing_periods", lambda s, sf: M.non_sat_ageing_periods(BM.non_sat_ageing(bind_meters(s, sf))),
        _m03_sql)
    reg("j07_inventory_installations", _j07, _j07_sql)
    reg("p25_project_from_discom", _p25, _p25_sql)
    reg("f23_progress_by_financial_year", _f23, _f23_sql)
    reg("r07_nested_breakdown", _r07, _r07_sql)

    f0 = Filters()
    # Q25 overview: one row from four summaries.
    prog = QM.q01_progress(f0)["total"]
    inv = QM.q04_inventory_utilization(f0)["summary"]
    open_ = single("a18", Section(aggs=[D.count_star().alias("open_tickets")]))
    clo = QO.q23_closure_time(f0)["summary"]
    reg_plan("q25_overview", merged([], [(prog, ["total_progress"]), (inv, ["total_inventory", "total_installed"]),
                                         (open_, ["open_tickets"]), (clo, ["avg_resolution_days"])]))
    # Q26/Q27/Q29/Q30 paged lists (R21), stable order on the full key.
    reg_plan("q26_progress_list_page", QO._page("a01", D.and_(), C.MIDIM + ["period_type", "period_value", "period_start",
                                                                           "total_mi_progress"],
                                                ["period_type", "period_start"] + C.MIDIM, 100, 200))
    period = C.MIDIM + ["period_type", "period_value", "period_start"]
    for name, base, cols, order in [
            ("q20_open_tickets_last_page", "a18", QO.A18_COLS, ["ticket_id"]),
            ("q26_progress_list_last_page", "a01", period + ["total_mi_progress"], ["period_type", "period_start"] + C.MIDIM),
            ("q27_technician_daily_list_last_page", "a02", ["installation_date"] + C.MIDIM + ["technician", "total_installations"],
             ["installation_date"] + C.MIDIM + ["technician"]),
            ("q29_non_sat_list_last_page", "a07", C.MIDIM + ["meter_serial_number", "installation_date", "ageing_days"],
             ["ageing_days", "meter_serial_number", "installation_date"])]:
        reg(name, *_last_page(base, cols, order, 250))
    reg("q22_closure_list_last_page", *_last_page("a19", QO.A19_LIST, QO.A19_KEYS, 250, D.eq(D.c("period_type"), D.lit("daily"))))
    reg_plan("q27_technician_daily_list_page", QO._page(
        "a02", D.and_(), ["installation_date"] + C.MIDIM + ["technician", "total_installations"],
        ["installation_date"] + C.MIDIM + ["technician"], 100, 0))
    reg_plan("q29_stock_ageing_list_page", QO._page(
        "a05", D.and_(), C.MIDIM + ["period_value", "period_start"] + BM.AGE4, ["period_start"] + C.MIDIM, 100, 0))
    reg_plan("q29_non_sat_list_page", QO._page(
        "a07", D.and_(), C.MIDIM + ["meter_serial_number", "installation_date", "ageing_days"],
        ["ageing_days", "meter_serial_number", "installation_date"] + C.MIDIM, 100, 0))
    by_period = ["period_type", "period_start"] + C.MIDIM
    reg_plan("q29_inventory_list_page", QO._page(
        "a04", D.and_(), period + ["total_inventory", "total_installed", "utilization_rate_pct", "remaining_stock"], by_period, 100, 0))
    reg_plan("q29_mi_vs_sat_list_page", QO._page(
        "a06", D.and_(), period + ["total_mi", "total_sat", *BM.SAT_COLS, "sat_progress_pct"], by_period, 100, 0))
    reg_plan("q29_journey_list_page", QO._page(
        "a08", D.eq(D.c("period_type"), D.lit("daily")), period + BM.JOURNEY_NAMES + ["meter_count"], by_period, 100, 0))
    stock = {a: a for a in BM.AGE4}
    reg_plan("q29_stock_ageing_nested_category", _nested("a05", ["meter_category", "new_meter_type"], stock, row_total=True))
    reg_plan("q29_stock_ageing_nested_period", _nested("a05", ["period_value", "meter_category", "new_meter_type"], stock, row_total=True))
    # R7 with the helper's labels and without the grand total, both forms.
    monthly, progress = D.eq(D.c("period_type"), D.lit("monthly")), {"total": "total_mi_progress"}
    reg_plan("r07_nested_category", _nested("a01", ["meter_category", "new_meter_type"], progress, monthly))
    reg_plan("r07_nested_period", _nested("a01", ["period_value", "meter_category", "new_meter_type"], progress, monthly))
    reg_plan("q27_technician_period_list_page", _q27_periods())
    reg_plan("q30_closed_analysis_list_page", QO._page(
        "a20", D.and_(), ["period_type", "period_value", "closed_date", "closed_tickets", "project", "discom", "zone",
                          "circle", "division", "subdivision", "feeder", "dtr", "meter_category", "complaint_type",
                          "complaint_category", "complaint_by"],
        ["period_type", "closed_date", "project", "discom", "zone", "circle", "division", "subdivision", "feeder",
         "dtr", "meter_category", "complaint_type", "complaint_category", "complaint_by"], 100, 0))
    # Q28 monthly location productivity: location count beside the month total.
    month = D.date_fmt(D.c("installation_date"), "yyyy-MM", "%Y-%m")
    loc = single("a02", Section(group=[month.alias("month"), D.c("project").alias("project"), D.c("discom").alias("discom")],
                                aggs=[D.sum0(D.c("total_installations")).alias("installations")]))
    tot = single("a02", Section(group=[month.alias("month")], aggs=[D.sum0(D.c("total_installations")).alias("month_total")]))
    def q28_spark(d):
        by_month = Window.partitionBy("month")  # over the small grouped rows
        return loc.spark(d).withColumn("month_total", F.sum("installations").over(by_month))

    def q28_sql(n):
        return (f"SELECT a.*, b.month_total FROM ({loc.sql(n)}) a JOIN ({tot.sql(n)}) b "
                f"ON a.month IS NOT DISTINCT FROM b.month")
    reg_plan("q28_location_productivity", Plan(("a02",), q28_spark, q28_sql))
    # Q30 monthly closed counts (O&M).
    reg_plan("q30_om_monthly_closed", single("a17", Section(
        group=[D.date_fmt(D.c("closed_day"), "yyyy-MM", "%Y-%m").alias("month"), D.c("project").alias("project")],
        aggs=[D.sum0(D.c("closed_tickets")).alias("closed_tickets")], order=["month"])))
    # Q33 period series for KPIs 7, 9, 11, 12, 13.
    for name, plan in q33_series(f0).items():
        reg_plan(f"q33_{name}_series", plan)


def q33_series(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> dict:
    """Documented period series (§2.14 #20): KPI 7 rolled from daily to month and week
    on the fly, KPI 9 re-weighted (R11), KPIs 11-13 by their stored month."""
    mk = lambda base, where, measures, grand=(): single(base, QM._bucketed(
        f, where, [D.trunc(D.c("period_start"), "month").alias("period_start")], measures, list(grand), ["period_start"]))
    w_all = QM._where(f, cfg, restrict_three=False)
    w3 = QM._where(f, cfg, restrict_three=True)
    out = {
        "kpi07_mi_vs_sat": mk("a06", w_all, {"total_mi": D.c("total_mi"), "total_sat": D.c("total_sat")}),
        "kpi11_sat_invoice": mk("a13", w_all, {x: D.c(x) for x in QM.SAT_INV}),
        "kpi12_revenue": mk("a14", w3, {x: D.c(x) for x in QM.REV}),
        "kpi13_revenue_ageing": mk("a15", QM._where(f, cfg, restrict_three=False, period_type="monthly"),
                                   {a: D.c(a) for a in QM.AGE4}),
    }
    for grain, name in (("monthly", "kpi09_journey"), ("weekly", "kpi09_journey_weekly"), ("daily", "kpi09_journey_daily")):
        w9 = QM._where(f, cfg, restrict_three=True, period_type=grain)
        out[name] = single("a08", QM._journey_section(f, w9, [QM._n("period_start")], ["period_start"]))
    out["kpi07_mi_vs_sat_weekly"] = single("a06", QM._bucketed(
        f, w_all, [D.trunc(D.c("period_start"), "week").alias("period_start")],
        {"total_mi": D.c("total_mi"), "total_sat": D.c("total_sat")}, [], ["period_start"]))
    return out
