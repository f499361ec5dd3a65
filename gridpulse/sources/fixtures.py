"""Binding of the two fact tables (meters, complaints) to the test tables.

The reference reads two PostgreSQL fact tables. In tests and the bench they
are derived from the TPC-H-like tables in ``/root/testdata/sf*/`` by a fixed
rule (FIXTURES.md §3). The same rule is written twice: once as DataFrame code
(used by every Spark query) and once as SQL (the DuckDB oracle twin).

Scale notes: the meter binding is (lineitem ⋈ part) ⋈ (orders ⋈ customer ⋈
nation/region): both sides are fact-sized, a sort-merge join on the order key;
customer and part are dimension-sized (AQE turns them into broadcasts when the
runtime size allows), TPC-H fixes nation and region at 25 and 5 rows, so an
explicit broadcast is bounded. Only the columns
a query needs survive column pruning through the joins.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c) -> "F.Column":
    return c.cast("string")


def bind_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meter fact table (one row per lineitem row)."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_type")

    # the customers' columns are joined to the orders, a quarter as many rows; lineitem is shuffled by its two keys only, and without them
    placed = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
               .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
               .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")))
    j = li.join(p, li.l_partkey == p.p_partkey).join(placed, li.l_orderkey == F.col("o_orderkey"))

    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    codes = C.METER_TYPE_CODES + ["UNMAPPED"]
    metertype = F.element_at(F.array(*[F.lit(x) for x in codes]), (pk % 14 + 1).cast("int"))
    ship = F.to_date(F.col("l_shipdate"))
    mi_date = F.when(F.col("l_discount") < 0.015, F.lit(None).cast("date")).otherwise(ship)
    didate = F.when(pk % 17 == 0, F.lit(None).cast("date")).otherwise(F.to_date(F.col("o_orderdate")))
    sat_mod = ok % 12

    base = j.select(
        F.when(ok % 2 == 0, F.col("r_name"))
         .otherwise(F.concat(F.lit(" "), F.lower(F.col("r_name")), F.lit(" "))).alias("project"),
        F.when(sk % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("discom"),
        F.col("c_mktsegment").alias("zone"),
        F.col("p_type").alias("circle"),
        F.col("o_orderpriority").alias("division"),
        F.concat(F.lit("SD-"), _s(sk % 4)).alias("subdivision"),
        F.concat(F.lit("SS-"), _s(sk % 3)).alias("substation"),
        F.col("l_returnflag").alias("feeder"),
        F.col("l_linestatus").alias("dtr"),
        metertype.alias("metertype"),
        F.when(ok % 5 == 0, F.lit(" consumer")).when(ok % 5 == 1, F.lit("Feeder"))
         .when(ok % 5 == 2, F.lit("DT")).otherwise(F.lit(None).cast("string")).alias("connection_type"),
        F.when(sk % 3 == 0, F.lit(None).cast("string")).when(sk % 3 == 1, F.lit(" "))
         .otherwise(_s(F.col("o_custkey"))).alias("consumerno"),
        F.concat(F.lit("M"), _s(ok), F.lit("-"), _s(F.col("l_linenumber"))).alias("meterserialnumber"),
        F.when(sk % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" T"), _s(sk % 20))).alias("technicianname"),
        F.concat(F.lit("S"), _s(sk % 5)).alias("supervisor"),
        didate.alias("didate"),
        mi_date.alias("mi_date"),
        F.when(mi_date.isNull(), F.lit(None).cast("timestamp_ntz"))
         .otherwise(mi_date.cast("timestamp_ntz")).alias("installedts"),
        F.when(sat_mod == 0, F.lit(None).cast("string")).when(sat_mod == 1, F.lit(" "))
         .when(sat_mod == 2, F.lit("SAT Pending"))
         .otherwise(F.concat(F.lit("SAT-"), _s(sat_mod - 2))).alias("sat_no"),
        F.when(sat_mod > 2, F.date_add(mi_date, F.col("l_quantity").cast("int"))).alias("sat_date"),
        F.date_add(didate, (pk % 10).cast("int")).cast("timestamp_ntz").alias("gmrtoagencyts"),
        F.date_add(didate, (pk % 10 + sk % 7).cast("int")).cast("timestamp_ntz").alias("agencytosupts"),
        F.col("l_tax"), pk.alias("_pk"),
    )
    sat = F.col("sat_date")
    return (base.select(
        *[x for x in base.columns if x not in ("l_tax", "_pk")],
        F.when(F.col("_pk") % 2 == 0, F.date_add(sat, 10)).alias("lumpsum_invoice_date"),
        F.when(F.col("l_tax") >= 0.02, F.date_add(sat, 15)).alias("pmpm_invoice_date"),
        F.when(F.col("_pk") % 4 == 0, F.date_add(sat, 30)).alias("lumpsum_collection_date"),
        F.when(F.col("l_tax") >= 0.05, F.date_add(sat, 40)).alias("pmpm_collection_date"),
    ))


def bind_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complaint fact table (one row per event)."""
    e = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    eid, uid = F.col("event_id"), F.col("user_id")
    created = F.col("ts") - F.make_dt_interval(((uid * 7) % 250).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    closed_min = F.floor(F.col("value") * 144).cast("int")
    b = e.select(
        _s(eid).alias("ticket_id"),
        F.when(uid % 4 == 0, F.lit("AFRICA")).when(uid % 4 == 1, F.lit(" america"))
         .when(uid % 4 == 2, F.lit("ASIA")).otherwise(F.lit("EUROPE")).alias("project"),
        F.when(uid % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("NATION_"), _s(uid % 25))).alias("discom"),
        F.concat(F.lit("Z"), _s(uid % 5)).alias("zone"),
        F.concat(F.lit("C"), _s(uid % 3)).alias("circle"),
        F.concat(F.lit("D"), _s(eid % 2)).alias("division"),
        F.concat(F.lit("SD-"), _s(eid % 4)).alias("sub_division"),
        F.concat(F.lit("F"), _s(uid % 2)).alias("feeder"),
        F.concat(F.lit("DTR"), _s(uid % 3)).alias("dtr"),
        F.when(uid % 6 == 0, F.lit("Consumer")).when(uid % 6 == 1, F.lit("DTR"))
         .when(uid % 6 == 2, F.lit("dt")).when(uid % 6 == 3, F.lit("Feeder"))
         .when(uid % 6 == 4, F.lit(" ")).otherwise(F.lit(None).cast("string")).alias("meter_category"),
        F.when(eid % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Tech "), _s(uid % 30))).alias("technician"),
        F.when(uid % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Sup "), _s(uid % 4))).alias("supervisor"),
        created.alias("created_date"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("timestamp_ntz"))
         .otherwise(created + F.make_dt_interval(F.lit(0), F.lit(0), closed_min, F.lit(0))).alias("closed_date"),
        F.concat(F.lit("Agency "), _s(uid % 3)).alias("agency"),
        F.when(eid % 5 == 0, F.lit("Auto-Ticketing")).when(eid % 5 == 1, F.lit("1912 Helpdesk"))
         .when(eid % 5 == 2, F.lit("Auto Ticketing via 1912 helpdesk")).when(eid % 5 == 3, F.lit("Walk-in"))
         .otherwise(F.lit(None).cast("string")).alias("complaint_by"),
        F.when(eid % 6 == 0, F.lit('"Meter burnt"')).when(eid % 6 == 1, F.lit("Meter Terminal Burnt"))
         .when(eid % 6 == 2, F.lit("Meter Sparking or Sparking at Meter terminal"))
         .when(eid % 6 == 3, F.lit("Meter faulty or not working "))
         .when(eid % 6 == 4, F.lit("Meter No Display")).otherwise(F.lit(None).cast("string")).alias("complaint_type"),
        F.upper(F.col("event_type")).alias("complaint_category"),
        F.when(eid % 4 == 0, F.lit(None).cast("string")).when(eid % 4 == 1, F.lit(" "))
         .otherwise(F.concat(F.lit("M"), _s(eid % 1500), F.lit("-"), _s(1 + eid % 7))).alias("old_smart_meter_number"),
        F.when(eid % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("N"), _s(eid))).alias("new_smart_meter_number"),
    )
    return b


# ---------------------------------------------------------------------------
# SQL twin (DuckDB dialect) of the same binding, used by the oracles.
# ---------------------------------------------------------------------------

def _metertype_case() -> str:
    codes = C.METER_TYPE_CODES + ["UNMAPPED"]
    whens = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes))
    return f"CASE l.l_partkey % 14 {whens} END"


METERS_SQL = f"""
meters_b AS (
  SELECT
    CASE WHEN l.l_orderkey % 2 = 0 THEN r.r_name ELSE ' ' || lower(r.r_name) || ' ' END AS project,
    CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE n.n_name END AS discom,
    c.c_mktsegment AS zone, p.p_type AS circle, o.o_orderpriority AS division,
    'SD-' || CAST(l.l_suppkey % 4 AS VARCHAR) AS subdivision,
    'SS-' || CAST(l.l_suppkey % 3 AS VARCHAR) AS substation,
    l.l_returnflag AS feeder, l.l_linestatus AS dtr,
    {_metertype_case()} AS metertype,
    CASE l.l_orderkey % 5 WHEN 0 THEN ' consumer' WHEN 1 THEN 'Feeder' WHEN 2 THEN 'DT' ELSE NULL END AS connection_type,
    CASE l.l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE CAST(o.o_custkey AS VARCHAR) END AS consumerno,
    'M' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS meterserialnumber,
    CASE WHEN l.l_suppkey % 10 = 0 THEN '  ' ELSE ' T' || CAST(l.l_suppkey % 20 AS VARCHAR) END AS technicianname,
    'S' || CAST(l.l_suppkey % 5 AS VARCHAR) AS supervisor,
    CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS didate,
    CASE WHEN l.l_discount < 0.015 THEN NULL ELSE CAST(l.l_shipdate AS DATE) END AS mi_date,
    CASE WHEN l.l_discount < 0.015 THEN NULL ELSE CAST(CAST(l.l_shipdate AS DATE) AS TIMESTAMP) END AS installedts,
    CASE l.l_orderkey % 12 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'SAT Pending'
         ELSE 'SAT-' || CAST(l.l_orderkey % 12 - 2 AS VARCHAR) END AS sat_no,
    CASE WHEN l.l_orderkey % 12 > 2 AND l.l_discount >= 0.015
         THEN CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity AS INTEGER) END AS sat_date,
    CAST(CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END
         + CAST(l.l_partkey % 10 AS INTEGER) AS TIMESTAMP) AS gmrtoagencyts,
    CAST(CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END
         + CAST(l.l_partkey % 10 + l.l_suppkey % 7 AS INTEGER) AS TIMESTAMP) AS agencytosupts,
    l.l_tax AS _tax, l.l_partkey AS _pk
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
meters AS (
  SELECT * EXCLUDE (_tax, _pk),
    CASE WHEN _pk % 2 = 0 THEN sat_date + 10 END AS lumpsum_invoice_date,
    CASE WHEN _tax >= 0.02 THEN sat_date + 15 END AS pmpm_invoice_date,
    CASE WHEN _pk % 4 = 0 THEN sat_date + 30 END AS lumpsum_collection_date,
    CASE WHEN _tax >= 0.05 THEN sat_date + 40 END AS pmpm_collection_date
  FROM meters_b
)"""

COMPLAINTS_SQL = """
complaints_b AS (
  SELECT e.*, e.ts - to_days(CAST((e.user_id * 7) % 250 AS INTEGER)) AS created_date
  FROM events e
),
complaints AS (
  SELECT
    CAST(event_id AS VARCHAR) AS ticket_id,
    CASE user_id % 4 WHEN 0 THEN 'AFRICA' WHEN 1 THEN ' america' WHEN 2 THEN 'ASIA' ELSE 'EUROPE' END AS project,
    CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'NATION_' || CAST(user_id % 25 AS VARCHAR) END AS discom,
    'Z' || CAST(user_id % 5 AS VARCHAR) AS zone,
    'C' || CAST(user_id % 3 AS VARCHAR) AS circle,
    'D' || CAST(event_id % 2 AS VARCHAR) AS division,
    'SD-' || CAST(event_id % 4 AS VARCHAR) AS sub_division,
    'F' || CAST(user_id % 2 AS VARCHAR) AS feeder,
    'DTR' || CAST(user_id % 3 AS VARCHAR) AS dtr,
    CASE user_id % 6 WHEN 0 THEN 'Consumer' WHEN 1 THEN 'DTR' WHEN 2 THEN 'dt' WHEN 3 THEN 'Feeder'
         WHEN 4 THEN ' ' ELSE NULL END AS meter_category,
    CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'Tech ' || CAST(user_id % 30 AS VARCHAR) END AS technician,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'Sup ' || CAST(user_id % 4 AS VARCHAR) END AS supervisor,
    created_date,
    CASE WHEN event_type = 'error' THEN NULL
         ELSE created_date + to_minutes(CAST(floor(value * 144) AS BIGINT)) END AS closed_date,
    'Agency ' || CAST(user_id % 3 AS VARCHAR) AS agency,
    CASE event_id % 5 WHEN 0 THEN 'Auto-Ticketing' WHEN 1 THEN '1912 Helpdesk'
         WHEN 2 THEN 'Auto Ticketing via 1912 helpdesk' WHEN 3 THEN 'Walk-in' ELSE NULL END AS complaint_by,
    CASE event_id % 6 WHEN 0 THEN '"Meter burnt"' WHEN 1 THEN 'Meter Terminal' || chr(160) || 'Burnt'
         WHEN 2 THEN 'Meter Sparking or Sparking at Meter terminal' WHEN 3 THEN 'Meter faulty or not working '
         WHEN 4 THEN 'Meter No Display' ELSE NULL END AS complaint_type,
    upper(event_type) AS complaint_category,
    CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' '
         ELSE 'M' || CAST(event_id % 1500 AS VARCHAR) || '-' || CAST(1 + event_id % 7 AS VARCHAR) END AS old_smart_meter_number,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'N' || CAST(event_id AS VARCHAR) END AS new_smart_meter_number
  FROM complaints_b
)"""


class OracleSQL(str):
    """SQL text that also remembers its extra CTEs and final SELECT, so a
    summary oracle can be embedded as a CTE of a dashboard oracle."""
    ctes: tuple = ()
    select: str = ""


def with_facts(*ctes: str, select: str) -> OracleSQL:
    """Build a self-contained oracle: binding CTEs, extra CTEs, final SELECT."""
    parts = [METERS_SQL.strip(), COMPLAINTS_SQL.strip()] + [c.strip() for c in ctes]
    out = OracleSQL("WITH " + ",\n".join(parts) + "\n" + select.strip())
    out.ctes = tuple(c.strip() for c in ctes)
    out.select = select.strip()
    return out


def as_ctes(name: str, oracle: OracleSQL) -> list[str]:
    """The CTEs needed to use ``oracle``'s result under the name ``name``."""
    return list(oracle.ctes) + [f"{name} AS (\n{oracle.select}\n)"]
