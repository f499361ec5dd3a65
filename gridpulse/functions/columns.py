"""Derived-column builders (P-operators). All return pyspark ``Column`` objects
built from built-in functions, so they stay inside whole-stage codegen."""
from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """Null or empty after trimming spaces."""
    c = col(c)
    return c.isNull() | (F.trim(c) == F.lit(""))


def not_blank(c) -> Column:
    c = col(c)
    return c.isNotNull() & (F.trim(c) != F.lit(""))


def norm_upper(c) -> Column:
    """UPPER(TRIM(c))."""
    return F.upper(F.trim(col(c)))


def fallback_category(metertype="metertype", consumerno="consumerno") -> Column:
    """Category from the meter type when connection_type is null."""
    mt, cn = col(metertype), col(consumerno)
    no_consumer = blank(cn)
    return (F.when((mt == F.lit(C.DT_FALLBACK_METERTYPE)) & no_consumer, F.lit("DT"))
             .when((mt == F.lit(C.FEEDER_FALLBACK_METERTYPE)) & no_consumer, F.lit("FEEDER"))
             .otherwise(F.lit("CONSUMER")))


def meter_category(connection_type="connection_type", metertype="metertype",
                   consumerno="consumerno") -> Column:
    """UPPER(TRIM(connection_type)), else the meter-type fallback.
    A blank (non-null) connection type stays ''."""
    return F.coalesce(norm_upper(connection_type), fallback_category(metertype, consumerno))


def refined_complaint_category(own="meter_category", fallback="fallback_category") -> Column:
    """The complaint's own category (DTR -> DT) if not blank, else the
    fallback derived from the joined meter (unmatched -> CONSUMER)."""
    own_u = norm_upper(own)
    return (F.when(not_blank(own), F.when(own_u == F.lit("DTR"), F.lit("DT")).otherwise(own_u))
             .otherwise(F.coalesce(col(fallback), F.lit("CONSUMER"))))


def sat_lower(c="sat_no") -> Column:
    return F.lower(F.trim(col(c)))


def sat_stage(c="sat_no") -> Column:
    """P4: 's1'..'s9' by prefix of LOWER(TRIM(sat_no)); first match wins."""
    s = sat_lower(c)
    expr = None
    for k in C.SAT_STAGES:
        cond = s.startswith(f"sat-{k}")
        expr = F.when(cond, F.lit(f"s{k}")) if expr is None else expr.when(cond, F.lit(f"s{k}"))
    return expr.otherwise(F.lit(None).cast("string"))


def technician_or_supervisor(tech="technician", sup="supervisor") -> Column:
    """P5: COALESCE(NULLIF(TRIM(technician), ''), supervisor)."""
    return F.coalesce(F.nullif(F.trim(col(tech)), F.lit("")), col(sup))


def blank_to_null(c) -> Column:
    """NULLIF(TRIM(c), '')."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def clean_complaint_type(c="complaint_type") -> Column:
    """Strip double quotes, NBSP -> space, trim."""
    return F.trim(F.replace(F.replace(col(c), F.lit('"'), F.lit("")), F.lit("\u00a0"), F.lit(" ")))


def defect_type(clean="clean_type") -> Column:
    """Burnt / faulty / others (null -> Others)."""
    c = col(clean)
    return (F.when(c.isin(*C.BURNT_TYPES), F.lit(C.DEFECT_BURNT))
             .when(c == F.lit(C.FAULTY_TYPE), F.lit(C.DEFECT_FAULTY))
             .otherwise(F.lit(C.DEFECT_OTHERS)))


def age_days(as_of, d) -> Column:
    """Whole days between d and the run date (as_of is a literal)."""
    return F.datediff(F.lit(as_of), col(d))


def micros_between(start, end) -> Column:
    """Microseconds from start to end (bigint)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def fractional_days(start, end) -> Column:
    """P10: (end - start) in fractional days as double."""
    return micros_between(start, end).cast("double") / F.lit(86400000000.0)


def null_str() -> Column:
    """Typed null string column."""
    return F.lit(None).cast("string")
