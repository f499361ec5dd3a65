"""Row predicates (F-operators) as boolean Columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import blank, col, not_blank, sat_lower


def verified_installation(mi_date="mi_date", sat_no="sat_no") -> Column:
    """mi_date present and sat_no not blank ('SAT Pending' counts)."""
    return col(mi_date).isNotNull() & not_blank(sat_no)


def sat_achieved(sat_no="sat_no", stage: int | None = None) -> Column:
    """LOWER(TRIM(sat_no)) LIKE 'sat-%' (or 'sat-<k>%'). Null -> false."""
    prefix = "sat-" if stage is None else f"sat-{stage}"
    return F.coalesce(sat_lower(sat_no).startswith(prefix), F.lit(False))


def uninstalled_stock(installedts="installedts", didate="didate") -> Column:
    """installedts null and didate present."""
    return col(installedts).isNull() & col(didate).isNotNull()


def installed_without_sat(mi_date="mi_date", sat_no="sat_no") -> Column:
    """mi_date present and sat_no null, blank or 'sat pending' (and not 'sat-%')."""
    s = sat_lower(sat_no)
    first = col(sat_no).isNull() | (F.trim(col(sat_no)) == "") | (s == "sat pending")
    second = col(sat_no).isNull() | ~s.startswith("sat-")
    return col(mi_date).isNotNull() & first & second


def journey_cohort(collection="pmpm_collection_date", sat_date="sat_date") -> Column:
    """collected and sat_date <= MAX(sat_date); the max bound holds for every
    non-null sat_date, so the scalar subquery folds to IS NOT NULL."""
    return col(collection).isNotNull() & col(sat_date).isNotNull()


def any_revenue_date() -> Column:
    """any of the four revenue dates present."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in
                  ("lumpsum_invoice_date", "pmpm_invoice_date", "lumpsum_collection_date", "pmpm_collection_date")])


def sat_not_collected() -> Column:
    """SAT done, neither collection present."""
    return (F.col("sat_date").isNotNull() & F.col("lumpsum_collection_date").isNull()
            & F.col("pmpm_collection_date").isNull())


def replaced_meter(old="old_smart_meter_number", new="new_smart_meter_number") -> Column:
    """F8: old and new serial both non-blank."""
    return not_blank(old) & not_blank(new)


def open_ticket(closed="closed_date") -> Column:
    """F9."""
    return col(closed).isNull()


def closed_ticket(closed="closed_date") -> Column:
    return col(closed).isNotNull()


def missing_geo(cols=("discom", "zone", "circle", "division", "subdivision")) -> Column:
    """any geo column null or blank."""
    return reduce(lambda a, b: a | b, [blank(c) for c in cols])
