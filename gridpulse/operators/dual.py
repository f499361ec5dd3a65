"""Paired expressions: each value is a Spark Column plus its SQL text (DuckDB
dialect). Dashboard sections are declared once with these pairs; the Spark side
runs on the cluster, the SQL side is the oracle twin used by the tests.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


class E:
    """A paired expression: a Spark Column (built lazily, so plans can be
    declared before a SparkContext exists) and its SQL text."""
    __slots__ = ("_mk", "sql")

    def __init__(self, mk, sql: str):
        self._mk = mk if callable(mk) else (lambda v=mk: v)
        self.sql = sql

    @property
    def col(self) -> Column:
        return self._mk()

    def alias(self, name: str) -> "Named":
        return Named(name, self)


@dataclass(frozen=True)
class Named:
    name: str
    e: E


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def c(name: str) -> E:
    return E(lambda: F.col(name), q(name))


def lit(v) -> E:
    if isinstance(v, str):
        return E(lambda: F.lit(v), "'" + v.replace("'", "''") + "'")
    if v is None:
        return E(lambda: F.lit(None), "NULL")
    return E(lambda: F.lit(v), repr(v))


def upper_trim(x: E) -> E:
    return E(lambda: F.upper(F.trim(x.col)), f"UPPER(TRIM({x.sql}))")


def coalesce(*xs: E) -> E:
    return E(lambda: F.coalesce(*[x.col for x in xs]), f"COALESCE({', '.join(x.sql for x in xs)})")


def eq(a: E, b: E) -> E:
    return E(lambda: a.col == b.col, f"({a.sql} = {b.sql})")


def isin(a: E, values) -> E:
    return E(lambda: a.col.isin(*values), f"({a.sql} IN ({', '.join(lit(v).sql for v in values)}))")


def ilike(a: E, pattern: str) -> E:
    return E(lambda: a.col.ilike(pattern), f"({a.sql} ILIKE {lit(pattern).sql})")


def and_(*xs: E) -> E:
    xs = [x for x in xs if x is not None]
    if not xs:
        return E(lambda: F.lit(True), "TRUE")
    out = xs[0]
    for x in xs[1:]:
        out = E(lambda a=out, b=x: a.col & b.col, f"({out.sql} AND {x.sql})")
    return out


def ge(a: E, b: E) -> E:
    return E(lambda: a.col >= b.col, f"({a.sql} >= {b.sql})")


def le(a: E, b: E) -> E:
    return E(lambda: a.col <= b.col, f"({a.sql} <= {b.sql})")


def date_lit(s: str) -> E:
    return E(lambda: F.to_date(F.lit(s)), f"DATE '{s}'")


def concat3(a: E, sep: str, b: E) -> E:
    """Postgres CONCAT (nulls skipped)."""
    return E(lambda: F.concat(F.coalesce(a.col, F.lit("")), F.lit(sep), F.coalesce(b.col, F.lit(""))),
             f"(COALESCE({a.sql}, '') || {lit(sep).sql} || COALESCE({b.sql}, ''))")


def date_fmt(x: E, spark_fmt: str, sql_fmt: str) -> E:
    return E(lambda: F.date_format(x.col, spark_fmt), f"strftime({x.sql}, '{sql_fmt}')")


def trunc(x: E, unit: str) -> E:
    return E(lambda: F.trunc(x.col, unit), f"CAST(date_trunc('{unit}', {x.sql}) AS DATE)")


def case_when(pairs, otherwise: E | None = None) -> E:
    pairs = list(pairs)

    def mk():
        col = None
        for cond, val in pairs:
            col = F.when(cond.col, val.col) if col is None else col.when(cond.col, val.col)
        return col.otherwise(otherwise.col) if otherwise is not None else col
    sql = "CASE" + "".join(f" WHEN {cond.sql} THEN {val.sql}" for cond, val in pairs)
    if otherwise is not None:
        sql += f" ELSE {otherwise.sql}"
    return E(mk, sql + " END")


# ---- aggregates -------------------------------------------------------------

def sum0(x: E) -> E:
    """SUM, null -> 0, as bigint."""
    return E(lambda: F.coalesce(F.sum(x.col), F.lit(0)).cast("long"), f"CAST(COALESCE(SUM({x.sql}), 0) AS BIGINT)")


def sum_if0(cond: E, x: E) -> E:
    """SUM(CASE WHEN cond THEN x ELSE 0 END)."""
    return E(lambda: F.coalesce(F.sum(F.when(cond.col, x.col).otherwise(F.lit(0))), F.lit(0)).cast("long"),
             f"CAST(COALESCE(SUM(CASE WHEN {cond.sql} THEN {x.sql} ELSE 0 END), 0) AS BIGINT)")


def count_star() -> E:
    return E(lambda: F.count(F.lit(1)), "CAST(COUNT(*) AS BIGINT)")


def count_col(x: E) -> E:
    return E(lambda: F.count(x.col), f"CAST(COUNT({x.sql}) AS BIGINT)")


def count_if(cond: E) -> E:
    return E(lambda: F.count_if(cond.col), f"CAST(COUNT(*) FILTER (WHERE {cond.sql}) AS BIGINT)")


def count_distinct(x: E) -> E:
    return E(lambda: F.count_distinct(x.col), f"CAST(COUNT(DISTINCT {x.sql}) AS BIGINT)")


def avg(x: E) -> E:
    return E(lambda: F.avg(x.col), f"AVG({x.sql})")


def min_(x: E) -> E:
    return E(lambda: F.min(x.col), f"MIN({x.sql})")


def max_(x: E) -> E:
    return E(lambda: F.max(x.col), f"MAX({x.sql})")


# ---- post-aggregation arithmetic -------------------------------------------

def r2_col(x):
    """Python's ``round(x, 2)``: on the exact binary value, ties to even.

    100 * |x| may round in a double, so the side of k + 0.5 is decided on a
    float and the rest: their products by 100 are exact, and so is the sign of
    ``side``."""
    a = F.abs(x)
    k = F.floor(a * F.lit(100.0))
    high = a.cast("float").cast("double")
    side = (high * F.lit(100.0) - (k.cast("double") + F.lit(0.5))) + (a - high) * F.lit(100.0)
    up = (side > 0) | ((side == 0) & (k % 2 == 1))
    r = (k + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("double") / F.lit(100.0)
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * r + F.lit(0.0)


def r2_sql(x: str) -> str:
    """The same by another way: the printed decimal, which is rounded from the exact value."""
    return f"(CAST(printf('%.2f', CAST({x} AS DOUBLE)) AS DOUBLE) + CAST(0 AS DOUBLE))"


def pct2(num: E, den: E) -> E:
    """round(num/den*100, 2) if den > 0 else 0."""
    return E(lambda: F.when(den.col > 0, r2_col(num.col.cast("double") / den.col.cast("double") * 100)).otherwise(F.lit(0.0)),
             f"CASE WHEN {den.sql} > 0 THEN {r2_sql(f'CAST({num.sql} AS DOUBLE) / CAST({den.sql} AS DOUBLE) * 100')} "
             f"ELSE CAST(0 AS DOUBLE) END")


def clamp0(a: E, b: E) -> E:
    """max(0, a - b)."""
    return E(lambda: F.greatest(F.lit(0).cast("long"), (a.col - b.col).cast("long")),
             f"CAST(greatest(0, {a.sql} - {b.sql}) AS BIGINT)")


def round2(x: E) -> E:
    return E(lambda: F.coalesce(r2_col(x.col.cast("double")), F.lit(0.0)),
             f"COALESCE({r2_sql(f'CAST({x.sql} AS DOUBLE)')}, CAST(0 AS DOUBLE))")


def ceil_days(x: E) -> E:
    """Whole-day ceiling, null-safe. Six decimals are kept first, so that
    the order in which doubles are summed can't add a day."""
    return E(lambda: F.ceil(F.round(x.col, 6)).cast("int"), f"CAST(ceil(round({x.sql}, 6)) AS INTEGER)")


def mul(a: E, b: E) -> E:
    return E(lambda: a.col * b.col, f"({a.sql} * {b.sql})")


def not_null(x: E) -> E:
    return E(lambda: x.col.isNotNull(), f"({x.sql} IS NOT NULL)")


def sum_where(cond: E, x: E) -> E:
    """Sum of x over the rows that meet cond, as a double; null if none does."""
    return E(lambda: F.sum(F.when(cond.col, x.col)).cast("double"), f"CAST(SUM({x.sql}) FILTER (WHERE {cond.sql}) AS DOUBLE)")


def ratio(num: E, den: E) -> E:
    """num/den as double, null when den is 0 (R11 nullif)."""
    return E(lambda: F.when(den.col != 0, num.col.cast("double") / den.col.cast("double")),
             f"CASE WHEN {den.sql} <> 0 THEN CAST({num.sql} AS DOUBLE) / CAST({den.sql} AS DOUBLE) END")


def add(*xs: E) -> E:
    def mk():
        col = xs[0].col
        for x in xs[1:]:
            col = col + x.col
        return col
    return E(mk, "(" + " + ".join(x.sql for x in xs) + ")")


# ---- category buckets (R5) ---------------------------------------------------

def consumer_sub(mt: E) -> E:
    """P17 exact map."""
    pairs = [(eq(mt, lit(k)), lit(v)) for k, v in C.CONSUMER_SUBCATEGORY_MAP.items()]
    return case_when(pairs)


def consumer_sub_substring(mt: E) -> E:
    """Substring rule in order."""
    m = coalesce(mt, lit(""))
    pairs = [(E(lambda n=n: m.col.contains(n), f"(strpos({m.sql}, '{n}') > 0)"), lit(b)) for n, b in C.CONSUMER_SUBSTRING_RULES]
    return case_when(pairs)


def bucket(category: str, cat: E | None = None, mt: E | None = None, substring: bool = False) -> tuple[E | None, list]:
    """Bucket key per row and the ordered bucket names for a category scope.
    total -> CONSUMER/FEEDER/DT; consumer -> 4 sub-buckets; feeder/dt -> flat."""
    cat = cat or c("meter_category")
    mt = mt or c("new_meter_type")
    up = E(lambda: F.upper(cat.col), f"UPPER({cat.sql})")
    if category == "total":
        return case_when([(isin(up, C.CATEGORY_KEYS), up)]), list(C.CATEGORY_KEYS)
    if category == "consumer":
        sub = consumer_sub_substring(mt) if substring else consumer_sub(mt)
        return case_when([(eq(up, lit("CONSUMER")), sub)]), list(C.CONSUMER_SUB_KEYS)
    return None, []


def bucket_aggs(measures: dict, category: str, total_mode: str = "mapped", **kw) -> list[Named]:
    """Per measure: one conditional sum per bucket plus ``__total``
    (mapped rows only, or all rows); a flat sum for feeder/dt."""
    b, keys = bucket(category, **kw)
    out = []
    for name, x in measures.items():
        if b is None:
            out.append(sum0(x).alias(name))
            continue
        notnull = E(lambda: b.col.isNotNull(), f"({b.sql} IS NOT NULL)")
        for k in keys:
            out.append(sum_if0(eq(b, lit(k)), x).alias(f"{name}__{k}"))
        out.append((sum_if0(notnull, x) if total_mode == "mapped" else sum0(x)).alias(f"{name}__total"))
    return out


def bucket_names(measure: str, category: str) -> list[str]:
    _, keys = bucket(category)
    if not keys:
        return [measure]
    return [f"{measure}__{k}" for k in keys] + [f"{measure}__total"]
