"""Plan plumbing for dashboards: a dashboard section reads one or more summary
tables ("bases") and is both a Spark plan and an SQL twin."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from .. import config as C
from ..functions.filters import Filters, normalise_level
from ..operators import dual as D
from ..operators import sections as S


@dataclass(frozen=True)
class Plan:
    bases: tuple
    spark: Callable[[dict], DataFrame]
    sql: Callable[[dict], str]


def single(base: str, sec: S.Section) -> Plan:
    return Plan((base,), lambda d: S.run(d[base], sec), lambda n: S.sql(n[base], sec))


def chain(base: str, *secs: S.Section) -> Plan:
    """Sections applied one after another (staged aggregation)."""
    def sp(d):
        df = d[base]
        for s in secs:
            df = S.run(df, s)
        return df

    def sq(n):
        src = n[base]
        for s in secs:
            src = f"({S.sql(src, s)})"
        return src[1:-1]
    return Plan((base,), sp, sq)


def merged(keys: list[str], parts: list[tuple[Plan, list[str]]], order: list[str] | None = None,
           post: list | None = None) -> Plan:
    bases = tuple(dict.fromkeys(b for p, _ in parts for b in p.bases))

    def sp(d):
        out = S.merge(keys, [(p.spark(d), cols) for p, cols in parts])
        if post is not None:
            out = out.select(*[n.e.col.alias(n.name) for n in post])
        return out.orderBy(*order) if order else out

    def sq(n):
        body = S.merge_sql(keys, [(p.sql(n), cols) for p, cols in parts])
        if post is not None:
            body = f"SELECT {', '.join(f'{x.e.sql} AS {D.q(x.name)}' for x in post)} FROM ({body}) _pp"
        return body
    return Plan(bases, sp, sq)


# ---- shared scope / label rules ---------------------------------------------

def dim_filters(f: Filters, allowed) -> list:
    """case-insensitive match per given dimension (ILIKE, no wildcards added)."""
    return [D.ilike(D.c(k), v) for k, v in f.dims if v and k in allowed]


def project_scope_mi(f: Filters, cfg: C.Config) -> D.E:
    """'all' -> configured list; else equality on the normalised project."""
    p = D.upper_trim(D.c("project"))
    return D.isin(p, list(cfg.projects)) if f.project_l == "all" else D.eq(p, D.lit(f.project.upper()))


def project_scope_om(f: Filters) -> D.E | None:
    """'all' -> no restriction; else ILIKE on the raw project."""
    return None if f.project_l == "all" else D.ilike(D.c("project"), f.project)


def category_scope(f: Filters, restrict_three: bool, dt_rows: tuple = ()) -> D.E | None:
    """F13. ``dt_rows``: the stored categories that the inputs dt and dtr stand
    for; without them dt is DT and dtr is no category (§2.14 #16)."""
    mc = f.mapped_category
    cat = D.upper_trim(D.c("meter_category"))
    if f.category_l in ("dt", "dtr") and dt_rows:
        return D.isin(cat, list(dt_rows))
    if f.category_l == "dtr":
        raise ValueError(f"invalid category {f.category!r}")
    if mc:
        return D.eq(cat, D.lit(mc))
    return D.isin(cat, C.CATEGORY_KEYS) if restrict_three else None


def date_range(f: Filters, col: str = "period_start") -> list:
    """Inclusive range on a date column."""
    out = []
    if f.start_date:
        out.append(D.ge(D.c(col), D.date_lit(f.start_date)))
    if f.end_date:
        out.append(D.le(D.c(col), D.date_lit(f.end_date)))
    return out


def mi_label(f: Filters, allowed, project_level: bool = False, unknown_is_discom: bool = False) -> D.E:
    """P20 (MI): all + discom -> PROJECT; all + lower level -> 'PROJECT | level';
    one project -> level; null level -> 'Unknown'. With ``unknown_is_discom`` a
    level that isn't known compares discoms also over all projects (KPI 1)."""
    level = normalise_level(f.level, allowed)
    if unknown_is_discom and f.level and not normalise_level(f.level, allowed, default=""):
        return D.coalesce(D.c("discom"), D.lit("Unknown"))
    proj = D.upper_trim(D.c("project"))
    if f.project_l == "all" and (level == "discom" or (project_level and level == "project")):
        return proj
    lc = proj if (project_level and level == "project") else D.c(level)
    if f.project_l == "all" and level != "discom":
        return D.concat3(proj, " | ", D.coalesce(lc, D.lit("Unknown")))
    return D.coalesce(lc, D.lit("Unknown"))
