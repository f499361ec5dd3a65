"""Roll-up operators shared by dashboards (R8-R10, R16): staged aggregates over
a (keys, day, person) grain.

Distinct counts are done as two plain group-bys ((keys, person) then keys),
never as several COUNT(DISTINCT) in one aggregate, so no Expand blow-up and
hot keys are pre-combined map-side.
"""
from __future__ import annotations

from ..plans.base import Plan, chain, merged
from . import dual as D
from .sections import Section


def _n(name):
    return D.c(name).alias(name)


def daily_grain(keys: list, where, day: str, who: str, measure: str) -> list[Section]:
    """Stages to (keys, day): day_total = Σ measure, day_who = #distinct who,
    daily_prod = day_total / day_who."""
    kn = [k.name for k in keys]
    s1 = Section(where=where, group=keys + [_n(day), _n(who)], aggs=[D.sum0(D.c(measure)).alias("_m")])
    s2 = Section(group=[_n(k) for k in kn] + [_n(day)],
                 aggs=[D.sum0(D.c("_m")).alias("day_total"), D.count_star().alias("day_who")],
                 post=[_n(k) for k in kn] + [_n(day), _n("day_total"), _n("day_who"),
                       D.ratio(D.c("day_total"), D.c("day_who")).alias("daily_prod")])
    return [s1, s2]


def distinct_people(base: str, keys: list, where, who: str, out: str) -> Plan:
    """Number of distinct people per key (two group-bys)."""
    kn = [k.name for k in keys]
    s1 = Section(where=where, group=keys + [_n(who)], aggs=[])
    s2 = Section(group=[_n(k) for k in kn], aggs=[D.count_star().alias(out)])
    return chain(base, s1, s2)


def avg_of_daily(base: str, keys: list, where, day: str, who: str, measure: str, out_total: str,
                 extra: bool = False) -> Plan:
    """Per key Σ measure, active days, mean daily ratio (and mean daily people)."""
    kn = [k.name for k in keys]
    aggs = [D.sum0(D.c("day_total")).alias(out_total), D.count_star().alias("active_days"),
            D.avg(D.c("daily_prod")).alias("_prod")]
    if extra:
        aggs.append(D.avg(D.c("day_who")).alias("_who"))
    s3 = Section(group=[_n(k) for k in kn], aggs=aggs)
    return chain(base, *daily_grain(keys, where, day, who, measure), s3)


def productivity(base: str, keys: list, where, *, day: str, who: str, measure: str, out_total: str,
                 people_col: str | None = "active_technicians", extra: bool = False,
                 order: list | None = None) -> Plan:
    """Σ measure, distinct people, active days, round(mean of daily ratios, 2)."""
    kn = [k.name for k in keys]
    a = avg_of_daily(base, keys, where, day, who, measure, out_total, extra)
    cols = [out_total, "active_days", "_prod"] + (["_who"] if extra else [])
    parts = [(a, cols)]
    if people_col:
        parts.append((distinct_people(base, keys, where, who, people_col), [people_col]))
    post = [_n(k) for k in kn] + [_n(out_total)]
    if people_col:
        post.append(_n(people_col))
    post.append(_n("active_days"))
    if extra:
        post.append(D.round2(D.c("_who")).alias("avg_active_technicians"))
    post.append(D.round2(D.c("_prod")).alias("productivity_per_technician_per_day"))
    return merged(kn, parts, order=order, post=post)


def performers(base: str, where, *, day: str, who: str, measure: str) -> Plan:
    """Top and lowest person by mean daily count. Ties: order is
    (mean desc, name asc); top = first, lowest = last. Done with
    one aggregate over (-mean, name), not a global sort; unnamed rows take no part."""
    per_day = Section(where=where, group=[_n(who), _n(day)], aggs=[D.sum0(D.c(measure)).alias("_d")])
    per_who = Section(group=[_n(who)], aggs=[D.avg(D.c("_d")).alias("_avg")])
    scored = chain(base, per_day, per_who)

    def sp(d):
        from pyspark.sql import functions as F
        best, worst = F.min(F.struct((-F.col("_avg")).alias("v"), who)), F.max(F.struct((-F.col("_avg")).alias("v"), who))
        ends = scored.spark(d).where(F.col(who).isNotNull()).agg(best.alias("best"), worst.alias("worst"))
        both = F.array(F.struct(F.lit("top").alias("position"), F.col("best").alias("e")),
                       F.struct(F.lit("lowest").alias("position"), F.col("worst").alias("e")))
        return (ends.select(F.explode(both).alias("x")).where(F.col("x.e").isNotNull())
                .select("x.position", F.col(f"x.e.{who}").alias("name"),
                        D.r2_col(-F.col("x.e.v")).alias("productivity_per_technician_per_day")))

    def sq(n):
        src = scored.sql(n)
        w = D.q(who)
        return f"""SELECT position, name, {D.r2_sql('v')} AS productivity_per_technician_per_day FROM (
  SELECT 'top' AS position, MIN({w}) AS name, MAX(_avg) AS v FROM ({src}) s
   WHERE _avg = (SELECT MAX(_avg) FROM ({src}) s2)
  UNION ALL
  SELECT 'lowest', MAX({w}), MIN(_avg) FROM ({src}) s
   WHERE _avg = (SELECT MIN(_avg) FROM ({src}) s2)) x WHERE name IS NOT NULL"""
    return Plan(scored.bases, sp, sq)
