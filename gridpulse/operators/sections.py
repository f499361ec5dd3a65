"""Declarative grouped sections run on Spark and rendered as SQL.

A :class:`Section` is filter -> group -> aggregate -> project. Chained sections
express staged aggregates (average of daily ratios, R8/R9); :func:`merge`
combines sections that share a key (J6) without a join: union the partial rows
and take the per-key non-null value, which groups null keys together (null-safe).
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dual import E, q


@dataclass(frozen=True)
class Section:
    aggs: list
    group: list = field(default_factory=list)
    where: E | None = None
    post: list | None = None
    order: list = field(default_factory=list)


def run(df: DataFrame, s: Section) -> DataFrame:
    if s.where is not None:
        df = df.where(s.where.col)
    aggs = [n.e.col.alias(n.name) for n in s.aggs]
    if s.group:
        out = df.groupBy(*[n.e.col.alias(n.name) for n in s.group]).agg(*aggs) if aggs else \
            df.select(*[n.e.col.alias(n.name) for n in s.group]).distinct()
    else:
        out = df.agg(*aggs)
    if s.post is not None:
        out = out.select(*[n.e.col.alias(n.name) for n in s.post])
    if s.order:
        out = out.orderBy(*s.order)
    return out


def sql(src: str, s: Section) -> str:
    """Render as SQL over ``src`` (a table name or a parenthesised subquery)."""
    sel = [f"{n.e.sql} AS {q(n.name)}" for n in s.group] + [f"{n.e.sql} AS {q(n.name)}" for n in s.aggs]
    where = f" WHERE {s.where.sql}" if s.where is not None else ""
    grp = f" GROUP BY {', '.join(str(i + 1) for i in range(len(s.group)))}" if s.group else ""
    inner = f"SELECT {', '.join(sel)} FROM {src} _t{where}{grp}"
    if s.post is not None:
        inner = f"SELECT {', '.join(f'{n.e.sql} AS {q(n.name)}' for n in s.post)} FROM ({inner}) _p"
    return inner


def merge(keys: list[str], parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Combine frames keyed by ``keys`` (each key at most once per frame)."""
    u = None
    for df, cols in parts:
        x = df.select(*keys, *cols)
        u = x if u is None else u.unionByName(x, allowMissingColumns=True)
    others = [c for df, cols in parts for c in cols]
    if keys:
        return u.groupBy(*keys).agg(*[F.max(c).alias(c) for c in others])
    return u.agg(*[F.max(c).alias(c) for c in others])


def merge_sql(keys: list[str], parts: list[tuple[str, list[str]]], all_cols: list[str] | None = None) -> str:
    others = [c for _, cols in parts for c in cols]
    sels = []
    for src, cols in parts:
        items = [q(k) for k in keys] + [q(c) if c in cols else f"NULL AS {q(c)}" for c in others]
        sels.append(f"SELECT {', '.join(items)} FROM ({src}) _m")
    u = " UNION ALL ".join(sels)
    agg = ", ".join(f"MAX({q(c)}) AS {q(c)}" for c in others)
    k = ", ".join(q(x) for x in keys)
    if keys:
        return f"SELECT {k}, {agg} FROM ({u}) _u GROUP BY {k}"
    return f"SELECT {agg} FROM ({u}) _u"
