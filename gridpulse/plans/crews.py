"""Q2, Q3, Q18 and Q19's distinct people, active days and mean daily ratios from stored crews (``operators.crews``): every section and every length of
period from one scan of one table. The person rankings (R16) need each person's own measure and stay on the summaries."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions.filters import Filters
from ..operators import dual as D
from ..operators import rollups as R
from ..operators.crews import CrewTable, two_decimals
from ..session import ensure_checkpoint_dir
from ..sources.versions import VersionedStore
from . import dashboards_mi as QM
from . import dashboards_om as QO
from .base import Plan


def _periods(day: str) -> dict:
    d = D.c(day)

    def start(unit):
        return D.date_fmt(D.trunc(d, unit), "yyyy-MM-dd", "%Y-%m-%d")
    return {"total": D.lit("total"), "day": D.date_fmt(d, "yyyy-MM-dd", "%Y-%m-%d"), "week": start("week"), "month": start("month"),
            "quarter": start("quarter"), "year": start("year")}


def crew_sections(base: str, keys: list[str], sections: dict, where, *, day: str, measure: str, split: str, conditions: dict | None = None) -> Plan:
    """All ``sections`` (name -> key expression) of the crews of ``base``, which are stored in two loads: days before ``split``, and the rest."""
    conditions = conditions or {}

    def sp(d):
        df = d[base]
        spark = df.sparkSession
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crews-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{root}/{base}")  # as the refresh leaves the summary
        rows = spark.read.parquet(f"{root}/{base}")
        early = F.coalesce(F.col(day) < F.lit(split).cast("date"), F.lit(False))
        table = CrewTable.create(VersionedStore(spark, root), base, keys, day=day, who="technician", measure=measure)
        table = table.add(rows.where(early), "early").add(rows.where(~early), "late")
        out = table.sections({n: e.col for n, e in sections.items()}, where.col, {n: e.col for n, e in conditions.items()})
        return two_decimals(out, "mean_people", "mean_ratio")

    def sq(n):
        parts = []
        for name, e in sections.items():
            w = D.and_(where, conditions[name]) if name in conditions else where
            one = R.productivity(base, [e.alias("key")], w, day=day, who="technician", measure=measure, out_total="total", people_col="people", extra=True)
            parts.append(f"SELECT '{name}' AS section, CAST(key AS VARCHAR) AS key, total, people, active_days, avg_active_technicians AS mean_people, "
                         f"productivity_per_technician_per_day AS mean_ratio FROM ({one.sql(n)}) s")
        return " UNION ALL ".join(parts)
    return Plan((base,), sp, sq)


def installers(f: Filters = Filters(), cfg: C.Config = C.DEFAULT) -> Plan:
    """Q2 and Q3: installations by total, period, label and category."""
    category = D.coalesce(D.c("meter_category"), D.lit("Unknown"))
    sections = _periods("installation_date") | {"comparison": QM.mi_label(f, QM.PROD_LEVELS, True), "category": category}
    return crew_sections("a02", C.MIDIM, sections, QM._prod_where(f, cfg), day="installation_date", measure="total_installations", split="1995-06-01")


def repair_teams(f: Filters = Filters()) -> Plan:
    """Q18 and Q19: closed tickets by total, period, label and category."""
    label, has_level = QO.om_label(f, table_cols=QO.A17_COLS)
    category, has_category = QO._cat_key()
    keys = ["project", "discom", "zone", "circle", "division", "subdivision", "meter_category"]
    return crew_sections("a17", keys, _periods("closed_day") | {"comparison": label, "category": category.e}, QO._where(f, "closed_day"),
                         day="closed_day", measure="closed_tickets", split="2023-12-01",
                         conditions={"comparison": has_level, "category": has_category})


def register_all() -> None:
    from .queries_dash import reg_plan
    f = Filters()
    reg_plan("r10_installers_from_crews", installers(f))
    reg_plan("r10_installers_from_crews_dated", installers(f.with_(category="consumer", level="zone", start_date="1995-01-01", end_date="1996-06-30")))
    reg_plan("r10_repair_teams_from_crews", repair_teams(f))
    reg_plan("r10_repair_teams_from_crews_asia", repair_teams(f.with_(project="asia", level="zone", category="dt")))
