"""Ageing from a stored histogram of days (A5, A15, R17, M3): the age classes of any run date and any bounds, without a scan of the facts.

``<name>-days-<k>``: keys, day and a signed number of rows. A load adds the rows that enter the cohort (sign 1) or takes away those that leave it
(sign -1), so a new day costs its own rows alone; loads are summed at read time and a load that is known does nothing. Ages are whole days (P9). The
open tickets of A18 are aged by the microsecond and stay on their rows.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import VersionedStore


class AgeHistogram:
    def __init__(self, store: VersionedStore, name: str, keys: list[str], day: str):
        if {"n", "age", "period_start"} & {*keys, day}:
            raise ValueError("columns n, age and period_start are the histogram's own")
        self.store, self.name, self.keys, self.day = store, name, keys, day

    def add(self, rows: DataFrame, load: str, sign: int = 1) -> AgeHistogram:
        """Rows without a day have no age and are left out."""
        return self.add_all(rows, {load: (F.lit(True), sign)})

    def add_all(self, rows: DataFrame, loads: dict[str, tuple[Column, int]]) -> AgeHistogram:
        """Several loads, each the rows that its condition holds for and a sign, from one aggregate over ``rows``, committed together."""
        if any(sign not in (1, -1) for _, sign in loads.values()):
            raise ValueError("sign must be 1 or -1")
        base = self.store.manifest()
        new = {load: x for load, x in loads.items() if f"{self.name}-days-{load}" not in base["tables"]}
        if new:
            cells = (rows.where(F.col(self.day).isNotNull()).groupBy(*self.keys, F.col(self.day).cast("date").alias(self.day))
                     .agg(*[F.count(F.when(cond, F.lit(1))).alias(f"_n{i}") for i, (cond, _) in enumerate(new.values())]))
            if len(new) > 1:
                work = self.store.full(self.store.new_folder(f"{self.name}-work"))  # named by no manifest: expire() removes it by age
                cells.write.parquet(work)
                cells = self.store.spark.read.schema(cells.schema).parquet(work)
            folders = {f"{self.name}-days-{load}": self.store.new_folder(self.name) for load in new}
            for i, (folder, (_, sign)) in enumerate(zip(folders.values(), new.values())):
                n = F.col(f"_n{i}")
                cells.where(n > 0).select(*self.keys, self.day, (n * sign).alias("n")).write.parquet(self.store.full(folder))
            self.store.commit(folders, base)
        return self

    def rows(self) -> DataFrame:
        tables = self.store.manifest()["tables"]
        found = [self.store.full(f) for t, f in tables.items() if t.startswith(f"{self.name}-days-")]
        if not found:
            raise ValueError(f"{self.name} has no load yet")
        return self.store.spark.read.parquet(*found)

    def at(self, as_of: dt.date | list[dt.date], classes: dict[str, tuple[int | None, int | None]], period: str | None = None,
           by: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """``by`` (all keys by default), period_start (where ``period`` is a unit of ``trunc``; the day itself for 'day') and the rows of each class at
        ``as_of``. A class (lo, hi) holds ages above lo up to hi; None leaves a side open. Groups that no row is left in don't appear.
        For a list of run dates, ``as_of`` comes first and all of them are counted in one aggregate."""
        dates = as_of if isinstance(as_of, list) else [as_of]
        rows = self.rows() if where is None else self.rows().where(where)
        by = list(self.keys if by is None else by)
        start = [] if period is None else [(F.col(self.day) if period == "day" else F.trunc(self.day, period)).alias("period_start")]

        def within(date, lo, hi):
            n, age = F.col("n"), F.datediff(F.lit(date), F.col(self.day))
            if lo is not None:
                n = F.when(age > lo, n)
            if hi is not None:
                n = F.when(age <= hi, n)
            return F.coalesce(F.sum(n), F.lit(0)).cast("long")
        counts = [within(d, *c).alias(f"_c{i}_{j}") for i, d in enumerate(dates) for j, c in enumerate(classes.values())]
        out = rows.groupBy(*by, *start).agg(F.sum("n").alias("n"), *counts).where("n > 0")
        each = [F.struct(F.lit(d).alias("_as_of"), *[F.col(f"_c{i}_{j}").alias(c) for j, c in enumerate(classes)]) for i, d in enumerate(dates)]
        out = out.select(*by, *(["period_start"] if start else []), F.inline(F.array(*each)))
        dated = [F.col("_as_of").alias("as_of")] if isinstance(as_of, list) else []
        return out.select(*dated, *[c for c in out.columns if c != "_as_of"])


def classes_of(bounds: list[int], names: list[str]) -> dict[str, tuple[int | None, int | None]]:
    """Classes between inclusive upper bounds, the last one open."""
    return dict(zip(names, zip([None, *bounds], [*bounds, None])))
