"""Period bucketing and labels (P12-P14, P22) and the roll-up over grains."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

GRAINS = ("daily", "weekly", "monthly")


def period_start(d, grain: str) -> Column:
    """Start date of the period holding d (ISO week starts Monday)."""
    d = F.to_date(col(d))
    if grain in ("daily", "as_on"):
        return d
    if grain == "weekly":
        return F.trunc(d, "week")
    if grain == "monthly":
        return F.trunc(d, "month")
    if grain == "quarterly":
        return F.trunc(d, "quarter")
    if grain == "yearly":
        return F.trunc(d, "year")
    raise ValueError(f"unknown grain {grain!r}")


def label_ddmmyy(d) -> Column:
    """DD-MM-YY text of a date."""
    return F.date_format(col(d), "dd-MM-yy")


def label_mon_yy(d) -> Column:
    """Mon-YY."""
    return F.date_format(col(d), "MMM-yy")


def label_quarter(d) -> Column:
    """YYYY-Qn."""
    return F.date_format(col(d), "yyyy-'Q'q")


#: The grain each grain is summed from. Weeks cross months, so both come from days.
PARENT = {"weekly": "daily", "monthly": "daily", "quarterly": "monthly", "yearly": "quarterly"}


def clustered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups shuffled by ``keys``, for sums by these and other columns without a shuffle of their own. The launcher's number of partitions
    is given outright, else AQE would merge them to few, and these sums hold their groups twice."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def roll_up(rows: DataFrame, keys: list[str], day: str, sums: dict[str, Column], grains=GRAINS, folder: str | None = None) -> DataFrame:
    """(keys, period_type, period_start, sums) of every grain, each summed from the next finer one.

    Only the finest grain aggregates ``rows``; its groups, not the rows, are shuffled again, once, by ``keys`` alone, so that every coarser grain is
    summed where they lie: a key has no more of them than the calendar has periods, however many rows it holds. ``sums`` must be additive
    (counts and sums; a mean is carried as its sum and count and divided by the caller afterwards). The grains share both exchanges:
    Spark computes them once for the whole union, and a filter on ``period_type`` leaves only that grain's branch. With ``folder`` each
    stage is a written table, from which a lost executor starts again. A null date is a period of its own.
    """
    finest = "daily" if {"daily", "weekly"} & set(grains) else next(g for g in ("monthly", "quarterly", "yearly") if g in grains)
    stages = {}

    def stage(grain: str) -> DataFrame:
        if grain not in stages:
            if grain == finest:
                out = rows.groupBy(*keys, period_start(day, grain).alias("period_start")).agg(*[c.alias(n) for n, c in sums.items()])
            else:
                out = (spread(PARENT[grain]).groupBy(*keys, period_start("period_start", grain).alias("period_start"))
                       .agg(*[F.sum(n).alias(n) for n in sums]))
            if folder:
                out.write.mode("overwrite").parquet(f"{folder}/{grain}")
                out = rows.sparkSession.read.schema(out.schema).parquet(f"{folder}/{grain}")
            stages[grain] = out
        return stages[grain]

    def spread(grain: str) -> DataFrame:
        """The finest grain's own branch reads the shared exchange too, so that its groups are made once and its partitions stay small."""
        return clustered(stage(grain), keys) if (grain == finest or folder) and set(grains) != {finest} else stage(grain)

    parts = [(spread(g) if g == finest and not folder else stage(g)).select(*keys, F.lit(g).alias("period_type"), "period_start", *sums) for g in grains]
    return reduce(DataFrame.union, parts)
