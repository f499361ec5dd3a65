"""Ageing histograms: any run date and bounds from signed daily counts."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridpulse.operators.ageing import AgeHistogram, classes_of
from gridpulse.sources.versions import VersionedStore

DAY0 = dt.date(2024, 1, 1)


def test_any_run_date_and_bounds(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), DAY0 + dt.timedelta(rng.randrange(200)), rng.random() < .4) for _ in range(600)] + [("a", None, False)]
    df = spark.createDataFrame(rows, "k string, d date, left boolean")
    store = VersionedStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        AgeHistogram(store, "x", ["k"], "d").rows()
    early = F.col("d") < F.lit(DAY0 + dt.timedelta(90))
    hist = AgeHistogram(store, "h", ["k"], "d").add(df.where(early), "1").add(df.where(~early), "2").add(df.where("left"), "3", -1)
    version = store.manifest()["version"]
    assert hist.add(df, "2") and store.manifest()["version"] == version  # a known load
    for as_of in (DAY0, DAY0 + dt.timedelta(100), DAY0 + dt.timedelta(400)):
        for bounds in ([30, 60, 90, 120], [0, 7]):
            names = [f"c{i}" for i in range(len(bounds) + 1)]
            want = {}
            for k, d, left in rows:
                if d is not None and not left:
                    age = (as_of - d).days
                    at = next((i for i, b in enumerate(bounds) if age <= b), len(bounds))
                    want.setdefault((k, d.replace(day=1)), [0] * len(names))[at] += 1
            got = {(r.k, r.period_start): [r[n] for n in names] for r in hist.at(as_of, classes_of(bounds, names), "month").collect()}
            assert got == want
    # cumulative classes (M3), a coarser key, a filter
    got = hist.at(DAY0 + dt.timedelta(150), {"all": (None, None), "over_30": (30, None)}, by=[], where=F.col("k") == "a").first()
    alive = [(DAY0 + dt.timedelta(150) - d).days for k, d, left in rows if k == "a" and d and not left]
    assert (got["all"], got.over_30) == (len(alive), sum(a > 30 for a in alive))
    assert "period_start" in hist.at(DAY0, {"n_all": (None, None)}, "day").columns


def test_emptied_groups_go(spark, tmp_path):
    df = spark.createDataFrame([("a", DAY0)], "k string, d date")
    hist = AgeHistogram(VersionedStore(spark, str(tmp_path / "s")), "h", ["k"], "d").add(df, "1").add(df, "2", -1)
    assert hist.at(DAY0, {"all": (None, None)}).count() == 0
