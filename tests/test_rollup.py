"""Roll-up by stages against the plain counts of each grain."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse.functions.periods import period_start, roll_up
from plan_tools import named, shuffled_rows

GRAINS = ("daily", "weekly", "monthly", "quarterly", "yearly")


def facts(spark, n=200_000, tasks=128, keys=4000, days=10):
    day = F.date_add(F.lit(dt.date(2024, 2, 26)), (F.xxhash64("id") % days).cast("int"))
    return spark.range(0, n, 1, tasks).select((F.pmod(F.xxhash64(F.col("id") + 7), F.lit(keys))).alias("k"), day.alias("d"), (F.col("id") % 5).alias("v"))


def exploded(rows, grains):
    """The form in which every row meets every grain before the exchange."""
    tags = F.array(*[F.struct(F.lit(g).alias("t"), period_start("d", g).alias("s")) for g in grains])
    return (rows.withColumn("g", F.explode(tags)).groupBy("k", F.col("g.t").alias("period_type"), F.col("g.s").alias("period_start"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")))


def sums():
    return {"n": F.count(F.lit(1)), "v": F.sum("v")}


@pytest.mark.parametrize("grains", [("daily", "weekly", "monthly"), ("monthly", "quarterly"), ("weekly",), ("quarterly",), ("yearly", "daily"), GRAINS])
def test_stages_equal_plain_counts(spark, grains):
    rows = facts(spark, 5000, 3, keys=20, days=500).withColumn("d", F.when(F.col("v") > 0, F.col("d")))  # null days, too
    order = ["k", "period_type", "period_start", "n", "v"]
    got = sorted(map(tuple, roll_up(rows, ["k"], "d", sums(), grains).select(order).collect()), key=repr)
    assert got == sorted(map(tuple, exploded(rows, grains).select(order).collect()), key=repr)


def test_written_stages(spark, tmp_path):
    rows = facts(spark, 5000, 3, keys=20, days=500)
    got = roll_up(rows, ["k"], "d", sums(), GRAINS, folder=str(tmp_path / "stages"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, roll_up(rows, ["k"], "d", sums(), GRAINS).collect()))
    assert not named(got, "RangeExec")  # starts from the written stages


def test_facts_that_aggregate_shuffle_less_than_half(spark):
    rows, grains = facts(spark), ("daily", "weekly", "monthly")
    staged, plain = roll_up(rows, ["k"], "d", sums(), grains), exploded(rows, grains)
    assert staged.count() and staged.collect() and plain.collect()
    assert len(named(staged, "RangeExec")) == 1  # the finest grain is computed once
    assert shuffled_rows(staged) < shuffled_rows(plain) / 2


def test_a_filter_on_the_grain_leaves_its_branch(spark):
    one = roll_up(facts(spark, 5000, 3), ["k"], "d", sums(), ("daily", "weekly", "monthly")).where("period_type = 'monthly'")
    one.collect()
    assert len(named(one, "ShuffleExchangeExec")) == 2  # days, months
