"""Stored crews against plain distinct counts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse.operators.crews import CrewTable
from gridpulse.sources.versions import VersionedStore
from plan_tools import named

KEYS = ["place", "kind"]


def facts(spark, n=3000, people=300, salt=0):
    """A third of the rows belong to one person; every column has nulls."""
    h = F.xxhash64("id", F.lit(salt))
    some = lambda c, m: F.when(F.pmod(F.shiftright(h, m), F.lit(37)) != 0, c)
    who = F.when(F.col("id") % 3 == 0, F.lit("p0")).otherwise(F.concat(F.lit("p"), F.pmod(h, F.lit(people)).cast("string")))
    return spark.range(0, n, 1, 3).select(
        some(F.concat(F.lit("z"), F.pmod(F.shiftright(h, 5), F.lit(4)).cast("string")), 11).alias("place"),
        some((F.pmod(F.shiftright(h, 9), F.lit(2))).cast("string"), 13).alias("kind"),
        some(F.date_add(F.lit(dt.date(2024, 1, 25)), F.pmod(F.shiftright(h, 15), F.lit(50)).cast("int")), 17).alias("day"),
        some(who, 19).alias("who"), (F.col("id") % 7).alias("n"))


def table(spark, folder, *loads, name="crews"):
    out = CrewTable.create(VersionedStore(spark, str(folder)), name, KEYS, day="day", who="who", measure="n")
    for i, rows in enumerate(loads):
        out = out.add(rows, f"load {i}")
    return out


def plain(rows, keys):
    """One key expression's figures by COUNT(DISTINCT)."""
    days = rows.groupBy(*keys, "day").agg(F.sum("n").alias("m"), F.countDistinct("who").alias("p"))
    means = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("active_days"), F.avg("p").alias("mean_people"),
                                    F.avg(F.when(F.col("p") != 0, F.col("m") / F.col("p"))).alias("mean_ratio"))
    sets = rows.groupBy(*keys).agg(F.sum("n").alias("total"), F.countDistinct("who").alias("people"))
    if not keys:
        return sets.crossJoin(means)  # one row each
    on = [sets[k.replace("`", "")].eqNullSafe(means[k]) for k in keys]
    return sets.join(means, on).select(*[sets[k] for k in keys], "total", "people", "active_days", "mean_people", "mean_ratio")


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keys", [[], ["place"], ["place", "kind"]])
def test_equals_distinct_counts_over_two_loads(spark, tmp_path, keys):
    first, second = facts(spark), facts(spark, 2000, 500, salt=1)  # the second brings new people and late rows of old days
    got = table(spark, tmp_path, first, second).productivity({k: F.col(k) for k in keys})
    assert rounded(got) == rounded(plain(first.unionByName(second), keys))


@pytest.mark.parametrize("unit", ["week", "month", "quarter"])
def test_any_period_from_one_table(spark, tmp_path, unit):
    rows = facts(spark)
    start = F.trunc("day", unit)
    assert rounded(table(spark, tmp_path, rows).productivity({"start": start})) == rounded(plain(rows.withColumn("start", start), ["start"]))


def test_sections_are_the_single_ones(spark, tmp_path):
    crews = table(spark, tmp_path, facts(spark))
    keys = {"place": F.col("place"), "month": F.trunc("day", "month")}
    got = crews.sections(keys, F.col("kind") == "1", {"place": F.col("place").isNotNull()})
    for name, key in keys.items():
        alone = crews.productivity({"key": key}, (F.col("kind") == "1") & (F.col("place").isNotNull() if name == "place" else F.lit(True)))
        assert rounded(got.where(F.col("section") == name).drop("section")) == rounded(alone.withColumn("key", F.col("key").cast("string")))


def test_a_known_load_does_nothing_and_numbers_stay(spark, tmp_path):
    rows = facts(spark)
    crews = table(spark, tmp_path, rows)
    version = crews.store.manifest()["version"]
    again = crews.add(rows, "load 0")
    assert again.store.manifest()["version"] == version and again.rows().count() == crews.rows().count()
    before = dict(map(tuple, crews.names().collect()))
    after = dict(map(tuple, crews.add(facts(spark, 2000, 500, salt=1), "load 1").names().collect()))
    assert len(set(after.values())) == len(after) > len(before)
    assert all(after[who] == number for who, number in before.items())


def test_empty_and_nameless_loads(spark, tmp_path):
    rows = facts(spark, 100)
    crews = table(spark, tmp_path, rows.limit(0))
    assert [tuple(r) for r in crews.productivity({}).collect()] == [(0, 0, 0, None, None)]
    assert not crews.productivity({"place": F.col("place")}).collect()
    nameless = rows.withColumn("who", F.lit(None).cast("string"))
    crews = crews.add(nameless, "nameless")
    assert rounded(crews.productivity({})) == rounded(plain(nameless, []))
    assert rounded(crews.add(rows, "named").productivity({})) == rounded(plain(rows.unionByName(nameless), []))


def test_a_day_with_an_own_name_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        CrewTable.create(VersionedStore(spark, str(tmp_path)), "c", ["word"], day="day", who="who", measure="n")


def test_one_scan_and_hash_aggregates(spark, tmp_path):
    got = table(spark, tmp_path, facts(spark)).sections({"place": F.col("place"), "month": F.trunc("day", "month"), "all": F.lit("all")})
    got.collect()
    assert len(named(got, "FileSourceScanExec")) == 1
    assert not named(got, "SortAggregateExec")


def test_one_row_of_the_table_holds_up_to_64_people(spark, tmp_path):
    rows = spark.range(0, 10_000, 1, 4).select(F.lit("z").alias("place"), F.lit("k").alias("kind"), F.lit(dt.date(2024, 1, 1)).alias("day"),
                                               F.concat(F.lit("p"), "id").alias("who"), F.lit(1).alias("n"))
    crews = table(spark, tmp_path, rows)
    assert crews.rows().count() <= 10_000 // 64 + 1
    assert [tuple(r) for r in crews.productivity({}).collect()] == [(10_000, 10_000, 1, 10_000.0, 1.0)]
