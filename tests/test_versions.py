"""Versioned refresh (S9, S10) and bucketed loads."""
import datetime as dt
import glob
import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from gridpulse.sources.incremental import BucketedStage, latest_by_key
from gridpulse.sources.sinks import refresh, write_aligned
from gridpulse.sources.versions import CommitConflict, VersionedStore
from plan_tools import named


def run_frames(spark, run):
    return {name: spark.range(200).select("id", F.lit(run).alias("run"), F.lit("daily").alias("period_type")) for name in ("a", "b", "c")}


def test_readers_see_one_run_whole(spark, tmp_path):
    store, failed, seen = VersionedStore(spark, str(tmp_path / "s")), [], set()
    assert store.manifest()["version"] == 0 and store.frames() == {}
    refresh(store, run_frames(spark, 0))
    done = threading.Event()

    def read():
        try:
            while not done.is_set():
                runs = {r.run for df in VersionedStore(spark, str(tmp_path / "s")).frames().values() for r in df.select("run").distinct().collect()}
                assert len(runs) == 1, runs
                seen.update(runs)
        except BaseException as e:  # noqa: BLE001
            failed.append(e)
    reader = threading.Thread(target=read)
    reader.start()
    for run in range(1, 6):
        refresh(store, run_frames(spark, run))
        store.expire(older_than=3600)
    done.set()
    reader.join()
    assert not failed and len(seen) > 1
    assert store.versions() == [1, 2, 3, 4, 5, 6] and store.frame("b").first().run == 5


def test_failed_run_and_late_writer_change_nothing(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    refresh(store, run_frames(spark, 1))
    broken = run_frames(spark, 2)
    broken["c"] = broken["c"].withColumn("id", F.expr("if(id = 7, raise_error('stop'), id)"))
    with pytest.raises(Exception, match="stop"):
        refresh(store, broken)
    assert {df.first().run for df in store.frames().values()} == {1}
    base = store.manifest()
    refresh(store, {"a": run_frames(spark, 3)["a"]})  # the others stay
    assert {n: df.first().run for n, df in store.frames().items()} == {"a": 3, "b": 1, "c": 1}
    with pytest.raises(CommitConflict):
        store.commit({}, base)
    assert store.manifest()["version"] == 2 and len(glob.glob(str(tmp_path / "s" / "_versions" / "v*"))) == 2


def test_old_versions_go_by_age(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    for run in (1, 2, 3):
        refresh(store, run_frames(spark, run))
    assert store.expire(older_than=3600) == []
    store.expire(older_than=-1)
    assert store.versions() == [3] and len(list((tmp_path / "s" / "data").iterdir())) == 3
    assert {df.first().run for df in store.frames().values()} == {3}


def test_write_aligned(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    target = spark.createDataFrame([], "a long, b string, c double").schema
    write_aligned(spark.createDataFrame([("1", 2, 3)], "A string, x int, y int"), target, store, "t", rename={"x": "B"})
    back = store.frame("t")
    assert [tuple(r) for r in back.collect()] == [(1, "2", None)] and back.columns == ["a", "b", "c"]


def load(spark, rows):
    return spark.createDataFrame([(k, v, dt.datetime(2024, 1, d)) for k, v, d in rows], "k string, v string, load_ts timestamp_ntz")


def digests(folder):
    return {f: hashlib.sha1(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_loads_rewrite_touched_buckets_only(spark, tmp_path):
    stage = BucketedStage(spark, str(tmp_path / "s"), "k", buckets=8)
    assert stage.frame() is None
    assert stage.load(load(spark, [(f"k{i}", "first", 1) for i in range(200)] + [(None, "no key", 1)]), "day-1")
    before, old = digests(tmp_path / "s"), stage.store.manifest()["tables"]
    assert stage.load(load(spark, [("k3", "second", 2), ("k3", "older", 1), ("new", "second", 2)]), "day-2")
    tables = stage.store.manifest()["tables"]
    changed = {b for b in tables if tables[b] != old.get(b)}
    assert 1 <= len(changed) <= 2
    after = digests(tmp_path / "s")
    assert all(after[f] == d for f, d in before.items())
    got = {r.k: (r.v, r.load_ts.day) for r in stage.frame().collect()}
    assert got["k3"] == ("second", 2) and got["new"] == ("second", 2) and got["k4"] == ("first", 1) and got[None] == ("no key", 1) and len(got) == 202
    assert not stage.load(load(spark, [("k3", "again", 3)]), "day-2")  # known: no effect
    assert digests(tmp_path / "s") == after and stage.store.manifest()["version"] == 2
    late = BucketedStage(spark, str(tmp_path / "s"), "k", buckets=99)
    assert late.buckets == 8 and late.load(load(spark, [("k3", "late", 1)]), "day-3")
    assert {r.k: r.v for r in late.frame().collect()}["k3"] == "second"
    assert late.load(load(spark, []), "day-4") and late.frame().count() == 202


def test_latest_by_key_sorts_no_rows(spark):
    rows = spark.range(20_000).select((F.col("id") % 700).cast("string").alias("k"), F.xxhash64("id").cast("string").alias("v"),
                                      F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(50))).alias("load_ts"))
    rows = rows.union(rows.limit(50))  # repeated rows
    got = latest_by_key(rows, "k")
    data = got.collect()
    assert not named(got, "SortAggregateExec")
    newest = {}
    for r in rows.collect():
        newest.setdefault(r.k, []).append((r.load_ts, r.v))
    assert len(data) == len(newest)
    for r in data:
        assert (r.load_ts, r.v) in newest[r.k] and r.load_ts == max(t for t, _ in newest[r.k])
    assert sorted(map(tuple, data)) == sorted(map(tuple, latest_by_key(rows.repartition(7), "k").collect()))
