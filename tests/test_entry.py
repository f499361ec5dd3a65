"""Driver contract: entry / queries / oracle_sql."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "label" in df.columns


def test_queries_and_oracles_align():
    q, o = E.queries(), E.oracle_sql()
    # corpus queries, where they are there, have SQL only as far as it can express them
    corpus = {x for x in q if x.startswith("op") or x == "pipeline"}
    assert set(q) - corpus == set(o) - corpus and set(o) <= set(q) and len(set(q) - corpus) >= 140
    assert all(isinstance(v, str) and v.lstrip().upper().startswith("WITH") for v in o.values())


def test_api_paths_resolve(spark):
    from gridpulse.plans import api
    from gridpulse.plans.queries_dash import base_frames
    bases = base_frames(spark, "/root/testdata/sf0.001", ["a01", "a10", "a11", "a12"])
    out = api.dashboard("/api/mi/progress/dashboard", {"category": "consumer", "level": "zone"}, bases)
    assert set(out) == {"total", "trend", "comparison"} and out["total"].collect()[0].total_progress > 0
    cc = api.dashboard("/api/mi/command-center/asia", {}, bases)
    assert len(cc["cards"].collect()) == 8
