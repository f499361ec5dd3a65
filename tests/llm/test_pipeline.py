"""The corpus pipeline: stages' contracts and the registered queries."""
import re

import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_planted_cases(spark, docs_of, folder):
    import corpus_pipeline as P
    from gridpulse.llm.common import written
    prose = ("The committee met on Monday to talk about the new library, and most of its members liked the plan that the town had drawn up.\n"
             "Afterwards they walked along the river, where children fed the ducks and an old man sold roasted chestnuts from a small cart.\n"
             "When the evening came the lamps were lit, the shops put up their shutters, and the last tram rang its bell on the way to the depot by the hill.\n")
    clean = [(i, prose + f"Chapter {i} tells how the {w} came to the harbour, who saw it first, what the mayor said about it, and why nobody ever forgot that long and windy day."
              f" It was the year of the {w}, and the {w} was all that people spoke of in the market, in the school and at the mill.") for i, w in enumerate("whale ship storm circus train comet".split())]
    rows = [*clean, (50, clean[0][1]), (51, "too short"), (52, None), (53, ""), (None, clean[1][1])]
    docs = docs_of(rows)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = written(out, folder, name)
        if name == "quality_rules":
            assert {r["doc_id"] for r in docs.collect()} == {*range(6), 50, None}
        if name == "line_deduplication":
            assert sum("ducks" in r["text"] for r in docs.collect()) == 1 and {r["doc_id"] for r in docs.collect()} >= set(range(6)) - {0, 1}
    last = P.STAGES[-1][1](spark, docs, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(last.columns) and last.count() >= docs.count()
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_deduplication", "simhash_near_dedup", "mixing", "packing"]


def test_stages_take_empty_tables(spark, docs_of, folder):
    import corpus_pipeline as P
    for name, stage in P.STAGES:
        assert stage(spark, docs_of([]), SF).count() == 0, name


def test_queries_are_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op5_topk", "op10_warc"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as E
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = E.queries()[name](spark, SF)
    found = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[columns.index(c)] for c in df.columns) for r in found.fetchall()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
