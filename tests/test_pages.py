"""Pages of stored lists against the plain offset form."""
import pytest
from pyspark.sql import functions as F

from gridpulse.operators.pages import PagedList
from gridpulse.sources.versions import VersionedStore
from plan_tools import named

ROWS = 5000


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    n = F.col("id")
    df = spark.range(ROWS).select(F.when(n % 50 != 0, F.concat(F.lit("t"), (n * 7919 % 900).cast("string"))).alias("ticket"),
                                  F.when(n % 11 != 0, n % 13).alias("age"), (n % 3).cast("double").alias("x"))
    store = VersionedStore(spark, str(tmp_path_factory.mktemp("pages")))
    return df, PagedList.write(df, ["ticket", "age"], store, "tickets", rows_per_file=400)


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("offset, limit", [(0, 100), (395, 10), (2345, 1), (1000, 1500), (ROWS - 100, 100), (ROWS - 5, 100), (ROWS + 5, 10)])
def test_pages_equal_the_offset_form(listed, offset, limit):
    df, pages = listed
    assert pages.rows == ROWS
    assert tuples(pages.page(offset, limit)) == tuples(df.orderBy(*pages.order).offset(offset).limit(limit))


def test_last_page_reads_one_file(listed):
    df, pages = listed
    assert len(pages.files) >= 10
    last = pages.page(ROWS - 100, 100)
    assert tuples(last) == tuples(df.orderBy(*pages.order).offset(ROWS - 100).limit(100))
    scan, = named(last, "FileSourceScanExec")
    assert scan.metrics().get("numFiles").get().value() == 1 and scan.metrics().get("numOutputRows").get().value() < 1000


def test_pages_after_a_row_walk_the_list(listed):
    df, pages = listed
    every, got, page = tuples(df.orderBy(*pages.order)), [], pages.page(0, 700).collect()
    while page:
        got += [tuple(r) for r in page]
        following = pages.after(page[-1].asDict(), 700)
        page = following.collect()
    # equal rows at a border can't be told apart: those behind the key start after all of them
    assert sorted(set(got), key=repr) == sorted(set(every), key=repr) and got == sorted(got, key=lambda r: [(v is not None, v) for v in r])
    key = {"ticket": None, "age": 5, "x": 1.0}
    want = [r for r in every if tuple((v is not None, v) for v in r) > ((False, None), (True, 5), (True, 1.0))][:20]
    assert tuples(pages.after(key, 20)) == want


def test_empty_list(spark, tmp_path):
    pages = PagedList.write(spark.createDataFrame([], "a long, b string"), ["a"], VersionedStore(spark, str(tmp_path / "s")), "none")
    assert pages.page(0, 10).count() == 0 and pages.page(5, 10).count() == 0
