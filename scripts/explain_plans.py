"""Print the formatted physical plans of the summary builders over the staged
fact Parquet (what a cluster run executes): scans with their ReadSchema and
PushedFilters, exchanges and aggregates. usage: python scripts/explain_plans.py [sf_dir] [builder ...]"""
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from gridpulse.plans import pipeline  # noqa: E402
from gridpulse.session import get_spark  # noqa: E402
from gridpulse.sources.fixtures import bind_complaints, bind_meters  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = get_spark()
    m, c = pipeline.stage_facts(spark, bind_meters(spark, sf), bind_complaints(spark, sf))
    for name, df in pipeline.build_all(m, c).items():
        if only and not any(o in name for o in only):
            continue
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln for ln in plan.splitlines()]
        n_ex = sum("Exchange" in ln for ln in lines)
        n_scan = sum("FileScan" in ln or "Scan parquet" in ln for ln in lines)
        print(f"===== {name}: exchanges={n_ex} scans={n_scan}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
