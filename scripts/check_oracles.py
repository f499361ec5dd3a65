"""Local twin of the driver's correctness gate: run each registered Spark query
and its DuckDB oracle on the same sf directory; compare row count, column
names and an order-insensitive value hash.

usage: python scripts/check_oracles.py [sf_dir] [name-substring ...]
"""
import hashlib
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

import duckdb  # noqa: E402

from gridpulse.plans import registry  # noqa: E402
from gridpulse.session import get_spark  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


EXACT = bool(__import__("os").environ.get("CHECK_EXACT"))


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if EXACT else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(keyed).encode()).hexdigest(), keyed


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    registry.load_all()
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ok = bad = 0
    for name, (fn, oracle) in sorted(registry.REGISTRY.items()):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        df = fn(spark, sf)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        ts = time.time() - t0
        if oracle is None:
            print(f"{name:45s} rows={len(srows):7d} (no oracle) {ts:.1f}s")
            continue
        res = con.execute(oracle())
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        sh, sk = digest(scols, srows)
        oh, ok_ = digest(ocols, orows)
        same = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and sh == oh
        status = "OK " if same else "BAD"
        ok += same
        bad += not same
        print(f"{status} {name:45s} spark={len(srows):7d} duck={len(orows):7d} {ts:.1f}s")
        if not same:
            if sorted(scols) != sorted(ocols):
                print("   cols spark-only", sorted(set(scols) - set(ocols)), "duck-only", sorted(set(ocols) - set(scols)))
            else:
                a, b = set(sk), set(ok_)
                for x in list(a - b)[:3]:
                    print("   spark:", x[:400])
                for x in list(b - a)[:3]:
                    print("   duck: ", x[:400])
    print(f"ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
