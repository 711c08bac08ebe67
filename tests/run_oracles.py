"""Run every registered query against its DuckDB oracle: python tests/run_oracles.py [sf_dir] [names...]"""
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from oracle_check import compare, duck  # noqa: E402

from detecteval.plans.catalog import CATALOG  # noqa: E402
from detecteval.session import get_spark  # noqa: E402


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CATALOG)
    spark = get_spark()
    con = duck(d)
    bad = 0
    for n in names:
        fn, sql = CATALOG[n]
        t = time.time()
        try:
            df = fn(spark, d)
            if sql is None:
                print(f"{n:28s} ROWS-ONLY {df.count()} rows {time.time()-t:.1f}s", flush=True)
                continue
            ok, exact, msg = compare(df, con, sql)
            print(f"{n:28s} {'OK' if ok else 'FAIL'} {'exact' if exact else 'tol'} {msg} {time.time()-t:.1f}s",
                  flush=True)
            bad += not ok
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{n:28s} ERROR {type(e).__name__}: {str(e)[:800]}", flush=True)
            traceback.print_exc(limit=3)
    print("failures:", bad)


if __name__ == "__main__":
    main()
