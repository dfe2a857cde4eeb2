"""CLI: compare queries() against oracle_sql() at a scale factor (default sf0.01)."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402
from tabtaint.session import get_spark  # noqa: E402


def main():
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = get_spark()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                r = compare(df, con, sqls[name])
            else:
                r = {"rows": df.count(), "ok": None}
        except Exception as e:  # noqa: BLE001
            r = {"ok": False, "error": repr(e)[:2000]}
        r["sec"] = round(time.time() - t, 2)
        if r.get("ok") is False:
            bad += 1
        print(name, json.dumps(r, default=str)[:3000], flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
