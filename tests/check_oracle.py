"""Run registered queries against their oracle SQL and print a JSON line per query.

usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parity import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from riskpanel.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):  # the driver's style of session, none of our defaults
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .getOrCreate())
    else:
        spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        if name not in sqls:
            try:
                n = qs[name](spark, sf_dir).count()
                print(json.dumps({"query": name, "rows_only": n, "sec": round(time.time() - t0, 2)}))
            except Exception as exc:
                bad += 1
                print(json.dumps({"query": name, "ok": False, "error": repr(exc)[:800]}))
            continue
        try:
            res = compare(spark, con, qs[name], sqls[name], sf_dir)
        except Exception as exc:  # report and continue
            res = {"ok": False, "error": repr(exc)[:800]}
        res["query"] = name
        res["sec"] = round(time.time() - t0, 2)
        bad += not res["ok"]
        print(json.dumps(res, default=str))
    print(json.dumps({"failed": bad}))


if __name__ == "__main__":
    main()
