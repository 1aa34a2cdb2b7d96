"""Run registered queries against their DuckDB oracle (like the driver does).

usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from crisislens.session import get_spark  # noqa: E402


def main(argv: list[str]) -> int:
    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf)
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sqls:
                r = compare(df, con, sqls[name])
                ok = r["cols_match"] and r["values_match"]
            else:
                r = {"rows": df.count(), "oracle": "none"}
                ok = True
        except Exception as ex:  # report and go on
            r, ok = {"error": repr(ex)[:800]}, False
        bad += not ok
        print(("OK  " if ok else "BAD ") + f"{name:28s} {time.time() - t:6.1f}s",
              json.dumps({k: v for k, v in r.items() if k not in ("spark_cols", "duck_cols") or not ok},
                         default=str)[:1500], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
