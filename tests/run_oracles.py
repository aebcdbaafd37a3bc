"""python tests/run_oracles.py [NAME...]: every query against its SQL on sf0.01, with times."""

import sys
import time

sys.path.insert(0, ".")
import __spark_entry__ as e
from glossmill.context import session
from tests.oracle import same

if __name__ == "__main__":
    spark = session(8)
    sf = "/root/testdata/sf0.01"
    sql, wrong = e.oracle_sql(), 0
    for name, query in e.queries().items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        t = time.time()
        try:
            ok, why = same(spark, query, sql[name], sf) if name in sql else (True, f"rows {query(spark, sf).count()}, no SQL")
        except Exception as x:
            ok, why = False, repr(x)[:600]
        wrong += not ok
        print("ok  " if ok else "BAD ", name, f"{time.time() - t:.1f}s", why, flush=True)
    print("wrong:", wrong)
