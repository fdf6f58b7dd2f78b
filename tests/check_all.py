"""Compare all registered queries with their SQL: ``python -m tests.check_all [sf_dir] [name ...]``."""

import sys
import time

import registered
from tests.harness import compare, oracle
from tidelake.session import local_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    registered.load()
    names = sys.argv[2:] or list(registered.QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = oracle(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = registered.QUERIES[name](spark, sf)
            if name in registered.ORACLES:
                said = compare(df, registered.ORACLES[name], con)
            else:
                said = None if df.count() else "no rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:900]}"
        bad += said is not None
        print(f"{'ok ' if said is None else 'BAD'} {time.time() - start:6.2f}s {name} {said or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
