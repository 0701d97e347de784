"""Check queries against their twins: run_oracle.py <sf_dir> [name ...]"""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
from compare import connect, differences  # noqa: E402

from grantmill.session import build_session  # noqa: E402
from workload import ORACLE, QUERIES  # noqa: E402

sf = sys.argv[1]
names = sys.argv[2:] or list(QUERIES)
spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
bad = 0
for n in names:
    t0 = time.time()
    try:
        df = QUERIES[n](spark, sf)
        if n in ORACLE:
            p = differences(df, con, ORACLE[n])
        else:
            p = [] if df.count() >= 0 else ["?"]
    except Exception as e:  # noqa: BLE001
        p = [f"{type(e).__name__}: {str(e)[:700]}"]
    took = time.time() - t0
    bad += bool(p)
    if p or took > 8:
        print(("FAIL" if p else "slow"), n, f"{took:.1f}s", *[x[:600] for x in p], flush=True)
print(len(names), "queries,", bad, "failing")
