"""Compare registered queries with their SQL: check_all.py [sf] [name-part ...]."""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")
import traceback

import __spark_entry__ as entry
from conftest import make_session
from oracle import compare, connect

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
parts = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = make_session()
con = connect(sf_dir)
sqls = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    start = time.time()
    try:
        if name in sqls:
            problems = compare(con, name, fn(spark, sf_dir), sqls[name])
            note = "ok"
        else:
            problems, note = [], f"rows {fn(spark, sf_dir).count()}"
    except Exception as e:
        problems, note = [f"{name}: {type(e).__name__} {str(e)[:1500]}"], ""
        if "-v" in sys.argv:
            traceback.print_exc()
    bad += bool(problems)
    print(f"{time.time() - start:6.2f}s {name}: {'; '.join(problems) if problems else note}", flush=True)
print("failed:", bad)
