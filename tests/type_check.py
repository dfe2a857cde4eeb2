"""Compare column types of every query with its DuckDB oracle (sf0.01)."""
import os, sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from oracle_harness import duck
from tabtaint.session import get_spark

MAP = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
       "TIMESTAMP": "timestamp_ntz", "TINYINT": "tinyint", "FLOAT": "float", "DATE": "date", "SMALLINT": "smallint"}
spark = get_spark()
con = duck("/root/testdata/sf0.01")
qs, sqls = E.queries(), E.oracle_sql()
names = sys.argv[1:] or sorted(sqls)
for n in names:
    df = qs[n](spark, "/root/testdata/sf0.01")
    st = dict(df.dtypes)
    rel = con.sql(sqls[n])
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    bad = [(c, st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt)) if MAP.get(dt.get(c), dt.get(c)) != st.get(c)]
    if bad:
        print(n, bad, flush=True)
print("done")
