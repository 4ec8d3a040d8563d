"""Compares queries with their SQL: python tests/parity.py SF_DIR [NAME...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, f, sql, sf):
    df = f(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return ""
    extra = [x for x in got[1] if x not in want[1]][:3] if len(got[1]) < 5000 else ""
    lacking = [x for x in want[1] if x not in got[1]][:3] if len(got[1]) < 5000 else ""
    return f"{got[0]} {want[0]} rows {len(got[1])} {len(want[1])}; extra {extra}; lacking {lacking}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from corvane.session import local_session

    spark, con, sf = local_session(8), connect(sys.argv[1]), sys.argv[1]
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, name, queries[name], sqls[name], sf)
            else:
                said = f"{queries[name](spark, sf).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:500]}"
        print(f"{name} {time.time() - t:.1f} s {said or 'equal'}", flush=True)
