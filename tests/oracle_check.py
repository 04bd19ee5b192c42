"""Run registered queries against their SQL statements in DuckDB.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return "\x00" if v is None else str(v)


def compare(names_a, rows_a, names_b, rows_b):
    if sorted(names_a) != sorted(names_b):
        return f"columns {sorted(names_a)} != {sorted(names_b)}"
    order = sorted(names_a)
    ia, ib = [names_a.index(c) for c in order], [names_b.index(c) for c in order]
    a = sorted(tuple(norm(r[i]) for i in ia) for r in rows_a)
    b = sorted(tuple(norm(r[i]) for i in ib) for r in rows_b)
    if len(a) != len(b):
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return f"rows spark {len(a)} != sql {len(b)}; spark only {only_a}; sql only {only_b}; {order}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        sa, sb = set(a), set(b)
        return (f"{len(sa - sb)} of {len(a)} rows differ, columns {order}: "
                f"spark {sorted(sa - sb)[:2]} sql {sorted(sb - sa)[:2]}")
    return ""


def main(argv):
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    con, failed = duck(sf), []
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name in oracles:
                t = time.time()
                cur = con.execute(oracles[name])
                cols = [d[0] for d in cur.description]
                problem = compare(df.columns, rows, cols, cur.fetchall())
                note = f"sql {time.time() - t:.1f}s"
            else:
                problem, note = "", "no sql"
        except Exception as e:  # noqa: BLE001
            took, problem, note, rows = time.time() - t, f"{type(e).__name__}: {str(e)[:600]}", "", []
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {len(rows):7d} rows {took:6.1f}s {note} {problem}",
              flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
