"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

    python tests/compare.py [name ...]      (a name may end in * for a prefix)
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

SF_DIR = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir=SF_DIR):
    """(ok, message) for one query."""
    frame = query(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL"
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(frame.columns) != sorted(want_columns):
        return False, f"columns {sorted(frame.columns)} / {sorted(want_columns)}"
    a, b = rows_of(frame.columns, got), rows_of(want_columns, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ: {bad[0]}"
    return len(a) > 0, f"{len(a)} rows equal"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from metricloom.session import get_spark

    spark = get_spark(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, found, sqls = connect(), queries(), oracle_sql()
    wanted = sys.argv[1:] or list(found)
    names = [n for n in found if any(n == w or (w[-1] == "*" and n.startswith(w[:-1])) for w in wanted)]
    failed = []
    for name in names:
        start = time.time()
        try:
            ok, message = compare(spark, con, name, found[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.1f}s {message}", flush=True)
    print(len(names) - len(failed), "ok;", "failed:", failed)


if __name__ == "__main__":
    main()
