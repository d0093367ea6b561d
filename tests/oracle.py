"""Compare every registered query with its SQL in DuckDB.

    python tests/oracle.py [directory] [name ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_plain(r[i]) for i in order) for r in data)


def compare(df, con, sql):
    """None when both agree, else a short description of the difference."""
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want_names, want = rows(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        have, expected = set(got), set(want)
        return (
            f"rows {len(got)} != {len(want)}; only Spark: {sorted(have - expected)[:3]}; "
            f"only SQL: {sorted(expected - have)[:3]}"
        )
    return None if got else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from spanmart.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                 "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("OFF")
    db = connect(folder)
    wanted = sys.argv[2:]
    sql_of = entry.oracle_sql()
    bad = 0
    for query, fn in entry.queries().items():
        if wanted and query not in wanted:
            continue
        began = time.time()
        try:
            problem = compare(fn(session, folder), db, sql_of[query])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {query} {time.time() - began:.2f}s {problem or ''}",
              flush=True)
    print(f"{bad} failed")
