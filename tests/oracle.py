"""Run registered queries next to their check SQL and compare the rows.

    python tests/oracle.py [name ...]      all queries when no name is given
"""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def check_engine(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return value
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def differences(df, con, sql, show=3) -> str:
    got_rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    want_rows = result.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    got, want = normal(df.columns, got_rows), normal(want_columns, want_rows)
    if got == want:
        return ""
    got_set, want_set = set(map(repr, got)), set(map(repr, want))
    return (
        f"rows {len(got)} != {len(want)}\n  columns {sorted(df.columns)}"
        + "".join(f"\n  spark only: {r}" for r in sorted(got_set - want_set)[:show])
        + "".join(f"\n  check only: {r}" for r in sorted(want_set - got_set)[:show])
    )


def main(names: list[str], folder: str = "/root/testdata/sf0.01") -> int:
    import __spark_entry__ as entry
    from wareloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = check_engine(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in checks:
                df.write.format("noop").mode("overwrite").save()
                n = f"spark {time.time() - start:.1f}s"
                problem = differences(df, con, checks[name])
            else:
                problem, n = "", f"no check sql, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name:28s} {time.time() - start:5.1f}s {n} {problem}", flush=True)
    print(f"{bad} of {len(names or queries)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
