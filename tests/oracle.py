"""Run registered queries beside their SQL on the same tables and compare rows, columns and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, type(v).__name__, v if v is not None else 0) for v in row)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(r) for r in df.select(*cols).collect()), key=_key)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=_key)


def difference(got, want) -> str | None:
    """None when equal, else a short description."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = set(got[1]) ^ set(want[1])
        return f"rows {len(got[1])} != {len(want[1])}; e.g. {list(extra)[:3]}"
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from conftest import make_spark

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = make_spark()
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, sf_dir))
            took = time.time() - start
            if name in sqls:
                start = time.time()
                want = sql_rows(con, sqls[name])
                diff = difference(got, want)
                status = "ok" if diff is None else "DIFF " + diff
                status += f" (sql {time.time() - start:.1f}s)"
            else:
                diff, status = None, "rows only"
        except Exception as error:  # report and go on with the next query
            took, diff, got = time.time() - start, "error", ([], [])
            status = "ERROR " + str(error)[:1500]
        failed += diff is not None
        print(f"{name:32s} {len(got[1]):7d} rows {took:6.1f}s  {status}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
