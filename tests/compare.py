"""Side-by-side check of the registered queries against their SQL.

Usage: ``python tests/compare.py [sf] [query ...]``
"""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def normal(rows, columns) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def difference(spark, con, query, sql, folder: str) -> str | None:
    """None if both give the same rows, else what is different."""
    df = query(spark, folder)
    left = normal(df.collect(), df.columns)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    right = normal(result.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if left == right:
        return None
    extra = [r for r in left if r not in set(right)][:2]
    missing = [r for r in right if r not in set(left)][:2]
    return f"rows {len(left)} and {len(right)}; only in Spark {str(extra)[:600]}; only in SQL {str(missing)[:600]}"


def digest(rows: list[str]) -> str:
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def main() -> None:
    from tests.conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    folder = str(DATA / f"sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}")
    names = sys.argv[2:] or list(queries())
    spark, con, expected = make_session(), duck(folder), oracle_sql()
    failed = 0
    for name in names:
        begin = time.monotonic()
        try:
            if name in expected:
                wrong = difference(spark, con, queries()[name], expected[name], folder)
            else:
                wrong = None if queries()[name](spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            wrong = f"{type(error).__name__}: {str(error)[:700]}"
        failed += wrong is not None
        print(f"{name:32s} {time.monotonic() - begin:6.2f}s {'ok' if wrong is None else 'DIFFERENT ' + wrong}", flush=True)
    print(f"{len(names) - failed} of {len(names)} the same")


if __name__ == "__main__":
    main()
