"""Compare every registered query with its SQL on the test tables.

    python tests/check.py [scale factor] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as driver  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """What is wrong with a query, or ``None``."""
    got = driver.queries()[name](spark, sf_dir)
    wanted = con.sql(driver.oracle_sql()[name])
    columns = sorted(got.columns)
    theirs = {column: str(kind) for column, kind in zip(wanted.columns, wanted.types)}
    if columns != sorted(theirs):
        return f"columns {columns} and {sorted(theirs)}"
    kinds = {c: KINDS.get(k, k) for c, k in got.dtypes}
    if kinds != theirs:
        return f"types {kinds} and {theirs}"
    expected = wanted.to_arrow_table().select(columns).sort_by([(c, "ascending") for c in columns])
    found = got.toArrow().select(columns).sort_by([(c, "ascending") for c in columns])
    if found.num_rows != expected.num_rows:
        return f"{found.num_rows} rows, not {expected.num_rows}"
    if found.num_rows == 0:
        return "no rows"
    for c in columns:
        a, b = found.column(c).combine_chunks(), expected.column(c).combine_chunks()
        if not a.equals(b.cast(a.type)):
            at = next(n for n, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())) if x != y)
            return f"row {at}: {found.slice(at, 1).to_pylist()} not {expected.slice(at, 1).to_pylist()}"
    return None


def main() -> int:
    from conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(driver.oracle_sql())
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    failed = 0
    for name in names:
        start = time.perf_counter()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:32} {time.perf_counter() - start:6.1f} s  {problem or 'ok'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed > 0


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    raise SystemExit(main())
