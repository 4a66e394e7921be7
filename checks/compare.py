"""Run registered queries next to their SQL in DuckDB: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession

from checks.catalogue import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    return value


def rows_of(arrow: pa.Table) -> list[tuple]:
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    return sorted((tuple(_cell(v) for v in row) for row in zip(*columns, strict=True)), key=repr)


def difference(got: pa.Table, expected: pa.Table) -> str | None:
    """None if both tables agree, otherwise the first difference in words."""
    a = {f.name: str(f.type).replace("large_", "") for f in got.schema}
    b = {f.name: str(f.type).replace("large_", "") for f in expected.schema}
    if set(a) != set(b):
        return f"columns {sorted(a)} vs {sorted(b)}"
    types = {n: (a[n], b[n]) for n in a if a[n] != b[n] and "timestamp" not in a[n]}
    if types:
        return f"types {types}"
    x, y = rows_of(got), rows_of(expected)
    if len(x) != len(y):
        return f"rows {len(x)} vs {len(y)}"
    for left, right in zip(x, y, strict=True):
        if left != right:
            return f"{left} vs {right}"
    return None


def check(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf: str, name: str) -> tuple[str | None, int]:
    got = QUERIES[name](spark, sf).toArrow()
    if name not in ORACLES:
        return None, got.num_rows
    return difference(got, con.sql(ORACLES[name]).to_arrow_table()), got.num_rows


def main(argv: list[str]) -> int:
    from starloom.session import local_session

    sf, names = argv[0], argv[1:] or list(QUERIES)
    spark, con = local_session(), oracle_connection(sf)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem, n = check(spark, con, sf, name)
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        failed += problem is not None
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'FAIL' if problem else 'ok'} {name}{kind} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
