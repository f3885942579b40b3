"""Run registered queries and their SQL on one data folder and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

from .oracle import oracle_sql
from .queries import QUERIES


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    return value


def rows(table) -> list[tuple]:
    table = table.select(sorted(table.column_names))
    data = [tuple(map(canonical, r)) for r in zip(*[c.to_pylist() for c in table.columns])]
    return sorted(data, key=lambda r: tuple((v is not None, str(v)) for v in r))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b))
    return type(a) is type(b) and a == b


def check(spark, folder: str, name: str, sql: str | None, queries=QUERIES) -> str:
    start = time.time()
    got = queries[name](spark, folder).toArrow()
    took = time.time() - start
    if sql is None:
        return f"rows-only {got.num_rows} rows {took:.1f}s"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"COLUMNS {sorted(got.column_names)} != {sorted(want.column_names)}"
    mine, theirs = rows(got), rows(want)
    if len(mine) != len(theirs):
        return f"ROWS {len(mine)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if not all(map(same, a, b))]
    if bad:
        return f"VALUES {len(bad)} of {len(mine)} differ, e.g. {sorted(got.column_names)}\n  {bad[0][0]}\n  {bad[0][1]}"
    exact = sum(a != b for a, b in zip(mine, theirs))
    types = [
        (n, str(got.schema.field(n).type), str(want.schema.field(n).type))
        for n in got.column_names if str(got.schema.field(n).type) != str(want.schema.field(n).type)
    ]
    note = (f" inexact={exact}" if exact else "") + (f" types={types}" if types else "")
    return f"ok {len(mine)} rows {took:.1f}s{note}"


def main(argv: list[str]) -> int:
    from wardflow.session import build_session

    folder, names = argv[0], argv[1:]
    spark = build_session(
        master="local[8]", **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-"),
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failed = oracle_sql(), 0
    for name in names or QUERIES:
        try:
            result = check(spark, folder, name, oracles.get(name))
        except Exception as exc:
            result = f"ERROR {type(exc).__name__} {str(exc)[:1500]}"
        failed += not result.startswith(("ok", "rows-only"))
        print(name, result, flush=True)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
