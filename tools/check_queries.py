"""Run registered queries next to their SQL and compare the results.

    python tools/check_queries.py [--dir FOLDER] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from foldlight.plans.catalog import ORACLE, QUERIES  # noqa: E402
from foldlight.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return value
    if hasattr(value, "as_tuple"):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [str(v) for v in r])


def compare(spark, con, name: str, folder: str) -> str:
    df = QUERIES[name](spark, folder)
    columns, rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return f"rows only: {len(rows)}"
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want_columns, want = _sorted(names, res.fetchall())
    if columns != want_columns:
        return f"FAIL columns {columns} != {want_columns}"
    if len(rows) != len(want):
        return f"FAIL rows {len(rows)} != {len(want)}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [
        (f.name, f.dataType.simpleString(), kinds[f.name])
        for f in df.schema
        if same.get(f.dataType.simpleString()) != kinds[f.name]
    ]
    for got, expected in zip(rows, want, strict=True):
        if got != expected:
            return f"FAIL {columns}\n   spark {got}\n   sql   {expected}"
    return f"ok {len(rows)}" + (f"  TYPES {odd}" if odd else "")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("parts", nargs="*")
    args = parser.parse_args()
    spark = local_session(8, "check")
    con = connect(args.dir)
    bad = []
    for name in QUERIES:
        if args.parts and not any(p in name for p in args.parts):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, args.dir)
        except Exception as error:  # noqa: BLE001
            verdict = "FAIL " + (str(error)[:1500] or traceback.format_exc()[-800:])
        if verdict.startswith("FAIL"):
            bad.append(name)
        print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
    print("failed:", bad or "none")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
