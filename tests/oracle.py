"""Holds a query's rows against its SQL in DuckDB."""

import decimal
import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder=DATA):
    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else p
        c.execute(f"create view {p.stem} as select * from '{files}'")
    return c


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool):
        return x
    return float(x) if isinstance(x, int) else x


def same(frame, sql, folder=DATA):
    cursor = connect(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    wanted = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in cursor.fetchall()), key=repr)
    found = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)
