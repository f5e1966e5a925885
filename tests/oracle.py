"""Run registered queries against their SQL twins: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(frame: pd.DataFrame, whole: frozenset[str] = frozenset()) -> list[tuple]:
    """Rows as comparable text, columns by name, order ignored.

    Pandas makes doubles of whole-number columns with nulls; those in ``whole`` are made whole again.
    """
    frame = frame[sorted(frame.columns)].copy()
    for name in whole.intersection(frame.columns):
        frame[name] = frame[name].astype("Int64").astype(object)

    def shown(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value) or value is pd.NaT:
            return "NULL"
        if isinstance(value, float):
            return f"{value + 0.0:.6f}"
        return str(value)

    return sorted(tuple(shown(v) for v in row) for row in frame.itertuples(index=False))


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    started = time.time()
    ours = entry.queries()[name](spark, folder)
    got = ours.toPandas()
    spent = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} ({spent:.1f}s)"
    want = con.execute(sql).df()
    types = {f.name: f.dataType.simpleString() for f in ours.schema}
    theirs = dict(zip(want.columns, (str(t) for t in con.execute(sql).description and [d[1] for d in con.description])))
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    whole = frozenset(c for c, kind in types.items() if kind == "bigint" and got[c].dtype != object)
    a, b = rows_of(got, whole), rows_of(want, whole)
    note = f"{len(a)} / {len(b)} rows ({spent:.1f}s, sql {time.time() - started - spent:.1f}s)"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{note} first differences {diff} types {types} {theirs}"
    wide = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    odd = {c: (types[c], t) for c, t in theirs.items() if wide.get(t, types[c]) != types[c]}
    return not odd, f"{note}{' types ' + str(odd) if odd else ''}"


def main() -> None:
    from pagequarry.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session("8"), connect(folder), []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
