"""Run registered queries beside their SQL and compare the rows.

``python -m tests.oracle /root/testdata/sf0.01 [name …]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value
    return str(value)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    from docsluice.plans import ORACLES, QUERIES

    started = time.time()
    frame = QUERIES[name](spark, folder)
    mine = [tuple(r) for r in frame.collect()]
    took = time.time() - started
    note = f"{len(mine)} rows {took:.1f}s"
    if name not in ORACLES:
        return False, note + " (no SQL)"
    started = time.time()
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    note += f" sql {time.time() - started:.1f}s"
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(columns)}"
    a, b = _rows(frame.columns, mine), _rows(columns, theirs)
    if a == b:
        return True, note
    bad = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    near = f"\n   spark {a[bad] if bad < len(a) else None}\n   sql   {b[bad] if bad < len(b) else None}"
    return False, note + f" rows {len(a)} vs {len(b)}" + near[:1500]


def main() -> int:
    from docsluice.plans import QUERIES
    from docsluice.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    picked = [n for n in QUERIES if not names or any(n == m or (m.endswith("*") and n.startswith(m[:-1])) for m in names)]
    spark, con, failed = local_session(8, progress=False), connect(folder), 0
    for name in picked:
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(picked) - failed}/{len(picked)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main())
