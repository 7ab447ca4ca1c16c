"""Compare registered queries with their SQL twins, as the driver does: columns by name, rows as a bag."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, int)):
        return f"{float(x):.6g}" if isinstance(x, float) and x != int(x) else str(int(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return str(x)


def connect(directory: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(spark, directory: str, name: str, query, sql: str | None, con=None) -> str:
    """Empty if the two agree."""
    df = query(spark, directory)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    if sql is None:
        return ""
    got = (con or connect(directory)).execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(cell(r[i]) for i in order) for r in got.fetchall())
    if ours != theirs:
        extra, missing = [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3]
        return f"{len(ours)} rows against {len(theirs)}; only here {extra}; only in SQL {missing}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e

    from marquee.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    directory = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(directory)
    chosen = sys.argv[1:]
    bad = []
    for name, query in e.queries().items():
        if chosen and not any(name == c or (c.endswith("*") and name.startswith(c[:-1])) for c in chosen):
            continue
        t = time.time()
        try:
            said = differences(spark, directory, name, query, e.oracle_sql().get(name), con)
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {said or 'ok'}{'' if name in e.oracle_sql() else ' (rows only)'} {time.time() - t:.1f} s", flush=True)
        bad += [name] if said else []
    print("BAD:", bad)
