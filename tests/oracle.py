"""Compare registered queries with their SQL run by DuckDB on the same files."""
from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from plumbline import catalog


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        v = float(v)
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def sort_key(row):
    return tuple((x is None, str(type(x)), round(x, 3) if isinstance(x, float) else str(x)) for x in row)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def kind(t: str) -> str:
    t = t.lower()
    for word, names in (
        ("int", ("tinyint", "smallint", "bigint", "integer", "int", "long")),
        ("float", ("double", "float")),
        ("bool", ("bool",)),
        ("text", ("varchar", "string")),
    ):
        if t.startswith(names) and "[" not in t:
            return word
    return "list" if t.startswith("array") or t.endswith("[]") else t


def type_gaps(df, con, sql: str) -> list[str]:
    """Columns whose type family differs between the two engines."""
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    have = dict(df.dtypes)
    return [f"{c}: {have[c]} / {want[c]}" for c in sorted(want) if c in have and kind(have[c]) != kind(want[c])]


def compare(spark, con, root: str, name: str) -> str | None:
    """None when equal, otherwise the first difference found."""
    df = catalog.QUERIES[name](spark, root)
    if name in catalog.SQL:
        gaps = type_gaps(df, con, catalog.SQL[name])
        if gaps:
            print("    types", name, gaps)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=sort_key)
    if name not in catalog.SQL:
        return None
    rel = con.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=sort_key)
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}; first {got[:2]} vs {want[:2]}"
    for g, w in zip(got, want):
        if not all(close(a, b) for a, b in zip(g, w)):
            return f"row {dict(zip(cols, g))} != {dict(zip(cols, w))}"
    return None


def main(argv):
    from plumbline.session import local_session

    root = argv[0]
    catalog.load()
    wanted = argv[1:]
    home = {n: f.__wrapped__.__module__.rsplit(".", 1)[-1] for n, f in catalog.QUERIES.items()}
    names = [n for n in catalog.QUERIES if not wanted or home[n] in wanted or any(n.startswith(w) for w in wanted)]
    spark, con = local_session(), connect(root)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            msg = compare(spark, con, root, n)
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        flag = "ok  " if msg is None else "FAIL"
        bad += msg is not None
        print(f"{flag} {time.time() - t0:6.2f}s {n}{'' if n in catalog.SQL else '  (rows only)'} {msg or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")


if __name__ == "__main__":
    main(sys.argv[1:])
