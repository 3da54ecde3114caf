"""Compare registered queries with their SQL in DuckDB: python tests/check.py [sf] [names…]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TIMES: list[tuple[float, float]] = []


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) if isinstance(v, float) else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    got_cols = df.columns
    t0 = time.time()
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    t1 = time.time()
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = rows_of(want_cols, res.fetchall())
    TIMES.append((t1 - t0, time.time() - t1))
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if got == want:
        return ""
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"


def main() -> None:
    import __spark_entry__ as entry
    from tributary.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, checks = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in checks:
                diff = compare(df, con, checks[name])
            else:
                diff = "" if df.count() else "no rows"
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(diff)
        took = time.time() - t0
        sql_s = TIMES.pop()[1] if TIMES else 0.0
        print(f"{'FAIL' if diff else 'ok  '} {name} spark {took - sql_s:.2f}s sql {sql_s:.2f}s {'' if name in checks else '(rows)'} {diff}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
