"""Runs registered queries against their SQL in DuckDB: python -m tests.compare [-d DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return float(v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return con


def differences(spark_df, con, sql: str) -> str:
    """'' if both give the same columns and rows."""
    got_cols = sorted(spark_df.columns)
    rel = con.sql(sql)
    want_cols = sorted(rel.columns)
    if got_cols != want_cols:
        return f"columns {got_cols} and {want_cols}"
    got = Counter(tuple(canon(r[c]) for c in got_cols) for r in (x.asDict(recursive=True) for x in spark_df.collect()))
    want = Counter(tuple(canon(v) for v in row) for row in rel.select(*(f'"{c}"' for c in want_cols)).fetchall())
    if got == want:
        return ""
    return f"rows {sum(got.values())} and {sum(want.values())}; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"


def main(args: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as e
    from seqloom.session import local_session

    where = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        where, args = args[1], args[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, sqls = duck(where), 0, e.oracle_sql()
    for name, f in e.queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            df = f(spark, where)
            said = differences(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
