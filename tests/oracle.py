"""Compare registered queries with their SQL: python tests/oracle.py [name...]."""

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    import decimal

    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), sorted(names)


def same(df, rel):
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    cols = [c if isinstance(c, str) else c[0] for c in rel.columns]
    want, expected = rows(cols, rel.fetchall())
    if names != expected:
        return f"columns {names} and {expected}"
    if got != want:
        odd = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
        return f"{len(got)} and {len(want)} rows; {len(odd)} differ, first {odd[:2]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tessera.runtime import session

    spark = session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    c, bad = duck(sf), 0
    for name, q in entry.queries().items():
        if len(sys.argv) > 1 and name not in sys.argv[1:] or len(sys.argv) == 1 and (name[:2] == "op" or name == "pipeline"):
            continue
        t = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            df = q(spark, sf)
            said = same(df, c.sql(sql)) if sql else f"rows only: {df.count()}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print("differences:", bad)
    sys.exit(bool(bad))
