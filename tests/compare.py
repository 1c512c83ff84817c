"""Run registered queries on Spark and their SQL on DuckDB and compare the row multisets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 9)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the difference."""
    rel = con.execute(sql)
    dcols, drows = rows_of([d[0] for d in rel.description], rel.fetchall())
    scols, srows = rows_of(df.columns, df.collect())
    if dcols != scols:
        return f"columns {scols} != {dcols}"
    if srows != drows:
        extra, missing = srows - drows, drows - srows
        return (
            f"rows spark={sum(srows.values())} duck={sum(drows.values())} only-spark={sum(extra.values())} "
            f"only-duck={sum(missing.values())}\n  {scols}\n  S {list(extra)[:3]}\n  D {list(missing)[:3]}"
        )
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from specgate.session import get_spark

    sf = "/root/testdata/sf" + __import__("os").environ.get("SF", "0.01")
    fam = [a[1:] for a in sys.argv[1:] if a.startswith("@")]
    wanted = [a for a in sys.argv[1:] if not a.startswith("@")]
    for f in fam:
        wanted += list(__import__(f"specgate.plans.{f}", fromlist=["QUERIES"]).QUERIES)
    spark, con = get_spark(), duck(sf)
    bad = 0
    for name, q in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"rows-only {name}: {len(q(spark, sf).collect())} rows {time.time() - t:.1f}s", flush=True)
                continue
            df = q(spark, sf)
            diff = compare(df, con, sql)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        bad += diff is not None
        n = "" if diff else f" ({con.execute(f'SELECT count(*) FROM ({sql})').fetchall()[0][0]} rows)"
        print(f"{'DIFF' if diff else 'ok  '} {name} {time.time() - t:.1f}s{n}" + (f"\n  {diff}" if diff else ""), flush=True)
    print("differences:", bad)
