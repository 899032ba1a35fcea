"""Compare a registered Spark query with its DuckDB oracle the way the driver does: same
column names, same row count, same multiset of rows (columns sorted by name, floats rounded)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in r))


_DUCK_TO_SPARK = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
                  "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint",
                  "HUGEINT": "hugeint", "DECIMAL": "decimal"}


def type_mismatches(sdf, res) -> list:
    """Columns whose Spark type and DuckDB type differ (after mapping names)."""
    st = dict(sdf.dtypes)
    out = []
    for d in res.description:
        dt = str(d[1]).split("(")[0].upper()
        want = _DUCK_TO_SPARK.get(dt, dt.lower())
        if st.get(d[0]) != want:
            out.append((d[0], st.get(d[0]), str(d[1])))
    return out


def compare(spark, name: str, sf_dir: str, con=None, verbose=True, check_types=True):
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    if sql is None:
        if verbose:
            print(f"{name}: rows-only {len(srows)} ({t1 - t0:.1f}s)")
        return True
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok = True
    msg = []
    if sorted(scols) != sorted(dcols):
        ok = False
        msg.append(f"cols spark={sorted(scols)} duck={sorted(dcols)}")
    if len(srows) != len(drows):
        ok = False
        msg.append(f"rows spark={len(srows)} duck={len(drows)}")
    if check_types:
        tm = type_mismatches(sdf, res)
        if tm:
            ok = False
            msg.append(f"types differ {tm}")
    if ok:
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a != b:
            ok = False
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            msg.append(f"values differ, e.g. {diffs}")
    if verbose:
        print(f"{name}: {'OK' if ok else 'FAIL'} rows={len(srows)} ({t1 - t0:.1f}s) {' '.join(msg)}")
    return ok


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pairmatch.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]", 8)
    import __spark_entry__ as E
    con = duck(sf)
    bad = []
    for n in names or list(E.queries()):
        try:
            if not compare(spark, n, sf, con):
                bad.append(n)
        except Exception as e:  # report and continue
            print(f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}")
            bad.append(n)
    print("FAILED:", bad)
