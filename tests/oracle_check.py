"""Run ``queries()`` against ``oracle_sql()`` on one data directory.

Usage: python tests/oracle_check.py [data_dir] [name ...]

Per query: row count, column names, column types (Spark vs DuckDB families)
and an order-insensitive comparison of all values.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_SPARK_FAMILY = {
    "bigint": "int64",
    "int": "int32",
    "double": "float64",
    "string": "str",
    "boolean": "bool",
}
_DUCK_FAMILY = {
    "BIGINT": "int64",
    "INTEGER": "int32",
    "DOUBLE": "float64",
    "VARCHAR": "str",
    "BOOLEAN": "bool",
}


def duck(data_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(data_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("num", repr(float(v)))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("num", repr(float(v)))
    return ("str", str(v))


def compare(spark, data_dir: str, names=None, verbose=True):
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    con = duck(data_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, data_dir)
            s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
            s_rows = [tuple(r) for r in sdf.collect()]
            s_cols = list(sdf.columns)
        except Exception as ex:  # noqa: BLE001
            results[name] = ("spark-error", repr(ex)[:400])
            if verbose:
                print(f"{name:24s} SPARK ERROR {repr(ex)[:400]}")
            continue
        el = time.time() - t0
        if name not in sql:
            results[name] = ("rows-only", len(s_rows))
            if verbose:
                print(f"{name:24s} rows-only rows={len(s_rows)} {el:.1f}s")
            continue
        try:
            rel = con.sql(sql[name])
            d_cols = list(rel.columns)
            d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            d_rows = rel.fetchall()
        except Exception as ex:  # noqa: BLE001
            results[name] = ("sql-error", repr(ex)[:400])
            if verbose:
                print(f"{name:24s} SQL ERROR {repr(ex)[:400]}")
            continue
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        else:
            for c in s_cols:
                a = _SPARK_FAMILY.get(s_types[c], s_types[c])
                b = _DUCK_FAMILY.get(d_types[c], d_types[c])
                if a != b:
                    problems.append(f"type {c}: {s_types[c]} vs {d_types[c]}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows {len(s_rows)} vs {len(d_rows)}")
        if not problems:
            order = sorted(s_cols)
            si = [s_cols.index(c) for c in order]
            di = [d_cols.index(c) for c in order]
            sa = sorted(tuple(_norm(r[i]) for i in si) for r in s_rows)
            da = sorted(tuple(_norm(r[i]) for i in di) for r in d_rows)
            if sa != da:
                diff = [(x, y) for x, y in zip(sa, da) if x != y][:3]
                problems.append(f"values differ, e.g. {diff}")
        status = "ok" if not problems else "MISMATCH"
        results[name] = (status, problems)
        if verbose:
            print(f"{name:24s} {status} rows={len(s_rows)} {el:.1f}s {'; '.join(problems)[:600]}")
    return results


def main():
    from pyspark.sql import SparkSession

    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, data_dir, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    print(f"\n{len(res) - len(bad)}/{len(res)} fine; problems: {sorted(bad)}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
