"""Local correctness gate: run registered Spark queries and their DuckDB oracles, compare.

    python tools/oracle_check.py [--sf DIR] [--schemas] [name ...]

``--schemas`` refreshes ``tessera/plans/double_columns.json`` from the named
queries' Spark output schemas (used by both sides' float normalisation) before comparing.
Compares column names, row counts and an order-insensitive multiset of rows.
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tessera import session  # noqa: E402
from tessera.plans import registry  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return canon(v.item())
    except Exception:
        pass
    return str(v)


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT"}


def type_diffs(sdf, con, sql):
    """Columns whose Spark type and DuckDB type differ (scalar types only)."""
    st = {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, f.dataType.simpleString()) for f in sdf.schema.fields}
    rel = con.sql(sql)
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}


def rows_of(records, cols):
    return Counter(tuple(canon(r[c]) for c in cols) for r in records)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--schemas", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()

    spark = session.build("local[8]", conf={"spark.sql.shuffle.partitions": "8",
                                            "spark.sql.session.timeZone": "America/New_York"})
    registry.load_all()
    names = a.names or sorted(registry.QUERIES)

    if a.schemas:
        dbl = registry.double_columns()
        for n in names:
            df = registry.QUERIES[n](spark, a.sf)
            dbl[n] = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        dbl = {k: v for k, v in sorted(dbl.items()) if k in registry.QUERIES}
        with open(registry._DOUBLES_FILE, "w") as fh:
            json.dump(dbl, fh, indent=1, sort_keys=True)
        print(f"wrote {len(dbl)} schemas")

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")

    ok = bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = registry.run(n, spark, a.sf)
            scols = sdf.columns
            srecs = [r.asDict(recursive=True) for r in sdf.collect()]
            ts = time.time() - t0
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {str(e).splitlines()[0][:300]}")
            bad += 1
            continue
        if n not in registry.ORACLE:
            print(f"ROWS {n}: {len(srecs)} rows (no oracle) spark {ts:.1f}s")
            ok += 1
            continue
        try:
            t1 = time.time()
            cur = con.execute(registry.oracle_sql(n))
            dcols = [d[0] for d in cur.description]
            drecs = [dict(zip(dcols, r)) for r in cur.fetchall()]
            td = time.time() - t1
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {n}: columns differ spark-only={sorted(set(scols)-set(dcols))} duck-only={sorted(set(dcols)-set(scols))}")
            bad += 1
            continue
        cols = sorted(scols)
        td_ = type_diffs(sdf, con, registry.oracle_sql(n))
        if td_:
            print(f"FAIL {n}: column types differ {td_}")
            bad += 1
            continue
        a_, b_ = rows_of(srecs, cols), rows_of(drecs, cols)
        if a_ == b_:
            print(f"OK   {n}: {len(srecs)} rows spark {ts:.1f}s duck {td:.2f}s")
            ok += 1
        else:
            bad += 1
            only_s = list((a_ - b_).elements())[:3]
            only_d = list((b_ - a_).elements())[:3]
            print(f"FAIL {n}: rows spark={len(srecs)} duck={len(drecs)} cols={cols}")
            for r in only_s:
                print("   spark-only", r)
            for r in only_d:
                print("   duck-only ", r)
    print(f"== {ok} ok, {bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
