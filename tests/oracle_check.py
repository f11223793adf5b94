"""Run registered queries beside their oracle SQL and report differences: `python tests/oracle_check.py [sf] [keys...]`."""
from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

from hiresift.plans import registry  # noqa: E402
from hiresift.plans.tables import TABLES  # noqa: E402


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, key, query, oracle):
    start = time.time()
    df = query(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if oracle is None:
        return True, f"rows={len(got[1])} spark={took:.1f}s (no oracle)"
    cur = con.execute(oracle)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return True, f"rows={len(got[1])} spark={took:.1f}s"
    a, b = set(got[1]), set(want[1])
    return False, (f"cols {got[0]} vs {want[0]} rows {len(got[1])} vs {len(want[1])} spark={took:.1f}s\n"
                   f"    only spark {len(a - b)}: {str(sorted(a - b)[:2])[:900]}\n    only duck {len(b - a)}: {str(sorted(b - a)[:2])[:900]}")


def main(argv):
    from hiresift.session import local_session

    sf = argv[0] if argv else "0.01"
    spark, sf_dir = local_session(8), f"/root/testdata/sf{sf}"
    con, queries, oracles = connect(sf_dir), registry.queries(), registry.oracles()
    wanted = argv[1:]
    keys = [k for k in queries if not wanted or k in wanted or any(w.endswith("*") and k in area_keys(w[:-1]) for w in wanted)]
    bad = 0
    for key in keys:
        try:
            ok, note = compare(spark, con, sf_dir, key, queries[key], oracles.get(key))
        except Exception as e:  # noqa: BLE001 - a report, not a library
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + key, note, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} agree")
    return bad


def area_keys(area):
    import importlib
    return importlib.import_module(f"hiresift.plans.{area}").QUERIES


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
