"""Run registered queries on Spark and their check SQL on DuckDB and compare the rows.

usage: python tools/check.py [--sf 0.01] [name-or-module-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from barline.plans import load
from barline.plans.adapters import BASE
from barline.session import local_session


def canon(table) -> tuple[list[str], list[tuple]]:
    cols = sorted(table.column_names)
    rows = list(zip(*[table.column(c).to_pylist() for c in cols])) if cols else []
    return cols, sorted(rows, key=repr)


def close(a, b) -> bool:
    return repr(a) == repr(b)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    sf = f"/root/testdata/sf{args.sf}"
    todo = [q for n, q in load().items()
            if not args.names or any(n.startswith(a) or q.run.__qualname__ == a for a in args.names)]
    spark = local_session(int(os.environ.get("CHECK_CPUS", "8")))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for q in todo:
        try:
            t0 = time.time()
            df = q.run(spark, sf)
            if args.explain:
                df.explain("formatted")
            got = df.toArrow()
            t1 = time.time()
        except Exception as exc:  # report and go on with the next query
            print(f"FAIL {q.name}: spark {str(exc)[:1500]}")
            bad += 1
            continue
        if q.sql is None:
            print(f"rows {q.name}: {got.num_rows} rows {t1 - t0:.2f}s")
            continue
        try:
            want = con.execute(q.sql).to_arrow_table()
        except Exception as exc:
            print(f"FAIL {q.name}: duckdb {str(exc)[:1500]}")
            bad += 1
            continue
        gc, gr = canon(got)
        wc, wr = canon(want)
        types = {c: (str(got.schema.field(c).type), str(want.schema.field(c).type)) for c in gc if c in wc}
        odd = {c: v for c, v in types.items() if v[0].replace("large_", "") != v[1].replace("large_", "")
               and "timestamp" not in v[0] and "list" not in v[0] and "map" not in v[0] and "struct" not in v[0]}
        if gc != wc:
            print(f"FAIL {q.name}: columns {gc} != {wc}")
            bad += 1
        elif len(gr) != len(wr) or any(not close(a, b) for a, b in zip(gr, wr)):
            diff = [(a, b) for a, b in zip(gr, wr) if not close(a, b)]
            print(f"FAIL {q.name}: rows {len(gr)} vs {len(wr)}, {len(diff)} differ; cols {gc}; first {diff[:2]} types {odd}")
            bad += 1
        else:
            print(f"ok   {q.name}: {len(gr)} rows spark {t1 - t0:.2f}s duck {time.time() - t1:.2f}s" + (f" TYPES {odd}" if odd else ""))
    print(f"{len(todo)} queries, {bad} bad")


if __name__ == "__main__":
    main()
