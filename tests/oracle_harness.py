"""Compare a Spark DataFrame with a DuckDB query: rows, columns, value hash.

Used by the tests and by ``python -m tests.oracle_harness [names...]``.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

from rtq.sources.fixtures import TABLES


def duck_connect(sf_dir: str):
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
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return cols, lines, h


def compare(spark_df, con, sql: str, show: int = 5):
    t0 = time.time()
    srows = [tuple(r) for r in spark_df.collect()]
    scols = spark_df.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    sc, sl, sh = digest(scols, srows)
    dc, dl, dh = digest(dcols, drows)
    ok = sc == dc and sh == dh
    info = {"ok": ok, "spark_rows": len(srows), "duck_rows": len(drows), "spark_cols": sc, "duck_cols": dc,
            "spark_sec": round(t1 - t0, 2), "duck_sec": round(t2 - t1, 2)}
    if not ok:
        s_only = sorted(set(sl) - set(dl))[:show]
        d_only = sorted(set(dl) - set(sl))[:show]
        info["spark_only"] = s_only
        info["duck_only"] = d_only
    return info


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from rtq.session import get_session

    sf_dir = "/root/testdata/sf0.01"
    spark = get_session()
    con = duck_connect(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    names = argv or list(qs)
    bad = 0
    for n in names:
        if n not in os_:
            t0 = time.time()
            try:
                c = qs[n](spark, sf_dir).count()
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"{n:32s} ERROR {type(e).__name__}: {str(e)[:300]}", flush=True)
                continue
            print(f"{n:32s} ROWS-ONLY rows={c} {time.time()-t0:.1f}s", flush=True)
            continue
        try:
            info = compare(qs[n](spark, sf_dir), con, os_[n])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{n:32s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        status = "OK " if info["ok"] else "BAD"
        bad += 0 if info["ok"] else 1
        print(f"{n:32s} {status} rows={info['spark_rows']}/{info['duck_rows']} "
              f"t={info['spark_sec']}/{info['duck_sec']}", flush=True)
        if not info["ok"]:
            print("   cols", info["spark_cols"], info["duck_cols"])
            for r in info.get("spark_only", []):
                print("   S:", r[:300])
            for r in info.get("duck_only", []):
                print("   D:", r[:300])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
