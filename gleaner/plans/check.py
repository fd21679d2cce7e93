"""Run registered queries against their SQL on DuckDB and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, datetime.date):
        return str(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_cell(r[i]) for i in order)) for r in rows)


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> dict:
    out = {"name": name}
    t = time.time()
    df = fn(spark, sf)
    got = df.collect()
    out["spark_sec"], out["rows"] = round(time.time() - t, 2), len(got)
    if sql is None:
        out["ok"] = True
        return out
    t = time.time()
    rel = con.sql(sql)
    want, cols = rel.fetchall(), rel.columns
    out["sql_sec"] = round(time.time() - t, 2)
    if sorted(cols) != sorted(df.columns):
        return {**out, "ok": False, "why": f"columns {sorted(df.columns)} / {sorted(cols)}"}
    kinds = dict(zip(cols, map(str, rel.types)))
    odd = [c for c, k in kinds.items() if k in ("HUGEINT", "INTEGER") or k.startswith("DECIMAL")]
    ints = [c for c, k in df.dtypes if k in ("int", "smallint") or k.startswith("decimal")]
    a, b = _rows(df.columns, got), _rows(cols, want)
    out["ok"] = a == b
    if odd or ints:
        out["types"] = f"sql {odd} spark {ints}"
    if a != b:
        sa, sb = set(a), set(b)
        out["why"] = f"{len(a)}/{len(b)} rows; only spark {sorted(sa - sb)[:2]}; only sql {sorted(sb - sa)[:2]}"[:1500]
    return out


def main(names: list[str], sf: str = "/root/testdata/sf0.01") -> int:
    from ..session import local_session
    from .catalog import ORACLES, QUERIES

    spark, con = local_session(8), connect(sf)
    bad = 0
    for name in names or QUERIES:
        try:
            r = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:700]}"}
        bad += not r["ok"]
        print(("ok   " if r["ok"] else "FAIL "), r, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = next((a[3:] for a in args if a.startswith("sf=")), "/root/testdata/sf0.01")
    sys.exit(1 if main([a for a in args if not a.startswith("sf=")], sf) else 0)
