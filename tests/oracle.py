"""Run queries and their SQL twins side by side: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("", "null")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        return ("n", repr(float(v)))
    if isinstance(v, dt.datetime):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_cell(x) for x in v))
    return ("s", str(v))


def _family(t: str) -> str:
    t = t.lower()
    if t in ("string", "varchar"):
        return "text"
    if t in ("bigint", "int", "integer", "smallint", "tinyint"):
        return "int"
    return "float" if t in ("double", "float") else t.split("_")[0].split(" ")[0]


def compare(spark, con, sf_dir, fn, oracle) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in cols) for r in df.collect()]
    if oracle is None:
        return None if got else "no rows"
    res = con.execute(oracle)
    names = [c[0] for c in res.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    kinds = {c[0]: _family(str(c[1])) for c in res.description}
    want_types = {c: _family(t) for c, t in df.dtypes}
    at = [names.index(c) for c in cols]
    want = [tuple(_cell(r[i]) for i in at) for r in res.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got.sort(), want.sort()
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {cols}: {bad[0][0]} vs {bad[0][1]}"
    drift = {c: (want_types[c], kinds[c]) for c in cols if kinds[c] not in ("number", "nonetype", want_types[c]) and kinds[c] in ("int", "float", "text")}
    return f"types differ {drift}" if drift else None


def main() -> int:
    from accuracast.plans import load_all
    from accuracast.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = load_all()
    names = sys.argv[2:] or list(queries)
    spark, con, failed = build_session(8), connect(sf_dir), 0
    for name in [n for n in queries if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]:
        start = time.time()
        try:
            why = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as e:  # report and go on with the next query
            why = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {'' if name in oracles else '(rows only) '}{why or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main() > 0)
