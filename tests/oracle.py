"""Compare registered queries with their SQL on the same parquet tables.

    python tests/oracle.py /root/testdata/sf0.001 [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), "" if v is None else v) for v in row)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in res.fetchall()), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first differing {next(((g, w) for g, w in zip(got, want) if g != w), None)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{cols}: {g} != {w}"
    return None if got else "EMPTY"


def main(argv):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from tracewright.session import build_session
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                 "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, parts = argv[0], argv[1:]
    con, oracle, bad = connect(sf_dir), oracle_sql(), []
    for name, run in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in oracle:
                msg = compare(run(spark, sf_dir), con, oracle[name])
            else:
                n = len(run(spark, sf_dir).collect())
                msg = None if n else "EMPTY"
                name += f" (rows only: {n})"
        except Exception as e:
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if msg is None else 'FAIL'} {time.time() - t:6.2f}s {name} {msg or ''}", flush=True)
        if msg:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
