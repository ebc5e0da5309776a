"""Run registered queries beside their SQL and report every difference.

usage: python tests/check_oracles.py SF_DIR [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from corpuslens.session import build_session  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("PRAGMA disable_progress_bar")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def compare(df, con, sql):
    """None when equal, else what differs."""
    names = sorted(df.columns)
    mine = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr)
    result = con.execute(sql)
    given = [c[0] for c in result.description]
    if sorted(given) != names:
        return f"columns {names} != {sorted(given)}"
    order = [given.index(n) for n in names]
    theirs = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    if mine == theirs:
        return None
    left = [r for r in mine if r not in set(theirs)][:3] if len(mine) < 200000 else []
    right = [r for r in theirs if r not in set(mine)][:3] if len(mine) < 200000 else []
    return f"rows {len(mine)} vs {len(theirs)}\n   spark {names} {str(left)[:700]}\n   sql   {str(right)[:700]}"


def main():
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    oracles = contract.oracle_sql()
    con = connect(sf_dir)
    bad = []
    for name, run in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        took = time.time() - start
        print(f"{'ok ' if problem is None else 'BAD'} {name} {took:.1f}s{'' if name in oracles else ' (rows only)'}", flush=True)
        if problem:
            bad.append(name)
            print("   " + problem, flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
