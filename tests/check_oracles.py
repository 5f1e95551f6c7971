"""Run every query next to its SQL and compare names, kinds and rows.

    python tests/check_oracles.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from lotwise.session import get_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, db, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = contract.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return True, f"{name:24s} rows only  {len(got):7d} rows {spent:6.2f}s"
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"{name:24s} columns {sorted(df.columns)} against {sorted(names)}"
    left, right = rows_of(df.columns, got), rows_of(names, expected)
    kinds = [({type(v) for v in c if v is not None}) for c in zip(*left)]
    others = [({type(v) for v in c if v is not None}) for c in zip(*right)]
    if len(left) != len(right):
        return False, f"{name:24s} {len(left)} rows against {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return False, f"{name:24s} {len(wrong)} of {len(left)} rows differ, as {wrong[0]}"
    if kinds != others:
        return False, f"{name:24s} types {kinds} against {others}"
    return True, f"{name:24s} equal      {len(got):7d} rows {spent:6.2f}s"


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(contract.queries())
    spark = get_session("check", cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            good, line = compare(spark, db, sf_dir, name)
        except Exception as error:  # one failing query should not hide the others
            good, line = False, f"{name:24s} {type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "BAD ", line, flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
