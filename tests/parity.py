"""Run queries in Spark and their SQL twins in DuckDB and compare all rows.

    python tests/parity.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def _kind(value) -> str:
    return type(value).__name__


def compare(spark, con, function, sql: str, folder: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    frame = function(spark, folder)
    names = sorted(frame.columns)
    ours = [tuple(_plain(row[n]) for n in names) for row in frame.collect()]
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != names:
        return [f"columns {names} vs {sorted(theirs_names)}"]
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]
    problems = []
    for i, name in enumerate(names):
        a = {_kind(row[i]) for row in ours if row[i] is not None}
        b = {_kind(row[i]) for row in theirs if row[i] is not None}
        if a != b:
            problems.append(f"type of {name}: {a} vs {b}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    left, right = Counter(ours), Counter(theirs)
    if left != right:
        problems.append(f"only Spark {list((left - right).elements())[:3]}")
        problems.append(f"only SQL {list((right - left).elements())[:3]}")
    if not ours:
        problems.append("no rows")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from chatterlens.session import build

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build(
        "parity", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    sqls = entry.oracle_sql()
    for name, function in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            problems = compare(spark, con, function, sqls[name], folder) if name in sqls else ["no SQL"]
        except Exception as failure:
            problems = [f"{type(failure).__name__}: {str(failure)[:600]}"]
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - began:.2f}s", flush=True)
        for problem in problems:
            print("     ", problem[:900], flush=True)
        bad += bool(problems)
    print(f"{bad} of {len(wanted) or len(entry.queries())} differ")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
