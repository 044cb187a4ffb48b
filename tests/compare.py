"""Run queries against their SQL in DuckDB and report exact differences.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()  # noqa: E501


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def compare(spark_df, con, sql: str) -> str | None:
    """None when the two results are identical, else what differs."""
    names = spark_df.columns
    mine = _rows(names, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    other_names = [d[0] for d in result.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    theirs = _rows(other_names, result.fetchall())
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} / {sorted(other_names)}"
    types = {n: (t, kinds[n]) for n, t in spark_df.dtypes if t != kinds[n]}
    if types:
        return f"types {types}"
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        return (
            f"rows {sum(mine.values())} / {sum(theirs.values())}, "
            f"only here {sum(extra.values())}: {sorted(extra)[:3]}, "
            f"only there {sum(missing.values())}: {sorted(missing)[:3]}"
        )
    return None if mine else "empty"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from contactscope.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(folder)
    wanted = sys.argv[2:] or list(queries())
    oracles, bad = oracle_sql(), 0
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None and not problem.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
