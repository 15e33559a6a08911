"""Run queries next to their oracle SQL and compare the rows without regard to order.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.catalog import QUERIES
from checks.oracle import ORACLE
from checks.views import DRIVER_TABLES
from tidewatch.session import build_session


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _sort_key(row):
    return tuple((value is None, str(value)) for value in row)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(_value(row[i]) for i in order) for row in result.fetchall()]
    return sorted(names), sorted(rows, key=_sort_key)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(_value(value) for value in row) for row in df.select(*names).collect()]
    return names, sorted(rows, key=_sort_key)


def difference(spark, sf_dir: str, name: str) -> str | None:
    """None when query and oracle agree, else what differs first."""
    got_names, got = spark_rows(QUERIES[name](spark, sf_dir))
    want_names, want = oracle_rows(sf_dir, ORACLE[name])
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    if len(got) != len(want):
        extra = [row for row in got if row not in set(want)][:2]
        missing = [row for row in want if row not in set(got)][:2]
        return f"{len(got)} rows vs {len(want)}; extra {extra}; missing {missing}"
    for a, b in zip(got, want):
        if a != b:
            cells = [(n, x, y) for n, x, y in zip(got_names, a, b) if x != y]
            return f"first difference {cells[:4]}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=8, spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    failures = 0
    for name in sys.argv[2:] or list(QUERIES):
        start = time.time()
        try:
            problem = difference(spark, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = str(error)[:500].replace("\n", " ")
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
