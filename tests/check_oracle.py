"""Compare registered queries with their SQL on DuckDB: ``python tests/check_oracle.py [name-part ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, list):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return repr(value)


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns))


def kinds(table: pa.Table) -> dict[str, str]:
    def kind(t):
        if pa.types.is_large_string(t) or pa.types.is_string(t):
            return "string"
        return str(t)
    return {f.name: kind(f.type) for f in table.schema}


def compare(spark_table: pa.Table, duck_table: pa.Table) -> str:
    a, b = kinds(spark_table), kinds(duck_table)
    if a != b:
        diff = {k: (a.get(k), b.get(k)) for k in set(a) | set(b) if a.get(k) != b.get(k)}
        return f"schema {diff}"
    left, right = rows_of(spark_table), rows_of(duck_table)
    if left == right:
        return ""
    only_l = [r for r in left if r not in set(right)][:3]
    only_r = [r for r in right if r not in set(left)][:3]
    return f"rows {len(left)} vs {len(right)}\n   spark: {only_l}\n   sql  : {only_r}"


def main(parts: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    import __spark_entry__ as entry
    from stackroom.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8",
                                         "spark.driver.memory": "12g", "spark.ui.enabled": "false",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            t0 = time.time()
            got = fn(spark, sf_dir).toArrow()
            t1 = time.time()
            if name not in sqls:
                print(f"rows {name:32s} n={got.num_rows} spark={t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(sqls[name]).to_arrow_table()
            t2 = time.time()
            problem = compare(got, want)
            print(f"{'BAD ' if problem else 'ok  '} {name:32s} n={got.num_rows} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s {problem}", flush=True)
            bad += bool(problem)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
    print(f"bad={bad}")
    spark.stop()
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        folder, args = args[0], args[1:]
    sys.exit(min(1, main(args, folder)))
