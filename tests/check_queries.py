"""Compare registered queries with their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else round(float(value), 6) + 0.0
    return str(value)


def canonical(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[tuple], list[str], list[str]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    out = con.sql(sql)
    return out.fetchall(), list(out.columns), [str(t) for t in out.types]


def compare(spark, sf_dir: str, name: str) -> str:
    import __spark_entry__ as entry

    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"ROWS  {name}: {len(rows)} rows, {took:.1f}s"
    expected, columns, types = oracle_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(columns):
        return f"BAD   {name}: columns {sorted(df.columns)} against {sorted(columns)}"
    mine, theirs = canonical(rows, df.columns), canonical(expected, columns)
    kinds = dict(zip(columns, types))
    notes = " ".join(f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes)
    if mine != theirs:
        wrong = [p for p in zip(mine, theirs) if p[0] != p[1]][:2]
        return f"BAD   {name}: {len(mine)} rows against {len(theirs)}; {wrong}"
    return f"OK    {name}: {len(rows)} rows, {took:.1f}s {notes}"


def main() -> None:
    from cadenza.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check",
        "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
         "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    for name in sys.argv[2:] or entry.queries():
        try:
            print(compare(spark, sf_dir, name), flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
