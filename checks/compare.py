"""Run every query and its SQL side by side: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from checks import oracle, queries
from pluvia.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def open_tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def difference(spark, con, sf: str, name: str, sql: str) -> str | None:
    """What differs between a query and its SQL; None if nothing does."""
    df = queries.registry()[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = con.sql(sql)
    types = dict(zip(result.columns, map(str, result.types)))
    if sorted(types) != columns:
        return f"columns {columns} / {sorted(types)}"
    for field in df.schema.fields:
        if SAME_TYPE.get(field.dataType.simpleString()) != types[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} / {types[field.name]}"
    want = Counter(result.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    if got != want:
        extra, lacking = got - want, want - got
        return (
            f"{sum(got.values())} / {sum(want.values())} rows, {sum(extra.values())} differ: "
            f"{sorted(extra, key=str)[:2]} / {sorted(lacking, key=str)[:2]}"
        )
    return None if got else "no rows"


def main(sf: str, names: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = open_tables(sf), 0
    sqls = oracle.statements()
    for name in names or queries.registry():
        start = time.time()
        try:
            if name in sqls:
                problem = difference(spark, con, sf, name, sqls[name])
            else:
                problem = None if queries.registry()[name](spark, sf).count() else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{time.time() - start:6.1f}s {name}: {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
