"""Runs the check queries in Spark and their SQL in DuckDB and compares them.

    python -m checks.compare SF_DIR [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(dtype: str) -> str:
    known = {"bigint": "int", "BIGINT": "int", "string": "text", "VARCHAR": "text",
             "int": "int32", "INTEGER": "int32", "double": "float", "DOUBLE": "float", "boolean": "bool", "BOOLEAN": "bool"}
    return known.get(dtype, dtype)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both give the same columns, types and bag of rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*names).collect())
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(types) != names:
        return f"columns {names} != {sorted(types)}"
    mine = dict(df.dtypes)
    odd = [f"{n}: {mine[n]} / {types[n]}" for n in names if kind(mine[n]) != kind(types[n])]
    if odd:
        return "types " + ", ".join(odd)
    want = Counter(rel.project(", ".join(f'"{n}"' for n in names)).fetchall())
    if got != want:
        extra, missing = list((got - want).items()), list((want - got).items())
        return (f"rows {sum(got.values())} / {sum(want.values())}, only in Spark {len(extra)}: "
                f"{str(extra[:2])[:600]}, only in SQL {len(missing)}: {str(missing[:2])[:600]}")
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLE:
                found = difference(spark, con, QUERIES[name], ORACLE[name], sf_dir)
            else:
                found = None if QUERIES[name](spark, sf_dir).count() >= 0 else "no rows"
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
