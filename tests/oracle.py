"""Holds registered queries against their SQL: python tests/oracle.py [SF_DIR] [NAME...]"""

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(float(v) + 0.0)
        return "" if v is None else str(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf):
    df = query(spark, sf)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.sql(sql)
    expected = rows_of(answer.columns, answer.fetchall())
    if found[0] != expected[0]:
        return f"{name}: columns {found[0]} and {expected[0]}"
    if len(found[1]) != len(expected[1]):
        return f"{name}: {len(found[1])} rows and {len(expected[1])}"
    wrong = [(a, b) for a, b in zip(found[1], expected[1], strict=True) if a != b]
    return f"{name}: {len(wrong)} of {len(found[1])} rows differ: {wrong[0]}" if wrong else None


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main(sf="/root/testdata/sf0.01", *names):
    from pyspark.sql import SparkSession

    from tickloom.plans import catalog

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in names or catalog.QUERIES:
        try:
            if name in catalog.ORACLE_SQL:
                print(compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf) or f"{name}: same", flush=True)
            else:
                print(f"{name}: {catalog.QUERIES[name](spark, sf).count()} rows", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: failed: {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
