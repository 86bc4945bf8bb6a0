"""Runs queries and their SQL side by side: python tests/oracle.py SF_DIR [NAME...]."""

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x):
    if x is None:
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, (int, float)) or x.__class__.__name__ == "Decimal":
        x = float(x)
        return (2, "nan" if math.isnan(x) else f"{x + 0.0:.9g}")
    return (3, str(x))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(df, con, sql):
    """'' if the rows are the same, else what differs."""
    got_columns, got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_columns, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} {want_columns}"
    if got != want:
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"rows {len(got)} {len(want)}; only here {len(extra)} {extra[:2]}; only in SQL {len(missing)} {missing[:2]}"
    return "" if got else "no rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    con, sql = connect(sf), e.oracle_sql()
    for name, f in e.queries().items():
        if names and name not in names or not names and (name.startswith("op") and name[2].isdigit() or name == "pipeline"):
            continue
        t = time.time()
        try:
            said = compare(f(spark, sf), con, sql[name]) if name in sql else f"no SQL, {f(spark, sf).count()} rows"
        except Exception:
            said = "ERROR " + " ".join(traceback.format_exc().split())[-700:]
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
