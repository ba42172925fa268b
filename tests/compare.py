"""Runs queries beside their SQL on the test tables: python tests/compare.py [sf_dir] [name ...]"""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def connect(sf_dir):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        p = f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def differences(spark, c, f, sql, sf_dir):
    df = f(spark, sf_dir)
    mine = df.toPandas().astype(object)
    mine = mine.where(mine.notna(), None)
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(df.columns)
    a = sorted((tuple(plain(v) for v in r) for r in mine[order].itertuples(index=False)), key=repr)
    b = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in other), key=repr)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; {order}; {odd}"
    return ""


def session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    import __spark_entry__ as e

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, c, sql = session(), connect(d), e.oracle_sql()
    for n, f in e.queries().items():
        if len(sys.argv) > 2 and n not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            said = differences(spark, c, f, sql[n], d) if n in sql else f"no SQL, {f(spark, d).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{n:32} {time.time() - t:6.1f} s  {said or 'equal'}", flush=True)
