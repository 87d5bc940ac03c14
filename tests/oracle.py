"""Runs registered queries next to DuckDB and compares the rows.

    python tests/oracle.py [table directory] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    return f"{type(v).__name__} {v}"


def compare(df, con, sql):
    """None when equal, otherwise a description of the difference."""
    names = sorted(df.columns)
    ours = Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != names:
        return f"columns {names} vs {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(_cell(r[i]) for i in order) for r in result.fetchall())
    if ours == theirs:
        return None
    extra, lacking = ours - theirs, theirs - ours
    show = lambda c: [dict(zip(names, k)) for k in list(c)[:3]]
    return (f"{sum(ours.values())} vs {sum(theirs.values())} rows; only here ({sum(extra.values())}) {str(show(extra))[:700]};"
            f" only there ({sum(lacking.values())}) {str(show(lacking))[:700]}")


def main(sf_dir, names):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry_points
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry_points.queries(), entry_points.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__} {str(error)[:900]}"
        bad += problem is not None and not problem.startswith("no SQL")
        print(f"{name:32s} {time.time() - started:6.2f}s {problem or 'equal'}", flush=True)
    print("different:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", set(sys.argv[2:]))
