"""Runs catalog queries against their DuckDB twins and reports every difference."""

import math
import os
import sys
import time
import traceback

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet{'/*' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is None and b is None
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-9 * max(1.0, abs(a))
    return a == b


def difference(spark, con, sf_dir, query, sql):
    """None if all rows agree."""
    df = query(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} {rel.columns}"
    order = [rel.columns.index(c) for c in df.columns]
    theirs = [tuple(r[i] for i in order) for r in rel.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    key = lambda r: tuple((x is None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in r)
    bad = [(a, b) for a, b in zip(sorted(mine, key=key), sorted(theirs, key=key), strict=True) if not all(map(same, a, b))]
    return f"{len(bad)} of {len(mine)} rows: {bad[:2]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
    from driftwood.plans import catalog

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1]
    con, names = duck(sf), sys.argv[2:]
    q, o = catalog.queries(), catalog.oracle_sql()
    for name in q:
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            said = difference(spark, con, sf, q[name], o[name]) if name in o else f"no twin; {q[name](spark, sf).count()} rows"
        except Exception as e:
            said = "ERROR " + " ".join(str(e).split())[:700] if not isinstance(e, NameError) else traceback.format_exc()
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
