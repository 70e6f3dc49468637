"""Compare registered queries with their SQL twins: python tests/check.py [sf] [name-prefix ...]"""
import math
import sys
import time
import traceback

sys.path.insert(0, "/root/repo")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, entry, sf_dir):
    df = entry.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if entry.oracle is None:
        return len(got), None
    cur = con.execute(entry.oracle)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        return len(got), f"{len(got)} vs {len(want)} rows\n   extra {sorted(g - w)[:3]}\n   lack  {sorted(w - g)[:3]}"
    return len(got), ""


def connect(sf_dir):
    import duckdb
    from corrobora.plans.views import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def session(cores=8):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    return s


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picks = sys.argv[2:]
    from corrobora.plans.catalog import load_all
    sf_dir = f"/root/testdata/sf{sf}"
    entries = load_all()
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name, e in entries.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t0 = time.time()
        try:
            n, err = compare(spark, con, e, sf_dir)
        except Exception as ex:
            n, err = -1, "ERR " + str(ex).split("JVM stacktrace")[0].split("== DataFrame")[0].split("\n\tat ")[0][:500]
            if "--tb" in sys.argv:
                traceback.print_exc()
        bad += bool(err)
        mark = "FAIL" if err else ("rows" if err is None else "ok")
        print(f"{mark:5} {name:32} {n:7} rows {time.time() - t0:6.1f}s {err or ''}", flush=True)
    print("failures:", bad)
