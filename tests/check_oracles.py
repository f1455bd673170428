"""Compare queries with their SQL counterparts: python tests/check_oracles.py [sf_dir] [names...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def cell(v):
        if isinstance(v, float) and v != v or v is None or v is pd.NaT:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "tolist"):
            return str(v.tolist())
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


def compare(spark, con, name, query, sql, sf_dir):
    start = time.time()
    got = query(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no oracle, {took:.1f}s"
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return True, f"{len(a)} rows, {took:.1f}s"
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return False, f"{len(a)} vs {len(b)} rows; only spark {only_a}; only sql {only_b}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = [n for n in sys.argv[2:]]
    skip = [n[1:] for n in names if n.startswith("~")]
    names = [n for n in names if not n.startswith("~")]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sqls = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if any(n in name for n in skip) or names and not any(n in name for n in names):
            continue
        try:
            ok, note = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, str(e)[:600]
            if "-v" in names:
                traceback.print_exc()
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
