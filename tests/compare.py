"""python tests/compare.py SF NAME...: runs queries and their SQL side by side, as the driver does."""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v

    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main(sf, names):
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    d = f"/root/testdata/{sf}"
    for t in "region nation customer supplier part orders lineitem events documents embeddings knowledge_bases jobs files file_text index_log favorites recents split_limits mix_targets".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names or qs:
        t0 = time.time()
        try:
            df = qs[n](spark, d)
            got = rows(df.columns, df.collect())
            t1 = time.time()
            if n not in sql:
                print(f"{n}: {len(got)} rows, no SQL, {t1 - t0:.1f} s")
                continue
            rel = con.sql(sql[n])
            want = rows(rel.columns, rel.fetchall())
            same = sorted(df.columns) == sorted(rel.columns) and got == want
            bad += not same
            print(f"{n}: {len(got)} / {len(want)} rows, {'same' if same else 'DIFFERENT'}, {t1 - t0:.1f} s")
            if not same:
                print("   only Spark:", [x for x in got if x not in want][:3], sorted(df.columns), "\n   only SQL:", [x for x in want if x not in got][:3], sorted(rel.columns))
        except Exception as e:
            bad += 1
            print(f"{n}: ERROR {str(e)[:600]}")
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
